"""Dates of experience periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column, as_of: Column | None = None) -> Column:
    """Full dates and year-month dates; placeholders and other texts give null.

    The pattern is told from the text's shape: trying one format after the other would raise and
    catch an exception for every date in the second one. "Present" is ``as_of`` where that is given.
    """
    dated = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date")).when(
        text.rlike(r"^\d{4}-\d{1,2}$"), F.concat(text, F.lit("-01")).try_cast("date")
    )
    return dated if as_of is None else F.when(text == "Present", as_of).otherwise(dated)


def months(start: Column, end: Column) -> Column:
    """Months between two dates as an exact decimal; null if unknown or negative.

    Decimals make the sum independent of the order in which Spark adds the rows.
    """
    between = F.months_between(end, start)
    return F.when(between >= 0, between.cast("decimal(20,8)"))


def years(total_months: Column) -> Column:
    """Years to one decimal; null counts as none."""
    return F.round(F.coalesce(total_months.cast("double") / 12, F.lit(0.0)), 1)
