"""Nested CV documents: schema and the fields read from them, all within the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocatio import presets
from vocatio.functions.dates import months, parse_date, years
from vocatio.functions.render import education_summary
from vocatio.functions.rules import clean

_NAMES = T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))

CV_SCHEMA = T.StructType(
    [
        T.StructField(
            "experience",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("company", T.StringType()),
                        T.StructField("title", T.StringType()),
                        T.StructField("level", T.StringType()),
                        T.StructField(
                            "dates",
                            T.StructType([T.StructField("start", T.StringType()), T.StructField("end", T.StringType())]),
                        ),
                        T.StructField(
                            "technical_environment",
                            T.StructType([T.StructField("technologies", T.ArrayType(T.StringType()))]),
                        ),
                    ]
                )
            ),
        ),
        T.StructField(
            "skills",
            T.StructType(
                [T.StructField("technical", T.StructType([T.StructField(g, _NAMES) for g in presets.SKILL_GROUPS]))]
            ),
        ),
        T.StructField(
            "education",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "degree",
                            T.StructType([T.StructField("level", T.StringType()), T.StructField("field", T.StringType())]),
                        ),
                        T.StructField("institution", T.StructType([T.StructField("name", T.StringType())])),
                    ]
                )
            ),
        ),
    ]
)


def _strings(value: Column) -> Column:
    return F.coalesce(value, F.array().cast("array<string>"))


def total_years(experience: Column, as_of: Column) -> Column:
    """Years over all periods of a CV; overlapping periods count twice."""
    spans = F.transform(
        experience, lambda e: months(parse_date(e["dates"]["start"]), parse_date(e["dates"]["end"], as_of))
    )
    zero = F.lit(0).cast("decimal(38,8)")
    total = F.aggregate(
        spans, zero, lambda acc, m: (acc + F.coalesce(m, F.lit(0).cast("decimal(20,8)"))).cast("decimal(38,8)")
    )
    return years(total)


def skill_names(cv: Column) -> Column:
    """Distinct skills over all groups and technologies, sorted; null if there are none.

    The names are gathered inside the row, so no shuffle is needed.
    """
    groups = [_strings(cv["skills"]["technical"][g]["name"]) for g in presets.SKILL_GROUPS]
    used = F.filter(cv["experience"]["technical_environment"]["technologies"], lambda t: t.isNotNull())
    unknown = F.array(F.lit(None).cast("string"), *[F.lit(p) for p in presets.PLACEHOLDERS])
    names = F.array_except(F.concat(*groups, _strings(F.flatten(used))), unknown)
    return F.when(F.size(names) > 0, F.array_sort(names))


def education(cv: Column) -> Column:
    first = F.get(cv["education"], 0)
    return education_summary(
        clean(first["degree"]["level"]), clean(first["degree"]["field"]), clean(first["institution"]["name"])
    )
