"""Postings of several sources brought to one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocatio import presets
from vocatio.sources.files import read_csv


def source_schema(source: str) -> T.StructType:
    """The columns a source's CSV file is expected to have, all text."""
    return T.StructType([T.StructField(c, T.StringType()) for c in presets.SOURCE_COLUMNS[source].values()])


def unified(rows: DataFrame, source: str, id_column: str | None = None, nan_as_null: bool = True) -> DataFrame:
    """Rows of one source under the unified names; absent fields are ''.

    Without an id column each row gets a random id, as for rows that never had one.
    """
    mapping = presets.SOURCE_COLUMNS[source]

    def field(name: str):
        origin = mapping.get(name)
        if origin is None or origin not in rows.columns:
            return F.lit("").alias(name)
        value = F.col(f"`{origin}`").cast("string")
        if nan_as_null:
            value = F.when(value != "nan", value)
        return F.coalesce(value, F.lit("")).alias(name)

    identity = F.col(id_column).cast("string") if id_column else F.uuid()
    fields = [field(c) for c in presets.UNIFIED_POSTING_COLUMNS if c not in ("id", "source")]
    return rows.select(identity.alias("id"), F.lit(source).alias("source"), *fields)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union by name of disjoint sources."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_source(
    spark: SparkSession, source: str, path: str, max_rows: int | None = None, multi_line: bool = False
) -> DataFrame:
    """A source's CSV file; ``max_rows`` is the operator's own row limit."""
    return read_csv(spark, path, source_schema(source), max_rows, multi_line)
