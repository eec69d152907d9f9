"""What the operators of this subpackage share: input tables, written steps, Arrow batches, row numbers and running sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocatio.session import written

# Bytes of one Arrow batch, so that a batch of long texts stays small.
BATCH_BYTES = 8 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches bounded in bytes; the rows of a batch stay at the session's bound."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(function, schema)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch, nulls as empty texts."""
    return [t or "" for t in batch.column(name).to_pylist()]


def numbered(df: DataFrame, keys: list[str], weights: dict[str, Column] | None = None) -> DataFrame:
    """Give the rows of ``df`` gapless numbers from 0 in the order of ``keys`` (nulls first), without a global sort.

    Equal rows are counted before the shuffle, come as one row of the result with ``copies``, and take as many numbers
    as they have copies. The different ones are dealt to ranges of ``keys``; only the sums of each range, of which there
    are as many as shuffle partitions, meet in one task. A number depends on the rows alone, not on the ranges.
    With ``weights`` each named weight has numbers of its own, as if a row stood for that many; else ``row_number``.
    The result holds ``keys``, ``copies`` and for each weight its first number as a column of the weight's name.
    """
    weights = weights or {"row_number": F.lit(1)}
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col(k).asc_nulls_first() for k in keys]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt.withColumns({f"_w_{w}": c.cast("long") * F.col("copies") for w, c in weights.items()}), "numbering")
    sums = dealt.groupBy("_range").agg(*(F.sum(f"_w_{w}").alias(f"_w_{w}") for w in weights))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", *(F.coalesce(F.sum(f"_w_{w}").over(before), F.lit(0)).alias(f"_s_{w}") for w in weights))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = dealt.withColumns({w: F.coalesce(F.sum(f"_w_{w}").over(inside), F.lit(0)) for w in weights})
    joined = running.join(F.broadcast(starts), "_range")
    return joined.select(*keys, "copies", *((F.col(w) + F.col(f"_s_{w}")).alias(w) for w in weights))


class Remembered(dict):
    """``function`` of a key, kept for at most twice ``limit`` keys: those used since the last full set stay."""

    def __init__(self, function: Callable, limit: int = 300_000):
        super().__init__()
        self.function, self.limit, self.older = function, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        self[key] = found = self.function(key) if found is None else found
        return found


def among_lowest(hashed: str, limit: int, n: int) -> Column:
    """A condition that some 8 times ``limit`` of ``n`` different 64-bit hashes meet, the smallest ones; all if there are fewer.

    It stands before a sort with that limit, so that few rows, not ``limit`` of each partition, meet in the task that sorts.
    """
    share = 8 * limit / max(1, n)
    return F.col(hashed) < -(1 << 63) + int(share * (1 << 64)) if share < 1 else F.lit(True)


def laid(df: DataFrame, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` sorted by ``order`` (nulls first) over ranges, written with ``_at``, a number that rises with the order.

    ``keep`` names the columns that stay; the others only sort. A key with a third of all rows fills many ranges if the
    order tells its rows apart. The number of the range stands in the upper bits of ``_at``.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in order]
    dealt = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    return written(dealt.select(*(keep or df.columns), F.monotonically_increasing_id().alias("_at")), "laid")


def running(rows: DataFrame, group: list[str], sums: dict[str, Column], ahead: dict[str, str] | None = None) -> DataFrame:
    """Running sums (this row included) within each group of ``laid`` rows, whose order began with the columns of ``group``.

    A group may lie in many ranges: each range takes over what the ranges before it have summed of its first group, from
    a table of one row for each range. ``ahead`` names new columns after the column whose value in the group's next row
    they take (null in its last row).
    """
    ahead = ahead or {}
    key = F.struct(F.lit(0).alias("_"), *group)
    ranged = rows.withColumn("_range", F.shiftright("_at", 33))
    each = ranged.groupBy("_range", *group).agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    tail = each.groupBy("_range").agg(F.max(F.struct(key.alias("key"), *(f"_t_{n}" for n in sums))).alias("tail"))
    first = F.min(F.struct("_at", key.alias("key"), *(F.col(v).alias(f"_v_{n}") for n, v in ahead.items()))).alias("first")
    edges = tail.join(ranged.groupBy("_range").agg(first), "_range")
    same, whole = Window.partitionBy("tail.key").orderBy("_range"), Window.orderBy("_range")
    so_far = F.struct(F.col("tail.key").alias("key"), *(F.sum(f"tail._t_{n}").over(same).alias(n) for n in sums))
    edges = edges.select("_range", "first", so_far.alias("so_far"))
    edges = edges.select("_range", F.lag("so_far").over(whole).alias("_before"), F.lead("first").over(whole).alias("_after"))
    inside = Window.partitionBy("_range", *group).orderBy("_at")
    until = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {n: F.sum(c).over(until) for n, c in sums.items()} | {n: F.lead(v).over(inside) for n, v in ahead.items()}
    joined = ranged.withColumns(new).join(F.broadcast(edges), "_range", "left")
    before, after = F.col("_before.key").eqNullSafe(key), F.col("_after.key").eqNullSafe(key)
    last = F.when(F.col("_after").isNotNull() & after, F.lit(True)).otherwise(False)
    out = {n: F.col(n) + F.when(F.col("_before").isNotNull() & before, F.col(f"_before.{n}")).otherwise(0) for n in sums}
    out |= {n: F.coalesce(F.col(n), F.when(last, F.col(f"_after._v_{n}"))) for n in ahead}
    return joined.select(*rows.columns, *(c.alias(n) for n, c in out.items()))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
