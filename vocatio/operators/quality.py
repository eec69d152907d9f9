"""Counts, shares and checks; every report is one pass over its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocatio.functions import vectors
from vocatio.functions.text import word_count
from vocatio.session import written


def group_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count"))


def group_share(df: DataFrame, key: str, digits: int = 1) -> DataFrame:
    """Rows per group and their share of all rows in percent."""
    counted = group_counts(df, key)
    total = counted.agg(F.sum("count").alias("t")).scalar()
    return counted.withColumn("percentage", F.round(F.col("count") * 100.0 / total, digits))


def known_group_counts(df: DataFrame, key: str, unknown: tuple[str, ...] = ("", "nan")) -> DataFrame:
    """Rows per group without null and the values that stand for it."""
    return group_counts(df.filter(F.col(key).isNotNull() & ~F.col(key).isin(*unknown)), key)


def coverage(df: DataFrame, present: Column, digits: int = 1) -> DataFrame:
    counted = df.agg(F.count("*").alias("total"), F.count_if(present).alias("with_value"))
    return counted.select(
        "total",
        "with_value",
        (F.col("total") - F.col("with_value")).alias("without_value"),
        F.when(F.col("total") > 0, F.round(F.col("with_value") * 100.0 / F.col("total"), digits)).otherwise(0.0).alias("percentage"),
    )


def text_summary(df: DataFrame, text: str, short: int = 50) -> DataFrame:
    """Length statistics and the number and share of short texts."""
    n = F.length(text)
    return df.agg(
        F.count("*").alias("rows"),
        F.avg(n).alias("avg_len"),
        F.min(n).alias("min_len"),
        F.max(n).alias("max_len"),
        F.count_if(n < short).alias("short"),
    ).withColumn("short_percent", F.when(F.col("rows") > 0, F.round(F.col("short") * 100.0 / F.col("rows"), 2)).otherwise(0.0))


def text_sizes(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("char_count", F.length(text)).withColumn("word_count", word_count(F.col(text)))


def column_summary(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Smallest, largest and mean value, and the exact median.

    The column is written once, since what it comes from may be long work, and read for the counts and for the rest.
    Equal values are counted first and the different ones dealt to ranges; the sums of the ranges, as many
    as there are shuffle partitions, tell which of them hold the middle, and only those are looked at.
    """
    df = written(df.select(column), "distribution")
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ranges = written(counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    sums = sorted(tuple(r) for r in ranges.groupBy("part").agg(F.sum("n")).collect())
    total, before, starts = sum(n for _, n in sums), 0, {}
    middle = [(total - 1) // 2, total // 2]
    for part, n in sums:
        if any(before <= m < before + n for m in middle):
            starts[part] = before
        before += n
    sofar = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.coalesce(*(F.when(F.col("part") == p, F.lit(b)) for p, b in starts.items()), F.lit(0))
    near = ranges.filter(F.col("part").isin(list(starts))).withColumn("end", F.sum("n").over(sofar) + begin)
    holds = [(F.col("end") > m) & (F.col("end") - F.col("n") <= m) for m in middle]
    halves = near.agg(*(F.max(F.when(h, F.col("v"))).alias(f"m{i}") for i, h in enumerate(holds)))
    median = halves.select(((F.col("m0") + F.col("m1")) / 2).cast("double").alias("m")).scalar()
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean")).withColumn("median", median)


def text_checks(df: DataFrame, text: str, prefix: str, phrase: str) -> DataFrame:
    value = F.col(text)
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(value.isNull() | (value == "")).alias("missing"),
        F.count_if(~value.startswith(prefix)).alias("wrong_prefix"),
        F.count_if(value.contains(phrase)).alias("with_phrase"),
    )


def id_checks(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Ids of the form prefix and digits, and the others."""
    good = F.col(column).rlike(rf"^{prefix}\d+$")
    return df.agg(F.count_if(good).alias("valid"), F.count_if(~good | F.col(column).isNull()).alias("invalid"))


def vector_checks(df: DataFrame, vector: str, dimension: int, tolerance: float = 1e-6) -> DataFrame:
    """Wrong sizes, norms off one, NaN and infinite values, and the mean norm."""
    v = F.col(vector)
    norm = vectors.norm(v)
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(v.isNull()).alias("missing"),
        F.count_if(F.size(v) != dimension).alias("wrong_dimension"),
        F.count_if((F.abs(norm - 1) > tolerance) & vectors.is_finite(v)).alias("norm_off"),
        F.count_if(F.exists(v, lambda x: F.isnan(x))).alias("with_nan"),
        F.count_if(F.exists(v, lambda x: F.abs(x) == float("inf"))).alias("with_inf"),
        F.avg(F.when(vectors.is_finite(v), norm)).alias("mean_norm"),
    )


def unit_vectors(df: DataFrame, vector: str, low: float = 0.99, high: float = 1.01) -> DataFrame:
    """Normalise all vectors, but only if their mean norm lies outside [low, high]."""
    measured = df.withColumn("_norm", vectors.norm(F.col(vector)))
    mean = measured.agg(F.avg("_norm").alias("m")).scalar()
    by = F.when((mean < low) | (mean > high), F.col("_norm")).otherwise(F.lit(1.0))
    scaled = measured.withColumn("_by", by)
    return scaled.withColumn(vector, vectors.normalised(F.col(vector), F.col("_by"))).drop("_norm", "_by")


def reconciled(sent: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """Rows sent and received per key, and how many were lost."""
    tagged = sent.select(key, F.lit(1).alias("s"), F.lit(0).alias("r")).unionAll(
        received.select(key, F.lit(0).alias("s"), F.lit(1).alias("r"))
    )
    return (
        tagged.groupBy(key)
        .agg(F.sum("s").alias("sent"), F.sum("r").alias("received"))
        .withColumn("lost", F.col("sent") - F.col("received"))
    )


def row_differences(sent: DataFrame, received: DataFrame, key: str, buckets: int = 4096) -> DataFrame:
    """(key, kind, sent, received): what was ``lost``, ``added`` or ``altered`` on the way, as rows of each kind per key.

    Both sides must have the same columns; extra ones of ``received`` are left out. Rows count as often as they
    occur, null keys and null values are values. Each side is first reduced to one digest per bucket of keys, which does
    not depend on the order of rows (counts, sums and exclusive ors of two hashes of whole rows), so nothing but
    ``buckets`` small rows is shuffled where all rows arrived. Only rows of buckets whose digests differ are then
    shuffled and told apart by two 64-bit hashes.
    """
    columns = sent.columns

    def hashed(df: DataFrame, side: str) -> DataFrame:
        row = [F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in columns]
        return df.select(
            F.col(f"`{key}`").alias("key"),
            F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(buckets)).cast("int").alias("bucket"),
            F.xxhash64(*row).alias("h"),
            F.xxhash64(F.lit("second"), *reversed(row)).alias("g"),
            F.lit(int(side == "sent")).alias("s"),
            F.lit(int(side == "received")).alias("r"),
        )

    both = [hashed(sent, "sent"), hashed(received.select(*(F.col(f"`{c}`") for c in columns)), "received")]

    def sums(df: DataFrame) -> DataFrame:
        exact = F.sum(F.col("h").cast("decimal(38,0)"))
        return df.groupBy("bucket").agg(F.struct(F.count("*"), exact, F.bit_xor("h"), F.bit_xor("g")).alias("d"), F.max("s").alias("s"))

    digests = sums(both[0]).unionAll(sums(both[1]))
    digest = [F.max(F.when(F.col("s") == side, F.col("d"))) for side in (1, 0)]
    unequal = digests.groupBy("bucket").agg(digest[0].eqNullSafe(digest[1]).alias("same")).filter(~F.col("same")).select("bucket")
    # At most ``buckets`` rows of one number each.
    near = [df.join(F.broadcast(unequal), "bucket", "left_semi") for df in both]
    counted = near[0].unionAll(near[1]).groupBy("key", "h", "g").agg(F.sum("s").alias("s"), F.sum("r").alias("r"))
    over = counted.select("key", F.greatest(F.col("s") - F.col("r"), F.lit(0)).alias("out"), F.greatest(F.col("r") - F.col("s"), F.lit(0)).alias("in"))
    per_key = over.groupBy("key").agg(F.sum("out").alias("sent"), F.sum("in").alias("received")).filter("sent > 0 OR received > 0")
    kind = F.when(F.col("received") == 0, "lost").when(F.col("sent") == 0, "added").otherwise("altered")
    return per_key.select("key", kind.alias("kind"), "sent", "received")


def file_profile(df: DataFrame) -> DataFrame:
    """Rows, files and bytes of a table read from files."""
    files = df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).agg(
        F.count("*").alias("n")
    )
    return files.agg(F.sum("n").alias("rows"), F.count("*").alias("files"), F.sum("size").alias("bytes"))
