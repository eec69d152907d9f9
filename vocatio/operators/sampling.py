"""Stratified samples, exact samples and splits, all by a hash of the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocatio import presets
from vocatio.functions.hashing import RANGE, draw, uniform
from vocatio.session import written

# Rows of one bin of draws that may be sorted at once for an exact sample.
SORTED_AT_ONCE = 100_000


def allocation(counts: DataFrame, target: int, minimum: int) -> DataFrame:
    """Rows to draw per stratum from (stratum, count): (stratum, count, allotted, fraction).

    Strata below the minimum are taken whole, strata whose share falls below it get the minimum,
    the rest share what remains in proportion. ``counts`` has one row per stratum; it is written
    once, since three scalar subqueries read it and would count the rows again.
    """
    counts = written(counts, "strata")
    total = counts.agg(F.sum("count").alias("t")).scalar()
    share = F.col("count") * (F.lit(float(target)) / total)
    fixed = counts.withColumn(
        "fixed", F.when(F.col("count") < minimum, F.col("count")).when(share < minimum, F.lit(minimum))
    )
    rest = fixed.agg(
        F.struct(
            (F.lit(target) - F.coalesce(F.sum("fixed"), F.lit(0))).alias("budget"),
            F.sum(F.when(F.col("fixed").isNull(), F.col("count"))).alias("total"),
        ).alias("r")
    ).scalar()
    proportional = F.floor(F.col("count") / rest["total"] * rest["budget"])
    allotted = F.coalesce("fixed", proportional).cast("bigint")
    return fixed.withColumn("allotted", allotted).select(
        "stratum",
        "count",
        "allotted",
        F.least(F.lit(1.0), F.col("allotted") / F.col("count") * presets.SAMPLE_BUFFER).alias("fraction"),
    )


def stratified_sample(df: DataFrame, id_column: str, stratum: str, fractions: DataFrame, seed: int = 42) -> DataFrame:
    """Keep each row with its stratum's fraction.

    The fractions (one row per stratum) reach the rows as a map from a scalar subquery: no join,
    no shuffle of the rows, whatever a single stratum holds.
    """
    entries = F.map_from_entries(F.collect_list(F.struct("stratum", "fraction")))
    table = fractions.agg(entries.alias("m")).scalar()
    return df.filter(uniform(F.col(id_column), seed) < F.element_at(table, F.col(stratum)))


def stratum_summary(before: DataFrame, after: DataFrame, stratum: str) -> DataFrame:
    """Original and sampled rows per stratum present in the sample, with its share in percent."""
    original = before.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("original_count"))
    sampled = after.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("sampled_count"))
    total = sampled.agg(F.sum("sampled_count").alias("t")).scalar()
    return sampled.join(original, "stratum", "left").select(
        "stratum",
        "original_count",
        "sampled_count",
        F.round(F.col("sampled_count") / total * 100, 1).alias("percentage"),
    )


def sample_n(df: DataFrame, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all), chosen by the smallest draws.

    The draws and ids alone are written once. A histogram over the upper bits of the draw (at most 4096
    bins) tells the bin of row ``n``; a bin that is itself large is cut again by the bits below. Only the
    ids of the last bin are sorted, to find the last draw and id of the sample; the rows then pass a filter,
    so their input is read once and no task holds the sample. Where several rows share that last id, as
    many of them are taken as are needed.
    """
    drawn_as = F.coalesce(draw(F.col(id_column), seed), F.lit(0))  # rows without an id are drawn first
    draws = written(df.select(F.col(id_column).alias("_id"), drawn_as.alias("_draw")), "draws")
    low, taken, span = 0, 0, RANGE
    for width in (1 << 20, 1 << 8, 1):
        part = draws.filter((F.col("_draw") >= low) & (F.col("_draw") < low + span))
        bins = part.groupBy(F.floor((F.col("_draw") - low) / width).alias("bin")).count().collect()
        edge = None
        for row in sorted(bins, key=lambda r: r["bin"]):
            if taken + row["count"] > n:
                edge = row
                break
            taken += row["count"]
        if edge is None:
            return df
        low, span = low + edge["bin"] * width, width
        if edge["count"] <= SORTED_AT_ONCE:
            break
    drawn = df.withColumn("_draw", drawn_as)
    below = F.col("_draw") < low
    if taken >= n:
        return drawn.filter(below).drop("_draw")
    at = draws.filter((F.col("_draw") >= low) & (F.col("_draw") < low + span))
    edge = at.orderBy("_draw", "_id").limit(n - taken).agg(
        F.max(F.struct("_draw", "_id")).alias("last"), F.count("*").alias("n")
    ).first()["last"]
    own = (F.col("_draw") == edge["_draw"]) & F.col(id_column).eqNullSafe(F.lit(edge["_id"]))
    before = (F.col("_draw") == edge["_draw"]) & (F.coalesce(F.col(id_column) < F.lit(edge["_id"]), F.lit(edge["_id"] is not None)))
    inside = (F.col("_draw") >= low) & (F.col("_draw") < edge["_draw"]) | before
    same = at.filter((F.col("_draw") == edge["_draw"]) & F.col("_id").eqNullSafe(F.lit(edge["_id"]))).count()
    if same == 1:
        return drawn.filter(below | inside | own).drop("_draw")
    smaller = F.coalesce(F.col("_id") < F.lit(edge["_id"]), F.lit(edge["_id"] is not None))
    less = at.filter((F.col("_draw") < edge["_draw"]) | ((F.col("_draw") == edge["_draw"]) & smaller)).count()
    return drawn.filter(below | inside).unionByName(drawn.filter(own).limit(n - taken - less)).drop("_draw")


def split_of(key: Column, seed: int = 42, fractions=presets.SPLIT_FRACTIONS) -> Column:
    """Name of the split a key falls in; fixed for a key, whatever the partitioning."""
    place = uniform(key, seed)
    bound, chain = 0.0, None
    for name, share in fractions[:-1]:
        bound = round(bound + share, 9)
        chain = F.when(place < bound, name) if chain is None else chain.when(place < bound, name)
    return chain.otherwise(fractions[-1][0])


def stratified_split(key: Column, stratum: Column, seed: int = 42) -> Column:
    """80/10/10 within every stratum: one draw for train, a second one halves the remainder.

    The stratum is part of the draw's key, so strata are drawn independently.
    """
    own = F.concat_ws("|", stratum.cast("string"), key.cast("string"))
    return (
        F.when(uniform(own, seed) < presets.SPLIT_FRACTIONS[0][1], "train")
        .when(uniform(own, seed + 1) < 0.5, "val")
        .otherwise("test")
    )


def split_matrix(split: DataFrame, stratum: str) -> DataFrame:
    """Rows per stratum and split, one column per split."""
    names = [name for name, _ in presets.SPLIT_FRACTIONS]
    return split.groupBy(stratum).agg(*[F.count_if(F.col("split") == n).alias(n) for n in names])


def split_overlap(split: DataFrame, id_column: str) -> DataFrame:
    """How many ids lie in two splits, for every pair of splits; all must be zero."""
    names = [name for name, _ in presets.SPLIT_FRACTIONS]
    per_id = split.groupBy(id_column).agg(*[F.max(F.col("split") == n).alias(n) for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    return per_id.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in pairs])


def shuffled(df: DataFrame, id_column: str, seed: int = 42) -> DataFrame:
    """Rows in a repeatable random order."""
    return df.orderBy(draw(F.col(id_column), seed), id_column)


def shuffled_positions(df: DataFrame, id_column: str, seed: int = 42) -> DataFrame:
    """The rows with their ``position`` from 0 in the order of :func:`shuffled`, for readers that take them by number.

    Rows are dealt to ranges of the order and written; the rows of each range, as many as there are shuffle
    partitions, tell where its numbers begin, so nothing is numbered in one task.
    """
    order = ["_draw", id_column]
    dealt = df.withColumn("_draw", draw(F.col(id_column), seed)).repartitionByRange(*order)
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()), "shuffled")
    sizes = sorted(tuple(r) for r in dealt.groupBy("_range").count().collect())
    before, entries = 0, []
    for part, n in sizes:
        entries += [F.lit(part), F.lit(before).cast("bigint")]
        before += n
    starts = F.element_at(F.create_map(*entries), F.col("_range")) if entries else F.lit(0).cast("bigint")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("position", inside + starts).drop("_draw", "_range")
