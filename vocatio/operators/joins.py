"""Enrichment joins, id-set operations, unions and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocatio import presets


# A key with so many rows, and with a thousandth of its table, is hot; at most HOT_KEYS keys can be.
HOT_ROWS = 1_000_000
HOT_KEYS = 1000
SALTS = 64


def hot_keys(df: DataFrame, keys: list[str], rows: int = HOT_ROWS) -> dict[str, list]:
    """For each key column the values that would make a task of their own too large, by sketches in one pass; nulls are none."""
    counted = [F.count(F.lit(1)).alias("n")]
    counted += [F.expr(f"approx_top_k(`{k}`, {HOT_KEYS}, {8 * HOT_KEYS}) FILTER (WHERE `{k}` IS NOT NULL)").alias(f"top{i}") for i, k in enumerate(keys)]
    found = df.agg(*counted).first()
    least = max(rows, found["n"] / HOT_KEYS)
    return {k: [t["item"] for t in found[f"top{i}"] or [] if t["count"] >= least] for i, k in enumerate(keys)}


def left_joins(base: DataFrame, others: list[DataFrame], on: str, hot: list) -> DataFrame:
    """Left joins on one key that share a partitioning, with the rows of the ``hot`` keys spread over ``SALTS`` tasks.

    Only the rows of hot keys are copied on the other sides, once for each salt. It needs no setting of the session.
    """
    if not hot:
        for other in others:
            base = base.join(other, on, "left")
        return base
    is_hot, salts = F.col(on).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))
    # A row's part of the input decides, so copies of one row are spread too.
    salt = F.when(is_hot, F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0)
    joined = base.withColumn("_salt", salt)
    for other in others:
        copied = other.withColumn("_salt", F.explode(F.when(is_hot, salts).otherwise(F.array(F.lit(0)))))
        joined = joined.join(copied, [on, "_salt"], "left")
    return joined.select(*[c for c in joined.columns if c != "_salt"])


def skills_by_link(skills: DataFrame) -> DataFrame:
    """One row per link, so that the join cannot multiply postings: different lists are merged.

    Copies of a list fall away before the shuffle, so a link that fills a third of the table leaves
    only its different lists to be merged.
    """
    return (
        skills.select("job_link", "job_skills")
        .filter(F.col("job_link").isNotNull() & F.col("job_skills").isNotNull())
        .groupBy("job_link")
        .agg(F.array_join(F.array_sort(F.collect_set("job_skills")), ", ").alias("skills"))
    )


def with_skills(postings: DataFrame, skills: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of postings with their skill list; a link with very many postings is spread over tasks.

    Most sources have no link at all. A null key would send all their rows to one task, so a
    missing link is replaced by a value of the row's own, which no skill list has.
    """
    key = F.coalesce(F.col("job_link"), F.concat(F.lit("\u0000"), F.col("id").cast("string")))
    right = skills_by_link(skills).withColumnRenamed("job_link", "_key")
    hot = hot_keys(postings, ["job_link"], hot_rows)["job_link"]
    return left_joins(postings.withColumn("_key", key), [right], "_key", hot).drop("_key")


def enriched(base: DataFrame, *others: DataFrame, on: str = "id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left joins on one id; all share the partitioning of the first, hot ids are spread over tasks."""
    return left_joins(base, list(others), on, hot_keys(base, [on], hot_rows)[on])


def with_texts(pairs: DataFrame, cvs: DataFrame, jobs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Texts of both sides of (anchor, match); unknown ids give null, an id with very many pairs is spread over tasks."""
    left = cvs.select(F.col("id").alias("anchor"), F.col("text").alias("anchor_text"))
    right = jobs.select(F.col("id").alias("match"), F.col("text").alias("positive_text"))
    hot = hot_keys(pairs, ["anchor", "match"], hot_rows)
    return left_joins(left_joins(pairs, [left], "anchor", hot["anchor"]), [right], "match", hot["match"])


def only(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids.select(on), on, "left_semi")


def without(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids.select(on), on, "left_anti")


def details(matches: DataFrame, items: DataFrame, on: str = "item_id") -> DataFrame:
    """Rows of the matched items; a match without its row is dropped, never guessed."""
    return matches.join(items, on, "inner")


def one_per_text(df: DataFrame, text: str, id_column: str) -> DataFrame:
    """One row per text, the smallest id survives.

    Texts are grouped by digest, so the shuffle key is short, and copies collapse before the
    shuffle, so a text that fills a third of the table costs nothing extra.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    return (
        df.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("\u0000")), 256).alias("_digest"))
        .agg(F.min_by(row, F.col(id_column)).alias("_row"))
        .select("_row.*")
    )


def removed_by(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after a step, and what went: count and percent."""
    n_after = after.agg(F.count("*").alias("n")).scalar()
    counted = before.agg(F.count("*").alias("rows_before")).withColumn("rows_after", n_after)
    removed = F.col("rows_before") - F.col("rows_after")
    return counted.withColumn("removed", removed).withColumn(
        "removed_percent", F.when(F.col("rows_before") > 0, F.round(removed / F.col("rows_before") * 100, 2)).otherwise(0.0)
    )


def one_per_group(df: DataFrame, group: str, by: Column) -> DataFrame:
    """One sample row per group, the first by ``by``; groups are reduced before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns if c != group])
    return df.groupBy(group).agg(F.min_by(row, by).alias("_row")).select(group, "_row.*")


def with_stable_id(df: DataFrame, key: str, prefix: str = "B") -> DataFrame:
    """Keep the old id as ``original_uuid`` and add a ``job_id`` that depends on it alone.

    A number per partition and row would change with every new layout of the files. 120 bits of the
    key's hash stay the same, as two numbers of 19 digits, so that even among 10^12 keys no two are
    expected to meet; :func:`id_collisions` counts the ids that two keys share.
    """
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    halves = [F.lpad(F.conv(F.substring(digest, at, 15), 16, 10), 19, "0") for at in (1, 16)]
    return df.withColumn("job_id", F.concat(F.lit(prefix), *halves)).withColumnRenamed(key, "original_uuid")


def id_collisions(df: DataFrame) -> DataFrame:
    """Ids given to more than one key; expected to be empty."""
    return (
        df.groupBy("job_id")
        .agg(F.min("original_uuid").alias("a"), F.max("original_uuid").alias("b"))
        .filter(F.col("a") != F.col("b"))
    )


def default_skills(df: DataFrame) -> DataFrame:
    return df.withColumn("skills", F.coalesce("skills", F.lit(presets.DEFAULT_SKILLS)))
