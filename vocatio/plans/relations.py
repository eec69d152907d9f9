"""Queries on joins, id sets, groups and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio.functions import rules
from vocatio.operators import joins, quality
from vocatio.plans import views
from vocatio.plans.fields import CV_SQL, JOB_SQL, SENIORITY_REGEX_SQL, SKILLED_SQL, cv_texts, job_texts, normalised_cvs, skilled_postings
from vocatio.plans.registry import query


@query("skills_left_join", SKILLED_SQL + "SELECT id, source, job_link, skills FROM skilled")
def skills_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skilled_postings(spark, sf_dir).select("id", "source", "job_link", "skills")


@query(
    "enrich_left_joins",
    """WITH spent AS (SELECT o_custkey AS c_custkey, count(*) AS orders, min(o_orderdate) AS first_order FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
acted AS (SELECT user_id AS c_custkey, count(*) AS events FROM events GROUP BY 1)
SELECT c_custkey, c_name, orders, first_order, events FROM customer LEFT JOIN spent USING (c_custkey) LEFT JOIN acted USING (c_custkey)""",
)
def enrich_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, events = views.table(spark, sf_dir, "orders"), views.table(spark, sf_dir, "events")
    spent = (
        orders.filter(F.col("o_orderstatus") == "F")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("orders"), F.min("o_orderdate").alias("first_order"))
    )
    acted = events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("events"))
    return joins.enriched(views.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), spent, acted, on="c_custkey")


PAIRS_SQL = """, id_pairs AS (SELECT 'A' || l_orderkey AS anchor, CAST(l_partkey * 2 AS VARCHAR) AS match, l_linenumber FROM lineitem)
"""


def id_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a CV id and a posting id, half of the latter unknown."""
    return views.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("A"), "l_orderkey").alias("anchor"), (F.col("l_partkey") * 2).cast("string").alias("match"), "l_linenumber"
    )


@query(
    "attach_texts",
    CV_SQL
    + ", "
    + JOB_SQL.removeprefix("WITH ")
    + PAIRS_SQL
    + """SELECT anchor, match, l_linenumber, 'query: ' || c.id || ' ' || c.level AS anchor_text, embedding_text AS positive_text
FROM id_pairs LEFT JOIN cv_all c ON c.id = anchor LEFT JOIN jobs j ON j.id = match""",
)
def attach_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cvs = normalised_cvs(spark, sf_dir).select("id", F.concat(F.lit("query: "), "id", F.lit(" "), "level").alias("text"))
    jobs = job_texts(spark, sf_dir).select("id", F.col("embedding_text").alias("text"))
    return joins.with_texts(id_pairs(spark, sf_dir), cvs, jobs)


@query(
    "result_details",
    JOB_SQL + PAIRS_SQL + "SELECT anchor, match, l_linenumber, job_title, company, seniority FROM id_pairs JOIN jobs ON id = match",
)
def result_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = job_texts(spark, sf_dir).select(F.col("id").alias("match"), "job_title", "company", "seniority")
    return joins.details(id_pairs(spark, sf_dir), items, on="match")


@query("semi_by_ids", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def semi_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = views.table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("o_custkey"))
    return joins.only(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey")


@query("anti_by_ids", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = views.table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return joins.without(views.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ids, "c_custkey")


@query(
    "id_set_ops",
    """WITH f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT 'both' AS op, k FROM (SELECT k FROM f INTERSECT SELECT k FROM o) UNION ALL SELECT 'only_f', k FROM (SELECT k FROM f EXCEPT SELECT k FROM o)""",
)
def id_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders")

    def keys(status: str) -> DataFrame:
        return orders.filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"))

    both = keys("F").intersect(keys("O")).select(F.lit("both").alias("op"), "k")
    return both.unionByName(keys("F").subtract(keys("O")).select(F.lit("only_f").alias("op"), "k"))


SHARE_SQL = views.with_views("postings") + f", jobs AS (SELECT *, {SENIORITY_REGEX_SQL} AS seniority FROM postings)\n"


@query(
    "group_share",
    SHARE_SQL
    + "SELECT seniority, count(*) AS count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM jobs), 1) AS percentage FROM jobs GROUP BY seniority",
)
def group_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = views.postings(spark, sf_dir).withColumn("seniority", rules.seniority_by_regex(F.col("job_title")))
    return quality.group_share(jobs, "seniority")


@query(
    "group_share_sql",
    SHARE_SQL
    + "SELECT seniority, count(*) AS job_count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM jobs), 1) AS percentage FROM jobs GROUP BY seniority ORDER BY job_count DESC",
)
def group_share_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report as a user's SQL over a temporary view."""
    jobs = views.postings(spark, sf_dir).withColumn("seniority", rules.seniority_by_regex(F.col("job_title")))
    jobs.createOrReplaceTempView("jobs")
    return spark.sql(
        "SELECT seniority, COUNT(*) AS job_count, "
        "CAST(ROUND(COUNT(*) * 100.0D / (SELECT COUNT(*) FROM jobs), 1) AS DOUBLE) AS percentage "
        "FROM jobs GROUP BY seniority ORDER BY job_count DESC"
    )


@query(
    "filtered_group_count",
    views.with_views("postings")
    + "SELECT job_level, count(*) AS count FROM postings WHERE job_level IS NOT NULL AND job_level NOT IN ('', 'nan') GROUP BY job_level ORDER BY count DESC",
)
def filtered_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.known_group_counts(views.postings(spark, sf_dir), "job_level").orderBy(F.desc("count"))


@query(
    "one_per_group",
    SHARE_SQL + "SELECT seniority, id, job_title FROM jobs QUALIFY row_number() OVER (PARTITION BY seniority ORDER BY CAST(id AS BIGINT)) = 1",
)
def one_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = views.postings(spark, sf_dir).select(rules.seniority_by_regex(F.col("job_title")).alias("seniority"), "id", "job_title")
    return joins.one_per_group(jobs, "seniority", F.col("id").cast("bigint"))


@query("dedup_by_text", "SELECT doc_id, text, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.one_per_text(views.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "text", "doc_id")


@query(
    "dedup_report",
    """SELECT count(*) AS rows_before, count(DISTINCT text) AS rows_after, count(*) - count(DISTINCT text) AS removed,
  round((count(*) - count(DISTINCT text))::DOUBLE / count(*) * 100, 2) AS removed_percent FROM documents""",
)
def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    return joins.removed_by(documents, joins.one_per_text(documents, "text", "doc_id"))


@query(
    "stable_ids",
    views.with_views("postings") + "SELECT id AS original_uuid, job_title, 'B' || lpad(CAST(('0x' || substr(md5(id), 1, 15))::BIGINT AS VARCHAR), 19, '0') || lpad(CAST(('0x' || substr(md5(id), 16, 15))::BIGINT AS VARCHAR), 19, '0') AS job_id FROM postings",
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.with_stable_id(views.postings(spark, sf_dir).select("id", "job_title"), "id")


@query(
    "id_collisions",
    """SELECT 'B' || lpad(CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15))::BIGINT AS VARCHAR), 19, '0')
  || lpad(CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 16, 15))::BIGINT AS VARCHAR), 19, '0') AS job_id,
  CAST(o_orderkey AS VARCHAR) AS a, 'other ' || o_orderkey AS b FROM orders WHERE o_orderkey % 1000 = 1""",
)
def id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all orders, with some given to a second key as well: just these are reported."""
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    placed = joins.with_stable_id(orders, "id")
    twice = placed.filter(F.col("original_uuid").cast("bigint") % 1000 == 1)
    return joins.id_collisions(placed.unionByName(twice.withColumn("original_uuid", F.concat(F.lit("other "), "original_uuid"))))


@query(
    "unique_after_union",
    JOB_SQL
    + """SELECT source, count(*) AS postings, count(DISTINCT id) AS ids FROM jobs GROUP BY source""",
)
def unique_after_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are filtered apart and joined up again: every id is there exactly once."""
    rows = job_texts(spark, sf_dir)
    linked = rows.filter(F.col("source") == "linkedin")
    others = rows.filter(F.col("source").isin("indeed", "glassdoor"))
    every = linked.unionByName(others)
    return every.groupBy("source").agg(F.count("*").alias("postings"), F.countDistinct("id").alias("ids"))


@query(
    "cv_samples_by_level",
    CV_SQL + "SELECT level, id FROM cv_all QUALIFY row_number() OVER (PARTITION BY level ORDER BY CAST(substr(id, 2) AS BIGINT)) = 1",
)
def cv_samples_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.one_per_group(cv_texts(spark, sf_dir).select("level", "id"), "level", F.substring("id", 2, 20).cast("bigint"))
