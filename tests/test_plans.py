"""The plans that large tables need: what is pushed down, joined and shuffled."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from vocatio.functions import rules
from vocatio.operators import feedback, joins, quality, retrieval, sampling, skills
from vocatio.plans import views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_source_filter_reaches_the_scan(spark, sf):
    rows = views.table(spark, sf, "documents").filter(F.col("source") == "src1").select("doc_id")
    text = plan(rows)
    assert "EqualTo(source,src1)" in text and "text:string" not in text


def test_rules_are_native(spark, sf):
    rows = views.postings(spark, sf).select(
        rules.seniority_by_regex(F.col("job_title")), rules.seniority_by_substring(F.col("job_title")), rules.occupation_group(F.col("job_title"))
    )
    text = plan(rows)
    assert "Python" not in text and "Exchange" not in text
    assert re.search(r"ReadSchema: struct<p_partkey:bigint,p_name:string,p_size:int>", text)


def test_sample_does_not_shuffle_rows(spark, sf):
    rows = views.postings(spark, sf).withColumn("g", rules.occupation_group(F.col("job_title")))
    counts = rows.groupBy(F.col("g").alias("stratum")).agg(F.count("*").alias("count"))
    text = plan(sampling.stratified_sample(rows, "id", "g", sampling.allocation(counts, 50, 10)))
    main = text.split("Subquery")[0]
    assert "Join" not in main and "Exchange" not in main


def test_phrases_shuffle_once_and_never_the_texts(spark, sf):
    texts = views.documents(spark, sf)
    table = skills.phrases(spark.createDataFrame([("the of",)], "skill string"))
    text = plan(skills.find_phrases(texts, table, "doc_id", "text"))
    assert "MapInArrow" in text and "Join" not in text and text.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    large = plan(skills.find_phrases(texts, table, "doc_id", "text", broadcast_limit=0))
    assert "salt" in large


def test_search_trims_before_it_shuffles(spark, sf):
    queries, items = views.cv_vectors(spark, sf).drop("label"), views.job_vectors(spark, sf).drop("label")
    for limit in (64 << 20, 0):
        text = plan(retrieval.top_k(queries, items, 5, broadcast_limit=limit))
        assert "WindowGroupLimit" in text and "Partial" in text
        assert text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_totals_are_no_windows_over_everything(spark, sf):
    events = views.feedback(spark, sf)
    text = plan(feedback.aggregated(events)) + plan(quality.group_share(events, "event_type"))
    assert "Window" not in text and "NestedLoop" not in text


def test_missing_links_do_not_meet_in_one_partition(spark):
    rows = spark.range(0, 20000).select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("job_link"))
    lists = spark.createDataFrame([("a", "x")], "job_link string, job_skills string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = joins.with_skills(rows, lists).rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20000 and max(sizes) < 20000 / 4


def test_entry(spark):
    first = entry.entry(spark)
    assert first.columns == ["skill", "count"] and first.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
