"""A full run over small files, stage by stage."""

import csv
import json

import numpy as np
from pyspark.sql import functions as F

from vocatio.operators import encode, feedback
from vocatio.plans import stages

TITLES = ["Senior Engineer", "Sales Clerk", "Nurse", "Truck Driver", "Intern Analyst", "Farmer", "Store Manager", "Janitor"]
SKILLS = ["python", "sql", "machine learning", "driving", "nursing care", "cleaning"]


def write_csv(path, header, rows):
    with open(path, "w", newline="") as f:
        writer = csv.writer(f)
        writer.writerow(header)
        writer.writerows(rows)


def overlap(batch):
    return np.array([len(set(a.lower().split()) & set(b.lower().split())) for a, b in batch])


def test_full_run(spark, tmp_path):
    out = str(tmp_path / "out")
    linked = [[f"{TITLES[i % 8]} {i}", f"Firm {i % 5}", "Rome", "Associate", "Onsite", f"link{i}"] for i in range(80)]
    write_csv(tmp_path / "l.csv", ["job_title", "company", "job_location", "job_level", "job_type", "job_link"], linked)
    write_csv(
        tmp_path / "i.csv", ["job_title", "company", "location", "summary"],
        [[f"Clerk {i % 10}", "Shop", "Oslo", f"We need {SKILLS[i % 6]} and SQL."] for i in range(40)],
    )
    write_csv(tmp_path / "s.csv", ["job_link", "job_skills"], [[f"link{i}", f"{SKILLS[i % 6]}, sql,python"] for i in range(60)])
    with open(tmp_path / "cvs.jsonl", "w") as f:
        for i in range(50):
            f.write("\n" if i % 9 == 0 else "")
            cv = {
                "experience": [{"company": "ACME", "title": TITLES[i % 8], "level": None, "dates": {"start": f"{2000 + i % 15}-03", "end": "Present"}}],
                "skills": {"technical": {"tools": [{"name": SKILLS[i % 6]}, {"name": "Unknown"}]}},
                "education": [],
            }
            f.write(json.dumps(cv) + "\n")
        f.write("{oops\n")

    stages.ingest_postings(spark, {"linkedin": str(tmp_path / "l.csv"), "indeed": str(tmp_path / "i.csv")}, out)
    stages.ingest_cvs(spark, str(tmp_path / "cvs.jsonl"), "resumes", out)
    assert spark.read.parquet(f"{out}/raw_postings").count() == 120
    assert spark.read.parquet(f"{out}/raw_cvs").count() == 50 and spark.read.parquet(f"{out}/dead_letters").count() == 1

    stages.prepare_postings(spark, out, str(tmp_path / "s.csv"), min_count=5)
    jobs = spark.read.parquet(f"{out}/unified_jobs")
    # 80 linked postings differ; the 40 others repeat after 30 (ten titles, six skills).
    assert jobs.count() == 110 and jobs.select("id").distinct().count() == 110
    clerk = jobs.filter("job_title = 'Clerk 2'").select("skills").distinct().collect()
    assert "machine learning, sql" in {r["skills"] for r in clerk}

    stages.prepare_cvs(spark, out, F.to_date(F.lit("2020-03-01")))
    first = spark.read.parquet(f"{out}/cvs").filter("id = 'A1'").first()
    assert first["total_years"] == 20.0 and first["level"] == "expert level"
    assert first["text"].startswith("query: I am a Senior Engineer with 20 years of experience, expert level. My skills include: python.")

    stages.sample_postings(spark, out, target=90, minimum=5)
    assert 60 <= spark.read.parquet(f"{out}/jobs_to_embed").count() <= 110
    assert spark.read.parquet(f"{out}/id_mapping").count() == 110
    assert spark.read.json(f"{out}/isco_distribution").agg(F.sum("original_count")).first()[0] == 110

    stages.embed(spark, out)
    stages.split(spark, out)
    assert spark.read.parquet(f"{out}/cv_splits").count() == 50

    for name in ("train", "val"):
        stages.training_pairs(spark, out, name, lambda df: encode.score_pairs(df, "anchor_text", "positive_text", overlap), k=20)
        n = spark.read.parquet(f"{out}/cv_splits").filter(F.col("split") == name).count()
        pairs = spark.read.parquet(f"{out}/{name}_dataset")
        assert pairs.count() == n and pairs.filter("anchor_text is null or positive_text is null").count() == 0
    recall = {r["k"]: r["recall"] for r in stages.evaluate(spark, out, "train").collect()}
    assert 0 <= recall[1] <= recall[5] <= recall[10] <= recall[50] <= 1 and recall[50] == 1.0

    stages.build_index(spark, out, cells=4)
    queries = spark.read.parquet(f"{out}/cvs_embedded").withColumnRenamed("id", "query_id")
    hits = stages.search(spark, out, queries, k=5, probes=4)
    assert hits.count() == 250
    assert {"embedding_text", "isco_code"} <= set(spark.read.parquet(f"{out}/jobs_embedded").columns)
    asked = spark.createDataFrame([(1, "Senior Engineer with python and sql"), (2, "a nurse")], "query_id int, text string")
    scorer = lambda df: encode.score_pairs(df, "anchor_text", "positive_text", overlap)
    found = stages.match_texts(spark, out, asked, scorer, k=20, keep=5, probes=4)
    rows = found.collect()
    assert {r["query_id"] for r in rows} == {1, 2} and all(r["embedding_text"] and r["isco_code"] is not None for r in rows)
    best = max((r for r in rows if r["query_id"] == 1), key=lambda r: r["pair_score"])
    assert best["new_rank"] == 1 and "python" in best["embedding_text"].lower()

    rows = [(i, ["apply", "skip", "not_interested"][i % 3], f"query: knows zig build {i % 2}", "passage: x") for i in range(90)]
    log = feedback.logged(spark.createDataFrame(rows, "id int, action string, cv_text string, job_text string"))
    assert stages.learn(spark, log, out, "1", threshold=100) is False
    assert stages.learn(spark, log, out, "1") is True
    assert spark.read.parquet(f"{out}/model_log").first()["model_version"] == "1"
    stages.record_actions(log.drop("weight"), out)
    stages.record_actions(log.drop("weight"), out)
    assert spark.read.parquet(f"{out}/action_log").count() == 180
    known = {r["skill"]: r["count"] for r in spark.read.parquet(f"{out}/dictionary").collect()}
    assert known["zig build"] == 1 and known["sql"] > 1
    mix = spark.read.parquet(f"{out}/training_mix").groupBy("origin").count().collect()
    assert {r["origin"] for r in mix} == {"feedback", "original"}


def test_messages_stage(spark, tmp_path):
    sent = spark.createDataFrame([('{"id":"1","source":"a"}', 1), ('{"id":"1","source":"b"}', 2), ("{", 3)], "value string, seq int")
    stages.ingest_messages(sent, "seq", str(tmp_path))
    rows = spark.read.parquet(str(tmp_path / "raw_postings")).collect()
    assert [(r["id"], r["source"]) for r in rows] == [("1", "a")]
    assert spark.read.parquet(str(tmp_path / "dead_letters")).count() == 1
