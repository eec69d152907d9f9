"""Files and messages."""

import json

import pytest
from pyspark.sql import functions as F

from vocatio.session import broadcast_if_small, shared_folder, spread, work_path, written
from vocatio.sources import files, messages, postings


def test_line_numbers_over_many_splits(spark, tmp_path):
    """A file cut into many splits still gets the line numbers it has on disk."""
    lines = [json.dumps({"n": i, "pad": "x" * (i % 90)}) if i % 7 else "" for i in range(3000)]
    lines[11] = '{"broken": '
    path = tmp_path / "cvs.jsonl"
    path.write_text("\n".join(lines) + "\n")
    (tmp_path / "more.jsonl").write_text('\n{"n": 1}\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        numbered = files.read_lines(spark, str(tmp_path))
        assert numbered.rdd.getNumPartitions() > 8
        got = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in numbered.collect()}
        expected = {("cvs.jsonl", i): line for i, line in enumerate(lines)}
        expected |= {("more.jsonl", 0): "", ("more.jsonl", 1): '{"n": 1}'}
        assert got == expected
        good, bad = files.read_json_lines(spark, str(path), "resumes")
        ids = {r["id"]: json.loads(r["raw_data"])["n"] for r in good.collect()}
        assert ids == {f"A{i}": i for i in range(3000) if i % 7 and i != 11}
        assert [r["original_message"] for r in bad.collect()] == ['{"broken":']
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_lines_of_many_files_have_ids_of_their_own(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text('{"n": 1}\n{"n": 2}\n{"n": 3}\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    good, _ = files.read_json_lines(spark, str(tmp_path), "s")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8")  # splits change between building and reading
        ids = [r["id"] for r in good.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(ids) == len(set(ids)) == 6


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('job_link,first_seen,job_title,company\nl1,2020,"Night\nnurse",Ward\n')
    (tmp_path / "b.csv").write_text("company,job_title,job_link\nMill,Clerk,l2\nonly one\nMill,Smith,l3,too,many\n")
    schema = "job_title string, company string, job_link string"
    rows = files.read_csv(spark, str(tmp_path), schema, multi_line=True).collect()
    assert sorted(tuple(r) for r in rows) == [("Clerk", "Mill", "l2"), ("Night\nnurse", "Ward", "l1")]
    bad = files.rejected_csv(spark, str(tmp_path), schema, multi_line=True).collect()
    assert sorted(r["original_message"] for r in bad) == ["Mill,Smith,l3,too,many", "only one"]
    with pytest.raises(ValueError, match="no column"):
        files.read_csv(spark, str(tmp_path), "salary string")
    typed = files.read_csv(spark, str(tmp_path / "a.csv"), "first_seen int, job_link string", multi_line=True).first()
    assert typed["first_seen"] == 2020
    assert files.rejected_csv(spark, str(tmp_path / "a.csv"), "company int", multi_line=True).first()["error_type"] == "TypeMismatch"


def test_headers_of_many_files_take_few_jobs(spark, tmp_path):
    """1,000 files with 20 headers: the headers are found by at most 3 jobs, and every row lies under its own names."""
    for i in range(1000):
        more = [f"extra{n}" for n in range(i % 20)]
        (tmp_path / f"f {i}%20.csv").write_text(",".join([*more, "id", "v"]) + "\n" + ",".join([*("x" for _ in more), f"k{i}", str(i)]) + "\n")
    tracker, group = spark.sparkContext.statusTracker(), f"headers-{tmp_path.name}"
    spark.sparkContext.setJobGroup(group, "headers")
    try:
        found = files._headers(spark, str(tmp_path), False)
        assert len(tracker.getJobIdsForGroup(group)) <= 3
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(len(v) for v in found.values()) == [50] * 20 and all(h[-2:] == ("id", "v") for h in found)
    rows = files.read_csv(spark, str(tmp_path), "id string, v int").collect()
    assert sorted((r["id"], r["v"]) for r in rows) == sorted((f"k{i}", i) for i in range(1000))


def test_odd_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n\n"two\nlines",id,,ID2,id2\n1,2,3,4,5\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "b.csv").write_text('id,"two\nlines"\n"x\n""y""",7\n')
    assert set(files._headers(spark, str(tmp_path), True)) == {("two\nlines", "id", "_c2", "ID23", "id24"), ("id", "two\nlines")}
    rows = files.read_csv(spark, str(tmp_path), "id string", multi_line=True).collect()
    assert sorted(r["id"] for r in rows) == ["2", 'x\n"y"']
    assert files.read_csv(spark, str(tmp_path / "empty.csv"), "id string").count() == 0


def test_csv_sources_to_one_schema(spark, tmp_path):
    (tmp_path / "in.csv").write_text('summary,job_title,company,location\n,"Nurse, night",Ward,nan\n"say ""hi""",Clerk,,Rome\n')
    rows = postings.unified(postings.read_source(spark, "indeed", str(tmp_path / "in.csv")), "indeed")
    got = {r["job_title"]: r.asDict() for r in rows.collect()}
    assert got["Nurse, night"]["job_location"] == "" and got["Nurse, night"]["description"] == ""
    assert got["Clerk"]["company"] == "" and got["Clerk"]["description"] == 'say "hi"' and got["Clerk"]["job_link"] == ""
    assert len({r["id"] for r in got.values()}) == 2
    kept = postings.unified(postings.read_source(spark, "indeed", str(tmp_path / "in.csv")), "indeed", nan_as_null=False)
    assert "nan" in {r["job_location"] for r in kept.collect()}
    assert postings.read_source(spark, "indeed", str(tmp_path / "in.csv"), max_rows=1).count() == 1


def test_rows_per_file(spark, tmp_path):
    out = str(tmp_path / "out")
    files.write_rows(spark.range(0, 2500, 1, 1), out, rows_per_file=1000)
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 3
    files.write_rows(spark.range(0, 2500, 1, 4), out, single_file=True)
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 1 and spark.read.parquet(out).count() == 2500


def test_embedding_sink_refuses_other_sizes(spark, tmp_path):
    good = spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<float>")
    files.write_embeddings(good, str(tmp_path / "a"), dimension=2)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 1
    with pytest.raises(Exception, match="vector of size 2"):
        files.write_embeddings(good, str(tmp_path / "b"), dimension=3)


def test_versions_do_not_replace_each_other(spark, tmp_path):
    files.write_version(spark.range(1), str(tmp_path), "1")
    files.write_version(spark.range(2), str(tmp_path), "2")
    assert spark.read.parquet(str(tmp_path)).groupBy("version").count().count() == 2
    with pytest.raises(Exception):
        files.write_version(spark.range(3), str(tmp_path), "2")


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("one\ntwo")
    (tmp_path / "b.exe").write_text("no")
    got = files.read_documents(spark, str(tmp_path)).withColumn("ok", files.is_supported(F.col("file_type")))
    assert {(r["filename"], r["ok"], r["text"]) for r in got.collect()} == {("a.TXT", True, "one\ntwo"), ("b.exe", False, "no")}


def test_message_roundtrip_keeps_nulls_out(spark):
    rows = spark.createDataFrame([("1", None, 'a "b"\n')], "id string, source string, description string")
    back = messages.records(messages.parsed(messages.to_messages(rows))).first()
    assert (back["id"], back["source"], back["description"]) == ("1", "", 'a "b"\n')
    keyed = messages.to_messages(rows, key="id").first()
    assert keyed["key"] == "1" and json.loads(keyed["value"])["source"] is None


def test_shared_folder_is_the_clusters(spark):
    assert work_path(spark, "x").startswith(f"{shared_folder(spark)}/vocatio/{spark.sparkContext.applicationId}/x-")
    frame = written(spark.range(3), "small")
    assert frame.count() == 3 and "parquet" in frame.inputFiles()[0]


def test_broadcast_is_measured(spark):
    rows = spark.range(100)
    assert broadcast_if_small(rows, F.lit(8), 800)[1] is True
    assert broadcast_if_small(rows, F.lit(8), 799)[1] is False
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, 1, 20)).rdd.getNumPartitions() == 20


def test_work_is_removed_at_the_end_of_a_run(spark, monkeypatch, tmp_path):
    from vocatio import session

    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    frame = written(spark.range(3), "small")
    assert frame.count() == 3 and len(list(tmp_path.glob("vocatio/*/small-*"))) == 1
    assert session.remove_work(spark) is True and not list(tmp_path.glob("vocatio/*")) and session.remove_work(spark) is False
