"""Streams drained over several batches give what the batch operators give."""

import json
import os

from pyspark.sql import functions as F

from vocatio.operators import feedback, skills
from vocatio.sources import messages
from vocatio.streaming import ingest, running


def drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_ingest_keeps_each_id_once_over_restarts(spark, tmp_path):
    def message(i, minute):
        return {"value": json.dumps({"id": i, "source": "s"}), "timestamp": f"2024-01-01T00:{minute:02d}:00Z"}

    schema, box, out = "value string, timestamp timestamp", tmp_path / "in", str(tmp_path / "out")
    drop(box, "1.json", [message("a", 0), message("b", 1), message("a", 2)])
    ingest.ingest(source(spark, box, schema), out).awaitTermination()
    drop(box, "2.json", [message("b", 3), message("c", 4), {"value": "{bad", "timestamp": "2024-01-01T00:05:00Z"}])
    ingest.ingest(source(spark, box, schema), out).awaitTermination()
    # An id whose first message is far older than all before is no late repeat.
    drop(box, "3.json", [{"value": '{"id":"d"}', "timestamp": "2020-01-01T00:00:00Z"}, message("a", 9)])
    ingest.ingest(source(spark, box, schema), out).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{out}/rows").collect()) == ["a", "b", "c", "d"]
    assert [r["error_type"] for r in spark.read.parquet(f"{out}/dead").collect()] == ["JSONDecodeError"]
    assert ingest.ingest_counts(spark, out).first().asDict() == {"received": 8, "malformed": 1, "kept": 4, "repeated": 3}


def test_dead_letters_and_repeated_batches(spark, tmp_path):
    box, out = tmp_path / "in", str(tmp_path / "out")
    drop(box, "1.json", [{"value": '{"id":"a"}'}, {"value": "{bad"}])
    drop(box, "2.json", [{"value": '{"id":""}'}, {"value": "[]"}, {"value": '{"id":"a","source":"late"}'}, {"value": '{"id":"b"}'}, {"value": '{"id":"b"}'}])
    ingest.ingest_with_dead_letters(source(spark, box, "value string"), out).awaitTermination()
    kinds = sorted(r["error_type"] for r in spark.read.parquet(f"{out}/dead").collect())
    assert kinds == ["AttributeError", "JSONDecodeError", "ValueError"]
    assert sorted((r["id"], r["source"]) for r in spark.read.parquet(f"{out}/rows").collect()) == [("a", ""), ("b", "")]
    assert ingest.ingest_counts(spark, out).first().asDict() == {"received": 7, "malformed": 3, "kept": 2, "repeated": 2}
    write = ingest.batch_table(f"{out}/again")
    write(spark.range(5), 0)
    write(spark.range(5), 0)
    assert spark.read.parquet(f"{out}/again").count() == 5


def test_batches_look_up_their_own_ids_only(spark, tmp_path):
    """Many batches with repeats of all earlier ones: what a batch reads and keeps does not grow with what came before."""
    box, out, sent = tmp_path / "in", str(tmp_path / "out"), []
    for batch in range(6):
        new = [f"i{batch}-{n}" for n in range(40)]
        again = [sent[n * 7 % len(sent)] for n in range(20)] if sent else []
        drop(box, f"{batch}.json", [{"value": json.dumps({"id": i, "source": str(batch)})} for i in [*new, *again, new[0]]] + [{"value": "{bad"}])
        os.utime(box / f"{batch}.json", (1e9 + batch, 1e9 + batch))
        sent += new
    query = ingest.ingest_with_dead_letters(source(spark, box, "value string"), out)
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").collect()
    assert sorted(r["id"] for r in rows) == sorted(sent) and all(r["id"].startswith(f"i{r['source']}-") for r in rows)
    assert ingest.ingest_counts(spark, out).first().asDict() == {"received": 6 * 42 + 5 * 20, "malformed": 6, "kept": 240, "repeated": 6 + 100}
    updated = [max(s["numRowsUpdated"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert len(updated) >= 6 and max(updated) <= 61 and not (tmp_path / "out" / "ids").exists()


def test_a_hot_id_is_dropped_before_the_state(spark, tmp_path):
    """Ids are kept once in the state, repeats within the input do not reach it, and a message is parsed once."""
    box, out = tmp_path / "in", str(tmp_path / "out")
    ids = [i for n in range(1000) for i in ("hot", f"i{n}", "hot")]
    for part in range(2):
        drop(box, f"{part}.json", [{"value": json.dumps({"id": i, "source": str(part)})} for i in ids] + [{"value": "{bad"}])
        os.utime(box / f"{part}.json", (1e9 + part, 1e9 + part))
    streams = ingest.ingest(source(spark, box, "value string"), out)
    streams.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").collect()
    assert sorted(r["id"] for r in rows) == sorted(set(ids)) and {r["source"] for r in rows} == {"0"}
    assert ingest.ingest_counts(spark, out).first().asDict() == {"received": 6002, "malformed": 2, "kept": 1001, "repeated": 4999}
    states = [p["stateOperators"] for p in streams[0].recentProgress if p["numInputRows"]]
    assert len(states) == 2 and all(len(ops) == 1 for ops in states)
    assert sum(ops[0]["customMetrics"]["numDroppedDuplicateRows"] for ops in states) <= 1001 + 4
    spark.createDataFrame([("{}",)], "value string").write.parquet(str(tmp_path / "sent"))
    read = messages.records(messages.parsed(spark.read.parquet(str(tmp_path / "sent"))))
    assert read._jdf.queryExecution().executedPlan().toString().count("parseJson") == 1


def test_running_pairs_equal_batch(spark, tmp_path):
    rows = [
        {"job_id": f"j{i % 3}", "cv_id": f"c{i % 2}", "signal_strength": [1.0, -0.3, 0.5, 0.0][i % 4], "timestamp": f"2024-01-01T00:00:{i:02d}Z"}
        for i in range(40)
    ]
    schema = "job_id string, cv_id string, signal_strength double, timestamp timestamp"
    box, out = tmp_path / "in", str(tmp_path / "out")
    drop(box, "1.json", rows[:15])
    drop(box, "2.json", rows[15:])
    running.track_feedback(source(spark, box, schema), out).awaitTermination()
    live = feedback.normalised_pairs(running.latest(spark, out, ["job_id", "cv_id"], running.PAIRS_SCHEMA))
    batch = feedback.aggregated(spark.read.schema(schema).json(str(box)))

    def plain(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect())

    assert plain(live) == plain(batch) and len(plain(live)) == 6


def test_upserts_rewrite_the_buckets_of_a_batch_only(spark, tmp_path):
    """Rows written per batch, the runs left over, removal of old ones, and readers that started before a batch."""
    out, schema = str(tmp_path / "t"), "k string, v bigint"
    write, now = running.upserts(out, ["k"], buckets=8), {}

    def put(batch, values):
        write(spark.createDataFrame(list(values.items()), schema), batch)
        now.update(values)

    def versions():
        return {(p.parent.name, p.name) for p in (tmp_path / "t" / "runs").glob("*/bucket=*")}

    def written_rows(batch):
        return spark.read.parquet(f"{out}/runs/version={batch}").count()

    assert running.latest(spark, out, ["k"], schema).count() == 0
    put(0, {f"k{i}": i for i in range(4000)})
    reader = running.latest(spark, out, ["k"], schema)
    first = versions()
    put(1, {"k7": -7, "new": 1})
    assert written_rows(1) == 2 and len(versions() - first) <= 2 and first <= versions()
    # The reader still sees the state it has started with; a new one sees the batch.
    assert dict(reader.collect()) == {f"k{i}": i for i in range(4000)}
    assert dict(running.latest(spark, out, ["k"], schema).collect()) == now
    total = 0
    for batch in range(2, 7):
        put(batch, {f"k{i}": batch * 1000 + i for i in range(batch * 40, batch * 40 + 60)})
        total += written_rows(batch)
    assert dict(running.latest(spark, out, ["k"], schema).collect()) == now
    # Five batches of 60 rows beside 4,000: with whole buckets rewritten it would be 20,000.
    assert total < 300 * 5
    assert max(len(running._to_merge([r], 1)) for r in running._runs(spark, out, 6)) <= 1
    per_bucket = {}
    for bucket, _, _ in running._runs(spark, out, 6):
        per_bucket[bucket] = per_bucket.get(bucket, 0) + 1
    assert max(per_bucket.values()) <= 5
    put(6, {"k0": 5})  # repeated batch: already there
    assert running.latest(spark, out, ["k"], schema).filter("k = 'k0'").first()["v"] == 0
    named = {(f"version={v}", f"bucket={b}") for s in (5, 6) for b, v, _ in running._runs(spark, out, s)}
    assert versions() == named and sorted(p.name for p in (tmp_path / "t" / "states").iterdir()) == ["5", "6"]
    # A batch that was cut off before its state was written leaves nothing behind for readers.
    spark.createDataFrame([("k1", 99)], schema).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{out}/runs/version=7")
    assert running.latest(spark, out, ["k"], schema).filter("v = 99").count() == 0
    write(spark.createDataFrame([("k1", 100)], schema), 7)
    assert [r["v"] for r in running.latest(spark, out, ["k"], schema).filter("k = 'k1'").collect()] == [100]


def test_skill_tracker_over_batches(spark, tmp_path):
    rows = [{"cv": "Uses Redis", "job": "Wants Redis", "at": "2024-01-01T00:00:00Z"}, {"cv": "Redis", "job": None, "at": "2024-01-02T00:00:00Z"}]
    box, out = tmp_path / "in", str(tmp_path / "out")
    for i, row in enumerate(rows):
        drop(box, f"{i}.json", [row])
    def drain():
        running.track_skills(source(spark, box, "cv string, job string, at timestamp"), ["cv", "job"], "at", out).awaitTermination()

    drain()
    before = {r["skill_name"]: r["frequency"] for r in running.latest(spark, out, ["skill_name"], running.TRACKED_SCHEMA).collect()}
    drop(box, "9.json", [{"cv": "Redis", "job": "Uses Kafka", "at": "2024-01-01T12:00:00Z"}])
    drain()
    assert before["redis"] == 3
    now = {r["skill_name"]: r for r in running.latest(spark, out, ["skill_name"], running.TRACKED_SCHEMA).collect()}
    assert now["redis"]["frequency"] == 4 and now["redis"]["last_seen"].day == 2 and now["redis"]["first_seen"].day == 1
    batch = skills.tracked_skills(
        skills.term_sightings(spark.read.schema("cv string, job string, at timestamp").json(str(box)), ["cv", "job"], "at")
    )
    assert {r["skill_name"]: r["frequency"] for r in batch.collect()} == {k: r["frequency"] for k, r in now.items()}


def test_folder_messages(spark, tmp_path):
    box = tmp_path / "cv"
    box.mkdir()
    (box / "a.txt").write_text("a long enough text")
    (box / "b.txt").write_text("short")
    (box / "c.bin").write_text("a long enough text")
    (box / "d.pdf").write_text("%PDF-1.4 a long enough text")
    out = str(tmp_path / "out")
    seen = ingest.document_messages(ingest.watch_folder(spark, str(box)), "cv", F.current_timestamp())
    seen.writeStream.foreachBatch(ingest.batch_table(out)).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).collect()
    assert [(r["filename"], r["file_type"], r["word_count"]) for r in got] == [("a.txt", ".txt", 4)]
    assert got[0]["id"].startswith("cv_")
    still = spark.read.text(str(box), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    dead = ingest.document_dead_letters(still, F.current_timestamp()).collect()
    assert sorted((r["original_message"].rsplit("/", 1)[1], r["error_type"]) for r in dead) == [("b.txt", "TooShort"), ("c.bin", "UnsupportedFormat"), ("d.pdf", "BinaryFormat")]
