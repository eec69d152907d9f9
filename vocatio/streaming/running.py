"""Running aggregates over the action log: skill tracker and feedback pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vocatio.operators import feedback, skills


# Buckets of a table of running aggregates, and how many of its last states stay readable.
BUCKETS = 64
KEPT_STATES = 2


def _listed(spark, folder: str) -> list[str]:
    """Names of the finished states below ``folder``, or of all its folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def _remove(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _states(spark, out: str) -> list[int]:
    """Batches whose state is whole, oldest first; a state counts once Spark has marked its folder as written."""
    found = [n for n in _listed(spark, f"{out}/states") if n.isdigit()]
    return sorted(int(n) for n in found if "_SUCCESS" in _listed(spark, f"{out}/states/{n}"))


def _runs(spark, out: str, state: int) -> list[tuple[int, int, int]]:
    """(bucket, version, rows) of all runs of a state; a bucket has a few runs, each over twice as large as the next."""
    return sorted(tuple(r) for r in spark.read.schema("bucket int, version bigint, rows bigint").json(f"{out}/states/{state}").collect())


def _rows_of(spark, out: str, runs: list[tuple[int, int, int]], schema: str) -> DataFrame:
    """The rows of the given runs with their bucket and version; no other folder is listed or read."""
    paths = [f"{out}/runs/version={version}/bucket={bucket}" for bucket, version, _ in runs]
    full = f"{schema}, version bigint, bucket int"
    return spark.read.schema(full).option("basePath", f"{out}/runs").parquet(*paths) if paths else spark.createDataFrame([], full)


def _newest(rows: DataFrame, by: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in (*by, "version", "bucket")]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*values), "version").alias("r")).select(*by, "r.*")


def _to_merge(runs: list[tuple[int, int, int]], rows: int) -> list[tuple[int, int, int]]:
    """Runs of one bucket that a new run of ``rows`` takes in: from the newest on, while they are at most twice as large."""
    taken = []
    for run in sorted(runs, key=lambda r: -r[1]):
        if run[2] > 2 * rows:
            break
        taken.append(run)
        rows += run[2]
    return taken


def upserts(out: str, keys: list[str], buckets: int = BUCKETS, keep: int = KEPT_STATES):
    """For ``foreachBatch``: rows of a batch replace those with the same keys in the table below ``out``.

    Rows lie in buckets of their keys, and each bucket is a few runs, ordered by age. A batch writes a new run for the
    buckets that it has keys of and takes in their newest runs of like size, so other buckets are not touched, a row is
    written anew a logarithmic number of times, and there is a logarithmic number of runs to read. What the table
    consists of is a small state, written last: readers see the state before or after a batch, nothing between. Runs
    that none of the last ``keep`` states names are removed, so a reader may lag behind by ``keep - 1`` batches. A batch that
    comes again after its state was written changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, done = batch.sparkSession, _states(batch.sparkSession, out)
        if done and done[-1] >= batch_id:
            return
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
        tagged = batch.withColumn("version", F.lit(batch_id).cast("bigint")).withColumn(
            "bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        )
        tagged.persist()
        try:
            had = _runs(spark, out, done[-1]) if done else []
            new = {b: n for b, n in tagged.groupBy("bucket").count().collect()}
            taken = [run for b, n in new.items() for run in _to_merge([r for r in had if r[0] == b], n)]
            merged = _newest(tagged.unionByName(_rows_of(spark, out, taken, schema)), ["bucket", *keys])
            fresh = f"{out}/runs/version={batch_id}"
            merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(fresh)
            sizes = spark.read.schema(f"{schema}, bucket int").parquet(fresh).groupBy("bucket").count().collect() if new else []
            states = {s: _runs(spark, out, s) for s in done[1 - keep : -1]} | ({done[-1]: had} if done else {})
            states[batch_id] = [r for r in had if r not in taken] + [(b, batch_id, n) for b, n in sizes]
            _write_state(spark, out, states[batch_id], batch_id)
        finally:
            tagged.unpersist()
        _remove_unnamed(spark, out, dict(sorted(states.items())[-keep:]), done)

    return write


def _write_state(spark, out: str, runs: list[tuple[int, int, int]], state: int) -> None:
    rows = spark.createDataFrame(runs, "bucket int, version bigint, rows bigint").coalesce(1)
    rows.write.mode("overwrite").json(f"{out}/states/{state}")


def _remove_unnamed(spark, out: str, states: dict[int, list[tuple[int, int, int]]], older: list[int]) -> None:
    """Remove all but the given states, and the runs that those do not name."""
    named: dict[int, set[int]] = {}
    for runs in states.values():
        for bucket, version, _ in runs:
            named.setdefault(version, set()).add(bucket)
    for state in set(older) - set(states):
        _remove(spark, f"{out}/states/{state}")
    for folder in _listed(spark, f"{out}/runs"):
        version = int(folder.removeprefix("version="))
        if version not in named:
            _remove(spark, f"{out}/runs/{folder}")
            continue
        for bucket in _listed(spark, f"{out}/runs/{folder}"):
            if bucket.startswith("bucket=") and int(bucket.removeprefix("bucket=")) not in named[version]:
                _remove(spark, f"{out}/runs/{folder}/{bucket}")


def _keep_latest(stream: DataFrame, out: str, keys: list[str]) -> StreamingQuery:
    """Upsert the groups that changed in each batch; :func:`latest` reads the table."""
    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(upserts(out, keys))
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def latest(spark, out: str, keys: list[str], schema: str) -> DataFrame:
    """The current row of every key, from the runs that the newest state names; no rows where nothing is written yet."""
    states = _states(spark, out)
    rows = _rows_of(spark, out, _runs(spark, out, states[-1]) if states else [], schema)
    return _newest(rows, keys)


def track_skills(texts: DataFrame, columns: list[str], seen_at: str, out: str) -> StreamingQuery:
    """Running count, first and last sighting per candidate term.

    Known terms are taken out when the table is read, so a newer dictionary applies at once.
    """
    return _keep_latest(skills.tracked_skills(skills.term_sightings(texts, columns, seen_at)), out, ["skill_name"])


TRACKED_SCHEMA = "skill_name string, frequency bigint, first_seen timestamp, last_seen timestamp"


def track_feedback(events: DataFrame, out: str) -> StreamingQuery:
    """Running sums per pair; the normalised score needs all pairs and is added when read."""
    return _keep_latest(feedback.pair_sums(events), out, ["job_id", "cv_id"])


PAIRS_SCHEMA = (
    "job_id string, cv_id string, cumulative_score double, avg_signal double, event_count bigint, "
    "last_updated timestamp, positive_count bigint, negative_count bigint"
)
