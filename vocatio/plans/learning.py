"""Queries on feedback, training pairs, samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio.operators import feedback, sampling
from vocatio.plans import views
from vocatio.plans.ingest import GROUPED_SQL, grouped_postings
from vocatio.plans.registry import query
from vocatio.session import work_path
from vocatio.streaming import running

PAIR_SQL = views.with_views("feedback") + """, sums AS (
  SELECT job_id, cv_id, sum(signal_strength) AS cumulative_score, avg(signal_strength) AS avg_signal, count(signal_strength) AS event_count,
    max("timestamp") AS last_updated, count(*) FILTER (WHERE signal_strength > 0) AS positive_count,
    count(*) FILTER (WHERE signal_strength < 0) AS negative_count FROM feedback GROUP BY job_id, cv_id),
scores AS (SELECT *, CASE WHEN (SELECT max(abs(cumulative_score)) FROM sums) > 0 THEN cumulative_score / (SELECT max(abs(cumulative_score)) FROM sums)
  ELSE 0.0 END AS normalized_score FROM sums)
"""
PAIR_COLUMNS = (
    "SELECT job_id, cv_id, round(cumulative_score, 6) AS cumulative_score, round(avg_signal, 6) AS avg_signal, event_count, last_updated, "
    "positive_count, negative_count, round(normalized_score, 6) AS normalized_score FROM scores"
)


def _rounded(pairs: DataFrame) -> DataFrame:
    names = ("cumulative_score", "avg_signal", "normalized_score")
    # Adding zero turns a rounded minus zero into zero.
    plain = {n: F.round(F.col(n), 6) + 0.0 for n in names}
    return pairs.withColumns({**plain, "last_updated": F.col("last_updated").cast("timestamp_ntz")})


@query("feedback_pairs", PAIR_SQL + PAIR_COLUMNS)
def feedback_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(feedback.aggregated(views.feedback(spark, sf_dir)))


@query("stream_feedback_pairs", PAIR_SQL + PAIR_COLUMNS)
def stream_feedback_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running aggregate over a stream of events, normalised when it is read."""
    out = work_path(spark, "feedback-pairs")
    running.track_feedback(views.feedback_events(views.table_stream(spark, sf_dir, "events")), out).awaitTermination()
    return _rounded(feedback.normalised_pairs(running.latest(spark, out, ["job_id", "cv_id"], running.PAIRS_SCHEMA)))


ACTIONS_SQL = views.with_views("actions")


@query(
    "action_summary",
    ACTIONS_SQL
    + """SELECT 'total' AS metric, '' AS "key", count(*) AS count, CAST(NULL AS DOUBLE) AS weight FROM actions
UNION ALL SELECT 'action', action, count(*), round(sum(weight), 6) FROM actions GROUP BY action
UNION ALL SELECT 'role', role, count(*), NULL FROM actions GROUP BY role""",
)
def action_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.action_summary(views.actions(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("retrain_due", ACTIONS_SQL + "SELECT count(*) FILTER (WHERE weight <> 0) AS actions, count(*) FILTER (WHERE weight <> 0) >= 50 AS due FROM actions")
def retrain_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.retrain_due(views.actions(spark, sf_dir))


@query(
    "recent_actions",
    ACTIONS_SQL + 'SELECT id, session_id, role, action, similarity_score, "timestamp" FROM actions ORDER BY "timestamp" DESC, id DESC LIMIT 10',
)
def recent_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feedback.recent(views.actions(spark, sf_dir))
    return rows.select("id", "session_id", "role", "action", "similarity_score", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@query(
    "action_totals_sql",
    ACTIONS_SQL
    + """SELECT action, role, count(*) AS actions, round(sum(weight), 6) AS total_weight FROM actions WHERE weight <> 0
GROUP BY action, role ORDER BY actions DESC, action, role""",
)
def action_totals_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's SQL over the feedback store's tables."""
    views.register(spark, sf_dir)
    return spark.sql(
        "SELECT action, role, COUNT(*) AS actions, ROUND(SUM(weight), 6) AS total_weight FROM user_actions "
        "WHERE weight != 0 GROUP BY action, role ORDER BY actions DESC, action, role"
    )


TRAINING_SQL = ACTIONS_SQL + """, labelled AS (SELECT *, CASE WHEN weight >= 0.5 THEN 'positive' WHEN weight < 0 THEN 'hard_negative' END AS label
  FROM actions WHERE cv_text IS NOT NULL AND job_text IS NOT NULL)
"""


@query("feedback_training_pairs", TRAINING_SQL + "SELECT id, cv_text, job_text, label FROM labelled WHERE label IS NOT NULL")
def feedback_training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.training_pairs(views.actions(spark, sf_dir)).select("id", "cv_text", "job_text", "label")


@query(
    "training_mix",
    TRAINING_SQL
    + """, positives AS (SELECT cv_text AS anchor_text, job_text AS positive_text FROM labelled WHERE label = 'positive'),
original AS (SELECT 'query: customer ' || o_custkey AS anchor_text, 'passage: order ' || o_orderkey AS positive_text,
  row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::BIGINT, o_orderkey) AS n FROM orders)
SELECT anchor_text, positive_text, 'feedback' AS origin FROM positives
UNION ALL SELECT anchor_text, positive_text, 'original' FROM original WHERE n <= (SELECT count(*) FROM positives)""",
)
def training_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many original pairs as there are positive ones."""
    pairs = feedback.training_pairs(views.actions(spark, sf_dir)).filter(F.col("label") == "positive")
    positives = pairs.select(F.col("cv_text").alias("anchor_text"), F.col("job_text").alias("positive_text"))
    original = views.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("query: customer "), "o_custkey").alias("anchor_text"),
        F.concat(F.lit("passage: order "), "o_orderkey").alias("positive_text"),
    )
    return feedback.training_mix(positives, original, "o_orderkey", mix_ratio=0.5)


@query(
    "weight_grid",
    PAIR_SQL
    + """, a AS (SELECT unnest([0.8, 1.0, 1.2])::DOUBLE AS alpha, unnest([0, 1, 2]) AS ia), b AS (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS beta, unnest([0, 1, 2]) AS ib),
g AS (SELECT unnest([0.05, 0.1, 0.15])::DOUBLE AS gamma1, unnest([0, 1, 2]) AS ig), h AS (SELECT unnest([0.05, 0.1, 0.15])::DOUBLE AS gamma2, unnest([0, 1, 2]) AS ih),
d AS (SELECT unnest([0.0, 0.1, 0.2, 0.3])::DOUBLE AS delta, unnest([0, 1, 2, 3]) AS id),
grid AS (SELECT CAST((((ia * 3 + ib) * 3 + ig) * 3 + ih) * 4 + id AS INTEGER) AS combo, alpha, beta, gamma1, gamma2, delta FROM a, b, g, h, d)
SELECT combo, alpha, beta, gamma1, gamma2, delta, round(delta * (SELECT avg(normalized_score) FROM scores WHERE normalized_score > 0), 6) AS score
FROM grid ORDER BY score DESC, combo""",
)
def weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.weight_grid(feedback.aggregated(views.feedback(spark, sf_dir))).withColumn("score", F.round("score", 6))


@query(
    "latest_model",
    "SELECT max('model-' || strftime(ts, '%Y%m%d%H%M%S')) AS model_version FROM events WHERE event_type = 'signup'",
)
def latest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signup event stands for a logged model."""
    log = views.table(spark, sf_dir, "events").filter(F.col("event_type") == "signup").select(
        F.concat(F.lit("model-"), F.date_format(F.col("ts").cast("timestamp"), "yyyyMMddHHmmss")).alias("model_version")
    )
    return feedback.latest_model(log, "base")


@query(
    "training_log",
    TRAINING_SQL
    + """SELECT 'model-2' AS model_version, 'base' AS previous_model, (SELECT count(*) FROM actions WHERE weight <> 0) AS num_actions_used,
  count(*) FILTER (WHERE label = 'positive') AS num_positive_pairs, count(*) FILTER (WHERE label = 'hard_negative') AS num_hard_negatives,
  CAST(1.5 AS DOUBLE) AS training_time_sec FROM labelled""",
)
def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.actions(spark, sf_dir)
    return feedback.log_training(rows, feedback.training_pairs(rows), "model-2", "base", 1.5, F.current_timestamp()).drop("timestamp")


DRAW_SQL = "('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
SPLIT_SQL = "CASE WHEN {u} < 0.8::DOUBLE THEN 'train' WHEN {u} < 0.9::DOUBLE THEN 'val' ELSE 'test' END"


def _split_sql(key: str) -> str:
    return SPLIT_SQL.format(u=DRAW_SQL.format(seed=42, key=key))


@query("hash_split", f"SELECT doc_id, {_split_sql('doc_id')} AS split FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", sampling.split_of(F.col("doc_id")).alias("split"))


STRATIFIED_SQL = GROUPED_SQL + f""", split_rows AS (SELECT id, g AS occupation, CASE WHEN {DRAW_SQL.format(seed=42, key="g || '|' || id")} < 0.8::DOUBLE THEN 'train'
  WHEN {DRAW_SQL.format(seed=43, key="g || '|' || id")} < 0.5::DOUBLE THEN 'val' ELSE 'test' END AS split FROM grouped)
"""


def _split_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped_postings(spark, sf_dir)
    return rows.select("id", "occupation", sampling.stratified_split(F.col("id"), F.col("occupation")).alias("split"))


@query("stratified_split", STRATIFIED_SQL + "SELECT id, occupation, split FROM split_rows")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_postings(spark, sf_dir)


@query(
    "split_matrix",
    STRATIFIED_SQL
    + "SELECT occupation, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test FROM split_rows GROUP BY occupation",
)
def split_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_matrix(_split_postings(spark, sf_dir), "occupation")


OVERLAP_SQL = """, per_id AS (SELECT {key}, bool_or(split = 'train') AS train, bool_or(split = 'val') AS val, bool_or(split = 'test') AS test FROM split_rows GROUP BY {key})
SELECT count(*) FILTER (WHERE train AND val) AS train_val, count(*) FILTER (WHERE train AND test) AS train_test, count(*) FILTER (WHERE val AND test) AS val_test FROM per_id"""


@query("split_overlap", STRATIFIED_SQL + OVERLAP_SQL.format(key="id"))
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No posting may lie in two splits: all counts are zero."""
    return sampling.split_overlap(_split_postings(spark, sf_dir), "id")


@query("split_leaks", f"WITH split_rows AS (SELECT user_id, {_split_sql('event_id')} AS split FROM events)" + OVERLAP_SQL.format(key="user_id"))
def split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events split one by one leak their users: the check must see that."""
    rows = views.table(spark, sf_dir, "events").select("user_id", sampling.split_of(F.col("event_id")).alias("split"))
    return sampling.split_overlap(rows, "user_id")


@query(
    "sample_n",
    "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::BIGINT, o_orderkey LIMIT 1000",
)
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_n(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 1000)


@query(
    "shuffled_rows",
    """SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::BIGINT, o_orderkey) - 1 AS position
FROM orders""",
)
def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in a random order, which the positions tell."""
    return sampling.shuffled_positions(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
