"""Action log, pair aggregates, training pairs, weight search, model log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocatio import presets
from vocatio.functions.rules import action_weight
from vocatio.operators.sampling import sample_n
from vocatio.session import written


def logged(actions: DataFrame) -> DataFrame:
    """Actions with their weight; unknown actions weigh nothing."""
    return actions.withColumn("weight", action_weight(F.col("action")))


def pair_sums(events: DataFrame) -> DataFrame:
    """Per (job_id, cv_id): sum, mean and count of signals, latest time, positives, negatives."""
    signal = F.col("signal_strength")
    return events.groupBy("job_id", "cv_id").agg(
        F.sum(signal).alias("cumulative_score"),
        F.avg(signal).alias("avg_signal"),
        F.count(signal).alias("event_count"),
        F.max("timestamp").alias("last_updated"),
        F.count_if(signal > 0).alias("positive_count"),
        F.count_if(signal < 0).alias("negative_count"),
    )


def normalised_pairs(pairs: DataFrame) -> DataFrame:
    """Scores divided by the largest absolute score of all pairs, a scalar subquery."""
    largest = pairs.agg(F.max(F.abs("cumulative_score")).alias("m")).scalar()
    return pairs.withColumn(
        "normalized_score", F.when(largest > 0, F.col("cumulative_score") / largest).otherwise(F.lit(0.0))
    )


def aggregated(events: DataFrame) -> DataFrame:
    """Pair aggregate with normalised scores.

    The sums are written before the largest is looked up, so the events are read and shuffled once.
    """
    return normalised_pairs(written(pair_sums(events), "feedback-pairs"))


def action_summary(actions: DataFrame) -> DataFrame:
    """Long form of three reports: (metric, key, count, weight).

    Total, per action and per role come from one grouping by (action, role), which has a handful
    of rows, so the log is read once.
    """
    cells = actions.groupBy("action", "role").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    no_weight = F.lit(None).cast("double")

    def entry(metric: str, key: Column, weight: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), key.alias("key"), weight.alias("w"))

    entries = [
        entry("total", F.lit(""), no_weight), entry("action", F.col("action"), F.col("w")), entry("role", F.col("role"), no_weight),
    ]
    keyed = cells.select(F.explode(F.array(*entries)).alias("r"), "n")
    return keyed.groupBy("r.metric", "r.key").agg(F.sum("n").alias("count"), F.sum("r.w").alias("weight"))


def append_actions(actions: DataFrame, path: str) -> None:
    """Add weighted actions to the log, a table that only grows."""
    logged(actions).write.mode("append").parquet(path)


def retrain_due(actions: DataFrame, threshold: int = presets.RETRAIN_THRESHOLD) -> DataFrame:
    """Number of actions that mean something, and whether they suffice."""
    return actions.agg(F.count_if(F.col("weight") != 0).alias("actions")).withColumn(
        "due", F.col("actions") >= threshold
    )


def recent(actions: DataFrame, n: int = 10) -> DataFrame:
    return actions.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def training_pairs(actions: DataFrame, min_positive: float = presets.MIN_POSITIVE_WEIGHT) -> DataFrame:
    """Positive pairs and hard negatives among the actions that have both texts."""
    label = F.when(F.col("weight") >= min_positive, "positive").when(F.col("weight") < 0, "hard_negative")
    return actions.filter(F.col("cv_text").isNotNull() & F.col("job_text").isNotNull()).withColumn("label", label).filter(
        F.col("label").isNotNull()
    )


def training_mix(
    positives: DataFrame, original: DataFrame, original_id: str, mix_ratio: float = presets.MIX_RATIO, seed: int = 42
) -> DataFrame:
    """Positive pairs plus enough original pairs that feedback makes up ``mix_ratio`` of the whole.

    Both inputs have (anchor_text, positive_text); ``original`` also has a key column for the
    draw. Without positives, or with fewer than the least number of pairs, the result is empty.
    """
    n_positive, least = positives.count(), presets.MIN_TRAINING_PAIRS
    wanted = int(n_positive * (1 - mix_ratio) / mix_ratio)
    n_original = min(wanted, original.limit(least).count()) if n_positive < least else 0
    enough = n_positive > 0 and n_positive + n_original >= least
    drawn = sample_n(original, original_id, wanted, seed) if enough else original.limit(0)
    texts = ["anchor_text", "positive_text"]
    mixed = positives.select(*texts, F.lit("feedback").alias("origin")).unionByName(
        drawn.select(*texts, F.lit("original").alias("origin"))
    )
    return mixed if enough else mixed.limit(0)


def weight_grid(pairs: DataFrame, grid: dict[str, list[float]] | None = None) -> DataFrame:
    """Every combination of weights with its score; the best one comes first.

    The score is delta times the mean positive feedback, less a penalty for each other weight out
    of range. ``combo`` numbers the combinations in nested-loop order; the first best one wins.
    """
    grid = grid or presets.WEIGHT_GRID
    spark = pairs.sparkSession
    mean = pairs.filter(F.col("normalized_score") > 0).agg(F.avg("normalized_score").alias("m")).scalar()
    names = list(grid)
    combos = spark.range(1).select(*[F.lit(0).alias("combo")])
    for name in names:
        numbered = F.posexplode(F.array(*[F.lit(float(v)) for v in grid[name]])).alias("at", name)
        combos = combos.select("*", numbered).withColumn("combo", F.col("combo") * len(grid[name]) + F.col("at")).drop("at")
    penalty = sum(
        (
            F.when((F.col(n) < presets.WEIGHT_LOW) | (F.col(n) > presets.WEIGHT_HIGH), presets.WEIGHT_PENALTY).otherwise(0.0)
            for n in ("alpha", "beta", "gamma1", "gamma2")
        ),
        F.lit(0.0),
    )
    score = F.when(mean.isNull(), F.lit(0.0)).otherwise(F.col("delta") * mean - penalty)
    return combos.withColumn("score", score).orderBy(F.desc("score"), "combo")


def latest_model(log: DataFrame, base: str) -> DataFrame:
    """Latest model version by name, or the base model if the log is empty."""
    return log.agg(F.coalesce(F.max("model_version"), F.lit(base)).alias("model_version"))


def log_training(actions: DataFrame, pairs: DataFrame, version: str, previous: str, seconds: float, at: Column) -> DataFrame:
    """The row of the model log that describes one fit."""
    counts = pairs.agg(
        F.count_if(F.col("label") == "positive").alias("num_positive_pairs"),
        F.count_if(F.col("label") == "hard_negative").alias("num_hard_negatives"),
    )
    used = actions.agg(F.count_if(F.col("weight") != 0).alias("n")).scalar()
    return counts.select(
        F.lit(version).alias("model_version"),
        F.lit(previous).alias("previous_model"),
        used.alias("num_actions_used"),
        "num_positive_pairs",
        "num_hard_negatives",
        F.lit(float(seconds)).alias("training_time_sec"),
        at.alias("timestamp"),
    )
