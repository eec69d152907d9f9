"""Rows as JSON messages and back, with a dead-letter table for what cannot be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocatio import presets

POSTING_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in presets.UNIFIED_POSTING_COLUMNS])


def to_messages(df: DataFrame, key: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """(value) or (key, value) rows as a Kafka sink takes them."""
    value = F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}).alias("value")
    return df.select(value) if key is None else df.select(F.col(key).cast("string").alias("key"), value)


def skill_messages(found: DataFrame, at: Column) -> DataFrame:
    """Keyed messages of postings with their extracted skills."""
    return to_messages(
        found.select(
            "id",
            "job_title",
            "company",
            "source",
            F.concat_ws(", ", "found").alias("skills"),
            F.size("found").alias("extracted_skill_count"),
            at.alias("timestamp"),
        ),
        key="id",
    )


def write_topic(messages: DataFrame, servers: str, topic: str) -> None:
    """Publish a batch of messages; needs the Kafka connector on the session's classpath."""
    (
        messages.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.linger.ms", "100")
        .option("kafka.batch.num.messages", str(presets.MESSAGES_PER_FILE))
        .option("topic", topic)
        .save()
    )


def read_topic(spark, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """(value, timestamp) stream of a topic from its start, at most ``max_offsets`` messages a batch."""
    reader = spark.readStream.format("kafka")
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return (
        reader
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
        .select(F.col("value").cast("string").alias("value"), "timestamp")
    )


def parsed(messages: DataFrame, schema: T.StructType = POSTING_SCHEMA, value: str = "value") -> DataFrame:
    """Fields of each message with ``error_type``, null for good ones; absent fields become ''.

    A message that is no JSON, one that is no object, and one without an id are errors. The text
    is parsed once, into a variant column; the fields are looked up in that. The column is exploded from an
    array of one, since a filter on fields would else be moved before it and parse the text again.
    """
    read = messages.select("*", F.explode(F.array(F.try_parse_json(value))).alias("_json"))
    is_object = F.ltrim(F.col(value), F.lit(" \t\r\n")).startswith("{")

    def field(name: str) -> Column:
        return F.coalesce(F.try_variant_get("_json", f"$.{name}", "string"), F.lit(""))

    error = (
        F.when(F.col("_json").isNull(), "JSONDecodeError")
        .when(~is_object, "AttributeError")
        .when(field("id") == "", "ValueError")
    )
    fields = [field(f.name).alias(f.name) for f in schema.fields]
    return read.select(*messages.columns, error.alias("error_type"), *fields)


def records(parsed_messages: DataFrame, schema: T.StructType = POSTING_SCHEMA, extra: tuple[str, ...] = ()) -> DataFrame:
    return parsed_messages.filter(F.col("error_type").isNull()).select(*[f.name for f in schema.fields], *extra)


def dead_letters(parsed_messages: DataFrame, value: str = "value", at: Column | None = None) -> DataFrame:
    """(original_message, error_type, error_message, failed_at) of the messages that failed."""
    message = (
        F.when(F.col("error_type") == "JSONDecodeError", "malformed JSON")
        .when(F.col("error_type") == "AttributeError", "message is not an object")
        .otherwise("Missing id")
    )
    return parsed_messages.filter(F.col("error_type").isNotNull()).select(
        F.col(value).alias("original_message"),
        "error_type",
        message.alias("error_message"),
        (F.current_timestamp() if at is None else at).alias("failed_at"),
    )


def first_of_each_id(rows: DataFrame, order: str | None) -> DataFrame:
    """The earliest row of every id and how often it came; repeats are dropped before the shuffle.

    A batch has no arrival order of its own, so ``order`` names the column that stands for it; of rows
    that agree in it, or without one, the least row stays.
    """
    row = F.struct(*[F.col(c) for c in rows.columns])
    first = F.min_by(row, F.struct(F.col(order), row) if order else row).alias("_r")
    return rows.groupBy("id").agg(first, F.count("*").alias("deliveries")).select("_r.*", "deliveries")
