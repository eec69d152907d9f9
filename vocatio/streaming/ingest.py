"""Streams of messages and documents to tables, each drained once with ``availableNow``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vocatio import presets
from vocatio.functions.rules import stripped
from vocatio.functions.text import word_count
from vocatio.operators import joins
from vocatio.session import bound_batches
from vocatio.sources import messages


class Streams(list):
    """Streaming queries that belong together."""

    def awaitTermination(self) -> None:  # noqa: N802 - as a single query has it
        for query in self:
            query.awaitTermination()


def _one_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each id of an Arrow batch."""
    for batch in batches:
        codes = batch.column("id").dictionary_encode("encode").indices.to_numpy()
        first = np.sort(np.unique(codes, return_index=True)[1])
        yield batch if len(first) == len(codes) else batch.take(pa.array(first))


def distinct_ids(rows: DataFrame) -> DataFrame:
    """The first row of every id, however late it or its repeats come.

    The ids are kept in the stream's state (RocksDB, so on disk) without a watermark: a watermark
    would bound the state, but would also throw away ids that are seen for the first time after it.
    Repeats are first dropped within each Arrow batch, which needs no state, so of an id that makes up a
    third of a batch only a row for some thousands reaches the task that keeps the id.
    """
    bound_batches(rows.sparkSession)
    return rows.mapInArrow(_one_of_each, rows.schema).dropDuplicates(["id"])


def ingest(stream: DataFrame, out: str, schema: T.StructType = messages.POSTING_SCHEMA, at: Column | None = None) -> Streams:
    """Messages of a (value, ...) stream to tables below ``out``: ``rows`` has each id once, ``dead`` what cannot be read.

    ``counts`` gets a row for each batch, so that :func:`ingest_counts` can tell how many deliveries were repeats.
    """
    parsed = messages.parsed(stream, schema)
    rows = (
        distinct_ids(messages.records(parsed, schema))
        .writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint-rows")
        .option("maxRecordsPerFile", presets.MESSAGES_PER_FILE)
        .trigger(availableNow=True)
        .start()
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        # Counted on the way to the dead letters, so that the batch is read once and not kept.
        counts = Observation()
        seen = batch.observe(counts, F.count(F.lit(1)).alias("received"), F.count("error_type").alias("malformed"))
        batch_table(f"{out}/dead")(messages.dead_letters(seen, at=at), batch_id)
        row = batch.sparkSession.range(1).select(*(F.lit(counts.get[c]).cast("long").alias(c) for c in ("received", "malformed")))
        batch_table(f"{out}/counts")(row, batch_id)

    dead = (
        parsed.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{out}/checkpoint-dead")
        .trigger(availableNow=True)
        .start()
    )
    return Streams([rows, dead])


def _counts(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count("*").alias("received"), F.count("error_type").alias("malformed"))


def ingest_counts(spark, out: str) -> DataFrame:
    """One row on what has been ingested: received, malformed, kept and repeated messages."""
    kept = spark.read.parquet(f"{out}/rows").agg(F.count("*").alias("n")).scalar()
    sums = spark.read.parquet(f"{out}/counts").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("received", "malformed")))
    return sums.withColumn("kept", kept).withColumn("repeated", F.col("received") - F.col("malformed") - F.col("kept"))


def batch_table(path: str):
    """A ``foreachBatch`` writer: one folder per batch id, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def ingest_with_dead_letters(
    stream: DataFrame, out: str, order: str | None = None, at: Column | None = None, schema: T.StructType = messages.POSTING_SCHEMA
) -> StreamingQuery:
    """Good messages, each id once, and dead letters of one stream into tables, batch by batch.

    As :func:`ingest`, but all tables of a batch are written together and replace themselves if the
    batch runs again. Which ids are new is told by the stream's state, in which a batch looks up its own
    ids only, however many there have been; the state holds ids alone. Their rows are those of the batch: one
    for each new id, the earliest by ``order`` (without one, the least row), reduced before its shuffle.
    """
    read = messages.parsed(stream, schema)
    new_ids = distinct_ids(messages.records(read, schema).select("id")).select(F.col("id").alias("_new_id"))
    both = read.unionByName(new_ids, allowMissingColumns=True)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            parsed = batch.filter(F.col("_new_id").isNull()).drop("_new_id")
            new = batch.filter(F.col("_new_id").isNotNull()).select(F.col("_new_id").alias("id"))
            extra = (order,) if order else ()
            rows = messages.first_of_each_id(messages.records(parsed, schema, extra), order).drop(*extra, "deliveries")
            batch_table(f"{out}/rows")(joins.only(rows, new, "id"), batch_id)
            batch_table(f"{out}/dead")(messages.dead_letters(parsed, at=at), batch_id)
            batch_table(f"{out}/counts")(_counts(parsed), batch_id)
        finally:
            batch.unpersist()

    return (
        both.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def watch_folder(
    spark, folder: str, archive: str | None = None, glob: str | None = None, max_files: int | None = None
) -> DataFrame:
    """Stream of whole text files (path, text, size) dropped into a folder, at most ``max_files`` a batch.

    Writers put a file elsewhere and move it in, so a file is complete when it is seen. Files that
    were read move to ``archive`` where one is given.
    """
    reader = spark.readStream.format("text").option("wholetext", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _described(files: DataFrame) -> DataFrame:
    """(path, text, filename, file_type, reason) of files; ``reason`` tells why a file is no text document."""
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    # Binary formats read as text give bytes, not a document: parsing them needs a library of their own.
    reason = (
        F.when(extension.isin(*presets.BINARY_EXTENSIONS), "BinaryFormat")
        .when(~extension.isin(*presets.DOCUMENT_EXTENSIONS), "UnsupportedFormat")
        .when(F.col("text").contains("\u0000"), "BinaryFormat")
        .when(F.length(stripped(F.col("text"))) < presets.MIN_DOCUMENT_CHARS, "TooShort")
    )
    return files.select("path", "text", name.alias("filename"), extension.alias("file_type"), reason.alias("reason"))


def document_messages(files: DataFrame, kind: str, at: Column) -> DataFrame:
    """Messages of the text files with a supported extension and enough text.

    The id is the kind and a digest of the path, so reading a file again gives the same id.
    """
    return _described(files).filter(F.col("reason").isNull()).select(
        F.concat(F.lit(f"{kind}_"), F.substring(F.md5(F.col("path").cast("binary")), 1, 16)).alias("id"),
        F.lit(kind).alias("type"),
        "text",
        "filename",
        "file_type",
        word_count(F.col("text")).alias("word_count"),
        at.alias("timestamp"),
    )


def document_dead_letters(files: DataFrame, at: Column) -> DataFrame:
    """(original_message, error_type, error_message, failed_at) of the files that give no message; the path stands for the file."""
    return _described(files).filter(F.col("reason").isNotNull()).select(
        F.col("path").alias("original_message"), F.col("reason").alias("error_type"), F.concat(F.lit("no text document: "), "filename").alias("error_message"),
        at.alias("failed_at"),
    )
