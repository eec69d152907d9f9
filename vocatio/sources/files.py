"""File formats: CSV, JSON lines, parquet, and their sinks."""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocatio import presets
from vocatio.session import broadcast_if_small, written


# Makes every file one split of its own, so that a task can stop after the first record of its file.
WHOLE_FILE = 1 << 40
# Bytes behind a header that are still taken before a file is left.
READ_ON = 1 << 18
# Characters after which a quoted header is taken for one that never ends.
LONGEST_HEADER = 1 << 24


def _column_names(record: str) -> tuple[str, ...]:
    """Names in a header record; nameless columns and all of one name get their position, as the CSV source names them."""
    cells = next(csv.reader([record.removeprefix("\ufeff")]), [])
    # Names are compared without case, as the session does unless told otherwise.
    lowered = Counter(c.lower() for c in cells)
    return tuple(f"_c{i}" if not c else f"{c}{i}" if lowered[c.lower()] > 1 else c for i, c in enumerate(cells))


def _headers(spark: SparkSession, path: str | list[str], multi_line: bool) -> dict[tuple[str, ...], list[str]]:
    """Files of each different header, from one job in which a task opens a file and stops after its first record.

    Empty files have no header and no rows. The settings that make it so belong to a session of their own.
    """
    own = spark.newSession()
    for name in ("maxPartitionBytes", "openCostInBytes"):
        own.conf.set(f"spark.sql.files.{name}", WHOLE_FILE)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)

    def first_record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, length, quotes, past = [], 0, 0, None
        for batch in batches:
            # A small file is read to its end, which leaves the Python worker for the next one.
            if past is not None:
                past += batch.nbytes
                if past > READ_ON:
                    return
                continue
            for file, line in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
                if not lines and not line.strip():
                    continue
                lines.append(line)
                length += len(line)
                quotes += line.count('"')
                # A line break inside quotes belongs to the record.
                if not multi_line or quotes % 2 == 0:
                    record = "\n".join(lines)
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([record])], names=["file", "header"])
                    past = 0
                    break
                if length > LONGEST_HEADER:
                    raise ValueError(f"a quote in the header of {file} is not closed")

    every = own.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    by_header: dict[tuple[str, ...], list[str]] = {}
    # One short row for each file of the listing, which the driver holds anyway.
    for file, record in every.mapInArrow(first_record, "file string, header string").collect():
        by_header.setdefault(_column_names(record), []).append(unquote(file))
    return by_header


def _read_by_name(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, multi_line: bool
) -> tuple[DataFrame, list[str]]:
    """Rows under the names of ``schema``, still as text, and the line that does not fit its file's header in ``_rejected``."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = [f.name for f in wanted.fields]
    parts = []
    for header, found in _headers(spark, path, multi_line).items():
        missing = [n for n in names if n not in header]
        if missing:
            raise ValueError(f"no column {missing} in {found[0]}, which has {list(header)}")
        own = T.StructType([T.StructField(c, T.StringType()) for c in (*header, "_rejected")])
        reader = spark.read.schema(own).option("header", True).option("escape", '"').option("multiLine", multi_line)
        rows = reader.option("columnNameOfCorruptRecord", "_rejected").csv(found)
        parts.append(rows.select(*(F.col(f"`{n}`") for n in names), "_rejected"))
    if not parts:
        empty = T.StructType([T.StructField(c, T.StringType()) for c in (*names, "_rejected")])
        parts = [spark.createDataFrame([], empty)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows, names


def _fits(schema: T.StructType | str, rows: DataFrame) -> tuple[list[Column], Column]:
    """The columns in the types of ``schema``, and whether a row fits its header and these types."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted.fields]
    fit = F.col("_rejected").isNull()
    for f, value in zip(wanted.fields, typed):
        fit = fit & (F.col(f"`{f.name}`").isNull() | value.isNotNull())
    return typed, fit


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, max_rows: int | None = None, multi_line: bool = False
) -> DataFrame:
    """The columns of ``schema`` from CSV files with a header, found by name in whatever order and company they stand.

    Files may differ in their other columns; a missing column is an error, a row that does not fit its
    header or the types is left to :func:`rejected_csv`. ``multi_line`` allows line breaks inside quoted
    values, at the price that a file is not split. ``max_rows`` is the operator's own limit on the rows.
    """
    rows, _ = _read_by_name(spark, path, schema, multi_line)
    typed, fit = _fits(schema, rows)
    kept = rows.filter(fit).select(*typed)
    return kept.limit(max_rows) if max_rows is not None else kept


def rejected_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """(original_message, error_type, error_message, failed_at) of the rows that :func:`read_csv` leaves out."""
    rows, names = _read_by_name(spark, path, schema, multi_line)
    _, fit = _fits(schema, rows)
    return rows.filter(~fit).select(
        F.coalesce("_rejected", F.to_json(F.struct(*(F.col(f"`{n}`") for n in names)))).alias("original_message"),
        F.when(F.col("_rejected").isNotNull(), "HeaderMismatch").otherwise("TypeMismatch").alias("error_type"),
        F.lit("row does not fit the columns").alias("error_message"),
        F.current_timestamp().alias("failed_at"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; blanks at the ends of values are kept."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): every line of the files with its number, from 0 and blanks included.

    Spark reads the splits of a file independently. Rows of one split are numbered in file order by
    ``monotonically_increasing_id`` and written once; the number of lines before each split (one row per
    split) then follows from the written rows themselves, so however a later read cuts the files, no line
    is lost or numbered anew, and the lines are not shuffled.
    """
    lines = written(
        spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            "value",
        ),
        "lines",
    )
    splits = lines.groupBy("file", "block").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")
    offsets = written(splits.select("file", "block", shift.alias("shift")), "line-offsets")
    offsets, _ = broadcast_if_small(offsets, F.octet_length("file") + 16)
    return lines.join(offsets, ["file", "block"]).select("file", (F.col("seq") + F.col("shift")).alias("line"), "value")


def read_json_lines(spark: SparkSession, path: str, source: str) -> tuple[DataFrame, DataFrame]:
    """CV messages (id, source, raw_data) and dead letters of JSON-lines files.

    The id is ``A`` and the line number; where there are several files, a digest of the file stands before
    the line, so that no two rows share an id. Blank lines are skipped but counted, malformed ones are
    counted and go to the dead letters.
    """
    every = read_lines(spark, path)
    several = every.agg(F.min("file") != F.max("file")).first()[0]
    lines = every.withColumn("value", F.trim("value")).filter(F.col("value") != "")
    parsed = lines.withColumn("_json", F.try_parse_json("value"))
    of_file = [F.substring(F.md5(F.col("file").cast("binary")), 1, 16), F.lit("-")] if several else []
    good = parsed.filter(F.col("_json").isNotNull()).select(
        F.concat(F.lit("A"), *of_file, F.col("line").cast("string")).alias("id"),
        F.lit(source).alias("source"),
        F.col("value").alias("raw_data"),
    )
    bad = parsed.filter(F.col("_json").isNull()).select(
        F.col("value").alias("original_message"),
        F.lit("JSONDecodeError").alias("error_type"),
        F.lit("malformed JSON").alias("error_message"),
        F.current_timestamp().alias("failed_at"),
    )
    return good, bad


def write_rows(df: DataFrame, path: str, rows_per_file: int = presets.ROWS_PER_FILE, single_file: bool = False) -> None:
    """Parquet overwrite with a bound on the rows per file; one file only on request."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite")
    (writer if single_file else writer.option("maxRecordsPerFile", rows_per_file)).parquet(path)


def write_embeddings(df: DataFrame, path: str, vector: str = "embedding", dimension: int = 768) -> None:
    """Embedding table as snappy parquet; a vector of another size fails the write."""
    size_error = F.concat(F.lit("vector of size "), F.size(vector).cast("string"))
    sized = F.when(F.size(vector) == dimension, F.col(vector)).otherwise(
        F.raise_error(size_error).cast(df.schema[vector].dataType)
    )
    (
        df.withColumn(vector, sized)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", presets.EMBEDDINGS_PER_FILE)
        .option("compression", "snappy")
        .parquet(path)
    )


def write_version(df: DataFrame, root: str, version: str) -> str:
    """Write a new version next to the old ones, so readers of an old one are not disturbed."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_summary(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(filename, file_type, text) of whole text files in a folder."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.text(path, wholetext=True).select(
        name.alias("filename"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("file_type"), F.col("value").alias("text")
    )


def is_supported(file_type: Column) -> Column:
    return file_type.isin(*presets.DOCUMENT_EXTENSIONS)
