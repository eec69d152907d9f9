"""Queries on sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio import presets
from vocatio.functions.rules import occupation_group, occupation_name
from vocatio.operators import joins, quality, sampling
from vocatio.plans import views
from vocatio.plans.registry import query
from vocatio.session import spread, work_path
from vocatio.sources import files, messages, postings
from vocatio.streaming import ingest

NAMES_CASE = "CASE g " + " ".join(f"WHEN {g} THEN '{n}'" for g, n in presets.OCCUPATION_NAMES.items()) + " ELSE 'Unknown' END"


@query("csv_scan", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.table(spark, sf_dir, "part")
    path = work_path(spark, "csv-scan")
    files.write_csv(part, path)
    return files.read_csv(spark, path, part.schema)


@query("csv_roundtrip", "SELECT doc_id, lang, text FROM documents")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    path = work_path(spark, "csv-roundtrip")
    files.write_csv(documents, path)
    return files.read_csv(spark, path, documents.schema, multi_line=True)


@query(
    "csv_by_name",
    """SELECT 'good' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE doc_id % 10 <> 3
UNION ALL SELECT 'HeaderMismatch', 'r' || doc_id || ',only two fields', NULL FROM documents WHERE doc_id % 10 = 3""",
)
def csv_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose columns differ in order and company, with quoted line breaks, and rows that do not fit."""
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "source")
    path = work_path(spark, "csv-by-name")
    key = F.col("doc_id") % 10
    files.write_csv(documents.filter(key < 3).select("text", "doc_id"), f"{path}/a")
    files.write_csv(documents.filter(key > 3).select("source", "doc_id", "lang", "text"), f"{path}/b")
    broken = documents.filter(key == 3).select(F.concat(F.lit("r"), "doc_id", F.lit(",only two fields")).alias("value"))
    # The first line of each file is a header.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    headed = broken.select("value", first.alias("first"))
    lines = F.when(F.col("first"), F.array(F.lit("doc_id,lang,text"), "value")).otherwise(F.array("value"))
    headed.select(F.explode(lines).alias("value")).write.text(f"{path}/c")
    folders, schema = [f"{path}/{x}" for x in "abc"], "doc_id string, text string"
    good = files.read_csv(spark, folders, schema, multi_line=True)
    bad = files.rejected_csv(spark, folders, schema, multi_line=True)
    return good.select(F.lit("good").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(
        bad.select(F.col("error_type").alias("kind"), F.col("original_message").alias("id"), F.lit(None).cast("string").alias("text"))
    )


def _json_lines(spark: SparkSession, sf_dir: str) -> str:
    """Documents as JSON lines, with blank and broken lines in between."""
    key = F.col("doc_id")
    lines = F.array(
        F.to_json(F.struct("doc_id", "lang", "text")),
        F.when(key % 5 == 0, F.lit("")),
        F.when(key % 7 == 0, F.concat(F.lit('{"doc_id": '), key.cast("string"))),
    )
    path = work_path(spark, "json-lines")
    documents = spread(views.table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    documents.select(F.explode(lines).alias("value")).filter(F.col("value").isNotNull()).write.text(path)
    return path


@query("jsonl_scan", "SELECT doc_id, lang, text FROM documents")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = files.read_json_lines(spark, _json_lines(spark, sf_dir), "documents")
    return good.select(F.from_json("raw_data", "doc_id bigint, lang string, text string").alias("r")).select("r.*")


@query(
    "jsonl_line_ids",
    """SELECT count(*) AS messages, count(*) FILTER (WHERE doc_id % 7 = 0) AS dead,
  count(*) + count(*) FILTER (WHERE doc_id % 5 = 0) + count(*) FILTER (WHERE doc_id % 7 = 0) AS lines FROM documents""",
)
def jsonl_line_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and dead lines, and the lines of all files as their last line numbers tell."""
    path = _json_lines(spark, sf_dir)
    good, bad = files.read_json_lines(spark, path, "documents")
    per_file = files.read_lines(spark, path).groupBy("file").agg(F.max("line").alias("last"))
    return per_file.agg((F.sum("last") + F.count("*")).alias("lines")).select(
        good.agg(F.countDistinct("id").alias("n")).scalar().alias("messages"),
        bad.agg(F.count("*").alias("n")).scalar().alias("dead"),
        "lines",
    )


@query("parquet_scan", "SELECT vec_id, label, len(embedding) AS dimension FROM embeddings")
def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.size("embedding").cast("bigint").alias("dimension")
    )


@query(
    "embedding_sink",
    "SELECT vec_id, label, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings",
)
def embedding_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = views.table(spark, sf_dir, "embeddings")
    path = work_path(spark, "embeddings")
    files.write_embeddings(embeddings, path, dimension=64)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return spark.read.schema(embeddings.schema).parquet(path).select("vec_id", "label", F.round(total, 5).alias("total"))


@query("batched_write", "SELECT count(*) AS rows, true AS bounded FROM orders")
def batched_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written in files of at most 10,000 rows, counted per file when read back."""
    path = work_path(spark, "batched")
    files.write_rows(views.table(spark, sf_dir, "orders"), path, presets.MESSAGES_PER_FILE)
    per_file = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    return per_file.agg(F.sum("n").alias("rows"), (F.max("n") <= 10_000).alias("bounded"))


@query(
    "unify_sources",
    """SELECT 'p' || p_partkey AS id, 'linkedin' AS source, 'link/' || p_partkey AS job_link, p_name AS job_title,
  p_brand AS company, p_type AS job_location, CASE WHEN p_size % 2 = 0 THEN 'Associate' ELSE '' END AS job_level,
  '' AS job_type, '' AS description FROM part
UNION ALL SELECT 's' || s_suppkey, 'indeed', '', s_name, n_name, '', '', '', 'supplier of ' || n_name
  FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'c' || c_custkey, 'glassdoor', '', c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR), '', '', ''
  FROM customer""",
)
def unify_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier, customer, nation = (views.table(spark, sf_dir, t) for t in ("part", "supplier", "customer", "nation"))
    linkedin = part.select(
        F.concat(F.lit("p"), "p_partkey").alias("key"),
        F.col("p_name").alias("job_title"),
        F.col("p_brand").alias("company"),
        F.col("p_type").alias("job_location"),
        F.when(F.col("p_size") % 2 == 0, "Associate").otherwise("nan").alias("job_level"),
        F.lit(None).cast("string").alias("job_type"),
        F.concat(F.lit("link/"), "p_partkey").alias("job_link"),
    )
    indeed = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("s"), "s_suppkey").alias("key"),
        F.col("s_name").alias("job_title"),
        F.col("n_name").alias("company"),
        F.concat(F.lit("supplier of "), "n_name").alias("summary"),
    )
    glassdoor = customer.select(
        F.concat(F.lit("c"), "c_custkey").alias("key"),
        F.col("c_name").alias("position"),
        F.col("c_mktsegment").alias("company"),
        F.col("c_nationkey").alias("location"),
    )
    sources = {"linkedin": linkedin, "indeed": indeed, "glassdoor": glassdoor}
    return postings.union_all([postings.unified(rows, name, "key") for name, rows in sources.items()])


@query(
    "to_messages",
    views.with_views("postings")
    + "SELECT id, source, coalesce(job_link, '') AS job_link, job_title, company, job_location, "
    "coalesce(job_level, '') AS job_level, coalesce(job_type, '') AS job_type, '' AS description FROM postings",
)
def to_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = messages.to_messages(views.postings(spark, sf_dir))
    return messages.records(messages.parsed(sent))


@query(
    "to_keyed_messages",
    views.with_views("postings", "posting_skills")
    + """SELECT id AS "key", id, job_title, company, source, coalesce(job_skills, '') AS skills,
  CAST(CASE WHEN job_skills IS NULL THEN 0 ELSE len(string_split(job_skills, ', ')) END AS BIGINT) AS extracted_skill_count
FROM postings LEFT JOIN posting_skills USING (job_link)""",
)
def to_keyed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    skilled = joins.with_skills(views.postings(spark, sf_dir), views.posting_skills(spark, sf_dir))
    found = F.coalesce(F.split("skills", ", "), F.array().cast("array<string>"))
    sent = messages.skill_messages(skilled.withColumn("found", found), F.current_timestamp())
    fields = "id string, job_title string, company string, source string, skills string, extracted_skill_count bigint"
    return sent.select("key", F.from_json("value", fields).alias("r")).select("key", "r.*")


def _event_messages(events: DataFrame) -> DataFrame:
    record = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.lit("events").alias("source"),
        F.col("event_type").alias("job_title"),
        F.col("user_id").cast("string").alias("company"),
        F.col("props").alias("description"),
    )
    return events.select(F.to_json(record).alias("value"), F.col("ts").cast("timestamp").alias("timestamp"))


def _delivered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Events as a stream of three batches, late days of all months first; each comes again with the next batch.

    The first batch has the latest time of all, so a watermark would take nearly everything after it for late.
    Each batch holds one broken message.
    """
    day = F.dayofmonth("timestamp")
    sent = _event_messages(views.table(spark, sf_dir, "events"))
    sent = sent.withColumn("part", F.when(day > 20, 1).when(day > 10, 2).otherwise(3))
    return _in_batches(sent, [(1,), (2, 1), (3, 2)], work_path(spark, name))


def _in_batches(sent: DataFrame, batches: list[tuple[int, ...]], path: str) -> DataFrame:
    """A stream of one batch for each tuple of parts, each with one broken message more.

    A batch is as many files as the table has splits, so that no task writes or reads all of it.
    """
    spark = sent.sparkSession
    broken = spark.createDataFrame([('{"id": ',)], "value string").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    n_files = max(1, sent.rdd.getNumPartitions())
    for parts in batches:
        batch = sent.filter(F.col("part").isin(*parts)).drop("part").unionByName(broken)
        batch.repartition(n_files).write.mode("append").parquet(path)
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", n_files).parquet(path)


@query(
    "stream_ingest_dedup",
    """SELECT CAST(event_id AS VARCHAR) AS id, 'events' AS source, event_type AS job_title,
  CAST(user_id AS VARCHAR) AS company, props AS description, '' AS job_link FROM events""",
)
def stream_ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of several batches, each delivered up to twice; each id is kept once, none is lost."""
    out = work_path(spark, "stream-ingest")
    ingest.ingest(_delivered(spark, sf_dir, "stream-dedup-in"), out).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("id", "source", "job_title", "company", "description", "job_link")


@query(
    "stream_ingest_late",
    """SELECT count(*) + count(*) FILTER (WHERE day(ts) > 10) + 3 AS received, CAST(3 AS BIGINT) AS malformed, count(*) AS kept,
  count(*) FILTER (WHERE day(ts) > 10) AS repeated, CAST(3 AS BIGINT) AS dead FROM events""",
)
def stream_ingest_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has become of the deliveries of batches that come in falling order of time."""
    out = work_path(spark, "stream-late")
    ingest.ingest(_delivered(spark, sf_dir, "stream-late-in"), out).awaitTermination()
    dead = spark.read.parquet(f"{out}/dead").agg(F.count("*").alias("n")).scalar()
    return ingest.ingest_counts(spark, out).withColumn("dead", dead)


@query(
    "stream_ingest_exact",
    """SELECT CAST(event_id AS VARCHAR) AS id, 'events' AS source, event_type AS job_title,
  CAST(user_id AS VARCHAR) AS company, props AS description, '' AS job_link FROM events""",
)
def stream_ingest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in five batches: each comes again with the next one, a fifth of them once more with the last."""
    sent = _event_messages(views.table(spark, sf_dir, "events")).withColumn("part", 1 + F.pmod(F.xxhash64("value"), F.lit(5)))
    twice = _in_batches(sent, [(1,), (2, 1), (3, 2), (4, 3), (5, 4, 1)], work_path(spark, "stream-exact-in"))
    out = work_path(spark, "stream-exact")
    ingest.ingest_with_dead_letters(twice, out, order="timestamp").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("id", "source", "job_title", "company", "description", "job_link")


@query(
    "dedup_by_id",
    """SELECT CAST(event_id AS VARCHAR) AS id, event_type AS job_title, CAST(2 AS BIGINT) AS deliveries FROM events""",
)
def dedup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form: first delivery of each id, and how often it came."""
    sent = _event_messages(spread(views.table(spark, sf_dir, "events")))
    rows = messages.records(messages.parsed(sent.unionAll(sent)), extra=("timestamp",))
    return messages.first_of_each_id(rows, "timestamp").select("id", "job_title", "deliveries")


def _document_messages(documents: DataFrame) -> DataFrame:
    """Messages of which some are cut off, some no object, some without an id."""
    key = F.col("doc_id")
    whole = F.concat(F.lit('{"id":"'), key.cast("string"), F.lit('","source":"'), F.col("source"), F.lit('"}'))
    value = (
        F.when(key % 17 == 0, F.concat(F.lit('{"id":"'), key.cast("string")))
        .when(key % 13 == 0, F.concat(F.lit('{"id":"","source":"'), F.col("source"), F.lit('"}')))
        .when(key % 11 == 0, F.concat(F.lit("["), key.cast("string"), F.lit("]")))
        .otherwise(whole)
    )
    return documents.select(value.alias("value"))


MESSAGE_SQL = """WITH sent AS (
  SELECT doc_id, source, CASE WHEN doc_id % 17 = 0 THEN '{"id":"' || doc_id
    WHEN doc_id % 13 = 0 THEN '{"id":"","source":"' || source || '"}' WHEN doc_id % 11 = 0 THEN '[' || doc_id || ']'
    ELSE '{"id":"' || doc_id || '","source":"' || source || '"}' END AS value,
  CASE WHEN doc_id % 17 = 0 THEN 'JSONDecodeError' WHEN doc_id % 13 = 0 THEN 'ValueError' WHEN doc_id % 11 = 0 THEN 'AttributeError' END AS error_type
  FROM documents)
"""


@query(
    "dead_letters",
    MESSAGE_SQL
    + """SELECT value AS original_message, error_type, CASE error_type WHEN 'JSONDecodeError' THEN 'malformed JSON'
  WHEN 'AttributeError' THEN 'message is not an object' ELSE 'Missing id' END AS error_message FROM sent WHERE error_type IS NOT NULL""",
)
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _document_messages(views.table(spark, sf_dir, "documents"))
    return messages.dead_letters(messages.parsed(sent)).drop("failed_at")


@query(
    "stream_dead_letters",
    MESSAGE_SQL
    + """SELECT coalesce(error_type, 'good') AS kind, CASE WHEN error_type IS NULL THEN CAST(doc_id AS VARCHAR) ELSE value END AS content
FROM sent""",
)
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_path(spark, "stream-dead")
    ingest.ingest_with_dead_letters(
        _document_messages(views.table_stream(spark, sf_dir, "documents")), out
    ).awaitTermination()
    good = spark.read.parquet(f"{out}/rows").select(F.lit("good").alias("kind"), F.col("id").alias("content"))
    dead = spark.read.parquet(f"{out}/dead").select(F.col("error_type").alias("kind"), F.col("original_message").alias("content"))
    return good.unionByName(dead)


@query(
    "folder_documents",
    """SELECT 'cv' AS type, '.txt' AS file_type, text, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS word_count
FROM benchmark WHERE length(trim(text, E' \\t\\n\\r\\f\\v')) >= 10
UNION ALL SELECT 'BinaryFormat', '.pdf', 'scan.pdf', NULL FROM region WHERE r_regionkey = 0""",
)
def folder_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a file of its own, picked up from a folder by a stream; a PDF becomes a dead letter."""
    folder, out = work_path(spark, "folder"), work_path(spark, "folder-out")
    views.table(spark, sf_dir, "benchmark").select("text", "item_id").write.partitionBy("item_id").text(folder)
    # The first region's name stands for the bytes of a file in a binary format.
    pdf = views.table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.col("r_name").alias("text"), F.lit("scan.pdf").alias("path"))
    pdf.write.parquet(f"{out}/pdf")
    now = F.current_timestamp()
    seen = ingest.watch_folder(spark, f"{folder}/item_id=*", max_files=1000)
    binary = spark.readStream.schema("text string, path string").parquet(f"{out}/pdf")

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest.batch_table(f"{out}/rows")(ingest.document_messages(batch, "cv", now), batch_id)
        ingest.batch_table(f"{out}/dead")(ingest.document_dead_letters(batch, now), batch_id)

    files_in = seen.unionByName(binary)
    files_in.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    # A text file ends with a line break of its own.
    good = spark.read.parquet(f"{out}/rows").select(
        "type", "file_type", F.regexp_replace("text", r"\n$", "").alias("text"), F.col("word_count").cast("bigint")
    )
    dead = spark.read.parquet(f"{out}/dead").filter("error_type = 'BinaryFormat'")
    return good.unionByName(
        dead.select(F.col("error_type").alias("type"), F.lit(".pdf").alias("file_type"), F.col("original_message").alias("text"), F.lit(None).cast("bigint").alias("word_count"))
    )


@query("action_log_weights", views.with_views("actions") + "SELECT id, session_id, role, action, weight FROM actions")
def action_log_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.actions(spark, sf_dir).select("id", "session_id", "role", "action", "weight")


@query(
    "reconcile_counts",
    MESSAGE_SQL
    + """SELECT source, count(*) AS sent, count(error_type) AS lost, count(*) - count(error_type) AS received
FROM sent GROUP BY source""",
)
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents")
    received = messages.records(messages.parsed(_document_messages(documents)))
    return quality.reconciled(documents, received, "source")


@query(
    "reconcile_rows",
    """SELECT doc_id AS "key", CASE WHEN doc_id % 101 = 0 THEN 'lost' WHEN doc_id % 103 = 0 THEN 'altered' ELSE 'added' END AS kind,
  CAST(CASE WHEN doc_id % 101 = 0 OR doc_id % 103 = 0 THEN n ELSE 0 END AS BIGINT) AS sent,
  CAST(CASE WHEN doc_id % 101 = 0 THEN 0 ELSE n END AS BIGINT) AS received
FROM (SELECT doc_id, count(*) AS n FROM documents GROUP BY doc_id) WHERE doc_id % 101 = 0 OR doc_id % 103 = 0 OR doc_id % 107 = 0""",
)
def reconcile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were lost, altered or delivered twice on the way through messages, by name."""
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    key = F.col("doc_id")
    text = F.when(key % 103 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("."))).otherwise(F.col("text"))
    arriving = documents.filter(key % 101 != 0).withColumn("text", text)
    again = documents.filter((key % 107 == 0) & (key % 103 != 0) & (key % 101 != 0))
    sent = arriving.unionAll(again).select(F.to_json(F.struct("doc_id", "source", "text")).alias("value"))
    received = sent.select(F.from_json("value", "doc_id bigint, source string, text string").alias("r")).select("r.*")
    return quality.row_differences(documents, received, "doc_id")


@query("source_profile", "SELECT source, count(*) AS count FROM documents GROUP BY source")
def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.group_counts(views.table(spark, sf_dir, "documents"), "source")


@query("file_profile", "SELECT count(*) AS rows, CAST(1 AS BIGINT) AS files, true AS has_bytes FROM documents")
def file_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = quality.file_profile(views.table(spark, sf_dir, "documents"))
    return profile.select("rows", "files", (F.col("bytes") > 0).alias("has_bytes"))


OCCUPATION_SQL = (
    "CASE "
    + " ".join(f"WHEN t SIMILAR TO '.*({'|'.join(words)}).*' THEN {g}" for g, words in presets.OCCUPATION_RULES)
    + f" ELSE {presets.OCCUPATION_DEFAULT} END"
)
GROUPED_SQL = views.with_views("postings") + f", grouped AS (SELECT *, CAST({OCCUPATION_SQL} AS INTEGER) AS g FROM (SELECT *, lower(job_title) AS t FROM postings))\n"
# Rows wanted in all, and from every group at least.
TARGET, MINIMUM = 1000, 100
ALLOCATION_SQL = GROUPED_SQL + f""", counts AS (SELECT g, count(*) AS n FROM grouped GROUP BY g),
shares AS (SELECT *, CASE WHEN n < {MINIMUM} THEN n WHEN n * ({TARGET}.0::DOUBLE / (SELECT sum(n) FROM counts)) < {MINIMUM} THEN {MINIMUM} END AS fixed FROM counts),
allotments AS (
  SELECT g, n, CAST(coalesce(fixed, floor(n::DOUBLE / (SELECT sum(n) FROM shares WHERE fixed IS NULL)
    * ({TARGET} - coalesce((SELECT sum(fixed) FROM shares), 0)))) AS BIGINT) AS allotted FROM shares),
drawn AS (
  SELECT p.*, a.n, a.allotted, least(1.0::DOUBLE, a.allotted::DOUBLE / a.n * 1.1::DOUBLE) AS fraction,
    ('0x' || substr(md5('42:' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS place
  FROM grouped p JOIN allotments a USING (g))
"""


def grouped_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.postings(spark, sf_dir).withColumn("occupation", occupation_group(F.col("job_title")))


def _fractions(rows: DataFrame) -> DataFrame:
    counts = quality.group_counts(rows, "occupation").withColumnRenamed("occupation", "stratum")
    return sampling.allocation(counts, TARGET, MINIMUM)


@query(
    "stratum_allocation",
    ALLOCATION_SQL
    + "SELECT g AS stratum, n AS count, allotted, round(least(1.0::DOUBLE, allotted::DOUBLE / n * 1.1::DOUBLE), 6) AS fraction FROM allotments",
)
def stratum_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fractions(grouped_postings(spark, sf_dir)).withColumn("fraction", F.round("fraction", 6))


@query("stratified_sample", ALLOCATION_SQL + "SELECT id, g AS occupation, job_title FROM drawn WHERE place < fraction")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped_postings(spark, sf_dir)
    return sampling.stratified_sample(rows, "id", "occupation", _fractions(rows)).select("id", "occupation", "job_title")


@query(
    "stratum_summary",
    ALLOCATION_SQL
    + f"""SELECT g AS stratum, {NAMES_CASE} AS name, max(n) AS original_count, count(*) AS sampled_count,
  round(count(*)::DOUBLE / (SELECT count(*) FROM drawn WHERE place < fraction) * 100, 1) AS percentage
FROM drawn WHERE place < fraction GROUP BY g""",
)
def stratum_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary as it is written to JSON and read back."""
    rows = grouped_postings(spark, sf_dir)
    sample = sampling.stratified_sample(rows, "id", "occupation", _fractions(rows))
    summary = sampling.stratum_summary(rows, sample, "occupation").withColumn("name", occupation_name(F.col("stratum")))
    path = work_path(spark, "summary")
    files.write_summary(summary, path)
    return spark.read.schema(summary.schema).json(path)
