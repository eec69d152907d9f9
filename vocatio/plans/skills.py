"""Queries on the skill dictionary, phrases, terms and proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio import presets
from vocatio.functions import text
from vocatio.operators import quality, skills
from vocatio.plans import views
from vocatio.plans.fields import SKILLED_SQL, skilled_postings
from vocatio.plans.registry import query
from vocatio.session import spread, work_path, written
from vocatio.sources import files
from vocatio.streaming import running

DICTIONARY_SQL = SKILLED_SQL + """, dictionary AS (
  SELECT trim(s) AS skill, count(*) AS count FROM (SELECT unnest(string_split(skills, ',')) AS s FROM skilled) WHERE trim(s) <> '' GROUP BY 1)
"""


def skill_dictionary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.dictionary(skilled_postings(spark, sf_dir))


@query("skill_dictionary", DICTIONARY_SQL + "SELECT skill, count FROM dictionary ORDER BY count DESC, skill")
def skill_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skill_dictionary_rows(spark, sf_dir).orderBy(F.desc("count"), "skill")


@query("top_skills", DICTIONARY_SQL + "SELECT skill, count FROM dictionary ORDER BY count DESC, skill LIMIT 25")
def top_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skill_dictionary_rows(spark, sf_dir).orderBy(F.desc("count"), "skill").limit(25)


@query(
    "skill_coverage",
    SKILLED_SQL
    + """SELECT count(*) AS total, count(skills) AS with_value, count(*) - count(skills) AS without_value,
  round(count(skills) * 100.0::DOUBLE / count(*), 1) AS percentage FROM skilled""",
)
def skill_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coverage(skilled_postings(spark, sf_dir), F.col("skills").isNotNull())


def _runs_sql(source: str, key: str, name: str, longest: int) -> str:
    """Runs of 1..longest words of a table's texts: (key, run, pos, words)."""
    parts = "\n  UNION ALL ".join(
        f"SELECT {key}, array_to_string(w[i:i + {n - 1}], ' ') AS run, i - 1 AS pos, {n} AS words "
        f"FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM {name}_words)"
        for n in range(1, longest + 1)
    )
    words = f"SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}+#]+') AS w FROM {source}"
    return f"{name}_words AS ({words}),\n{name}_runs AS ({parts})"


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


QUALITY_SQL = f"length(run) >= {presets.MIN_SKILL_LENGTH} AND run NOT IN ({_listed([*presets.STOPWORDS, *presets.GENERIC_WORDS, *presets.GENERIC_SINGLE_WORDS])})"
REFRESH_SQL = f"length(run) > 2 AND run NOT IN ({_listed(presets.REFRESH_STOP_TERMS)})"
TERMS_SQL = "WITH " + _runs_sql("benchmark", "item_id", "bench", 3) + f""",
terms AS (SELECT run AS phrase, count(*) AS count FROM bench_runs WHERE {REFRESH_SQL} GROUP BY run),
phrases AS (SELECT phrase, count FROM (SELECT phrase AS run, phrase, count FROM terms) WHERE count >= 3 AND {QUALITY_SQL})
"""


def term_dictionary(spark: SparkSession, sf_dir: str, min_count: int = 3) -> DataFrame:
    """Runs of up to three words of the benchmark texts that pass the quality filter, written once."""
    runs = skills.refresh_terms(views.table(spark, sf_dir, "benchmark"), "text", 3)
    counted = runs.groupBy("skill").agg(F.count("*").alias("count"))
    return written(skills.quality_skills(counted, min_count), "term-dictionary")


@query("skill_quality_filter", TERMS_SQL + "SELECT phrase AS skill, count FROM phrases")
def skill_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_dictionary(spark, sf_dir)


FOUND_SQL = TERMS_SQL + ", " + _runs_sql("documents", "doc_id", "doc", 3) + """,
hits AS (SELECT doc_id, run AS phrase, min(pos * 10 + words) AS place FROM doc_runs WHERE run IN (SELECT phrase FROM phrases) GROUP BY doc_id, run)
"""


@query(
    "phrase_skills",
    FOUND_SQL
    + """SELECT doc_id, coalesce(string_agg(phrase, ', ' ORDER BY phrase), '') AS skills, count(phrase) AS skill_count,
  CAST(count(phrase) > 0 AS INTEGER) AS has_skills FROM documents LEFT JOIN hits USING (doc_id) GROUP BY doc_id""",
)
def phrase_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = skills.phrases(term_dictionary(spark, sf_dir))
    found = skills.find_phrases(views.documents(spark, sf_dir), table, "doc_id", "text")
    return skills.with_counts(found).select("doc_id", "skills", F.col("skill_count").cast("bigint").alias("skill_count"), "has_skills")


@query(
    "phrase_skills_ordered",
    FOUND_SQL + "SELECT doc_id, coalesce(string_agg(phrase, ', ' ORDER BY place), '') AS skills FROM documents LEFT JOIN hits USING (doc_id) GROUP BY doc_id",
)
def phrase_skills_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = skills.phrases(term_dictionary(spark, sf_dir))
    found = skills.find_phrases_in_order(views.documents(spark, sf_dir), table, "doc_id", "text")
    return found.select("doc_id", F.concat_ws(", ", "found").alias("skills"))


# A run can be frequent only if it is without its last word, so each round lengthens the frequent ones by a word.
NEW_SQL = TERMS_SQL.replace("WITH", "WITH RECURSIVE", 1) + f""",
conv_words AS (SELECT row_number() OVER () AS k, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}+#]+') AS w FROM conversations),
conv_starts AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM conv_words),
grown AS (SELECT k, i, 1 AS n, w[i] AS run, count(*) OVER (PARTITION BY w[i]) AS c FROM conv_starts
  UNION ALL
  SELECT k, i, n + 1, run, count(*) OVER (PARTITION BY run) FROM (
    SELECT k, i, n, run || ' ' || w[i + n] AS run FROM grown JOIN conv_words USING (k) WHERE c >= 2 AND i + n <= len(w))),
conv_runs AS (SELECT run FROM grown),
seen AS (SELECT run AS skill, count(*) AS count FROM conv_runs WHERE {REFRESH_SQL}
  GROUP BY run HAVING count(*) >= 2),
fresh AS (SELECT skill, count FROM seen WHERE skill NOT IN (SELECT phrase FROM phrases))
"""


@query("new_terms", NEW_SQL + "SELECT skill, count FROM fresh")
def new_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = skills.frequent_terms(spread(views.table(spark, sf_dir, "conversations")), "text")
    return skills.new_terms(terms, term_dictionary(spark, sf_dir))


@query("dictionary_refresh", NEW_SQL + "SELECT phrase AS skill, count FROM phrases UNION ALL SELECT skill, CAST(1 AS BIGINT) FROM fresh")
def dictionary_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refreshed dictionary, written as a new version and read back."""
    terms = skills.frequent_terms(spread(views.table(spark, sf_dir, "conversations")), "text")
    refreshed = skills.refreshed_dictionary(term_dictionary(spark, sf_dir), terms)
    path = files.write_version(refreshed, work_path(spark, "dictionary"), "2")
    return spark.read.schema(refreshed.schema).parquet(path)


CANDIDATE_SQL = r""", {name}_folded AS (SELECT {key} AS k, text, regexp_replace(text, '[^\P{{L}}\x00-\x7F]|[^\P{{N}}\x00-\x7F]', '_', 'g') AS f FROM {source}),
{name}_terms AS (SELECT DISTINCT k, lower(term) AS skill_name FROM (
  SELECT k, unnest(list_concat(regexp_extract_all(f, '\b([A-Z][a-z]+(?:\.[A-Za-z]+)?)\b', 1), list_concat(
    regexp_extract_all(f, '\b([A-Za-z]+(?:JS|SQL|ML|AI|DB|API))\b', 1), list_concat(
    regexp_extract_all(f, '\b([A-Za-z]+\s*\d+(?:\.\d+)?)\b', 1), list_concat(regexp_extract_all(f, '\b([A-Z]{{2,6}})\b', 1),
    [trim(x, E' \t\n\r\f\v') for x in regexp_split_to_array(regexp_extract(lower(text), 'skills[:\s]+([^.]+)', 1), '[,;|]')])))))  AS term
  FROM {name}_folded) WHERE length(term) > 2)
"""


def _candidates_sql(source: str, key: str, name: str) -> str:
    return CANDIDATE_SQL.format(source=source, key=key, name=name)


@query(
    "candidate_terms",
    "WITH x AS (SELECT 1)"
    + _candidates_sql("documents", "doc_id", "doc")
    + "SELECT doc_id, count(skill_name) AS terms, coalesce(string_agg(skill_name, '|' ORDER BY skill_name), '') AS found "
    "FROM documents LEFT JOIN doc_terms ON k = doc_id GROUP BY doc_id",
)
def candidate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_sort(text.candidate_terms(F.col("text")))
    return views.documents(spark, sf_dir).select("doc_id", found.alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("terms"), F.array_join("t", "|").alias("found")
    )


# Texts with a time: a document stands for the CV, the benchmark text of the same number for the job.
TIMED_SQL = """WITH timed AS (SELECT d.doc_id, d.text, b.text AS job_text, TIMESTAMP '2024-01-01' + to_seconds(d.doc_id) AS seen_at
  FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id)"""
TRACKED_SQL = (
    TIMED_SQL
    + _candidates_sql("timed", "doc_id", "doc")
    + ", jobs AS (SELECT doc_id AS item_id, job_text AS text FROM timed WHERE job_text IS NOT NULL)"
    + _candidates_sql("jobs", "item_id", "job")
    + """, known AS (SELECT run FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}+#]+')) AS run FROM benchmark) GROUP BY run HAVING count(*) >= 3),
sightings AS (SELECT * FROM doc_terms UNION ALL SELECT * FROM job_terms),
tracked AS (SELECT skill_name, count(*) AS frequency, min(TIMESTAMP '2024-01-01' + to_seconds(k)) AS first_seen, max(TIMESTAMP '2024-01-01' + to_seconds(k)) AS last_seen
  FROM sightings WHERE skill_name NOT IN (SELECT run FROM known) GROUP BY skill_name),
flagged AS (SELECT *, skill_name IN (SELECT lower(n_name) FROM nation UNION ALL SELECT lower(r_name) FROM region UNION ALL SELECT 'http') OR length(skill_name) = 4 AS added_to_dict FROM tracked)
"""
)


def timed_texts(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    second = F.timestamp_seconds(F.col("doc_id") + F.unix_timestamp(F.lit("2024-01-01"), "yyyy-MM-dd"))
    jobs = benchmark.select(F.col("item_id").alias("doc_id"), F.col("text").alias("job_text"))
    return documents.select("doc_id", "text", second.alias("seen_at")).join(jobs, "doc_id", "left")


def known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that occur at least three times in the benchmark texts stand for the dictionary."""
    words = views.table(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("skill"))
    return words.groupBy("skill").agg(F.count("*").alias("count")).filter(F.col("count") >= 3)


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = timed_texts(views.documents(spark, sf_dir), views.table(spark, sf_dir, "benchmark"))
    return skills.tracked_skills(skills.term_sightings(texts, ["text", "job_text"], "seen_at"), known_words(spark, sf_dir))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked skills with those approved that have four letters or name a place."""
    rows = written(tracked(spark, sf_dir), "tracked-skills")
    places = views.table(spark, sf_dir, "nation").select(F.col("n_name").alias("skill_name")).unionByName(
        views.table(spark, sf_dir, "region").select(F.col("r_name").alias("skill_name"))
    )
    short = rows.filter(F.length("skill_name") == 4).select(F.upper("skill_name").alias("skill_name"))
    approvals = places.unionByName(short).unionByName(places.select(F.lit("HTTP").alias("skill_name")))
    return skills.with_approvals(rows, approvals)


TRACKED_COLUMNS = "skill_name, frequency, first_seen, last_seen"


def _plain_times(rows: DataFrame) -> DataFrame:
    """Times without a zone, as the other tables have them."""
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


@query("approved_skills", TRACKED_SQL + f"SELECT {TRACKED_COLUMNS}, added_to_dict FROM flagged")
def approved_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_times(flagged(spark, sf_dir))


@query(
    "skill_proposals",
    TRACKED_SQL + "SELECT skill_name, frequency FROM flagged WHERE frequency >= 3 AND NOT added_to_dict ORDER BY frequency DESC, skill_name",
)
def skill_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.proposals(flagged(spark, sf_dir))


@query(
    "top_proposals",
    TRACKED_SQL + "SELECT skill_name, frequency FROM flagged WHERE frequency >= 3 AND NOT added_to_dict ORDER BY frequency DESC, skill_name LIMIT 10",
)
def top_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.proposals(flagged(spark, sf_dir)).limit(10)


@query(
    "skill_stats",
    TRACKED_SQL
    + "SELECT count(*) AS total_tracked, count(*) FILTER (WHERE NOT added_to_dict) AS pending, count(*) FILTER (WHERE added_to_dict) AS approved FROM flagged",
)
def skill_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.skill_statistics(flagged(spark, sf_dir))


@query("stream_skill_tracker", TRACKED_SQL + f"SELECT {TRACKED_COLUMNS} FROM tracked")
def stream_skill_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker fed by a stream of documents, read back without the known words."""
    texts = timed_texts(views.table_stream(spark, sf_dir, "documents"), views.table(spark, sf_dir, "benchmark"))
    out = work_path(spark, "skill-tracker")
    running.track_skills(texts, ["text", "job_text"], "seen_at", out).awaitTermination()
    current = running.latest(spark, out, ["skill_name"], running.TRACKED_SCHEMA)
    return _plain_times(current).join(known_words(spark, sf_dir).select(F.col("skill").alias("skill_name")), "skill_name", "left_anti")


@query(
    "matching_skills",
    SKILLED_SQL
    + """, texts AS (SELECT id, lower(job_title || ' ' || coalesce(skills, '')) AS t, skills FROM skilled)
SELECT id, array_to_string(list_filter(string_split(coalesce(skills, 'red rod, blue gear'), ', '), lambda s: contains(t, lower(s)))[1:8], ', ') AS matching FROM texts""",
)
def matching_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First eight skills of a posting that occur in its text."""
    body = F.concat_ws(" ", "job_title", F.coalesce("skills", F.lit("")))
    listed = F.split(F.coalesce("skills", F.lit("red rod, blue gear")), ", ")
    hits = text.matching_skills(listed, body)
    return skilled_postings(spark, sf_dir).select("id", F.array_join(F.slice(hits, 1, 8), ", ").alias("matching"))
