"""Queries on column functions: levels, dates, texts, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio import presets
from vocatio.functions import cvs, render, rules, text
from vocatio.functions.dates import months, parse_date, years
from vocatio.operators import joins, quality
from vocatio.plans import views
from vocatio.plans.ingest import OCCUPATION_SQL
from vocatio.plans.registry import query
from vocatio.session import spread

AS_OF = "2002-01-01"


@query(
    "filter_project",
    views.with_views("postings")
    + """SELECT id AS posting_id, job_title, source, job_level, CAST(NULL AS VARCHAR) AS skills, CAST(salary_min AS BIGINT) AS salary
FROM postings WHERE source IN ('indeed', 'linkedin') AND job_level IS NOT NULL AND job_level <> ''
  AND (job_title LIKE 'Sr.%' OR job_title LIKE '%Engineer%' OR job_level = 'Associate')""",
)
def filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, level = F.col("job_title"), F.col("job_level")
    return (
        views.postings(spark, sf_dir)
        .filter(F.col("source").isin("indeed", "linkedin") & level.isNotNull() & (level != ""))
        .filter(title.startswith("Sr.") | title.contains("Engineer") | (level == "Associate"))
        .withColumnRenamed("id", "posting_id")
        .select(
            "posting_id", "job_title", "source", "job_level", F.lit(None).cast("string").alias("skills"),
            F.col("salary_min").cast("bigint").alias("salary"),
        )
    )


SENIORITY_REGEX_SQL = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(job_title, '{p.removeprefix('(?i)')}', 'i') THEN '{level}'" for level, p in presets.SENIORITY_REGEX_RULES)
    + f" ELSE '{presets.SENIORITY_DEFAULT}' END"
)
# {t} stands for the title; substrings are looked for as they are.
SENIORITY_SUBSTRING_SQL = (
    "CASE WHEN trim({t}) = '' OR {t} IS NULL THEN NULL "
    + " ".join(
        "WHEN " + " OR ".join(f"contains(lower({{t}}), '{w}')" for w in words) + f" THEN '{level}'" for level, words in presets.SENIORITY_SUBSTRING_RULES
    )
    + f" ELSE '{presets.SENIORITY_DEFAULT}' END"
)


def _phrases(value: str, phrases, otherwise: str = "NULL") -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in phrases.items()) + f" ELSE {otherwise} END"


@query("seniority_regex", views.with_views("postings") + f"SELECT id, job_title, {SENIORITY_REGEX_SQL} AS seniority FROM postings")
def seniority_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.postings(spark, sf_dir).select("id", "job_title", rules.seniority_by_regex(F.col("job_title")).alias("seniority"))


@query(
    "seniority_substring",
    views.with_views("postings") + f"SELECT id, job_title, {SENIORITY_SUBSTRING_SQL.format(t='job_title')} AS seniority FROM postings",
)
def seniority_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.postings(spark, sf_dir).select("id", "job_title", rules.seniority_by_substring(F.col("job_title")).alias("seniority"))


@query(
    "occupation_group",
    views.with_views("postings")
    + f"SELECT id, job_title, CAST({OCCUPATION_SQL} AS INTEGER) AS occupation FROM (SELECT *, lower(job_title) AS t FROM postings)",
)
def occupation_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.postings(spark, sf_dir).select("id", "job_title", rules.occupation_group(F.col("job_title")).alias("occupation"))


def parsed_cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CV documents with the parsed struct ``cv``; broken ones have null."""
    return views.raw_cvs(spark, sf_dir).withColumn("cv", F.from_json("raw_data", cvs.CV_SCHEMA))


def normalised_cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, company, level, years, skills and education of every CV, read within its row.

    Only the join that builds the test documents shuffles; nothing is exploded and joined back.
    """
    first = F.get(F.col("cv.experience"), 0)
    total = cvs.total_years(F.col("cv.experience"), F.to_date(F.lit(AS_OF)))
    named = parsed_cvs(spark, sf_dir).select(
        "id",
        "source",
        F.coalesce(rules.clean(first["title"]), F.lit(presets.DEFAULT_TITLE)).alias("title"),
        F.coalesce(rules.clean(first["company"], presets.COMPANY_PLACEHOLDERS), F.lit(presets.DEFAULT_COMPANY)).alias("company"),
        rules.clean(first["level"]).alias("given_level"),
        F.coalesce(total, F.lit(0.0)).alias("total_years"),
        cvs.skill_names(F.col("cv")).alias("skill_list"),
        cvs.education(F.col("cv")).alias("education_summary"),
    )
    return named.withColumn("level", rules.cv_level(F.col("given_level"), F.col("total_years"))).withColumn(
        "skills", F.coalesce(F.array_join("skill_list", ", "), F.lit(presets.DEFAULT_SKILLS))
    )


CV_SQL = views.with_views("cvs")


@query("cv_normalise", CV_SQL + "SELECT id, 'resumes' AS source, title, company, level, total_years FROM cv_all")
def cv_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised_cvs(spark, sf_dir).select("id", "source", "title", "company", "level", "total_years")


@query("level_from_years", CV_SQL + "SELECT id, given_level, total_years, level FROM cv_all")
def level_from_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised_cvs(spark, sf_dir).select("id", "given_level", "total_years", "level")


@query(
    "placeholder_clean",
    "WITH v AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Unknown' WHEN 1 THEN '' WHEN 2 THEN 'Fresher' "
    "WHEN 3 THEN NULL ELSE o_orderpriority END AS raw FROM orders) SELECT o_orderkey, raw, "
    "CASE WHEN raw NOT IN ('', 'Unknown', 'Not Provided') THEN raw END AS cleaned, "
    "CASE WHEN raw NOT IN ('', 'Unknown', 'Not Provided', 'Fresher') THEN raw END AS company FROM v",
)
def placeholder_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    raw = (
        F.when(key % 5 == 0, "Unknown").when(key % 5 == 1, "").when(key % 5 == 2, "Fresher").when(key % 5 == 3, None).otherwise(F.col("o_orderpriority"))
    )
    value = F.col("raw")
    return views.table(spark, sf_dir, "orders").select(key, raw.alias("raw")).select(
        "o_orderkey", "raw", rules.clean(value).alias("cleaned"), rules.clean(value, presets.COMPANY_PLACEHOLDERS).alias("company")
    )


@query(
    "nested_json_parse",
    CV_SQL
    + """, j AS (SELECT 'A' || k AS id, broken, CASE WHEN k % 5 = 0 THEN 'Not Provided' ELSE """
    + views._pick(views.OCCUPATIONS, "k % 12")
    + """ END AS title, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS jobs, CASE WHEN k % 11 <> 0 AND k % 6 < 4 THEN seg END AS school FROM cv_rows)
SELECT id, CASE WHEN NOT broken THEN title END AS first_title, CAST(CASE WHEN NOT broken THEN jobs END AS BIGINT) AS jobs,
  CASE WHEN NOT broken THEN school END AS school, regexp_extract(props, '\\d+') AS k
FROM j JOIN events ON 'A' || event_id = id""",
)
def nested_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents under a schema, first elements of arrays, and a flat JSON field."""
    flat = views.table(spark, sf_dir, "events").select(
        F.concat(F.lit("A"), "event_id").alias("id"), F.from_json("props", "k bigint")["k"].cast("string").alias("k")
    )
    nested = parsed_cvs(spark, sf_dir).select(
        "id",
        F.get(F.col("cv.experience"), 0)["title"].alias("first_title"),
        F.size("cv.experience").cast("bigint").alias("jobs"),
        F.get(F.col("cv.education"), 0)["institution"]["name"].alias("school"),
    )
    return nested.join(flat, "id")


@query(
    "experience_years",
    f"""WITH periods AS (SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE ELSE date_trunc('month', o_orderdate)::DATE END AS s,
  CASE o_orderkey % 3 WHEN 0 THEN DATE '{AS_OF}' WHEN 1 THEN (o_orderdate::DATE + CAST(o_orderkey % 900 AS INTEGER) - 50)::DATE END AS e FROM orders),
  spans AS (SELECT o_custkey, {views._months("s", "e")} AS m FROM periods WHERE e >= s)
SELECT 'A' || o_custkey AS id, count(*) AS periods, round(CAST(sum(m) AS DOUBLE) / 12, 1) AS total_years FROM spans GROUP BY o_custkey""",
)
def experience_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods as rows: dates in two formats, placeholders, an open end; years summed per CV."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    begin = F.when(key % 2 == 0, F.date_format(date, "yyyy-MM-dd")).otherwise(F.date_format(date, "yyyy-MM"))
    finish = (
        F.when(key % 3 == 0, "Present")
        .when(key % 3 == 1, F.date_format(F.date_add(date, (key % 900).cast("int") - 50), "yyyy-MM-dd"))
        .otherwise("Not Provided")
    )
    orders = spread(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    spans = orders.select(
        "o_custkey", months(parse_date(begin), parse_date(finish, F.to_date(F.lit(AS_OF)))).alias("m")
    )
    return (
        spans.filter(F.col("m").isNotNull())
        .groupBy(F.concat(F.lit("A"), "o_custkey").alias("id"))
        .agg(F.count("*").alias("periods"), years(F.sum("m")).alias("total_years"))
    )


@query(
    "cv_skill_aggregate",
    CV_SQL
    + """SELECT id, CASE WHEN len(skills) = 0 THEN 'various technical skills' ELSE array_to_string(skills, ', ') END AS skills,
  CAST(len(skills) AS BIGINT) AS n FROM cv_all""",
)
def cv_skill_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.coalesce("skill_list", F.array().cast("array<string>"))
    return normalised_cvs(spark, sf_dir).select("id", "skills", F.size(found).cast("bigint").alias("n"))


@query("education_summary", CV_SQL + "SELECT id, education_summary FROM cv_all")
def education_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_cvs(spark, sf_dir).select("id", cvs.education(F.col("cv")).alias("education_summary"))


CV_TEXT_SQL = """'I am a ' || title || CASE WHEN total_years > 0 THEN ' with ' || CAST(CAST(round_even(total_years, 0) AS BIGINT) AS VARCHAR)
    || ' years of experience' ELSE '' END || ', ' || level || '. My skills include: '
  || CASE WHEN len(skills) = 0 THEN 'various technical skills' ELSE array_to_string(skills[1:15], ', ') END || '.'
  || coalesce(' I studied ' || education_summary || '.', '')
  || CASE WHEN company <> 'various organizations' THEN ' I worked as ' || title || ' at ' || company || '.' ELSE '' END"""


def cv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("title", "total_years", "level", "skills", "education_summary", "company")
    rendered = render.cv_text(*[F.col(n) for n in names])
    return normalised_cvs(spark, sf_dir).select("id", "level", text.add_prefix(rendered, presets.QUERY_PREFIX).alias("text"))


@query("render_cv", CV_SQL + f"SELECT id, level, 'query: ' || {CV_TEXT_SQL} AS text FROM cv_all")
def render_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv_texts(spark, sf_dir)


def skilled_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.with_skills(views.postings(spark, sf_dir), views.posting_skills(spark, sf_dir))


SKILLED_SQL = views.with_views("postings", "posting_skills") + ", skilled AS (SELECT p.*, s.job_skills AS skills FROM postings p LEFT JOIN posting_skills s USING (job_link))\n"


@query(
    "render_job_v1",
    SKILLED_SQL
    + f""", l AS (SELECT *, {SENIORITY_REGEX_SQL} AS seniority FROM skilled)
SELECT id, concat_ws(' ', 'Role of ' || job_title || ' at ' || company || ' in ' || job_location || '.',
  'Required skills: ' || array_to_string(string_split(skills, ', ')[1:15], ', ') || '.',
  'Experience level: ' || {_phrases("seniority", presets.LEVEL_PHRASES_SHORT)} || '.',
  CASE WHEN job_type <> 'nan' THEN 'Work type: ' || job_type || '.' END) AS embedding_text FROM l""",
)
def render_job_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = skilled_postings(spark, sf_dir).withColumn("seniority", rules.seniority_by_regex(F.col("job_title")))
    names = ("job_title", "company", "job_location", "skills", "seniority", "job_type")
    return rows.select("id", render.job_text(*[F.col(n) for n in names]).alias("embedding_text"))


LEVEL_LONG_SQL = _phrases("{c}", presets.LEVEL_PHRASES_LONG)
JOB_TEXT_SQL = f"""concat_ws(' ', 'Role of ' || job_title || ' at ' || company || ' in ' || job_location || '.',
  'Required skills: ' || array_to_string(string_split(skills, ', ')[1:10], ', ') || '.',
  'Experience level: ' || {LEVEL_LONG_SQL.format(c="seniority")} || '.',
  CASE WHEN salary_min > 0 AND salary_max > 0 AND salary_max > salary_min THEN 'Salary range: $' || format('{{:,.0f}}', salary_min) || ' to $' || format('{{:,.0f}}', salary_max) || '.'
    WHEN salary_min > 0 THEN 'Minimum salary: $' || format('{{:,.0f}}', salary_min) || '.' END,
  'Work type: ' || {_phrases("lower(job_type)", presets.WORK_TYPE_PHRASES, "job_type")} || '.')"""


def job_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with skills, seniority and the second text template."""
    rows = skilled_postings(spark, sf_dir).withColumn("seniority", rules.seniority_by_substring(F.col("job_title")))
    names = ("job_title", "company", "job_location", "skills", "seniority", "salary_min", "salary_max", "job_type")
    return rows.withColumn("embedding_text", render.job_text_full(*[F.col(n) for n in names]))


JOB_SQL = SKILLED_SQL + f", jobs AS (SELECT *, {JOB_TEXT_SQL} AS embedding_text FROM (SELECT *, {SENIORITY_SUBSTRING_SQL.format(t='job_title')} AS seniority FROM skilled))\n"


@query("render_job_v2", JOB_SQL + "SELECT id, seniority, embedding_text FROM jobs")
def render_job_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_texts(spark, sf_dir).select("id", "seniority", "embedding_text")


def pasted_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings as people paste them: a title line, labelled lines and a paragraph."""
    rows = skilled_postings(spark, sf_dir)
    low, high = F.format_number("salary_min", 0), F.format_number("salary_max", 0)
    lines = F.concat_ws(
        "\n",
        F.when(F.col("id").cast("bigint") % 4 == 0, F.lit("Type: full time")),
        F.lit(""),
        F.concat(F.lit("  "), "job_title", F.lit("  ")),
        F.lit(""),
        F.concat(F.lit("Company: "), "company"),
        F.when(F.col("id").cast("bigint") % 3 != 0, F.concat(F.lit("Location: "), "job_location")),
        F.concat(F.lit("Salary: $"), low, F.lit(" - $"), high),
        F.when(F.col("job_type") != "nan", F.concat(F.lit("We work "), "job_type", F.lit("."))),
        F.when(F.col("id").cast("bigint") % 5 != 0, F.concat((F.col("id").cast("bigint") % 9).cast("string"), F.lit("+ years of work"))),
    )
    listed = F.coalesce(F.split("skills", ", "), F.array().cast("array<string>"))
    return rows.select("id", lines.alias("text"), listed.alias("listed"))


PASTED_SQL = SKILLED_SQL + f""", pasted AS (
  SELECT id, job_title AS title, company, CASE WHEN CAST(id AS BIGINT) % 3 <> 0 THEN job_location ELSE '' END AS location,
    CASE WHEN salary_max IS NOT NULL THEN CAST(replace(format('{{:,.0f}}', salary_min), ',', '') AS BIGINT) END AS salary_min,
    CASE WHEN salary_min IS NOT NULL THEN CAST(replace(format('{{:,.0f}}', salary_max), ',', '') AS BIGINT) END AS salary_max,
    CASE WHEN CAST(id AS BIGINT) % 5 <> 0 THEN (CAST(id AS BIGINT) % 9) || '+' ELSE '' END AS experience_years,
    CASE WHEN lower(job_type) = 'remote' THEN 'remote' WHEN lower(job_type) = 'hybrid' THEN 'hybrid' ELSE 'onsite' END AS remote_status,
    {SENIORITY_SUBSTRING_SQL.format(t="job_title")} AS seniority, skills FROM skilled)
"""


@query(
    "posting_fields",
    PASTED_SQL + "SELECT id, title, company, location, salary_min, salary_max, experience_years, remote_status, seniority FROM pasted",
)
def posting_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pasted_postings(spark, sf_dir).select("id", text.posting_fields(F.col("text")).alias("f")).select("id", "f.*")


@query(
    "render_posting_fields",
    PASTED_SQL
    + f"""SELECT id, 'passage: ' || concat_ws(' ', 'Role of ' || title || ' at ' || company || CASE WHEN location <> '' THEN ' in ' || location ELSE '' END || '.',
  'Required skills: ' || array_to_string(string_split(skills, ', ')[1:10], ', ') || '.', 'Experience level: ' || {LEVEL_LONG_SQL.format(c="seniority")} || '.',
  CASE WHEN salary_min <> 0 AND salary_max <> 0 THEN 'Salary range: $' || format('{{:,}}', salary_min) || ' to $' || format('{{:,}}', salary_max) || '.' END,
  'Work type: ' || CASE remote_status WHEN 'remote' THEN 'Remote work available' WHEN 'hybrid' THEN 'Hybrid work, partially remote' ELSE 'Onsite work' END || '.') AS text
FROM pasted""",
)
def render_posting_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pasted_postings(spark, sf_dir).withColumn("f", text.posting_fields(F.col("text")))
    return rows.select("id", render.posting_text(F.col("f"), F.col("listed")).alias("text"))


@query(
    "prefix_normalise",
    """WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Query: ' WHEN 1 THEN 'query: ' WHEN 2 THEN 'passage: ' ELSE '' END || text AS t FROM documents)
SELECT doc_id, CASE WHEN starts_with(t, 'Query: ') THEN 'query: ' || substr(t, 8) WHEN starts_with(t, 'query: ') THEN t ELSE 'query: ' || t END AS as_query,
  CASE WHEN starts_with(t, 'passage:') THEN t ELSE 'passage: ' || t END AS as_passage, replace(t, 'Query: ', 'query: ') AS fixed,
  replace(replace(replace(t, 'query: ', ''), 'Query: ', ''), 'passage: ', '') AS plain FROM p""",
)
def prefix_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = views.pick(["Query: ", presets.QUERY_PREFIX, presets.PASSAGE_PREFIX, ""], F.col("doc_id") % 4)
    value = F.col("t")
    return views.table(spark, sf_dir, "documents").select("doc_id", F.concat(prefix, "text").alias("t")).select(
        "doc_id",
        text.ensure_query_prefix(value).alias("as_query"),
        text.ensure_prefix(value, presets.PASSAGE_PREFIX).alias("as_passage"),
        text.fix_query_case(value).alias("fixed"),
        text.strip_prefixes(value).alias("plain"),
    )


def _found(words) -> str:
    """How many of the words a text has."""
    listed = ", ".join(f"'{w}'" for w in words)
    return f"list_sum([CAST(contains(lower(text), w) AS INTEGER) for w in [{listed}]])"


DOCUMENT_TYPE_SQL = f"CASE WHEN {_found(presets.JOB_KEYWORDS)} > {_found(presets.CV_KEYWORDS)} THEN 'job' ELSE 'cv' END"


@query(
    "document_type",
    PASTED_SQL
    + f""", typed AS (SELECT 'd' || doc_id AS id, text FROM documents
  UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations
  UNION ALL SELECT 'p' || id, CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN 'About the role: ' WHEN 1 THEN 'Resume and Education. How to apply ' ELSE 'must have ' END
    || title || CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN '. Qualifications and references' ELSE '. Benefits: good' END FROM pasted)
SELECT id, {DOCUMENT_TYPE_SQL} AS type FROM typed""",
)
def document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.documents(spark, sf_dir).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    turns = views.table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    key = F.col("id").cast("bigint")
    ads = views.postings(spark, sf_dir).select(
        F.concat(F.lit("p"), "id").alias("id"),
        F.concat(
            views.pick(["About the role: ", "Resume and Education. How to apply ", "must have "], key % 3),
            "job_title",
            F.when(key % 2 == 0, ". Qualifications and references").otherwise(". Benefits: good"),
        ).alias("text"),
    )
    every = documents.unionByName(turns).unionByName(ads)
    return every.select("id", rules.document_type(F.col("text")).alias("type"))


@query(
    "text_stats",
    """SELECT doc_id, length(text) AS char_count, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS word_count, substr(text, 1, 300) AS preview
FROM documents WHERE length(trim(text, E' \\t\\n\\r\\f\\v')) >= 10""",
)
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = quality.text_sizes(views.documents(spark, sf_dir), "text")
    return sized.filter(F.length(rules.stripped(F.col("text"))) >= presets.MIN_DOCUMENT_CHARS).select(
        "doc_id", F.col("char_count").cast("bigint").alias("char_count"), F.col("word_count").cast("bigint").alias("word_count"),
        text.preview(F.col("text"), 300).alias("preview"),
    )


@query(
    "text_summary",
    """SELECT count(*) AS rows, round(avg(length(text)), 4) AS avg_len, min(length(text)) AS min_len, max(length(text)) AS max_len,
  count(*) FILTER (WHERE length(text) < 50) AS short, round(count(*) FILTER (WHERE length(text) < 50) * 100.0::DOUBLE / count(*), 2) AS short_percent FROM documents""",
)
def text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = quality.text_summary(views.table(spark, sf_dir, "documents"), "text")
    return summary.select(
        "rows", F.round("avg_len", 4).alias("avg_len"), F.col("min_len").cast("bigint").alias("min_len"),
        F.col("max_len").cast("bigint").alias("max_len"), "short", "short_percent",
    )


@query(
    "column_summary",
    CV_SQL + "SELECT min(total_years) AS min, max(total_years) AS max, round(avg(total_years), 6) AS mean FROM cv_all",
)
def column_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.column_summary(normalised_cvs(spark, sf_dir), "total_years").withColumn("mean", F.round("mean", 6))


@query(
    "quality_counters",
    CV_SQL
    + f""", texts AS (SELECT id, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 50 = 0 THEN NULL WHEN CAST(substr(id, 2) AS BIGINT) % 50 = 1 THEN 'Query: ' || t ELSE 'query: ' || t END AS text,
  CASE WHEN CAST(substr(id, 2) AS BIGINT) % 20 = 0 THEN 'X' || id ELSE id END AS shown FROM (SELECT id, {CV_TEXT_SQL} AS t FROM cv_all))
SELECT count(*) AS rows, count(*) - count(text) AS missing, count(*) FILTER (WHERE NOT starts_with(text, 'query: ')) AS wrong_prefix,
  count(*) FILTER (WHERE contains(text, 'I studied')) AS with_phrase, count(*) FILTER (WHERE regexp_matches(shown, '^A[0-9]+$')) AS valid,
  count(*) FILTER (WHERE NOT regexp_matches(shown, '^A[0-9]+$')) AS invalid FROM texts""",
)
def quality_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of texts and ids in which some were spoilt on purpose."""
    key = F.substring("id", 2, 20).cast("bigint")
    rows = cv_texts(spark, sf_dir).select(
        F.when(key % 50 == 0, None)
        .when(key % 50 == 1, F.replace(F.col("text"), F.lit("query: "), F.lit("Query: ")))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(key % 20 == 0, F.concat(F.lit("X"), "id")).otherwise(F.col("id")).alias("shown"),
    )
    texts = quality.text_checks(rows, "text", presets.QUERY_PREFIX, "I studied")
    ids = quality.id_checks(rows, "shown", "A").select(F.struct("valid", "invalid").alias("r")).scalar()
    return texts.select("*", ids["valid"].alias("valid"), ids["invalid"].alias("invalid"))
