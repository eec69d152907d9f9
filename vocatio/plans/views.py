"""Postings, CVs, skills, feedback and vectors derived from the given tables.

The tables hold no postings or CVs; these views give every row of a table a role. They are lazy
DataFrames over whole tables, so the work of a query grows with its tables. ``SQL`` holds the same
definitions for the check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio.session import spread

TITLE_PREFIXES = ["Senior", "Junior", "Lead", "Intern", "Principal", "", "International", "Sr."]
OCCUPATIONS = [
    "Sales", "Engineer", "Data Analyst", "Truck Driver", "Manager", "Nurse", "Clerk", "Store Cook", "Electrician",
    "Janitor", "Soldier", "Farmer",
]
JOB_LEVELS = ["Mid senior", "Associate", "", "nan", None]
JOB_TYPES = ["Onsite", "Remote", "hybrid", "nan"]
CV_LEVELS = ["entry", "junior", "mid", "senior", "principal", "manager", "Unknown", "", None]
LANGUAGES = ["Python", "SQL", "Java", "Scala", "", "Unknown"]
FRAMEWORKS = ["Spark", "Django", "React", "Python"]
FIELDS_OF_STUDY = ["Computer Science", "Unknown", None, "Nursing"]
DEGREES = ["Bachelor", None, "Master", "Not Provided"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files, whether it is one file or a folder of many.

    A plain path must be a folder and a filter by name would look at the files in it, so the path is a pattern that fits the table alone.
    """
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pick(values: list, at: Column) -> Column:
    """``values[at]`` as a column."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), at.cast("int"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    low = F.round(F.col("p_retailprice") * 50, 2)
    return table(spark, sf_dir, "part").select(
        key.cast("string").alias("id"),
        pick(["linkedin", "indeed", "glassdoor"], key % 3).alias("source"),
        F.trim(F.concat_ws(" ", pick(TITLE_PREFIXES, key % 8), pick(OCCUPATIONS, size % 12), "p_name")).alias("job_title"),
        F.col("p_brand").alias("company"),
        F.col("p_type").alias("job_location"),
        F.when(key % 3 == 0, F.concat(F.lit("link/"), key.cast("string"))).alias("job_link"),
        pick(JOB_LEVELS, size % 5).alias("job_level"),
        pick(JOB_TYPES, size % 4).alias("job_type"),
        F.when(size % 6 == 0, None).when(size % 6 == 1, 0.0).otherwise(low).alias("salary_min"),
        F.when(size % 6 == 2, None).when(size % 6 == 3, low - 1).otherwise(low + 10000).alias("salary_max"),
    )


def posting_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_link, job_skills): the names of the parts numbered like a posting's suppliers."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_suppkey"), "p_name")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().join(names, "l_suppkey")
    return lines.groupBy("l_partkey").agg(F.collect_set("p_name").alias("s")).select(
        F.concat(F.lit("link/"), F.col("l_partkey").cast("string")).alias("job_link"),
        F.array_join(F.array_sort("s"), ", ").alias("job_skills"),
    )


def raw_cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, raw_data): one nested JSON document per order, some of them broken."""
    order, cust, date = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    orders = spread(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    ).join(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey"
    )

    def day(value: Column) -> Column:
        return F.date_format(value, "yyyy-MM-dd")

    def month(value: Column) -> Column:
        return F.date_format(value, "yyyy-MM")

    start = F.when(order % 2 == 0, day(date)).otherwise(month(date))
    end = (
        F.when(order % 4 == 0, "Present")
        .when(order % 4 == 1, day(F.date_add(date, (order % 2000).cast("int"))))
        .when(order % 4 == 2, "Unknown")
        .otherwise(month(F.date_add(date, (cust % 1000).cast("int") - 100)))
    )

    def job(company: Column, title: Column, level: Column, begin: Column, finish: Column, used: Column) -> Column:
        return F.struct(
            company.alias("company"),
            title.alias("title"),
            level.alias("level"),
            F.struct(begin.alias("start"), finish.alias("end")).alias("dates"),
            F.struct(used.alias("technologies")).alias("technical_environment"),
        )

    company = (
        F.when(order % 7 == 0, "Unknown").when(order % 7 == 1, "Fresher").when(order % 7 == 2, None).otherwise(F.col("c_mktsegment"))
    )
    title = F.when(order % 5 == 0, "Not Provided").otherwise(pick(OCCUPATIONS, order % 12))
    first = job(
        company, title, pick(CV_LEVELS, order % 9), start, end,
        F.array(F.col("o_orderpriority"), F.lit("Unknown"), F.lit(None).cast("string")),
    )
    second = job(
        F.lit("Older"), F.lit("Helper"), F.lit("senior"), month(F.date_sub(date, 400)), day(date),
        F.array(F.col("o_orderstatus")),
    )
    experience = F.when(order % 3 == 0, F.array(first, second)).otherwise(F.array(first))

    def named(value: Column) -> Column:
        return F.array(F.struct(value.alias("name")))

    technical = F.when(order % 8 != 0, F.struct(
        named(pick(LANGUAGES, cust % 6)).alias("programming_languages"),
        named(pick(FRAMEWORKS, order % 4)).alias("frameworks"),
        named(F.lit("Not Provided")).alias("other"),
    ))
    study = F.struct(
        F.struct(pick(DEGREES, order % 4).alias("level"), pick(FIELDS_OF_STUDY, cust % 4).alias("field")).alias("degree"),
        F.struct(F.when(order % 6 < 4, F.col("c_mktsegment")).alias("name")).alias("institution"),
    )
    education = F.when(order % 11 == 0, F.array().cast(f"array<{_study_type()}>")).otherwise(F.array(study))
    document = F.to_json(
        F.struct(
            experience.alias("experience"),
            F.struct(technical.alias("technical")).alias("skills"),
            education.alias("education"),
        )
    )
    return orders.select(
        F.concat(F.lit("A"), order.cast("string")).alias("id"),
        F.lit("resumes").alias("source"),
        F.when(order % 97 == 0, "{broken").otherwise(document).alias("raw_data"),
    )


def _study_type() -> str:
    return "struct<degree:struct<level:string,field:string>,institution:struct<name:string>>"


EVENT_NAMES = {
    "purchase": "recruiter_hire",
    "signup": "candidate_apply",
    "click": "candidate_save",
    "view": "candidate_view",
    "error": "recruiter_reject",
}
ACTION_NAMES = {"purchase": "hire", "signup": "apply", "click": "save", "view": "view_full", "error": "not_interested"}


def _renamed(column: str, names: dict[str, str]) -> Column:
    entries = [F.lit(x) for pair in names.items() for x in pair]
    return F.element_at(F.create_map(*entries), F.col(column))


def feedback_events(events: DataFrame) -> DataFrame:
    """Feedback rows of an events table or stream; times become zoned for watermarks."""
    from vocatio.functions.rules import event_signal

    named = events.withColumn("event_type", _renamed("event_type", EVENT_NAMES))
    return named.select(
        F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("cv_id"),
        F.concat(F.lit("B"), F.get_json_object("props", "$.k")).alias("job_id"),
        "event_type",
        event_signal(F.col("event_type")).alias("signal_strength"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback_events(table(spark, sf_dir, "events"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action log, one row per event; some actions are unknown, some texts missing."""
    from vocatio.operators.feedback import logged

    k = F.get_json_object("props", "$.k")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), "p_name")
    value = F.col("value")
    events = table(spark, sf_dir, "events").withColumn("k", k).join(parts, "k", "left")
    return logged(
        events.select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
            F.when(F.col("user_id") % 2 == 0, "recruiter").otherwise("job_seeker").alias("role"),
            F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("doc_id"),
            F.concat(F.lit("B"), "k").alias("match_id"),
            F.when(value < 1, "skip").when(value > 200, "wave").otherwise(_renamed("event_type", ACTION_NAMES)).alias("action"),
            value.alias("similarity_score"),
            F.when(value >= 2, F.concat(F.lit("query: user "), F.col("user_id").cast("string"))).alias("cv_text"),
            F.concat(F.lit("passage: "), "p_name").alias("job_text"),
            F.col("ts").cast("timestamp").alias("timestamp"),
        )
    )


def cv_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a query; its label stands for the occupation group."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("A"), F.col("vec_id").cast("string")).alias("query_id"), F.col("embedding").alias("vector"), "label"
    )


def job_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as an item, its two halves swapped so that no query finds itself."""
    v = F.col("embedding")
    half = F.floor(F.size(v) / 2).cast("int")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("B"), F.col("vec_id").cast("string")).alias("item_id"),
        F.concat(F.slice(v, half + 1, F.size(v)), F.slice(v, F.lit(1), half)).alias("vector"),
        "label",
    )


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views for SQL: jobs, job_skills, raw_cvs, feedback_events, user_actions."""
    for name, build in {
        "jobs": postings, "job_skills": posting_skills, "raw_cvs": raw_cvs, "feedback_events": feedback, "user_actions": actions,
    }.items():
        build(spark, sf_dir).createOrReplaceTempView(name)


def _quoted(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values: list, at: str) -> str:
    return f"list_extract({_quoted(values)}, CAST({at} AS INTEGER) + 1)"


def _case(column: str, names: dict[str, str]) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


SQL = {
    "postings": f"""postings AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id,
    {_pick(["linkedin", "indeed", "glassdoor"], "p_partkey % 3")} AS source,
    trim(concat_ws(' ', {_pick(TITLE_PREFIXES, "p_partkey % 8")}, {_pick(OCCUPATIONS, "p_size % 12")}, p_name)) AS job_title,
    p_brand AS company, p_type AS job_location,
    CASE WHEN p_partkey % 3 = 0 THEN 'link/' || p_partkey END AS job_link,
    {_pick(JOB_LEVELS, "p_size % 5")} AS job_level,
    {_pick(JOB_TYPES, "p_size % 4")} AS job_type,
    CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN 0.0::DOUBLE ELSE round(p_retailprice * 50, 2) END AS salary_min,
    CASE p_size % 6 WHEN 2 THEN NULL WHEN 3 THEN round(p_retailprice * 50, 2) - 1 ELSE round(p_retailprice * 50, 2) + 10000 END AS salary_max
  FROM part)""",
    "posting_skills": """posting_skills AS (
  SELECT 'link/' || l_partkey AS job_link, array_to_string(list_sort(list(DISTINCT p_name)), ', ') AS job_skills
  FROM lineitem JOIN part ON p_partkey = l_suppkey GROUP BY l_partkey)""",
    "cvs": f"""cv_rows AS (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, c_mktsegment AS seg, o_orderpriority AS prio,
    o_orderstatus AS stat, o_orderkey % 97 = 0 AS broken
  FROM orders JOIN customer ON c_custkey = o_custkey),
cvs AS (
  SELECT 'A' || k AS id,
    CASE WHEN broken OR k % 5 = 0 THEN 'Professional' ELSE {_pick(OCCUPATIONS, "k % 12")} END AS title,
    CASE WHEN broken OR k % 7 IN (0, 1, 2) THEN 'various organizations' ELSE seg END AS company,
    CASE WHEN broken THEN NULL ELSE nullif(nullif({_pick(CV_LEVELS, "k % 9")}, ''), 'Unknown') END AS given_level,
    CASE WHEN broken THEN NULL WHEN k % 2 = 0 THEN d ELSE date_trunc('month', d)::DATE END AS s1,
    CASE WHEN broken THEN NULL WHEN k % 4 = 0 THEN DATE '2002-01-01' WHEN k % 4 = 1 THEN (d + CAST(k % 2000 AS INTEGER))::DATE
         WHEN k % 4 = 2 THEN NULL ELSE date_trunc('month', d + (CAST(c % 1000 AS INTEGER) - 100))::DATE END AS e1,
    CASE WHEN NOT broken AND k % 3 = 0 THEN date_trunc('month', d - 400)::DATE END AS s2,
    CASE WHEN NOT broken AND k % 3 = 0 THEN d END AS e2,
    CASE WHEN broken THEN [] ELSE list_sort(list_distinct(list_filter([
      CASE WHEN k % 8 <> 0 THEN {_pick(LANGUAGES, "c % 6")} END, CASE WHEN k % 8 <> 0 THEN {_pick(FRAMEWORKS, "k % 4")} END,
      prio, CASE WHEN k % 3 = 0 THEN stat END], lambda x: x IS NOT NULL AND x NOT IN ('', 'Unknown', 'Not Provided')))) END AS skills,
    CASE WHEN NOT broken AND k % 11 <> 0 THEN nullif({_pick(DEGREES, "k % 4")}, 'Not Provided') END AS degree,
    CASE WHEN NOT broken AND k % 11 <> 0 THEN nullif({_pick(FIELDS_OF_STUDY, "c % 4")}, 'Unknown') END AS field,
    CASE WHEN NOT broken AND k % 11 <> 0 AND k % 6 < 4 THEN seg END AS school
  FROM cv_rows),
cv_months AS (
  SELECT *, CASE WHEN e1 >= s1 THEN {{m1}} ELSE 0 END + CASE WHEN e2 >= s2 THEN {{m2}} ELSE 0 END AS months FROM cvs),
cv_years AS (SELECT *, round(CAST(months AS DOUBLE) / 12, 1) AS total_years FROM cv_months),
cv_full AS (
  SELECT *, CASE WHEN given_level IN ('entry', 'entry-level', 'intern', 'junior') THEN 'entry level'
      WHEN given_level IN ('mid', 'mid-senior') THEN 'mid-level' WHEN given_level = 'senior' THEN 'senior level'
      WHEN given_level IN ('expert', 'principal') THEN 'expert level' WHEN given_level IS NOT NULL THEN given_level
      WHEN total_years < 2 THEN 'entry level' WHEN total_years < 6 THEN 'mid-level' WHEN total_years < 11 THEN 'senior level'
      ELSE 'expert level' END AS level,
    CASE WHEN degree IS NOT NULL AND field IS NOT NULL THEN degree || ' in ' || field WHEN degree IS NOT NULL THEN degree
      WHEN field IS NOT NULL THEN 'degree in ' || field END AS degree_part FROM cv_years),
cv_all AS (
  SELECT *, CASE WHEN degree_part IS NOT NULL AND school IS NOT NULL THEN degree_part || ' from ' || school
      WHEN degree_part IS NOT NULL THEN degree_part WHEN school IS NOT NULL THEN 'graduate from ' || school END AS education_summary
  FROM cv_full)""",
    "feedback": f"""feedback AS (
  SELECT 'A' || user_id AS cv_id, 'B' || regexp_extract(props, '\\d+') AS job_id, {_case("event_type", EVENT_NAMES)} AS event_type,
    CAST(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.5 WHEN 'click' THEN 0.3 WHEN 'view' THEN 0.1 ELSE -0.3 END AS DOUBLE) AS signal_strength,
    ts AS "timestamp" FROM events)""",
    "actions": f"""acted AS (
  SELECT event_id AS id, 's' || user_id AS session_id, CASE WHEN user_id % 2 = 0 THEN 'recruiter' ELSE 'job_seeker' END AS role,
    'A' || user_id AS doc_id, 'B' || regexp_extract(props, '\\d+') AS match_id,
    CASE WHEN value < 1 THEN 'skip' WHEN value > 200 THEN 'wave' ELSE {_case("event_type", ACTION_NAMES)} END AS action,
    value AS similarity_score, CASE WHEN value >= 2 THEN 'query: user ' || user_id END AS cv_text,
    'passage: ' || p_name AS job_text, ts AS "timestamp"
  FROM events LEFT JOIN part ON p_partkey = CAST(regexp_extract(props, '\\d+') AS BIGINT)),
actions AS (
  SELECT *, CAST(CASE action WHEN 'apply' THEN 1.0 WHEN 'contact' THEN 1.0 WHEN 'hire' THEN 1.0 WHEN 'save' THEN 0.5
    WHEN 'view_full' THEN 0.3 WHEN 'not_interested' THEN -0.5 ELSE 0.0 END AS DOUBLE) AS weight FROM acted)""",
    "vectors": """cv_vec AS (SELECT 'A' || vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
job_vec AS (
  SELECT 'B' || vec_id AS item_id, label,
    list_concat(CAST(embedding AS DOUBLE[])[len(embedding) // 2 + 1:], CAST(embedding AS DOUBLE[])[1:len(embedding) // 2]) AS v
  FROM embeddings),
pairs AS (
  SELECT query_id, item_id, c.label AS query_label, j.label AS item_label,
    floor(list_dot_product(c.v, j.v) * 1000000 + 0.5) / 1000000 AS score FROM cv_vec c, job_vec j)""",
}


def _months(s: str, e: str) -> str:
    """Months between two dates, as Spark counts them."""
    return (
        f"CAST(round((year({e}) - year({s})) * 12 + month({e}) - month({s}) + CASE WHEN day({e}) = day({s}) "
        f"OR ({e} = last_day({e}) AND {s} = last_day({s})) THEN 0 ELSE (day({e}) - day({s})) / 31.0::DOUBLE END, 8) AS DECIMAL(20, 8))"
    )


SQL["cvs"] = SQL["cvs"].format(m1=_months("s1", "e1"), m2=_months("s2", "e2"))


def with_views(*names: str) -> str:
    """The head of a SQL query: ``WITH`` and the named definitions."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
