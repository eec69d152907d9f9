"""Hand rows for the column functions."""

import pytest
from pyspark.sql import functions as F

from vocatio import presets
from vocatio.functions import dates, hashing, render, rules, text, vectors


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def column(spark, function, values, type_="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r["x"] for r in rows.orderBy("i").select(function(F.col("v")).alias("x")).collect()]


def test_seniority_by_substring(spark):
    titles = [
        "Senior Software Engineer", "Data Science Intern", "Lead Machine Learning Engineer", "Software Developer",
        "Principal Data Scientist", "International Sales Manager", "  ", None, "Sr Engineer", "Sr",
    ]
    expected = ["senior", "intern", "lead", "mid", "principal", "intern", None, None, "senior", "mid"]
    assert column(spark, rules.seniority_by_substring, titles) == expected


def test_seniority_by_regex(spark):
    titles = ["Sr. Manager", "International Buyer", "Engineer II", "Associate Director", "Sales Associate", "Staff Nurse", None, "JR Clerk"]
    expected = ["senior", "mid", "senior", "lead/principal", "junior", "lead/principal", "mid", "junior"]
    assert column(spark, rules.seniority_by_regex, titles) == expected


def test_occupation_group_takes_first_group(spark):
    titles = ["Sales Manager", "Truck Driver", "Store Cook", "Nurse", "Soldier", "Poet", None, "", "Data Entry Clerk", "Janitor"]
    # "cook" holds "coo" of the first group.
    assert column(spark, rules.occupation_group, titles) == [1, 8, 1, 2, 0, 2, 2, 2, 4, 9]


def test_level_by_years_when_missing(spark):
    years = [0.0, 1.9, 2.0, 5.9, 6.0, 10.9, 11.0]
    levels = column(spark, lambda y: rules.cv_level(F.lit(None).cast("string"), y), years, "double")
    assert levels == ["entry level", "entry level", "mid-level", "mid-level", "senior level", "senior level", "expert level"]
    given = column(spark, lambda v: rules.cv_level(v, F.lit(0.0)), ["entry-level", "mid-senior", "senior", "principal", "manager"])
    assert given == ["entry level", "mid-level", "senior level", "expert level", "manager"]


def test_document_type_needs_strictly_more_job_words(spark):
    texts = ["Work Experience, Skills: and Education", "Apply now! Requirements: none", "resume, apply now", ""]
    assert column(spark, rules.document_type, texts) == ["cv", "job", "cv", "cv"]


def test_skill_quality(spark):
    skills = ["Python", "C", "the", "Experience", "data", "data analysis", "remote", "remote work", "go"]
    assert column(spark, rules.is_quality_skill, skills) == [True, False, False, False, False, True, False, True, False]


def test_placeholders(spark):
    values = ["Unknown", "", "Not Provided", None, "Fresher", "ACME"]
    assert column(spark, rules.clean, values) == [None, None, None, None, "Fresher", "ACME"]
    assert column(spark, lambda c: rules.clean(c, presets.COMPANY_PLACEHOLDERS), values)[4:] == [None, "ACME"]


def test_dates(spark):
    as_of = F.to_date(F.lit("2024-06-01"))
    values = ["2020-05-17", "2020-05", "Present", "Unknown", "", "May 2020", "2020-13-01", None, "2020-5-7", "2020-5"]
    found = [str(d) if d else None for d in column(spark, lambda c: dates.parse_date(c, as_of), values)]
    assert found == ["2020-05-17", "2020-05-01", "2024-06-01", None, None, None, None, None, "2020-05-07", "2020-05-01"]
    assert one(spark, dates.years(dates.months(F.to_date(F.lit("2020-01-01")), F.to_date(F.lit("2021-07-01"))))) == 1.5
    assert one(spark, dates.months(F.to_date(F.lit("2021-01-01")), F.to_date(F.lit("2020-07-01")))) is None


def _cv(spark, *values):
    names = ["title", "years", "level", "skills", "education", "company"]
    types = "title string, years double, level string, skills string, education string, company string"
    rows = spark.createDataFrame([values], types)
    return rows.select(render.cv_text(*[F.col(n) for n in names]).alias("x")).first()["x"]


def test_cv_text(spark):
    assert _cv(spark, "Software Engineer", 5.0, "mid-level", "Python, Java, SQL", "Bachelor's in Computer Science from MIT", "Google") == (
        "I am a Software Engineer with 5 years of experience, mid-level. My skills include: Python, Java, SQL. "
        "I studied Bachelor's in Computer Science from MIT. I worked as Software Engineer at Google."
    )
    assert _cv(spark, "Professional", None, "entry level", "Excel, Word", None, "various organizations") == (
        "I am a Professional, entry level. My skills include: Excel, Word."
    )
    assert _cv(spark, "Clerk", 2.5, None, ", ".join(f"s{i}" for i in range(20)), "", None).startswith(
        "I am a Clerk with 2 years of experience. My skills include: s0, s1"
    )
    assert "s15" not in _cv(spark, "Clerk", 0.0, "", ", ".join(f"s{i}" for i in range(20)), None, None)


def _job(spark, *values):
    types = "a string, b string, c string, d string, e string, f double, g double, h string"
    rows = spark.createDataFrame([values], types)
    return rows.select(render.job_text_full(*[F.col(n) for n in "abcdefgh"]).alias("x")).first()["x"]


def test_job_text(spark):
    assert _job(
        spark, "Senior Data Scientist", "Tech Corp", "San Francisco, CA", "Python, Machine Learning, SQL, Spark", "senior", 120000.0, 180000.0, "hybrid"
    ) == (
        "Role of Senior Data Scientist at Tech Corp in San Francisco, CA. Required skills: Python, Machine Learning, SQL, Spark. "
        "Experience level: Senior level, 5+ years experience. Salary range: $120,000 to $180,000. Work type: Hybrid work, partially remote."
    )
    assert _job(spark, None, " ", "", None, "lead/principal", 900.0, 900.0, "night shift") == (
        "Role of Unknown Position at a company. Experience level: lead/principal. Minimum salary: $900. Work type: night shift."
    )


def test_short_job_text(spark):
    def short(*values):
        rows = spark.createDataFrame([values], "a string, b string, c string, d string, e string, f string")
        return rows.select(render.job_text(*[F.col(n) for n in "abcdef"]).alias("x")).first()["x"]

    assert short("Nurse", "Ward", None, "care,  first aid ", "mid", "nan") == (
        "Role of Nurse at Ward. Required skills: care, first aid. Experience level: Mid-level, 3-5 years experience."
    )
    assert short(None, "Ward", "Rome", None, None, None) == ""


def test_education(spark):
    cases = [("Bachelor", "Law", "Yale"), ("Bachelor", None, "Yale"), (None, "Law", None), (None, None, "Yale"), (None, None, None)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, c string")
    found = [r["x"] for r in rows.orderBy("i").select(render.education_summary(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()]
    assert found == ["Bachelor in Law from Yale", "Bachelor from Yale", "degree in Law", "graduate from Yale", None]


POSTING = """Senior Python Developer

Company: TechCorp Inc.
Location: San Francisco, CA (Remote OK)
Salary: $150,000 - $180,000

Requirements:
- 5+ years of Python development
- Django or FastAPI experience"""


def test_posting_fields(spark):
    fields = one(spark, text.posting_fields(F.col("t")), t=POSTING).asDict()
    assert fields == {
        "title": "Senior Python Developer",
        "company": "TechCorp Inc.",
        "location": "San Francisco, CA (Remote OK)",
        "salary_min": 150000,
        "salary_max": 180000,
        "experience_years": "5+",
        "remote_status": "remote",
        "seniority": "senior",
    }
    empty = one(spark, text.posting_fields(F.col("t")), t="Company: X\nType: Y\nsalary , - 5").asDict()
    assert (empty["title"], empty["salary_min"], empty["salary_max"], empty["seniority"]) == ("", None, None, "mid")


def test_posting_text(spark):
    rows = spark.createDataFrame([(POSTING, ["python", "django"])], "t string, s array<string>")
    rendered = rows.select(text.posting_fields(F.col("t")).alias("f"), "s").select(render.posting_text(F.col("f"), F.col("s")).alias("x"))
    assert rendered.first()["x"] == (
        "passage: Role of Senior Python Developer at TechCorp Inc. in San Francisco, CA (Remote OK). Required skills: python, django. "
        "Experience level: Senior level, 5+ years experience. Salary range: $150,000 to $180,000. Work type: Remote work available."
    )


def test_candidate_terms(spark):
    block = "Skills: Python, Django, FastAPI, PostgreSQL, Redis, Kubernetes; big data| go"
    found = set(one(spark, text.candidate_terms(F.col("t")), t=block))
    assert {"python", "django", "fastapi", "postgresql", "redis", "kubernetes", "big data"} <= found and "go" not in found
    other = set(one(spark, text.candidate_terms(F.col("t")), t="Café Node.js AWS Python 3 ÉCOLE x"))
    assert other == {"node.js", "aws", "python", "python 3"}
    assert column(spark, text.candidate_terms, [None, ""]) == [[], []]


@pytest.mark.parametrize(
    ("given", "expected"),
    [("Query: a", "query: a"), ("query: a", "query: a"), ("a", "query: a"), ("query:a", "query: query:a")],
)
def test_query_prefix(spark, given, expected):
    assert one(spark, text.ensure_query_prefix(F.col("t")), t=given) == expected


def test_passage_prefix_and_strip(spark):
    assert column(spark, lambda c: text.ensure_prefix(c, "passage: "), ["passage:a", "a"]) == ["passage:a", "passage: a"]
    assert column(spark, text.strip_prefixes, ["query: Query: a passage: b"]) == ["a b"]


def test_weights_and_labels(spark):
    assert column(spark, rules.action_weight, ["apply", "save", "not_interested", "dance", None]) == [1.0, 0.5, -0.5, 0.0, 0.0]
    assert column(spark, rules.event_signal, ["recruiter_hire", "skip", "dance"]) == [1.0, -0.1, None]
    assert column(spark, rules.match_label, [5.1, 5.0, 0.0], "double") == ["GREAT", "GOOD", "WEAK"]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = rows.select(
        vectors.dot(F.col("a"), F.col("b")).alias("d"), vectors.norm(F.col("a")).alias("n"),
        vectors.normalised(F.col("a"), vectors.norm(F.col("a"))).alias("u"),
    ).first()
    assert (got["d"], got["n"], got["u"]) == (3.0, 5.0, [0.6, 0.8])


def test_draws_do_not_depend_on_partitions(spark):
    ids = spark.range(1000)
    one_way = {r["id"]: r["u"] for r in ids.select("id", hashing.uniform(F.col("id")).alias("u")).collect()}
    other = {r["id"]: r["u"] for r in ids.repartition(7).select("id", hashing.uniform(F.col("id")).alias("u")).collect()}
    assert one_way == other and all(0 <= u < 1 for u in one_way.values())
    assert 0.45 < sum(one_way.values()) / 1000 < 0.55
