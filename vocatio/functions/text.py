"""Text helpers: prefixes, tokens, candidate terms, posting fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocatio import presets
from vocatio.functions.rules import seniority_by_substring, stripped

TOKEN = r"[\p{L}\p{N}+#]+"


def add_prefix(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), text)


def ensure_prefix(text: Column, prefix: str) -> Column:
    """Add ``prefix`` unless the text starts with its name already."""
    return F.when(text.startswith(prefix.strip()), text).otherwise(add_prefix(text, prefix))


def ensure_query_prefix(text: Column) -> Column:
    """Lower-case query prefix, whatever case it came in."""
    return (
        F.when(text.startswith("Query: "), F.concat(F.lit(presets.QUERY_PREFIX), F.substr(text, F.lit(8))))
        .when(text.startswith(presets.QUERY_PREFIX), text)
        .otherwise(add_prefix(text, presets.QUERY_PREFIX))
    )


def fix_query_case(text: Column) -> Column:
    return F.replace(text, F.lit("Query: "), F.lit(presets.QUERY_PREFIX))


def strip_prefixes(text: Column) -> Column:
    return reduce(
        lambda t, p: F.replace(t, F.lit(p), F.lit("")), [presets.QUERY_PREFIX, "Query: ", presets.PASSAGE_PREFIX], text
    )


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits, ``+`` and ``#``; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def normal_phrase(text: Column) -> Column:
    """A phrase in the same form in which it is looked up: its tokens, one blank apart."""
    return F.array_join(tokens(text), " ")


def split_trim(text: Column) -> Column:
    """Items of a comma-separated list without the blanks around them."""
    return F.transform(F.split(text, ","), lambda s: F.trim(s))


def first_items(text: Column, limit: int) -> Column:
    return F.array_join(F.transform(F.slice(F.split(text, ","), 1, limit), stripped), ", ")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def preview(text: Column, chars: int) -> Column:
    """A shortened copy for display; the whole text stays in its own column."""
    return F.substring(text, 1, chars)


def matching_skills(skills: Column, text: Column) -> Column:
    """The skills that occur in the text as plain substrings, case ignored, order kept."""
    return F.filter(skills, lambda s: F.contains(F.lower(text), F.lower(s)))


def candidate_terms(text: Column) -> Column:
    """Distinct lower-case terms that look like skills.

    Letters and digits beyond ASCII become ``_`` before the patterns run: they still count as
    word characters, so a pattern cannot end inside a word such as "Café".
    """
    folded = F.regexp_replace(text, r"[^\P{L}\x00-\x7F]|[^\P{N}\x00-\x7F]", "_")
    found = [F.regexp_extract_all(folded, F.lit(p), F.lit(1)) for p in presets.CANDIDATE_TERM_PATTERNS]
    section = F.regexp_extract(F.lower(text), presets.CANDIDATE_SECTION_PATTERN, 1)
    items = F.transform(F.split(section, presets.CANDIDATE_SECTION_SEPARATOR), stripped)
    terms = F.transform(F.concat(*found, items), lambda t: F.lower(t))
    kept = F.array_distinct(F.filter(terms, lambda t: F.length(t) > 2))
    return F.coalesce(kept, F.array().cast("array<string>"))


def posting_fields(text: Column) -> Column:
    """Title, company, location, salary range, years, work type and seniority of a pasted posting."""
    width = presets.POSTING_FIELD_CHARS
    lines = F.transform(F.split(text, "\n"), stripped)
    titled = F.filter(lines, lambda line: (line != "") & ~F.lower(line).rlike(presets.POSTING_TITLE_SKIP))
    title = F.coalesce(F.substring(F.get(titled, 0), 1, width), F.lit(""))

    def labelled(pattern: str) -> Column:
        return F.substring(stripped(F.regexp_extract(text, pattern, 1)), 1, width)

    def amount(group: int) -> Column:
        digits = F.replace(F.regexp_extract(text, presets.POSTING_SALARY_PATTERN, group), F.lit(","), F.lit(""))
        return digits.try_cast("bigint")

    low = amount(1)
    years = F.regexp_extract(text, presets.POSTING_YEARS_PATTERN, 1)
    remote = (
        F.when(text.rlike(r"(?i)\bremote\b"), "remote").when(text.rlike(r"(?i)\bhybrid\b"), "hybrid").otherwise("onsite")
    )
    return F.struct(
        title.alias("title"),
        labelled(presets.POSTING_COMPANY_PATTERN).alias("company"),
        labelled(presets.POSTING_LOCATION_PATTERN).alias("location"),
        low.alias("salary_min"),
        F.when(low.isNotNull(), amount(2)).alias("salary_max"),
        F.when(years != "", F.concat(years, F.lit("+"))).otherwise("").alias("experience_years"),
        remote.alias("remote_status"),
        F.coalesce(seniority_by_substring(title), F.lit(presets.SENIORITY_DEFAULT)).alias("seniority"),
    )
