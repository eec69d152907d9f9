"""Ordered rule tables turned into one ``CASE`` expression."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocatio import presets


def first_match(rules: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule whose condition holds."""
    rules = list(rules)
    chain = reduce(lambda acc, rule: acc.when(rule[0], F.lit(rule[1])), rules[1:], F.when(rules[0][0], F.lit(rules[0][1])))
    return chain.otherwise(F.lit(default))


def any_of(text: Column, words: Sequence[str]) -> Column:
    """True if ``text`` holds one of ``words`` as a plain substring.

    One alternation per rule keeps the plan small. A search per word takes half the time per row,
    but seconds more to plan and compile in every query.
    """
    return text.rlike("|".join(re.escape(w) for w in words))


def stripped(value: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(value, F.lit(" \t\n\r\f\v"))


def is_blank(value: Column) -> Column:
    return value.isNull() | (stripped(value) == "")


def seniority_by_regex(title: Column) -> Column:
    """Five levels by word-bounded patterns; a null title is the default level."""
    return first_match(
        ((title.rlike(p), level) for level, p in presets.SENIORITY_REGEX_RULES), presets.SENIORITY_DEFAULT
    )


def seniority_by_substring(title: Column) -> Column:
    """Six levels by plain substrings ("International" holds "intern"); blank titles give null."""
    lowered = F.lower(title)
    level = first_match(
        ((any_of(lowered, words), level) for level, words in presets.SENIORITY_SUBSTRING_RULES),
        presets.SENIORITY_DEFAULT,
    )
    return F.when(~is_blank(title), level)


def occupation_group(title: Column) -> Column:
    """Occupation major group by plain substrings; no hit, blank and null give the default."""
    lowered = F.lower(title)
    return first_match(
        ((any_of(lowered, words), code) for code, words in presets.OCCUPATION_RULES), presets.OCCUPATION_DEFAULT
    ).cast("int")


def lookup(key: Column, table: Mapping, default: Column | None = None) -> Column:
    """``table[key]``, or ``default`` where the key is missing."""
    found = first_match(((key == F.lit(k)), v) for k, v in table.items())
    return found if default is None else F.coalesce(found, default)


def occupation_name(code: Column) -> Column:
    return lookup(code, presets.OCCUPATION_NAMES, F.lit("Unknown"))


def clean(value: Column, extra: Sequence[str] = ()) -> Column:
    """Placeholders become null."""
    return F.when(~value.isin(*presets.PLACEHOLDERS, *extra), value)


def cv_level(level: Column, years: Column) -> Column:
    """Synonyms of a given level are unified; a missing level follows from the years."""
    named = first_match((level.isin(*names), target) for target, names in presets.LEVEL_SYNONYMS)
    by_years = first_match(((years < bound, name) for bound, name in presets.LEVEL_BY_YEARS), presets.LEVEL_ABOVE)
    return F.when(level.isNotNull(), F.coalesce(named, level)).otherwise(by_years)


def document_type(text: Column) -> Column:
    """'job' only if strictly more job keywords than CV keywords occur; else 'cv'."""
    lowered = F.lower(text)

    def hits(words: Sequence[str]) -> Column:
        return reduce(lambda a, b: a + b, (F.contains(lowered, F.lit(w)).cast("int") for w in words))

    return F.when(hits(presets.JOB_KEYWORDS) > hits(presets.CV_KEYWORDS), "job").otherwise("cv")


def match_label(score: Column) -> Column:
    return first_match([(score > presets.GREAT_ABOVE, "GREAT"), (score > presets.GOOD_ABOVE, "GOOD")], "WEAK")


def is_quality_skill(skill: Column) -> Column:
    """Long enough, no stop word, no generic word; single generic nouns are out, phrases stay."""
    lowered = F.trim(F.lower(skill))
    return (
        (F.length(lowered) >= presets.MIN_SKILL_LENGTH)
        & ~lowered.isin(*presets.STOPWORDS)
        & ~lowered.isin(*presets.GENERIC_WORDS)
        & ~lowered.isin(*presets.GENERIC_SINGLE_WORDS)
    )


def action_weight(action: Column) -> Column:
    return lookup(action, presets.ACTION_WEIGHTS, F.lit(0.0))


def event_signal(event_type: Column) -> Column:
    return lookup(event_type, presets.EVENT_SIGNALS)
