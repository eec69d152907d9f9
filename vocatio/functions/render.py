"""Records rendered as the sentences that are embedded and searched."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocatio import presets
from vocatio.functions.rules import is_blank, lookup, stripped
from vocatio.functions.text import add_prefix, first_items


def _text(*pieces: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def _given(value: Column) -> Column:
    """The value, or null for null and the empty string (both count as absent)."""
    return F.when(value != "", value)


def _money(value: Column) -> Column:
    return _text("$", F.format_number(value, 0))


def job_text(
    title: Column, company: Column, location: Column, skills: Column, seniority: Column, job_type: Column
) -> Column:
    """First job template: parts whose fields are missing are left out, nothing at all gives ''."""
    title, company, location = _given(title), _given(company), _given(location)
    role = F.coalesce(
        _text("Role of ", title, " at ", company, " in ", location, "."),
        _text("Role of ", title, " at ", company, "."),
        _text("Role of ", title, "."),
    )
    wanted = _text("Required skills: ", first_items(_given(skills), presets.JOB_SKILLS_LONG), ".")
    level = _text("Experience level: ", lookup(seniority, presets.LEVEL_PHRASES_SHORT), ".")
    work = F.when(~job_type.isin("nan", "None", ""), _text("Work type: ", job_type, "."))
    return F.concat_ws(" ", role, wanted, level, work)


def job_text_full(
    title: Column,
    company: Column,
    location: Column,
    skills: Column,
    seniority: Column,
    salary_min: Column,
    salary_max: Column,
    remote: Column,
) -> Column:
    """Second job template: defaults for title and company, salary and work type where known."""

    def present(value: Column) -> Column:
        return F.when(~is_blank(value), stripped(value))

    role = F.concat_ws(
        "",
        F.lit("Role of "),
        F.coalesce(present(title), F.lit("Unknown Position")),
        F.lit(" at "),
        F.coalesce(present(company), F.lit("a company")),
        _text(" in ", present(location)),
        F.lit("."),
    )
    wanted = F.when(~is_blank(skills), _text("Required skills: ", first_items(skills, presets.JOB_SKILLS_SHORT), "."))

    def phrase(value: Column, phrases: Mapping[str, str]) -> Column:
        return F.when(~is_blank(value), lookup(stripped(F.lower(value)), phrases, value))

    level = _text("Experience level: ", phrase(seniority, presets.LEVEL_PHRASES_LONG), ".")
    # NaN sorts above all numbers in Spark, but is no salary.
    salary_min, salary_max = (F.when(~F.isnan(c), c) for c in (salary_min, salary_max))
    salary = F.when(
        salary_min > 0,
        F.when(
            (salary_max > 0) & (salary_max > salary_min),
            _text("Salary range: ", _money(salary_min), " to ", _money(salary_max), "."),
        ).otherwise(_text("Minimum salary: ", _money(salary_min), ".")),
    )
    work = _text("Work type: ", phrase(remote, presets.WORK_TYPE_PHRASES), ".")
    return F.concat_ws(" ", role, wanted, level, salary, work)


def posting_text(fields: Column, skills: Column) -> Column:
    """Search text of a pasted posting from its extracted fields and its array of skills."""
    role = F.concat_ws(
        "",
        F.lit("Role of "),
        fields["title"],
        F.lit(" at "),
        fields["company"],
        F.when(fields["location"] != "", _text(" in ", fields["location"])),
        F.lit("."),
    )
    wanted = F.when(
        F.size(skills) > 0,
        _text("Required skills: ", F.array_join(F.slice(skills, 1, presets.JOB_SKILLS_SHORT), ", "), "."),
    )
    level = _text(
        "Experience level: ", lookup(fields["seniority"], presets.LEVEL_PHRASES_LONG, fields["seniority"]), "."
    )
    salary = F.when(
        (fields["salary_min"] != 0) & (fields["salary_max"] != 0),
        _text("Salary range: ", _money(fields["salary_min"]), " to ", _money(fields["salary_max"]), "."),
    )
    work = F.when(
        fields["remote_status"] != "",
        _text(
            "Work type: ",
            lookup(fields["remote_status"], presets.WORK_TYPE_PHRASES_POSTING, fields["remote_status"]),
            ".",
        ),
    )
    return add_prefix(F.concat_ws(" ", role, wanted, level, salary, work), presets.PASSAGE_PREFIX)


def cv_text(
    title: Column, years: Column, level: Column, skills: Column, education: Column, company: Column
) -> Column:
    """CV template in the first person; years are rounded half to even."""
    whole_years = F.bround(years, 0).cast("long").cast("string")
    known_company = F.when(company != presets.DEFAULT_COMPANY, company)
    return F.concat_ws(
        "",
        _text("I am a ", F.coalesce(title, F.lit("None"))),
        F.when(years > 0, _text(" with ", whole_years, " years of experience")),
        _text(", ", _given(level)),
        F.lit("."),
        _text(
            " My skills include: ",
            F.array_join(F.slice(F.split(_given(skills), ", "), 1, presets.CV_SKILLS), ", "),
            ".",
        ),
        _text(" I studied ", _given(education), "."),
        _text(" I worked as ", title, " at ", known_company, "."),
    )


def education_summary(level: Column, field: Column, institution: Column) -> Column:
    """'level in field from institution' with the parts that are known; null if none is."""
    degree = F.coalesce(_text(level, " in ", field), level, _text("degree in ", field))
    return F.coalesce(_text(degree, " from ", institution), degree, _text("graduate from ", institution))
