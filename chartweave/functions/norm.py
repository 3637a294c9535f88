"""Scalar normalisation: names, numbers, units, dates, terms."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def any_of(text: Column, words: list[str]) -> Column:
    """Whether a lower-case text contains one of the words."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def canonical(name: Column, kind: str) -> Column:
    """The canonical name of a ``diagnosis`` or ``medication``; other names lose strengths and spare spaces."""
    raw = F.lower(stripped(name))
    chain = F
    for shown, patterns in rules.DIAGNOSIS_NAMES if kind == "diagnosis" else rules.MEDICATION_NAMES:
        chain = chain.when(reduce(lambda a, b: a | b, (raw == p[1:] if p[0] == "=" else raw.contains(p[1:]) for p in patterns)), shown)
    return chain.otherwise(stripped(F.regexp_replace(F.regexp_replace(name, rules.STRENGTH, ""), r"\s+", " ")))


def leading_number(text: Column) -> Column:
    """The number a text starts with, else null."""
    return F.regexp_extract(text, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1).try_cast("double")


def digits_number(text: Column) -> Column:
    """The number left when all but digits and points are dropped ("5-10" gives 510)."""
    return leading_number(F.regexp_replace(text, r"[^\d.]", ""))


def clean_unit(test_name: Column, value: Column, unit: Column) -> Column:
    """Blood-count units: struct of ``value``, ``unit`` and ``status``; doubtful ones are null and ``needs_review``."""
    name, raw = F.lower(stripped(test_name)), F.lower(F.regexp_replace(F.coalesce(unit, F.lit("")), r"\s", ""))
    counts = name.isin("wbc", "white blood cells", "wbc count", "rbc", "red blood cells", "rbc count", "platelets", "platelet count")
    odd = raw.rlike(r"[^a-z0-9/^]")
    bare = value.rlike(r"^\s*\d+\.\d+\s*$") & raw.isin("/ul", "/cumm", "ul", "cumm")
    bad = counts & (odd | bare)
    to = F.when(~counts, unit).when(raw.contains("10^3"), "10^3/uL").when(raw.contains("10^6") | raw.contains("millions"), "10^6/uL").otherwise(F.coalesce(unit, F.lit("")))
    return F.struct(
        F.when(~bad, value).alias("value"), F.when(~bad, to).alias("unit"), F.when(bad, "needs_review").otherwise("normalized").alias("status")
    )


def same_identity(a: Column, b: Column) -> Column:
    """Whether one name, in lower letters and digits only, contains the other."""
    x, y = (F.regexp_replace(F.lower(n), "[^a-z0-9]", "") for n in (a, b))
    return x.contains(y) | y.contains(x)


def age(birth: Column, as_of: Column) -> Column:
    return F.floor(F.months_between(as_of, birth) / 12).cast("int")


def shown_date(text: Column) -> Column:
    """"Jul 5, 2026"; "N/A" for nothing, the text itself if it is no date."""
    empty = text.isNull() | (text == "")
    return F.when(empty, "N/A").otherwise(F.coalesce(F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), "MMM d, yyyy"), text))


def query_terms(question: Column) -> Column:
    """Words of more than three characters, lower-case, repeats kept."""
    return F.filter(F.split(F.regexp_replace(F.lower(question), r"[^\w\s]", ""), r"\s+"), lambda t: F.length(t) > 3)


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9._-]", "_")


def like_any(expr: str, words: list[str]) -> str:
    """SQL for ``any_of`` over a lower-case expression."""
    return "(" + " OR ".join(f"{expr} LIKE '%{w}%'" for w in words) + ")"


def canonical_sql(name: str, kind: str) -> str:
    raw = f"lower(trim({name}))"
    parts = []
    for shown, patterns in rules.DIAGNOSIS_NAMES if kind == "diagnosis" else rules.MEDICATION_NAMES:
        tests = " OR ".join(f"{raw} = '{p[1:]}'" if p[0] == "=" else f"{raw} LIKE '%{p[1:]}%'" for p in patterns)
        parts.append(f"WHEN {tests} THEN '{shown}'")
    pattern = re.sub(r"^\(\?i\)", "", rules.STRENGTH)
    return f"CASE {' '.join(parts)} ELSE trim(regexp_replace(regexp_replace({name}, '{pattern}', '', 'gi'), '\\s+', ' ', 'g')) END"
