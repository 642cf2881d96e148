"""Derived columns: levels, grades, averages, keys, names, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules the delivered data follows.
LEVEL_EDGES = (0, 30, 60, 90)
LEVEL_LABELS = ("Freshman", "Sophomore", "Junior", "Senior")
GRADE_CUTS = (3.85, 3.50, 3.20, 2.85, 2.50, 2.15, 1.85, 1.50, 1.00)
GRADE_LABELS = ("A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D", "F")
GPA_FRACTIONS = (0.0, 0.25, 0.5, 0.75, 1.0)
GPA_POINTS = (0.0, 3.02, 3.31, 3.57, 4.0)
COMPLETION_BASE, COMPLETION_SLOPE, COMPLETION_MAX = 0.70, 0.08, 0.98
SECTION_LETTERS = ("A", "B", "C", "D", "E")


def bucket(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the highest edge not above ``value``.

    ``labels`` has one entry per edge, or one more in front for values below
    the first edge. Null, and values below the first edge without such a
    label, give null; NaN is below every edge.
    """
    below = labels[0] if len(labels) == len(edges) + 1 else None
    named = list(zip(edges, labels[len(labels) - len(edges):]))
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in sorted(named, reverse=True):
        chain = chain.when((value >= F.lit(edge)) & ~F.isnan(value), F.lit(label))
    return chain.otherwise(F.lit(below))


def class_level(credits: Column) -> Column:
    """Year of study by credits (from zero up)."""
    return bucket(credits, LEVEL_EDGES, LEVEL_LABELS)


def letter_grade(points: Column) -> Column:
    """Letter of a grade-point value."""
    ascending = list(reversed(GRADE_LABELS))
    return bucket(points, sorted(GRADE_CUTS), ascending)


def clamp(value: Column, low: float, high: float) -> Column:
    """``value`` forced into [low, high]; null and NaN stay what they are."""
    within = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.when(F.isnan(value), value).when(value.isNotNull(), within)


def round2(value: Column) -> Column:
    """Two decimals, half away from zero on the scaled value."""
    return F.round(value * 100) / 100


def ratio_or_null(top: Column, bottom: Column) -> Column:
    """``top / bottom``, null where ``bottom`` is zero."""
    return F.when(bottom != 0, top / bottom)


def completed_credits(attempted: Column, gpa: Column) -> Column:
    """Credits earned out of the attempted ones, given the term average."""
    share = clamp(F.lit(COMPLETION_BASE) + F.lit(COMPLETION_SLOPE) * gpa, 0.0, COMPLETION_MAX)
    return F.round(attempted * share).cast("int")


def piecewise(value: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Linear interpolation between knots; from the last knot on, its value."""
    chain = F.when(value >= F.lit(xs[-1]), F.lit(ys[-1]))
    for left, right, low, high in zip(xs, xs[1:], ys, ys[1:]):
        step = (value - F.lit(left)) / F.lit(right - left) * F.lit(high - low) + F.lit(low)
        chain = chain.when((value >= F.lit(left)) & (value < F.lit(right)), step)
    return chain


def gpa_from_fraction(fraction: Column) -> Column:
    """Average that stands at a given fraction of the population."""
    return round2(piecewise(fraction, GPA_FRACTIONS, GPA_POINTS))


def credits_in_level(level: Column, fraction: Column) -> Column:
    """Credits at a fraction of the way through a year of study."""
    base = None
    for edge, label in zip(LEVEL_EDGES, LEVEL_LABELS):
        base = (F if base is None else base).when(level == label, F.lit(edge))
    width = LEVEL_EDGES[1] - LEVEL_EDGES[0]
    return F.floor(fraction * width + base).cast("int")


def pad_key(prefix: str, number: Column, width: int) -> Column:
    """``prefix`` and the number with leading zeros; longer numbers keep all digits."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")))


def prefixed_key(prefix: str, key: Column) -> Column:
    """``prefix`` and the key in lower case, such as ``mdl_s000001``."""
    return F.concat(F.lit(prefix), F.lower(key))


def section_letter(number: Column) -> Column:
    """1 to 5 as A to E, null outside."""
    return F.try_element_at(F.array(*[F.lit(x) for x in SECTION_LETTERS]), number.cast("int"))


def section_id(term: Column, subject: Column, catalog: Column, section: Column) -> Column:
    """Course section key ``WD-2024FA-MATH-101A``."""
    number = F.concat(pad_key("", catalog, 3), section_letter(section))
    return F.concat_ws("-", F.lit("WD"), term, subject, number)


def section_parts(key: Column) -> Column:
    """Struct of term, subject, catalog and letter of a course section key."""
    parts = F.split(key, "-")
    number = F.try_element_at(parts, F.lit(4))
    return F.struct(
        F.try_element_at(parts, F.lit(2)).alias("term_code"),
        F.try_element_at(parts, F.lit(3)).alias("subject"),
        F.left(number, F.length(number) - 1).alias("catalog_number"),
        F.right(number, F.lit(1)).alias("section"),
    )


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits of a text."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def full_name(first: Column, last: Column) -> Column:
    return F.concat_ws(" ", first, last)


def email(user: Column, domain: str) -> Column:
    return F.concat(user, F.lit("@" + domain))


def stable_uuid(*keys: Column) -> Column:
    """Version-4 shaped id made from the keys, the same on every retry."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), F.pmod(nibble, F.lit(4)) + 1)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("4"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def json_object(*fields: Column) -> Column:
    """JSON text of the fields, nulls written as ``null``."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def gated(flag: Column, amount: Column) -> Column:
    """``amount`` where the flag is set, zero elsewhere."""
    return F.when(flag, amount).otherwise(F.lit(0))


def collapse_space(text: Column) -> Column:
    """Every run of white space as one blank."""
    return F.regexp_replace(text, r"\s+", " ")


def strip_chars(text: Column, chars: str) -> Column:
    """``text`` without the given characters at either end."""
    return F.btrim(text, F.lit(chars))


def utc_timestamp_text() -> Column:
    """Current time as ISO text in UTC, whatever the session's time zone."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def utc_now() -> Column:
    """Current time; sessions run in UTC."""
    return F.current_timestamp()

