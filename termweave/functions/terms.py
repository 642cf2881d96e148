"""Academic terms: codes such as ``2024FA``, their order and their dates.

A year holds spring, summer and fall in that order, so a term is the integer
``3 * year + rank``. Comparisons, gaps and sequences use that integer; codes
sort wrongly as text (``2024FA`` < ``2024SP``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Seasons in calendar order, code format, months of dated records.
SEASONS = ("SP", "SU", "FA")
TERM_PATTERN = r"^[0-9]{4}(SP|SU|FA)\z"
ACTIVITY_MONTH = {"SP": 4, "SU": 7, "FA": 11}
HOLD_MONTH = {"SP": 1, "SU": 5, "FA": 8}


def _by_season(season: Column, values: dict[str, int]) -> Column:
    chain = None
    for name in SEASONS:
        chain = (F if chain is None else chain).when(season == name, F.lit(values[name]))
    return chain


def term_year(code: Column) -> Column:
    """Year of a well-formed code, null otherwise."""
    return F.when(code.rlike(TERM_PATTERN), F.substring(code, 1, 4).try_cast("int"))


def term_season(code: Column) -> Column:
    """``SP``, ``SU`` or ``FA`` of a well-formed code, null otherwise."""
    return F.when(code.rlike(TERM_PATTERN), F.substring(code, 5, 2))


def term_ord(code: Column, strict: bool = True) -> Column:
    """Position of a term in time. A malformed code is an error, or null if not strict."""
    rank = _by_season(F.substring(code, 5, 2), {s: i for i, s in enumerate(SEASONS)})
    position = F.substring(code, 1, 4).try_cast("int") * 3 + rank
    parsed = F.when(code.rlike(TERM_PATTERN), position)
    if not strict:
        return parsed
    message = F.concat(F.lit("not a term code (year and SP, SU or FA): "), code)
    return parsed.when(code.isNotNull(), F.raise_error(message).cast("int"))


def term_code(position: Column) -> Column:
    """Code of a term position."""
    season = F.element_at(F.array(*[F.lit(s) for s in SEASONS]), F.pmod(position, F.lit(3)).cast("int") + 1)
    return F.concat(F.floor(position / 3).cast("int").cast("string"), season)


def next_term(code: Column, strict: bool = True) -> Column:
    """Code of the following term; fall is followed by spring of the next year."""
    return term_code(term_ord(code, strict) + 1)


def terms_between(first: Column, last: Column) -> Column:
    """Array of term positions from ``first`` to ``last``, empty if reversed."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def term_sequence(spark: SparkSession, start: str, n: int) -> DataFrame:
    """The ``n`` terms from ``start`` on, as (term_ord, term_code)."""
    position = (term_ord(F.lit(start)) + F.col("id")).cast("int")
    return spark.range(n).select(position.alias("term_ord")).select(
        "term_ord", term_code(F.col("term_ord")).alias("term_code")
    )


def term_ord_of_date(day: Column) -> Column:
    """Position of the term a date falls in: spring to April, summer to July, then fall."""
    month = F.month(day)
    return F.year(day) * 3 + F.when(month <= 4, 0).when(month <= 7, 1).otherwise(2)


def term_of_date(day: Column) -> Column:
    """Code of the term a date falls in."""
    return term_code(term_ord_of_date(day))


def activity_month(season: Column) -> Column:
    """Month in which a season's activity is dated."""
    return _by_season(season, ACTIVITY_MONTH)


def hold_month(season: Column) -> Column:
    """Month in which a season's holds are placed."""
    return _by_season(season, HOLD_MONTH)


def term_date(code: Column, month: Column, day: Column) -> Column:
    """A date in the year of a term."""
    return F.make_date(term_year(code), month, day)


def iso_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")
