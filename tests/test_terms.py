from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from termweave.functions import terms


def one(spark, column, **fields):
    ddl = ", ".join(f"{k} {'date' if isinstance(v, dt.date) else 'int' if isinstance(v, int) else 'string'}" for k, v in fields.items())
    return spark.createDataFrame([tuple(fields.values())], ddl).select(column).first()[0]


@pytest.mark.parametrize(
    "code, ordinal, following",
    [("2024SP", 6072, "2024SU"), ("2024SU", 6073, "2024FA"), ("2024FA", 6074, "2025SP"), ("0001FA", 5, "2SP")],
)
def test_order_and_next(spark, code, ordinal, following):
    assert one(spark, terms.term_ord(F.col("c")), c=code) == ordinal
    if len(following) == 6:
        assert one(spark, terms.next_term(F.col("c")), c=code) == following
        assert one(spark, terms.term_code(F.col("n")), n=ordinal) == code


@pytest.mark.parametrize("bad", ["2024F", "2024WI", "20X4FA", "2024fa", " 2024FA", "2024FA ", "2024FA\n", ""])
def test_malformed_codes(spark, bad):
    assert one(spark, terms.term_ord(F.col("c"), strict=False), c=bad) is None
    assert one(spark, terms.term_year(F.col("c")), c=bad) is None
    with pytest.raises(Exception, match="not a term code"):
        one(spark, terms.term_ord(F.col("c")), c=bad)


def test_null_code_is_null_even_when_strict(spark):
    assert one(spark, terms.term_ord(F.col("c")), c=None) is None


def test_codes_sort_by_time_not_by_text(spark, rows):
    codes = rows("c string", ("2024FA",), ("2024SP",), ("2023FA",), ("2024SU",))
    ordered = [r.c for r in codes.orderBy(terms.term_ord(F.col("c"))).collect()]
    assert ordered == ["2023FA", "2024SP", "2024SU", "2024FA"]


def test_sequence(spark):
    got = [r.term_code for r in terms.term_sequence(spark, "2023FA", 5).orderBy("term_ord").collect()]
    assert got == ["2023FA", "2024SP", "2024SU", "2024FA", "2025SP"]
    assert terms.term_sequence(spark, "2023FA", 0).count() == 0


def test_terms_between_is_empty_when_reversed(spark, rows):
    spans = rows("a int, z int", (5, 7), (5, 5), (5, 4))
    assert [r[0] for r in spans.select(terms.terms_between(F.col("a"), F.col("z"))).collect()] == [[5, 6, 7], [5], []]


@pytest.mark.parametrize(
    "day, code",
    [("2024-01-01", "2024SP"), ("2024-04-30", "2024SP"), ("2024-05-01", "2024SU"), ("2024-07-31", "2024SU"),
     ("2024-08-01", "2024FA"), ("2024-12-31", "2024FA")],
)
def test_term_of_date(spark, day, code):
    assert one(spark, terms.term_of_date(F.col("d")), d=dt.date.fromisoformat(day)) == code


def test_months_lie_inside_their_term(spark, rows):
    codes = rows("c string", ("2024SP",), ("2024SU",), ("2024FA",))
    season = terms.term_season(F.col("c"))
    for month in (terms.activity_month(season), terms.hold_month(season)):
        day = terms.term_date(F.col("c"), month, F.lit(28))
        assert codes.filter(terms.term_of_date(day) != F.col("c")).count() == 0
