from __future__ import annotations

import re
import uuid

import pytest
from pyspark.sql import functions as F

from termweave.functions import catalogs, derive, hashing


def column(spark, ddl, data, expr):
    return [r[0] for r in spark.createDataFrame([(v,) for v in data], ddl).select(expr).collect()]


def test_class_level_boundaries(spark):
    got = column(spark, "x int", [0, 29, 30, 59, 60, 89, 90, 400, None], derive.class_level(F.col("x")))
    assert got == ["Freshman"] * 2 + ["Sophomore"] * 2 + ["Junior"] * 2 + ["Senior"] * 2 + [None]


def test_letter_grade_cut_points(spark):
    for cut, at, below in zip(derive.GRADE_CUTS, derive.GRADE_LABELS, derive.GRADE_LABELS[1:]):
        got = column(spark, "x double", [cut, cut + 0.01, cut - 0.01], derive.letter_grade(F.col("x")))
        assert got == [at, at, below], cut
    assert column(spark, "x double", [4.0, 0.0, None], derive.letter_grade(F.col("x"))) == ["A", "F", None]


def test_round2_is_half_away_from_zero(spark):
    got = column(spark, "x double", [1.005, 2.675, 0.125, -0.125, 3.3, None], derive.round2(F.col("x")))
    # 1.005 * 100 is 100.49999999999999 in binary, 0.125 * 100 is exactly 12.5
    assert got == [1.0, 2.68, 0.13, -0.13, 3.3, None]


def test_clamp_keeps_null(spark):
    assert column(spark, "x double", [-1.0, 0.5, 9.0, None], derive.clamp(F.col("x"), 0.0, 4.0)) == [0.0, 0.5, 4.0, None]


def test_ratio_or_null(spark, rows):
    df = rows("a int, b int", (1, 2), (1, 0), (None, 2), (1, None))
    assert [r[0] for r in df.select(derive.ratio_or_null(F.col("a"), F.col("b"))).collect()] == [0.5, None, None, None]


def test_completed_credits(spark, rows):
    df = rows("a int, g double", (18, 3.36), (13, 3.3), (4, 1.51), (12, 4.0), (12, 0.0), (None, None))
    got = [r[0] for r in df.select(derive.completed_credits(F.col("a"), F.col("g"))).collect()]
    assert got == [17, 13, 3, 12, 8, None]


def test_gpa_curve(spark):
    got = column(spark, "x double", [0.0, 0.125, 0.25, 0.5, 0.75, 0.999999, 1.0], derive.gpa_from_fraction(F.col("x")))
    assert got == [0.0, 1.51, 3.02, 3.31, 3.57, 4.0, 4.0]


def test_credits_in_level(spark, rows):
    df = rows("l string, u double", ("Freshman", 0.0), ("Freshman", 0.999), ("Sophomore", 0.0), ("Junior", 0.5), ("Senior", 0.999), (None, 0.5))
    got = [r[0] for r in df.select(derive.credits_in_level(F.col("l"), F.col("u"))).collect()]
    assert got == [0, 29, 30, 75, 119, None]


def test_padded_keys_keep_long_numbers(spark):
    assert column(spark, "n bigint", [1, 999999, 1234567], derive.pad_key("S", F.col("n"), 6)) == ["S000001", "S999999", "S1234567"]
    assert column(spark, "k string", ["S000001"], derive.prefixed_key("mdl_", F.col("k"))) == ["mdl_s000001"]


def test_section_ids(spark, rows):
    df = rows("t string, s string, c int, n int", ("2024FA", "MATH", 7, 1), ("2024SP", "BIOL", 150, 5))
    key = derive.section_id(F.col("t"), F.col("s"), F.col("c"), F.col("n"))
    assert [r[0] for r in df.select(key).collect()] == ["WD-2024FA-MATH-007A", "WD-2024SP-BIOL-150E"]
    parts = df.select(derive.section_parts(key).alias("p")).select("p.*").collect()
    assert [tuple(p) for p in parts] == [("2024FA", "MATH", "007", "A"), ("2024SP", "BIOL", "150", "E")]
    assert column(spark, "n int", [0, 1, 5, 6], derive.section_letter(F.nullif(F.col("n"), F.lit(0)))) == [None, "A", "E", None]


def test_slug(spark):
    got = column(spark, "x string", ["Alex Kim", "Zoë O'Neil-3", "  ", None], derive.slug(F.col("x")))
    assert got == ["alexkim", "zooneil3", "", None]


def test_stable_uuid_has_version_and_variant(spark):
    ids = column(spark, "n int", list(range(200)), derive.stable_uuid(F.col("n")))
    assert len(set(ids)) == 200
    assert all(uuid.UUID(i).version == 4 and uuid.UUID(i).variant == uuid.RFC_4122 for i in ids)
    assert ids == column(spark, "n int", list(range(200)), derive.stable_uuid(F.col("n")))


def test_json_object_writes_nulls(spark, rows):
    df = rows("a int, b string", (1, None))
    assert df.select(derive.json_object(F.col("a"), F.col("b"))).first()[0] == '{"a":1,"b":null}'


def test_text_helpers(spark):
    assert column(spark, "x string", ["a \n\t b  c"], derive.collapse_space(F.col("x"))) == ["a b c"]
    assert column(spark, "x string", [",;a,b;,", ";", "a"], derive.strip_chars(F.col("x"), ",;")) == ["a,b", "", "a"]


def test_hash_fraction_is_even_and_salted(spark):
    df = spark.range(20000)
    a, b = hashing.hash_fraction("a", F.col("id")), hashing.hash_fraction("b", F.col("id"))
    low, high, mean, both = df.select(F.min(a), F.max(a), F.avg(a), F.avg((a < 0.5).cast("int") * (b < 0.5).cast("int"))).first()
    assert 0 <= low < 0.001 and 0.999 < high < 1 and abs(mean - 0.5) < 0.01 and abs(both - 0.25) < 0.02


def test_weighted_choice_follows_weights(spark):
    total = sum(catalogs.MAJORS.values())
    major = hashing.weighted_choice(hashing.hash_fraction("m", F.col("id")), list(catalogs.MAJORS), list(catalogs.MAJORS.values()))
    counts = dict(spark.range(40000).groupBy(major.alias("m")).count().collect())
    assert set(counts) == set(catalogs.MAJORS)
    assert all(abs(counts[m] / 40000 - w / total) < 0.01 for m, w in catalogs.MAJORS.items())


@pytest.mark.parametrize("at, value", [(0.0, "a"), (0.2499, "a"), (0.25, "b"), (0.9999, "b")])
def test_weighted_choice_edges(spark, at, value):
    assert column(spark, "x double", [at], hashing.weighted_choice(F.col("x"), ["a", "b"], [1, 3])) == [value]


def test_uniform_choice_reaches_all(spark):
    letter = hashing.uniform_choice(hashing.hash_fraction("u", F.col("id")), list("abcd"))
    assert {r[0] for r in spark.range(500).select(letter).distinct().collect()} == set("abcd")


def test_catalogues(spark):
    assert catalogs.majors(spark).count() == 25 and catalogs.subjects(spark).count() == 16
    assert catalogs.hold_types(spark).count() == 6
    assert re.fullmatch("[A-Z]+", "".join(catalogs.SUBJECTS))


def test_nan_is_below_every_cut_and_is_not_clamped(rows):
    df = rows("x double", (float("nan"),))
    got = df.select(derive.letter_grade(F.col("x")), derive.clamp(F.col("x"), 0.0, 4.0), derive.class_level(F.col("x"))).first()
    assert got[0] == "F" and got[1] != got[1] and got[2] is None


def test_utc_text_does_not_follow_the_session_zone(spark, rows):
    from datetime import datetime, timezone

    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        text = rows("a int", (1,)).select(derive.utc_timestamp_text()).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    stamp = datetime.strptime(text, "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=timezone.utc)
    assert abs((datetime.now(timezone.utc) - stamp).total_seconds()) < 120
