from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from termweave.operators import fragment, identity, longitudinal, ordering, partials, quality, skew


@pytest.fixture(scope="module")
def hot(spark):
    """Rows of which one key holds a third, another a tenth, and some have no key."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, 8).when(F.col("id") % 17 == 2, None).otherwise(F.col("id") % 50)
    return spark.range(6000).select(key.cast("int").alias("k"), F.col("id").alias("v")).repartition(6).cache()


@pytest.fixture(scope="module")
def side(spark):
    return spark.createDataFrame([(k, f"p{k}-{i}") for k in range(0, 50, 2) for i in range(1 + k % 3)] + [(7, "hot"), (None, "none")], "k int, name string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("rows_per_task", [100, 1_000_000])
def test_salted_join_equals_join(hot, side, values, how, rows_per_task):
    plain = hot.join(side, "k", how)
    assert values(skew.salted_join(hot, side, ["k"], how, rows_per_task)) == values(plain)


def test_salted_join_of_two_heavy_sides(spark, hot, values):
    other = spark.range(900).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 30).cast("int").alias("k"), F.col("id").alias("w"))
    spread = skew.salted_join(hot, other, ["k"], "inner", 300, skew.heavy_keys(other, ["k"], 50))
    plain = hot.join(other, "k")
    assert spread.count() == plain.count() and spread.exceptAll(plain).count() == 0
    with pytest.raises(ValueError):
        skew.salted_join(hot, other, ["k"], "left", 300, skew.heavy_keys(other, ["k"], 50))


def test_salted_join_spreads_identical_rows(spark):
    same = spark.range(0, 4000, 1, 8).select(F.lit(1).alias("k"), F.lit("x").alias("v"))
    other = spark.createDataFrame([(1, "a")], "k int, w string")
    joined = skew.salted_join(same, other, ["k"], rows_per_task=500)
    assert joined.count() == 4000 and joined.distinct().count() == 1
    assert skew.heavy_keys(same, ["k"], 500).collect() == [(1, 8)]


def test_salted_join_rejects_joins_that_keep_the_other_side(hot, side):
    with pytest.raises(ValueError):
        skew.salted_join(hot, side, ["k"], "right")


def test_heavy_keys_are_all_keys_above_the_threshold(spark, hot):
    assert skew.heavy_keys(hot, ["k"]).count() == 0
    many = spark.range(36_000).select((F.col("id") % 12_000).alias("k"))
    assert skew.heavy_keys(many, ["k"], 2).count() == 12_000


@pytest.mark.parametrize("slices", [1, 20, 120, None])
def test_number_rows_equals_row_number(spark, hot, slices):
    got = defaultdict(list)
    for r in ordering.number_rows(hot, ["k"], ["v"], "n", slices).collect():
        got[r.k].append((r.v, r.n))
    assert sum(map(len, got.values())) == 6000
    for numbered in got.values():
        assert [n for _, n in sorted(numbered)] == list(range(1, len(numbered) + 1))


def test_number_rows_over_everything(spark):
    got = ordering.number_rows(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")), [], ["x"], "n", 7).collect()
    assert all(r.n == r.x + 1 for r in got) and len(got) == 1000


def test_dedupe_suffix(rows, values):
    df = rows("id int, base string", (3, "alexkim"), (1, "alexkim"), (2, "saray"), (9, "alexkim"), (4, None))
    got = dict(values(identity.dedupe_suffix(df, "base", ["id"], "u", slices=5), "id", "u"))
    assert got == {1: "alexkim", 3: "alexkim2", 9: "alexkim3", 2: "saray", 4: None}


def test_latest_per_key(rows, values):
    df = rows("k int, t int, id int, v string", (1, 5, 1, "a"), (1, 5, 2, "b"), (1, 4, 9, "c"), (2, 1, 1, "d"), (None, 1, 1, "e"))
    assert values(ordering.latest_per_key(df, ["k"], ["t", "id"])) == [(None, 1, 1, "e"), (1, 5, 2, "b"), (2, 1, 1, "d")]


def test_bridge_averages_equal_the_joined_rows(spark, values):
    left = spark.createDataFrame([(f"m{i % 5}", i % 3, i, None if i % 4 == 0 else i * 2) for i in range(60)], "mk string, t int, v int, w int")
    cross = spark.createDataFrame([("m0", "s0"), ("m1", "s1"), ("m1", "s2"), ("m2", "s1"), ("m3", "s3"), ("m3", "s3"), (None, "s4")], "mk string, s string")
    right = spark.createDataFrame([(f"s{i % 5}", i % 3, float(i)) for i in range(25)], "s string, t int, g double")
    joined = left.join(cross, "mk").join(right, ["s", "t"])
    for by in (["s"], ["t"], ["s", "t"]):
        want = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("a"), F.avg("w").alias("b"), F.avg("g").alias("c"))
        got = identity.bridge_averages(
            partials.partials(left, ["mk", "t"], ["v", "w"]), cross, partials.partials(right, ["s", "t"], ["g"]),
            "mk", "s", by, ["t"], ["v", "w"], ["g"],
        )
        for g, w in zip(values(got), values(want)):
            assert g[: len(by) + 1] == w[: len(by) + 1]
            assert g[len(by) + 1:] == pytest.approx(w[len(by) + 1:])
    rows_joined = identity.bridge_join(left, cross, right, "mk", "s", ["t"])
    assert values(rows_joined, "s", "t", "mk", "v", "w", "g") == values(joined, "s", "t", "mk", "v", "w", "g")


def test_orphans(rows, values):
    df = rows("hold int, s string", (1, "a"), (2, "x"), (3, None))
    assert values(identity.orphans(df, rows("s string", ("a",), ("a",), (None,)), ["s"]), "hold", "reason") == [(2, "unmatched"), (3, "no_key")]


def test_missing_keys(rows, values):
    want = rows("p int, t int", (1, 1), (1, 1), (1, 2), (2, 1), (None, 1))
    have = rows("p int, t int", (1, 2), (9, 9))
    assert values(identity.missing_keys(want, have, ["p", "t"])) == [(1, 1, 2), (2, 1, 1)]


def test_key_ambiguity(rows, values):
    df = rows("s string, k string", ("a", "1"), ("b", "1"), ("c", "2"), ("c", "3"), ("c", "3"), ("d", None))
    assert values(identity.key_ambiguity(df, "s", "k")) == [("key_of_several_people", "1", 2), ("person_with_several_keys", "c", 2)]


def test_swap_audit_finds_two_way_swaps_only(rows, values):
    df = rows(
        "s string, k string",
        ("S1", "mdl_s2"), ("S2", "mdl_s1"), ("S3", "mdl_s3"),
        ("S4", "mdl_s5"), ("S5", "mdl_s6"), ("S6", "mdl_s4"), ("S7", "mdl_s3"),
    )
    assert values(identity.swap_audit(df, "s", "k", "mdl_")) == [("S1", "S2")]
    assert identity.convention_breaks(df, "s", "k", "mdl_").count() == 6


def crosswalk(spark, n):
    return spark.range(n).select(F.format_string("S%06d", "id").alias("s"), F.format_string("mdl_s%06d", "id").alias("k"), (F.col("id") * 2).alias("extra"))


@pytest.mark.parametrize("rows_per_task", [20, 1_000_000])
def test_swap_pairs_are_disjoint_and_undo_themselves(spark, values, rows_per_task):
    before = crosswalk(spark, 2000)
    after = fragment.swap_pairs(before, 0.2, "x", "s", "k", rows_per_task)
    old, new = dict(values(before, "s", "k")), dict(values(after, "s", "k"))
    moved = {s for s in old if old[s] != new[s]}
    assert len(moved) > 300 and len(moved) % 2 == 0 and sorted(new.values()) == sorted(old.values())
    owner = {k: s for s, k in old.items()}
    assert all(new[owner[new[s]]] == old[s] for s in moved)
    assert values(fragment.swap_pairs(after, 0.2, "x", "s", "k", rows_per_task)) == values(before)
    assert identity.swap_audit(after, "s", "k", "mdl_").count() == len(moved) // 2


def test_swap_leaves_people_with_several_rows_alone(spark, values):
    doubled = crosswalk(spark, 50).union(crosswalk(spark, 50).withColumn("k", F.concat("k", F.lit("b"))))
    assert values(fragment.swap_pairs(doubled, 1.0, "x", "s", "k")) == values(doubled)


def test_swaps_leave_missing_keys_alone(spark, values):
    some = F.when(F.col("s").endswith("5"), F.lit(None)).otherwise(F.col("k"))
    before = crosswalk(spark, 400).withColumn("k", some)
    after = fragment.swap_pairs(before, 0.5, "x", "s", "k")
    old, new = dict(values(before, "s", "k")), dict(values(after, "s", "k"))
    assert sorted(map(str, old.values())) == sorted(map(str, new.values()))
    assert {s for s in old if old[s] is None} == {s for s in new if new[s] is None}
    # Half a swap per person, two people each: nearly everybody with a key.
    assert sum(old[s] != new[s] for s in old) >= 358


def test_rate_counts_swaps(spark, values):
    people = crosswalk(spark, 20_000)
    after = fragment.swap_pairs(people, fragment.CROSSWALK_MISMATCH_RATE, "x", "s", "k")
    assert identity.swap_audit(after, "s", "k", "mdl_").count() == pytest.approx(200, abs=40)


def test_thinning_is_nested_and_complete(spark, values):
    df = spark.range(3000)
    ten, half = fragment.thin(df, 0.1, "s", "id"), fragment.thin(df, 0.5, "s", "id")
    assert half.join(ten, "id", "left_anti").count() == 0
    assert values(ten.union(fragment.removed(df, 0.1, "s", "id"))) == values(df)
    assert fragment.thin(df, 0.0, "s", "id").count() == 3000 and fragment.thin(df, 1.0, "s", "id").count() == 0
    assert abs(half.count() - 1500) < 120


def test_sweep_equals_separate_copies(spark, values):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("g"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    together = fragment.sweep(df, [0.0, 0.3, 0.6, 1.0], "s", ["id"], ["g"], ["v"])
    for r in (0.0, 0.3, 0.6):
        alone = fragment.thin(df, r, "s", "id").groupBy("g").agg(F.sum("v").alias("v"))
        assert values(together.filter(F.col("missing_rate") == r), "g", "v") == values(alone)
    assert together.filter("missing_rate = 1").count() == 0


def test_null_out(spark):
    df = fragment.null_out(spark.range(4000).withColumn("s", F.lit("x")), "s", 0.87, "n", "id")
    assert abs(df.filter("s IS NULL").count() / 4000 - 0.13) < 0.02


def test_weighted_assign_from_a_table(spark, rows, values):
    weights = rows("c string, w int", ("b", 3), ("a", 1), ("z", 0))
    points = rows("x double", (0.0,), (0.24,), (0.25,), (0.99,))
    assert values(fragment.weighted_assign(points, F.col("x"), weights, "c", "w")) == [(0.0, "a"), (0.24, "a"), (0.25, "b"), (0.99, "b")]


def test_weighted_assign_from_a_long_and_uneven_catalogue(spark):
    weights = [(i, 1 + (i * 7) % 11 + (5000 if i == 700 else 0)) for i in range(1500)]
    catalogue = spark.createDataFrame(weights, "c long, w long")
    points = spark.range(4000).select((F.col("id") / 4000).alias("x"))
    got = dict(fragment.weighted_assign(points, F.col("x"), catalogue, "c", "w").select("x", "c").collect())
    total, upto = sum(w for _, w in weights), []
    for _, w in weights:
        upto.append((upto[-1] if upto else 0) + w)
    from bisect import bisect_right

    assert got == {i / 4000: bisect_right(upto, i / 4000 * total) for i in range(4000)}
    assert fragment.weighted_assign(points, F.col("x"), catalogue.where("false"), "c", "w").where("c IS NULL").count() == 4000


def test_running_totals_merge_rows_of_a_term(rows, values):
    df = rows("p int, t int, c int, o int", (1, 1, 3, 10), (1, 1, 4, 10), (1, 3, None, 10), (1, 4, 5, 10), (2, 2, 1, 0))
    got = longitudinal.running_totals(df, "p", "t", ["c"], {"c": "o"})
    assert values(got) == [(1, 1, 7, 17), (1, 3, None, 17), (1, 4, 5, 22), (2, 2, 1, 1)]


def test_running_totals_of_an_extract_take_one_shuffle(rows, values):
    import contextlib
    import io

    df = rows("p int, t int, c int", (1, 1, 3), (1, 2, None), (1, 3, 5), (2, 2, 1)).repartition(3)
    one = longitudinal.running_totals(df, "p", "t", ["c"], one_row_per_term=True)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        one.explain()
    assert text.getvalue().count("Exchange hashpartitioning") == 1
    assert values(one) == values(longitudinal.running_totals(df, "p", "t", ["c"]))


def test_running_mean_is_null_without_weight(rows, values):
    df = rows("p int, t int, q double, c int", (1, 1, 0.0, 0), (1, 2, 40.0, 12), (1, 3, 30.0, 9))
    got = longitudinal.running_weighted_mean(df, "p", "t", "q", "c")
    assert values(got, "t", "term_mean", "running_mean") == [(1, None, None), (2, 3.33, 3.33), (3, 3.33, 3.33)]


def test_opening_balance_enters_the_running_mean(rows):
    df = rows("p int, t int, q double, c int, q0 double, c0 int", (1, 1, 57.12, 17, 218.68, 71))
    got = longitudinal.running_weighted_mean(df, "p", "t", "q", "c", "q0", "c0").first()
    assert (got.running_c, got.running_mean) == (88, 3.13)


def test_fill_terms_up_to_an_end(rows, values):
    df = rows("p int, t int, c int, e int", (1, 1, 5, 6), (1, 3, 6, 6), (2, 2, 7, None), (3, 4, 8, 2))
    got = longitudinal.fill_terms(df, "p", "t", ["c"], end="e")
    assert values(got, "p", "t", "c") == [
        (1, 1, 5), (1, 2, None), (1, 3, 6), (1, 4, None), (1, 5, None), (1, 6, None), (2, 2, 7), (3, 4, 8),
    ]


def test_fill_terms(rows, values):
    df = rows("p int, t int, c int, total int", (1, 1, 3, 3), (1, 4, 5, 8), (2, 2, 1, 1))
    got = longitudinal.fill_terms(df, "p", "t", ["c"])
    assert values(got) == [
        (1, 1, 3, 3, "enrolled"), (1, 2, None, 3, "not_enrolled"), (1, 3, None, 3, "not_enrolled"),
        (1, 4, 5, 8, "enrolled"), (2, 2, 1, 1, "enrolled"),
    ]


def test_carry_forward(rows, values):
    df = rows("p int, t int, g double", (1, 1, None), (1, 2, 3.0), (1, 3, None), (2, 1, None))
    assert values(longitudinal.carry_forward(df, "p", "t", "g", "known"), "p", "t", "known") == [(1, 1, None), (1, 2, 3.0), (1, 3, 3.0), (2, 1, None)]


def test_changes_and_spans(rows, values):
    df = rows("p int, t int, d int, m string", (1, 1, 1, "x"), (1, 1, 2, "y"), (1, 2, 1, "y"), (1, 5, 1, "z"), (2, 1, 1, "x"))
    terms = longitudinal.latest_in_term(df, "p", "t", "m", ["d"])
    assert values(longitudinal.changes(terms, "p", "t", "m")) == [(1, 5, "y", "z")]
    assert values(longitudinal.stopouts(df, "p", "t")) == [(2, 1)]
    assert values(longitudinal.first_seen(df, "p", "t")) == [(1, 1), (2, 1)]
    assert values(longitudinal.eligible_by_term(df, "p", "t")) == [(1, 2), (2, 1), (3, 1), (4, 1), (5, 1)]


def test_eligible(rows, values):
    df = rows("t int, a int, z int", (1, 2, None), (2, 2, None), (5, 2, 5), (4, 2, 5))
    assert values(longitudinal.eligible(df, "t", "a", "z")) == [(2, 2, None), (4, 2, 5)]


def test_reconcile(rows, values):
    parent = rows("k int, c int", (1, 12), (2, 6), (3, 9))
    child = rows("k int, c int", (1, 4), (1, 3), (2, 4), (2, 3), (9, 3))
    assert values(longitudinal.reconcile(parent, child, ["k"], "c", "c")) == [
        (1, 12, 7, 2, "ok"), (2, 6, 7, 2, "exceeds"), (3, 9, None, 0, "no_children"), (9, None, 3, 1, "no_parent"),
    ]


def test_coverage_and_cardinality(rows, values):
    left = rows("p int, t int", (1, 1), (1, 1), (2, 1), (3, 2), (None, 2))
    right = rows("p int, t int", (1, 1), (1, 1), (9, 1), (None, 2))
    assert values(quality.coverage(left, right, ["p", "t"], ["t"])) == [(1, 3, 2, 3, 2, 2 / 3, 2 / 3), (2, 2, 0, 1, 0, 0.0, 0.0)]
    size = quality.join_cardinality(left, right, ["p", "t"]).first()
    assert (size.left_rows, size.right_rows, size.output_rows, size.many_to_many_keys) == (5, 4, 4, 1)
    assert left.join(right, ["p", "t"]).count() == 4


def test_join_cardinality_equals_the_join(hot, side):
    assert quality.join_cardinality(hot, side, ["k"]).first().output_rows == hot.join(side, "k").count()


def test_no_python_and_no_cartesian_in_plans(spark, tmp_path):
    import contextlib
    import io

    from termweave.plans.registry import load_all

    for name, query in load_all().items():
        if any(c[0] in "KTSQ" and c not in ("S2", "S7", "S10", "Q7", "Q9", "Q4") for c in query.covers):
            continue
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            query.build(spark, "/root/testdata/sf0.001").explain()
        plan = text.getvalue()
        for banned in ("PythonUDF", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas", "FlatMapGroups"):
            assert banned not in plan, (name, banned)
