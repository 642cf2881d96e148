"""Random data against brute force in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.functions import sqltext, terms
from termweave.operators import identity, longitudinal, quality
from termweave.sources import composite

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@few
@given(st.lists(st.one_of(st.none(), st.text("ab|^ \n", max_size=12)), min_size=1, max_size=30))
def test_splitting_keeps_every_part(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, k string")
    wide = composite.split_composite(df)
    n = max([t.count("|") + 1 for t in texts if t is not None], default=1)
    assert len(wide.columns) == 2 + (n if n > 1 else 0)
    for row in wide.collect():
        want = texts[row.i].split("|") if texts[row.i] is not None else []
        if n > 1:
            assert list(row)[2:] == want + [None] * (n - len(want))
    parts = defaultdict(dict)
    for row in composite.explode_composite(df, "k").collect():
        parts[row.i][row.part_no] = row.part
    for i, text in enumerate(texts):
        if text is not None:
            assert "|".join(parts[i][j] for j in sorted(parts[i])) == text


NAMES = st.sampled_from(["t1", "db.t2", "T5", "a.b.c", "t1,", "x;", "select", "Where"])


@few
@given(st.lists(st.lists(st.tuples(st.sampled_from([" FROM ", " join\n\t", ", from  ", " Left JOIN "]), NAMES), max_size=6), min_size=1, max_size=20))
def test_tables_follow_from_and_join(spark, statements):
    """A plain walk over the words of a statement names the same tables, in order and once."""
    rows = [(i, "SELECT a" + "".join(k + n + " z" for k, n in parts)) for i, parts in enumerate(statements)]
    found = spark.createDataFrame(rows, "i int, s string").orderBy("i").select(sqltext.tables_in_sql(F.col("s"))).collect()
    for (_, text), row in zip(rows, found):
        words = text.split()
        named = [w.strip(",;") for before, w in zip(words, words[1:]) if before.lower() in ("from", "join")]
        assert row[0] == list(dict.fromkeys(n.split(".")[-1] for n in named if n.lower() not in ("select", "on", "where")))


def test_codes_and_positions_are_inverse(spark):
    df = spark.range(3 * 1000, 3 * 9999 + 3).select(F.col("id").cast("int").alias("o"))
    coded = df.select("o", terms.term_code(F.col("o")).alias("c"))
    assert coded.filter(terms.term_ord(F.col("c")) != F.col("o")).count() == 0
    assert coded.filter((F.col("o") < 3 * 9999 + 2) & (terms.term_ord(terms.next_term(F.col("c"), strict=False), strict=False) != F.col("o") + 1)).count() == 0


@pytest.fixture(scope="module")
def facts():
    rng = random.Random(7)
    return [(1 if rng.random() < 0.33 else rng.randrange(40), rng.randrange(20), rng.choice([None, *range(9)]), i) for i in range(3000)]


def test_histories(spark, facts):
    df = spark.createDataFrame(facts, "p int, t int, v int, i int")
    sums, last = defaultdict(lambda: None), {}
    for p, t, v, i in facts:
        sums[p, t] = sums[p, t] if v is None else (sums[p, t] or 0) + v
        last[p, t] = (i, v)
    seen = {(p, t) for p, t, _, _ in facts}
    got = {(r.p, r.t): (r.v, r.running_v) for r in longitudinal.running_totals(df, "p", "t", ["v"]).collect()}
    assert got == {(p, t): (sums[p, t], sum(sums[p, u] or 0 for q, u in seen if q == p and u <= t)) for p, t in seen}
    terms_of = defaultdict(list)
    for p, t in sorted(seen):
        terms_of[p].append(t)
    filled = longitudinal.fill_terms(longitudinal.running_totals(df, "p", "t", ["v"]), "p", "t", ["v"])
    status = {(r.p, r.t): r.enrollment_status for r in filled.collect()}
    assert status == {
        (p, t): "enrolled" if (p, t) in seen else "not_enrolled" for p, ts in terms_of.items() for t in range(ts[0], ts[-1] + 1)
    }
    ended = longitudinal.latest_in_term(df, "p", "t", "v", ["i"])
    changed = {(r.p, r.t, r.previous, r.v) for r in longitudinal.changes(ended, "p", "t", "v").collect()}
    want = set()
    for p, ts in terms_of.items():
        for before, now in zip(ts, ts[1:]):
            a, b = last[p, before][1], last[p, now][1]
            if a is not None and b is not None and a != b:
                want.add((p, now, a, b))
    assert changed == want


def test_coverage_and_missing(spark, facts):
    left = [(p, t) for p, t, _, _ in facts]
    right = [(p, t) for p, t, v, _ in facts if v == 3] + [(99, 1)]
    a = spark.createDataFrame(left, "p int, t int")
    b = spark.createDataFrame(right, "p int, t int")
    rows = {r.t: r for r in quality.coverage(a, b, ["p", "t"], ["t"]).collect()}
    for t in range(20):
        mine, theirs = [k for k in left if k[1] == t], [k for k in right if k[1] == t]
        assert rows[t].left_rows == len(mine) and rows[t].left_matched == sum(k in set(theirs) for k in mine)
        assert rows[t].right_rows == len(theirs) and rows[t].right_matched == sum(k in set(mine) for k in theirs)
    lost = {(r.p, r.t): r.rows_without for r in identity.missing_keys(a, b, ["p", "t"]).collect()}
    assert lost == {k: n for k, n in Counter(left).items() if k not in set(right)}
    l, r = Counter(left), Counter(right)
    assert quality.join_cardinality(a, b, ["p", "t"]).first().output_rows == sum(n * r[k] for k, n in l.items())


def test_ambiguity(spark, facts):
    df = spark.createDataFrame([(f"s{p}", f"k{t}") for p, t, _, _ in facts] + [(None, "k0"), ("s0", None)], "s string, k string")
    people, keys = defaultdict(set), defaultdict(set)
    for p, t, _, _ in facts:
        people[f"k{t}"].add(p), keys[f"s{p}"].add(t)
    want = {("key_of_several_people", k, len(v)) for k, v in people.items() if len(v) > 1}
    want |= {("person_with_several_keys", s, len(v)) for s, v in keys.items() if len(v) > 1}
    assert {tuple(r) for r in identity.key_ambiguity(df, "s", "k").collect()} == want
