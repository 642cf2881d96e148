"""States that loads keep up to date, against computing them anew."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from termweave.operators import balances, sketches

DDL = "person string, term int, credits long"


def plain(rows):
    sums = defaultdict(lambda: defaultdict(int))
    for person, term, credits in rows:
        sums[person][term] += credits or 0
    found = []
    for person, terms in sums.items():
        total = 0
        for term in sorted(terms):
            total += terms[term]
            found.append((person, term, total))
    return sorted(found)


def test_totals_are_those_of_all_rows_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(12)}", rng.randrange(15), rng.choice([None, 1, 3, 4])) for _ in range(400)]
    loads = defaultdict(list)
    for r in rows:
        loads[max(0, r[1] // 4 + rng.choice([0, 0, 0, 1, -1]))].append(r)
    state, seen = str(tmp_path / "state"), []
    for number in sorted(loads):
        seen += loads[number]
        for _ in range(2 if number == 1 else 1):  # a load that runs again
            found = balances.add_load(spark.createDataFrame(loads[number], DDL), state, number, "person", "term", ["credits"])
        assert sorted(map(tuple, found.select("person", "term", "total_credits").collect())) == plain(seen)


def test_a_load_writes_only_what_it_changes(spark, tmp_path, values):
    state = str(tmp_path / "state")
    first = [(f"p{i}", t, 1) for i in range(10) for t in (1, 2, 4)]
    balances.add_load(spark.createDataFrame(first, DDL), state, 0, "person", "term", ["credits"])
    balances.add_load(spark.createDataFrame([("p1", 5, 7)], DDL), state, 1, "person", "term", ["credits"])
    assert values(spark.read.parquet(f"{state}/load=1"), "person", "term", "total_credits") == [("p1", 5, 10)]
    balances.add_load(spark.createDataFrame([("p2", 3, 7), ("new", 9, 1)], DDL), state, 2, "person", "term", ["credits"])
    assert values(spark.read.parquet(f"{state}/load=2"), "person", "term", "total_credits") == [("new", 9, 1), ("p2", 3, 9), ("p2", 4, 10)]
    found = balances.add_load(spark.createDataFrame([], DDL), state, 3, "person", "term", ["credits"])
    assert found.count() == 33


def test_sketches_are_exact_while_small_and_bounded_beyond(spark, tmp_path):
    people = spark.range(60_000).select(F.col("id"), (F.col("id") % 2).cast("int").alias("term"))
    path, lg = str(tmp_path / "sketches"), 10
    active = people.filter((F.col("id") % 10 < 7) | (F.col("term") == 1))
    for load in range(3):
        for system, rows in (("sis", people), ("lms", active)):
            part = rows.filter(F.col("id") % 3 == load)
            sketches.store_sketches(sketches.key_sketches(part, system, ["term"], F.col("id"), lg), path, f"{system}-{load}")
    for _ in range(2):  # a load stored again counts once
        found = sketches.estimated_coverage(sketches.merged_sketches(spark, path, ["term"], lg), "sis", "lms", ["term"], lg)
        for r in found.collect():
            exact = 1.0 if r.term else 0.8  # even ids that end in 0, 2, 4 and 6
            assert abs(r.left_keys - 30_000) < 30_000 * 0.15 and r.lowest <= exact <= r.highest and r.highest - r.lowest < 0.5
        sketches.store_sketches(sketches.key_sketches(people.filter(F.col("id") % 3 == 0), "sis", ["term"], F.col("id"), lg), path, "sis-0")
    small = str(tmp_path / "small")
    few = people.filter("id < 200")
    sketches.store_sketches(sketches.key_sketches(few, "sis", ["term"], F.col("id")), small, "a")
    sketches.store_sketches(sketches.key_sketches(few.filter("id < 50 AND term = 0"), "lms", ["term"], F.col("id")), small, "b")
    found = sketches.estimated_coverage(sketches.merged_sketches(spark, small, ["term"]), "sis", "lms", ["term"])
    assert sorted(tuple(r) for r in found.collect()) == [(0, 100, 25, 25, 0.25, 0.25, 0.25), (1, 100, 0, 0, 0.0, 0.0, 0.0)]
