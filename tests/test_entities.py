"""People across systems against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from termweave.operators import entities


def plain_components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 300
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range([120, 280, 900][seed])]
    edges += [(i, i + 1) for i in range(1000, 1200)]  # a long chain
    edges += [(5000, 2000 + i) for i in range(300)]  # a hub, larger than its neighbours
    edges += [(7, 7), (7, 7)]
    rng.shuffle(edges)
    found = entities.connected(spark.createDataFrame(edges, "u long, v long"), rows_per_task=50)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in found.collect()} == plain_components(linked, [e for e in edges if e[0] != e[1]])
    assert found.count() == len(linked)


def test_components_without_edges(spark):
    assert entities.connected(spark.createDataFrame([], "u long, v long")).collect() == []
    assert entities.connected(spark.createDataFrame([("a", "a")], "u string, v string")).collect() == []


def test_entities_of_links(spark, values):
    links = [
        ("p1", "lms", "k1"), ("p2", "lms", "k1"), ("p2", "aid", "k1"), ("p3", "aid", "k9"), ("p3", "lms", "k3"),
        ("p4", "lms", None), (None, "lms", "k3"), ("p5", "aid", "k2"), ("p2", "aid", "k2"), ("p2", "aid", "k2"), ("p6", "lms", "k9"),
    ]
    frame = spark.createDataFrame(links, "person string, system string, key string")
    members = entities.entities(frame, "person", "system", "key", rows_per_task=2)
    assert values(members) == [("p1", "p1"), ("p2", "p1"), ("p3", "p3"), ("p4", "p4"), ("p5", "p1"), ("p6", "p6")]
    summary = values(entities.entity_summary(frame, members, "person", "system", "key"))
    assert summary == [("p1", 3, 3, 2, 1), ("p3", 1, 2, 2, 0), ("p4", 1, 0, 0, 0), ("p6", 1, 1, 1, 0)]


def held(pairs):
    return [(i, None if k is None else f"mdl_{k.lower()}") for i, k in pairs]


def test_cycles_of_any_length_and_their_repair(spark, values):
    rng = random.Random(5)
    pairs, wanted = [], {}
    people = [f"S{i:04d}" for i in range(400)]
    rng.shuffle(people)
    at = 0
    for length in (1, 2, 2, 3, 4, 5, 16, 17, 100):
        ring = people[at : at + length]
        at += length
        for i, p in enumerate(ring):
            pairs.append((p, ring[(i + 1) % length]))
            if length > 1:
                wanted[p] = (min(ring), length, f"mdl_{p.lower()}", ring[i - 1])
    chain = people[at : at + 50]  # the last holds a key of nobody
    pairs += list(zip(chain, [*chain[1:], "S9999"]))
    at += 50
    a, b, c, d = people[at : at + 4]
    pairs += [(a, b), (b, a), (c, a), (d, None)]  # two hold a's key: nothing is certain
    e, f = people[at + 4 : at + 6]
    pairs += [(e, f), (f, e), (f, "S9998")]  # f has two rows
    frame = spark.createDataFrame(held(pairs), "student_id string, key string")
    cycles = entities.swap_cycles(frame, "student_id", "key", "mdl_")
    assert cycles.columns == ["student_id", "cycle", "length", "own_key", "holder"]
    assert {r.student_id: tuple(r)[1:] for r in cycles.collect()} == wanted
    mended = values(entities.repair_cycles(frame, cycles, "student_id", "key"))
    assert mended == sorted(held([(p, p if p in wanted else k) for p, k in pairs]), key=lambda t: tuple((v is not None, str(v)) for v in t))
    again = spark.createDataFrame([r for r in mended if r[0] in wanted], "student_id string, key string")
    assert entities.swap_cycles(again, "student_id", "key", "mdl_").count() == 0


def test_cycles_of_doubled_swaps(spark):
    """Swaps that use a person again make longer circles, which pairs do not show."""
    rng = random.Random(9)
    people = [f"S{i:03d}" for i in range(200)]
    key = {p: p for p in people}
    for _ in range(120):
        x, y = rng.sample(people, 2)
        key[x], key[y] = key[y], key[x]
    frame = spark.createDataFrame(held(key.items()), "student_id string, key string")
    rings = defaultdict(set)
    for p in people:
        ring, q = {p}, key[p]
        while q != p:
            ring.add(q)
            q = key[q]
        if len(ring) > 1:
            rings[min(ring)] = ring
    found = defaultdict(set)
    for r in entities.swap_cycles(frame, "student_id", "key", "mdl_").collect():
        found[r.cycle].add(r.student_id)
        assert r.length == len(rings[r.cycle])
    assert found == rings and max(map(len, rings.values())) > 2
