"""People across systems: who belongs together by shared keys, and who holds whose key.

Both operators work in rounds of joins and aggregations whose results are stored,
so that a round reads the last one and a lost executor costs a re-read. Their
number grows with the logarithm of the longest chain. A key that very many people
share is reduced by partial sums before each shuffle, and its rows are spread over
tasks where they are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.derive import prefixed_key
from termweave.operators.skew import ROWS_PER_TASK, salted_join
from termweave.storage import materialize


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Per node ``u`` the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))


def _large_star(edges: DataFrame, rows_per_task: int) -> DataFrame:
    """Each node's larger neighbours linked to its least one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = salted_join(both, _least_neighbour(both), ["u"], "inner", rows_per_task)
    return linked.filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, rows_per_task: int) -> DataFrame:
    """Each node and its smaller neighbours linked to the least of them; edges go from larger to smaller."""
    least = _least_neighbour(edges)
    linked = salted_join(edges, least, ["u"], "inner", rows_per_task)
    moved = linked.select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("_m").alias("v"))).distinct()


def connected(edges: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """node and its component, the least node that edges (u, v) of comparable nodes reach.

    Stars: edges are moved to the least neighbour of their larger end and of their
    smaller ends in turn, until all nodes of a component are linked to its least.
    Nodes without an edge to another node are not in the result.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now, before = materialize(ordered, "edges"), None
    while True:
        # A node is the larger end of one edge only, and no end of it another's larger: all are stars.
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        now = materialize(_small_star(_large_star(now, rows_per_task), rows_per_task), "stars")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def entities(links: DataFrame, person: str, system: str, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Each person with the entity that shared keys make them part of: ``person`` and entity, its least person.

    ``links`` says which person has which key in which system. A null person or key
    links nobody; people without any key stand alone.
    """
    people = links.filter(F.col(person).isNotNull())
    known = people.filter(F.col(key).isNotNull()).select(person, system, key).distinct()
    # Everyone of a key is linked to its least person, so a key of n people makes n links, not n * n.
    least = known.groupBy(system, key).agg(F.min(person).alias("v"))
    edges = salted_join(known, least, [system, key], "inner", rows_per_task).select(F.col(person).alias("u"), "v")
    found = connected(edges, rows_per_task)
    entity = F.coalesce("component", person).alias("entity")
    return people.select(person).distinct().join(found, F.col(person) == F.col("node"), "left").select(person, entity)


def entity_summary(links: DataFrame, members: DataFrame, person: str, system: str, key: str) -> DataFrame:
    """Per entity: people, keys, systems, and conflicts, the systems in which it has several keys."""
    known = links.filter(F.col(person).isNotNull())
    rows = known.join(members, person)
    # Counts of one system are merged from partial sets of the different keys.
    per_system = rows.groupBy("entity", system).agg(F.countDistinct(key).alias("_keys"))
    held = per_system.groupBy("entity").agg(
        F.sum("_keys").alias("keys"),
        F.count_if(F.col("_keys") > 0).alias("systems"),
        F.count_if(F.col("_keys") > 1).alias("conflicts"),
    )
    size = members.groupBy("entity").agg(F.count(F.lit(1)).alias("people"))
    return size.join(held, "entity").select("entity", "people", "keys", "systems", "conflicts")


def swap_cycles(crosswalk: DataFrame, id: str, key: str, prefix: str) -> DataFrame:
    """People who hold each other's keys in a circle: ``id``, cycle (its least id), length, own_key and holder.

    Someone's own key is ``prefix + lower(id)``; who holds another's points to them.
    Pointers are doubled: a round joins each pointer to the pointer where it ends, so
    after ``n`` rounds a person knows the least id among the next ``2 ** n``. A key
    that several hold, or a person with several rows, decides nothing and breaks
    the chain; chains that end are not cycles and drop out. ``holder`` has the
    person's own key and should give it back.
    """
    own = prefixed_key(prefix, F.col(id))
    broken = crosswalk.filter(F.col(id).isNotNull() & (F.col(key) != own)).select(F.col(id).alias("_id"), own.alias("_own"), F.col(key).alias("_held"))
    one_row = broken.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"), F.min("_own").alias("_own"), F.min("_held").alias("_held")).filter("_n = 1")
    one_holder = one_row.groupBy("_held").agg(F.count(F.lit(1)).alias("_holders"), F.min("_id").alias("_holder")).filter("_holders = 1")
    owners = one_row.select(F.col("_id").alias("_next"), F.col("_own").alias("_key"))
    points = one_holder.join(owners, F.col("_held") == F.col("_key")).select(F.col("_holder").alias("_id"), "_next")
    first = materialize(points, "pointers")
    now, before = first.select("_id", F.col("_next").alias("_far"), F.least("_id", "_next").alias("_least")), None
    while True:
        now = materialize(now, "pointers")
        # Members of cycles stay and their least ids settle; ends of chains drop out.
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_id", "_least").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        ahead = now.select(F.col("_id").alias("_far"), F.col("_far").alias("_farther"), F.col("_least").alias("_beyond"))
        now = now.join(ahead, "_far").select("_id", F.col("_farther").alias("_far"), F.least("_least", "_beyond").alias("_least"))
    length = now.groupBy("_least").agg(F.count(F.lit(1)).alias("length"))
    holders = first.select(F.col("_next").alias("_id"), F.col("_id").alias("holder"))
    return (
        now.join(length, "_least")
        .join(holders, "_id")
        .select(
            F.col("_id").alias(id), F.col("_least").alias("cycle"), "length", prefixed_key(prefix, F.col("_id")).alias("own_key"), "holder"
        )
    )


def repair_cycles(crosswalk: DataFrame, cycles: DataFrame, id: str, key: str) -> DataFrame:
    """The crosswalk with everyone of a cycle given their own key back."""
    given = cycles.select(F.col(id).alias("_id"), F.col("own_key").alias("_own"))
    mended = crosswalk.join(given, F.col(id) == F.col("_id"), "left")
    return mended.select(*[F.coalesce("_own", key).alias(key) if c == key else F.col(f"`{c}`") for c in crosswalk.columns])
