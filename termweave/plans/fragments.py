"""Queries over deliberately fragmented copies, and weighted choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from termweave.functions import catalogs
from termweave.functions.hashing import hash_fraction, weighted_choice
from termweave.operators import fragment
from termweave.plans import campus, sql
from termweave.plans.registry import query


@query(
    f"SELECT o_orderkey, o_custkey FROM orders WHERE {sql.fraction('thin', 'o_orderkey')} >= 0.45::DOUBLE",
    "F32", "F31",
)
def thin_rows(spark, sf_dir):
    """Orders with a share of the rows missing."""
    orders = campus.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return fragment.thin(orders, fragment.FINANCE_MISSING_RATE, "thin", "o_orderkey")


@query(
    f"""
    SELECT event_id, CASE WHEN {sql.fraction('null', 'event_id')} < 0.87::DOUBLE THEN user_id END AS user_id
    FROM events""",
    "F33",
)
def null_out(spark, sf_dir):
    """Events that lost their person in a share of the rows."""
    events = campus.table(spark, sf_dir, "events").select("event_id", "user_id")
    return fragment.null_out(events, "user_id", fragment.HOLD_KEY_KEPT_RATE, "null", "event_id")


LEVELS = (0.0, 0.10, 0.45)
LEVEL_LIST = ", ".join(f"({r}::DOUBLE)" for r in LEVELS)


@query(
    f"""
    WITH lines AS (
        SELECT o_custkey AS person, {sql.ord_('l_shipdate')} AS term_ord, l_quantity::BIGINT AS logins
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    copies AS (
        SELECT rate, l.* FROM lines l, (VALUES {LEVEL_LIST}) v(rate)
        WHERE {sql.fraction('sweep', "person || ':' || term_ord")} >= rate)
    SELECT rate AS missing_rate, {sql.code('term_ord')} AS term_code, count(*) AS n,
           sum(logins)::DOUBLE / count(*)::DOUBLE AS avg_logins
    FROM copies GROUP BY rate, term_ord""",
    "Q7", "F32", "A2",
)
def frag_sweep(spark, sf_dir):
    """The same averages over copies with more and more people missing, in one scan."""
    activity = campus.line_partials(spark, sf_dir, {"logins": campus.logins()})
    sums = fragment.sweep(
        activity, LEVELS, "sweep", ["person", "term_ord"], by=["term_ord"], sums=["n", "sum_logins"]
    )
    return campus.coded(sums).select("missing_rate", "term_code", "n", (F.col("sum_logins") / F.col("n")).alias("avg_logins"))


MAJOR_VALUES = ", ".join(
    "('{}', {}, {})".format(m.replace("'", "''"), w, sum(list(catalogs.MAJORS.values())[: i + 1]))
    for i, (m, w) in enumerate(catalogs.MAJORS.items())
)
MAJORS_SQL = f"""
    majors(major, weight, upto) AS (VALUES {MAJOR_VALUES}),
    people AS (SELECT c_custkey, {sql.fraction('major', 'c_custkey')} *
                      (SELECT sum(weight) FROM majors)::DOUBLE AS pos FROM customer),
    assigned AS (SELECT c_custkey, major FROM people JOIN majors ON pos < upto AND pos >= upto - weight)"""


def _assigned(spark, sf_dir):
    major = weighted_choice(
        hash_fraction("major", F.col("c_custkey")), list(catalogs.MAJORS), list(catalogs.MAJORS.values())
    )
    return campus.table(spark, sf_dir, "customer").select("c_custkey", major.alias("major"))


@query(f"WITH {MAJORS_SQL} SELECT * FROM assigned", "J9", "F31", "S10")
def weighted_assign(spark, sf_dir):
    """A major for every person, by the weights of the catalogue."""
    return _assigned(spark, sf_dir)


@query(
    f"""
    WITH {MAJORS_SQL}
    SELECT m.major, weight, count(c_custkey) AS people FROM majors m LEFT JOIN assigned a ON a.major = m.major
    GROUP BY m.major, weight""",
    "S10",
)
def major_mix(spark, sf_dir):
    """Every major of the catalogue with its weight and how many people have it."""
    counted = _assigned(spark, sf_dir).groupBy("major").agg(F.count(F.lit(1)).alias("people"))
    return catalogs.majors(spark).join(counted, "major", "left").select(
        "major", "weight", F.coalesce("people", F.lit(0)).alias("people")
    )


@query(
    f"""
    WITH w AS (SELECT n_name, count(*) AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
    r AS (SELECT n_name, weight, sum(weight) OVER (ORDER BY n_name) AS upto FROM w),
    p AS (SELECT c_custkey, {sql.fraction('nation', 'c_custkey')} * (SELECT sum(weight) FROM w)::DOUBLE AS pos
          FROM customer)
    SELECT c_custkey, n_name FROM p JOIN r ON pos < upto AND pos >= upto - weight""",
    "J9",
)
def weighted_assign_table(spark, sf_dir):
    """A nation for every customer, weighted by its number of suppliers."""
    nations = campus.table(spark, sf_dir, "nation")
    weights = (
        campus.table(spark, sf_dir, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    people = campus.table(spark, sf_dir, "customer").select("c_custkey")
    return fragment.weighted_assign(people, hash_fraction("nation", F.col("c_custkey")), weights, "n_name", "weight")


@query(
    f"""
    WITH w AS (SELECT l_partkey, count(*) AS weight FROM lineitem GROUP BY 1),
    r AS (SELECT l_partkey, weight, sum(weight) OVER (ORDER BY l_partkey) AS upto FROM w),
    p AS (SELECT o_orderkey, {sql.fraction('part', 'o_orderkey')} * (SELECT sum(weight) FROM w)::DOUBLE AS pos
          FROM orders)
    SELECT o_orderkey, l_partkey FROM p ASOF JOIN (SELECT l_partkey, upto - weight AS begin FROM r) b ON p.pos >= b.begin""",
    "J9",
)
def weighted_assign_parts(spark, sf_dir):
    """A part for every order, weighted by how often it is sold: a catalogue of thousands."""
    weights = campus.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("weight"))
    orders = campus.table(spark, sf_dir, "orders").select("o_orderkey")
    return fragment.weighted_assign(orders, hash_fraction("part", F.col("o_orderkey")), weights, "l_partkey", "weight")


YEARS_SQL = "CASE " + " ".join(
    f"WHEN pos < {sum(list(catalogs.FIRST_YEARS.values())[: i + 1])} THEN " + (f"'{year}'" if year else "NULL")
    for i, year in enumerate(catalogs.FIRST_YEARS)
) + " END"


@query(
    f"""
    SELECT c_custkey, {YEARS_SQL} AS initial_year
    FROM (SELECT c_custkey, {sql.fraction('year', 'c_custkey')} * {sum(catalogs.FIRST_YEARS.values())}::DOUBLE AS pos
          FROM customer)""",
    "J9", "F31",
)
def weighted_first_year(spark, sf_dir):
    """A year of study at admission for every person, which a few do not have."""
    year = weighted_choice(
        hash_fraction("year", F.col("c_custkey")), list(catalogs.FIRST_YEARS), list(catalogs.FIRST_YEARS.values())
    )
    return campus.table(spark, sf_dir, "customer").select("c_custkey", year.cast("string").alias("initial_year"))
