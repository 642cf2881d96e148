"""Queries that follow people from term to term."""

from __future__ import annotations

from pyspark.sql import functions as F

from termweave.functions.hashing import hash_fraction
from termweave.functions.terms import term_code, term_ord_of_date
from termweave.operators import balances
from termweave.operators import longitudinal as history
from termweave.plans import campus, sql
from termweave.plans.registry import query
from termweave.storage import fresh_path

ENROLLED = f"""enrolled AS (
    SELECT o_orderkey, o_custkey AS person, {sql.ord_('o_orderdate')} AS term_ord, o_orderstatus, o_orderpriority,
           o_orderdate, 12 + o_custkey % 7 AS credits, round(o_totalprice * 100)::BIGINT AS cents
    FROM orders)"""


def _enrolled(spark, sf_dir):
    orders = campus.table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        F.col("o_custkey").alias("person"),
        term_ord_of_date(F.col("o_orderdate")).alias("term_ord"),
        "o_orderstatus",
        "o_orderpriority",
        "o_orderdate",
        (12 + F.col("o_custkey") % 7).alias("credits"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )


@query(
    f"""
    WITH {ENROLLED},
    t AS (SELECT person, term_ord, sum(credits)::BIGINT AS credits, sum(cents)::BIGINT AS cents
          FROM enrolled GROUP BY person, term_ord)
    SELECT person, {sql.code('term_ord')} AS term_code, credits, cents,
           (person % 30 + sum(credits) OVER w)::BIGINT AS running_credits,
           (sum(cents) OVER w)::BIGINT AS running_cents
    FROM t WINDOW w AS (PARTITION BY person ORDER BY term_ord)""",
    "W1",
)
def running_totals(spark, sf_dir):
    """Credits and amounts per person and term, with the totals so far and an opening balance."""
    rows = _enrolled(spark, sf_dir).withColumn("opening", F.col("person") % 30)
    return campus.coded(history.running_totals(rows, "person", "term_ord", ["credits", "cents"], {"credits": "opening"}))


@query(
    f"""
    WITH {ENROLLED},
    t AS (SELECT person, term_ord, sum(credits)::BIGINT AS credits, sum(cents)::BIGINT AS cents
          FROM enrolled GROUP BY person, term_ord)
    SELECT person, {sql.code('term_ord')} AS term_code, credits, cents,
           (sum(credits) OVER w)::BIGINT AS total_credits, (sum(cents) OVER w)::BIGINT AS total_cents
    FROM t WINDOW w AS (PARTITION BY person ORDER BY term_ord)""",
    "W1", "W3", "T1",
)
def appended_totals(spark, sf_dir):
    """Totals kept up to date over loads: most terms in order, then some that are late, of which one load comes twice."""
    rows, state = _enrolled(spark, sf_dir), fresh_path(spark, "balances")
    year, late = F.floor(F.col("term_ord") / 3), F.col("o_orderkey") % 5 == 0
    loads = [rows.filter((year <= 1994) & ~late), rows.filter((year > 1994) & ~late), rows.filter(late & (year > 1993)), rows.filter(late & (year <= 1993))]
    for number, part in enumerate(loads):
        for _ in range(2 if number == 2 else 1):
            found = balances.add_load(part, state, number, "person", "term_ord", ["credits", "cents"])
    return campus.coded(found)


@query(
    f"""
    WITH lines AS (
        SELECT o_custkey AS person, {sql.ord_('l_shipdate')} AS term_ord,
               CASE WHEN l_linenumber > 3 THEN 4 ELSE 3 END AS credits, l_quantity::BIGINT * 8 AS score
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    t AS (SELECT person, term_ord, sum(score * credits)::BIGINT AS points, sum(credits)::BIGINT AS weight
          FROM lines GROUP BY person, term_ord),
    r AS (SELECT *, (sum(points) OVER w)::BIGINT AS running_points, (sum(weight) OVER w)::BIGINT AS running_weight
          FROM t WINDOW w AS (PARTITION BY person ORDER BY term_ord))
    SELECT person, {sql.code('term_ord')} AS term_code, points, weight, running_points, running_weight,
           round(points::DOUBLE / weight::DOUBLE * 100) / 100 AS term_mean,
           round(running_points::DOUBLE / running_weight::DOUBLE * 100) / 100 AS running_mean
    FROM r""",
    "W2", "A8", "F11", "F13",
)
def running_gpa(spark, sf_dir):
    """Credit-weighted score per person and term and over all terms so far.

    A line is a course section: 3 or 4 credits, its quantity the score in
    hundredths, so all sums are whole numbers.
    """
    credits = F.when(F.col("l_linenumber") > 3, F.lit(4)).otherwise(F.lit(3))
    sections = campus.line_partials(spark, sf_dir, {"points": campus.logins() * 8 * credits, "weight": credits})
    rows = sections.select("person", "term_ord", F.col("sum_points").alias("points"), F.col("sum_weight").alias("weight"))
    return campus.coded(history.running_weighted_mean(rows, "person", "term_ord", "points", "weight"))


@query(
    f"""
    SELECT {sql.code('term_ord')} AS term_code, sum(score * credits)::BIGINT AS points, sum(credits)::BIGINT AS weight,
           CASE WHEN sum(credits) <> 0 THEN sum(score * credits)::DOUBLE / sum(credits)::DOUBLE END AS weighted_mean
    FROM (SELECT {sql.ord_('l_shipdate')} AS term_ord, l_quantity::BIGINT * 8 AS score,
                 CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_linenumber::BIGINT END AS credits
          FROM lineitem)
    GROUP BY term_ord""",
    "A8", "F13",
)
def weighted_mean(spark, sf_dir):
    """Weighted mean score per term; sections without credit do not count."""
    lines = campus.table(spark, sf_dir, "lineitem").withColumn("term_ord", term_ord_of_date(F.col("l_shipdate")))
    credits = F.when(F.col("l_returnflag") == "N", F.lit(0)).otherwise(F.col("l_linenumber")).cast("bigint")
    return campus.coded(history.weighted_mean(lines, ["term_ord"], campus.logins() * 8, credits))


FILLED = f"""
    {ENROLLED},
    t AS (SELECT person, term_ord, sum(credits)::BIGINT AS credits FROM enrolled GROUP BY person, term_ord),
    calendar AS (
        SELECT person, unnest(range(min(term_ord), max(term_ord) + 1))::INTEGER AS term_ord FROM t GROUP BY person),
    filled AS (
        SELECT c.person, c.term_ord, t.credits,
               (sum(t.credits) OVER (PARTITION BY c.person ORDER BY c.term_ord))::BIGINT AS running_credits,
               CASE WHEN t.person IS NULL THEN 'not_enrolled' ELSE 'enrolled' END AS enrollment_status
        FROM calendar c LEFT JOIN t ON t.person = c.person AND t.term_ord = c.term_ord)"""


def _filled(spark, sf_dir):
    totals = history.running_totals(_enrolled(spark, sf_dir), "person", "term_ord", ["credits"])
    return history.fill_terms(totals, "person", "term_ord", blank=["credits"])


@query(
    f"WITH {FILLED} SELECT person, {sql.code('term_ord')} AS term_code, credits, running_credits, "
    "enrollment_status FROM filled",
    "W3", "P7", "W1",
)
def enrolment_history(spark, sf_dir):
    """Every term of every person from first to last, skipped ones with carried totals."""
    return campus.coded(_filled(spark, sf_dir))


@query(
    f"""
    WITH {FILLED}
    SELECT {sql.code('term_ord')} AS term_code, enrollment_status, count(*) AS cnt
    FROM filled GROUP BY term_ord, enrollment_status""",
    "A1", "P7", "W3",
)
def attendance_by_term(spark, sf_dir):
    """People enrolled and skipping, per term."""
    counted = _filled(spark, sf_dir).groupBy("term_ord", "enrollment_status").agg(F.count(F.lit(1)).alias("cnt"))
    return campus.coded(counted)


@query(
    f"""
    WITH {ENROLLED},
    t AS (SELECT person, term_ord, max(CASE WHEN o_orderstatus <> 'P' THEN credits END) AS credits
          FROM enrolled GROUP BY person, term_ord)
    SELECT person, {sql.code('term_ord')} AS term_code, credits,
           last_value(credits IGNORE NULLS) OVER (PARTITION BY person ORDER BY term_ord
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_credits
    FROM t""",
    "W3",
)
def carried_values(spark, sf_dir):
    """The last known load of each person, carried over terms without one."""
    known = F.max(F.when(F.col("o_orderstatus") != "P", F.col("credits"))).alias("credits")
    terms = history.per_term(_enrolled(spark, sf_dir), "person", "term_ord", known)
    return campus.coded(history.carry_forward(terms, "person", "term_ord", "credits", "last_credits"))


@query(
    f"""
    WITH {ENROLLED},
    t AS (SELECT person, term_ord, o_orderpriority AS major FROM enrolled
          QUALIFY row_number() OVER (PARTITION BY person, term_ord ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
    l AS (SELECT *, lag(major) OVER (PARTITION BY person ORDER BY term_ord) AS previous FROM t)
    SELECT person, {sql.code('term_ord')} AS term_code, previous, major FROM l WHERE previous <> major""",
    "W4",
)
def change_events(spark, sf_dir):
    """Terms in which a person's main attribute differs from the term before."""
    rows = _enrolled(spark, sf_dir).withColumnRenamed("o_orderpriority", "major")
    terms = history.latest_in_term(rows, "person", "term_ord", "major", ["o_orderdate", "o_orderkey"])
    return campus.coded(history.changes(terms, "person", "term_ord", "major"))


@query(
    f"""
    WITH {ENROLLED}
    SELECT person, max(term_ord) AS last_ord FROM enrolled GROUP BY person
    HAVING max(term_ord) < (SELECT max(term_ord) FROM enrolled)""",
    "W5",
)
def stopouts(spark, sf_dir):
    """People not seen in the last term of all."""
    return history.stopouts(_enrolled(spark, sf_dir), "person", "term_ord")


@query(
    f"""
    WITH {ENROLLED}
    SELECT person, {sql.code('min(term_ord)')} AS admit_term FROM enrolled GROUP BY person""",
    "W6",
)
def first_term(spark, sf_dir):
    """Admission term of each person."""
    first = history.first_seen(_enrolled(spark, sf_dir), "person", "term_ord")
    return first.select("person", term_code(F.col("first_ord")).alias("admit_term"))


@query(
    f"""
    WITH {ENROLLED},
    s AS (SELECT person, min(term_ord) AS a, max(term_ord) AS z FROM enrolled GROUP BY person)
    SELECT {sql.code('t')} AS term_code, count(*) AS eligible
    FROM (SELECT unnest(range(a, z + 1))::INTEGER AS t FROM s) GROUP BY t""",
    "P6", "W5", "W6",
)
def eligible_by_term(spark, sf_dir):
    """People between admission and last term, per term."""
    return campus.coded(history.eligible_by_term(_enrolled(spark, sf_dir), "person", "term_ord"))


ADMIT = f"(5985 + floor({sql.fraction('admit', 'person')} * 12))::INTEGER"
STOP = (
    f"CASE WHEN {sql.fraction('stopped', 'person')} < 0.3::DOUBLE "
    f"THEN {ADMIT} + 3 + floor({sql.fraction('stop', 'person')} * 6)::INTEGER END"
)


@query(
    f"""
    WITH {ENROLLED}
    SELECT o_orderkey, person, {sql.code('term_ord')} AS term_code FROM enrolled
    WHERE term_ord >= {ADMIT} AND ({STOP} IS NULL OR term_ord < {STOP})""",
    "P6",
)
def eligible_rows(spark, sf_dir):
    """Enrolments between a person's assigned admission and stop-out terms."""
    person = F.col("person")
    admit = (F.lit(5985) + F.floor(hash_fraction("admit", person) * 12)).cast("int")
    after = (3 + F.floor(hash_fraction("stop", person) * 6)).cast("int")
    rows = (
        _enrolled(spark, sf_dir)
        .select("o_orderkey", "person", "term_ord")
        .withColumn("admit", admit)
        .withColumn("stopped", F.when(hash_fraction("stopped", person) < 0.3, F.col("admit") + after))
    )
    kept = history.eligible(rows, "term_ord", "admit", "stopped")
    return campus.coded(kept.select("o_orderkey", "person", "term_ord"))


@query(
    """
    WITH c AS (SELECT l_orderkey, sum(CASE WHEN l_quantity <= 10 THEN 4 ELSE 3 END)::BIGINT AS child_total,
                      count(*) AS children FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, 12 + o_custkey % 7 AS parent_total, child_total, coalesce(children, 0) AS children,
           CASE WHEN children IS NULL THEN 'no_children'
                WHEN child_total > 12 + o_custkey % 7 THEN 'exceeds' ELSE 'ok' END AS status
    FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""",
    "A10",
)
def reconcile(spark, sf_dir):
    """Credits of an enrolment against the sum of its sections."""
    sections = campus.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.when(F.col("l_quantity") <= 10, F.lit(4)).otherwise(F.lit(3)).cast("bigint").alias("credits"),
    )
    return history.reconcile(_enrolled(spark, sf_dir), sections, ["o_orderkey"], "credits", "credits")
