"""Queries that connect systems through the crosswalk."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from termweave.functions.hashing import hash_fraction
from termweave.operators import entities, fragment, identity, quality, sketches
from termweave.operators.ordering import top
from termweave.plans import campus, sql
from termweave.plans.registry import query
from termweave.storage import fresh_path, materialize

Q2_SQL = f"""
    WITH {sql.CROSSWALK}, {sql.LMS}, {sql.SIS}
    SELECT s.student_id, count(*) AS n, avg(l.login_count) AS avg_logins
    FROM crosswalk cw
    JOIN lms l ON cw.moodle_user_key = l.moodle_user_key
    JOIN sis s ON cw.student_id = s.student_id AND s.term_code = l.term_code
    GROUP BY s.student_id"""


@query(Q2_SQL, "J1", "J3", "J4", "A2", "P1", "S7", "Q9")
def activity_avg_by_person(spark, sf_dir):
    """Average logins per person over the terms they are enrolled in."""
    lms = campus.line_partials(spark, sf_dir, {"logins": campus.logins()})
    averages = identity.bridge_averages(
        lms.withColumnRenamed("person", "system_key"),
        campus.numbered_crosswalk(spark, sf_dir),
        campus.enrolment_partials(spark, sf_dir),
        "system_key",
        "person",
        by=["person"],
        on=["term_ord"],
        left_values=["logins"],
    )
    return campus.with_keys(averages, campus.student_id(F.col("person")).alias("student_id"))


@query(
    f"SELECT student_id, avg_logins FROM ({Q2_SQL}) ORDER BY student_id LIMIT 10",
    "O1", "O2", "Q9",
)
def login_average(spark, sf_dir):
    """The ten first people by id with their average logins."""
    return top(activity_avg_by_person(spark, sf_dir).select("student_id", "avg_logins"), 10, "student_id")


@query(
    f"""
    WITH {sql.CROSSWALK}, {sql.AID}, {sql.SIS}
    SELECT s.term_code, count(*) AS n, avg(a.loans) AS avg_loans, avg(s.term_gpa) AS avg_term_gpa
    FROM aid a
    JOIN crosswalk cw ON a.workday_person_id = cw.workday_person_id
    JOIN sis s ON cw.student_id = s.student_id AND a.term_code = s.term_code
    GROUP BY s.term_code ORDER BY s.term_code""",
    "J2", "J3", "A3", "O1", "Q9",
)
def two_averages_by_term(spark, sf_dir):
    """Average loans and term averages of people who have both, per term."""
    aid = campus.line_partials(spark, sf_dir, {"loans": campus.loans()})
    averages = identity.bridge_averages(
        aid.withColumnRenamed("person", "system_key"),
        campus.numbered_crosswalk(spark, sf_dir),
        campus.enrolment_partials(spark, sf_dir, ["term_gpa"]),
        "system_key",
        "person",
        by=["term_ord"],
        on=["term_ord"],
        left_values=["loans"],
        right_values=["term_gpa"],
    )
    return campus.coded(averages).orderBy("term_code")


def _events(spark, sf_dir, kind, key, key_name, *columns):
    rows = campus.table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    return rows.select(key(F.col("user_id")).alias(key_name), F.to_date("ts").alias("day"), *columns)


@query(
    f"""
    WITH {sql.CROSSWALK}
    SELECT e.event_id, cw.student_id, e.ts::DATE AS day
    FROM events e JOIN crosswalk cw ON {sql.moodle('e.user_id')} = cw.moodle_user_key
    WHERE e.event_type = 'click'""",
    "J1",
)
def clicks_with_student(spark, sf_dir):
    """Every click with the student behind its key, heavy users spread over tasks."""
    clicks = _events(spark, sf_dir, "click", campus.moodle_key, "moodle_user_key", F.col("event_id"))
    people = campus.crosswalk(spark, sf_dir).select("moodle_user_key", "student_id")
    joined = clicks.join(people, "moodle_user_key")
    return joined.select("event_id", "student_id", "day")


@query(
    f"""
    WITH {sql.CROSSWALK}
    SELECT cw.student_id, c.ts::DATE AS day, c.event_id AS click_id, p.purchases, p.first_purchase
    FROM events c
    JOIN crosswalk cw ON {sql.moodle('c.user_id')} = cw.moodle_user_key
    JOIN (SELECT user_id, ts::DATE AS day, count(*) AS purchases, min(event_id) AS first_purchase
          FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts::DATE) p
      ON {sql.student('p.user_id')} = cw.student_id AND p.day = c.ts::DATE
    WHERE c.event_type = 'click'""",
    "J4", "J3",
)
def bridge_rows(spark, sf_dir):
    """Every click with what the same person bought on that day, matched through the crosswalk."""
    clicks = _events(spark, sf_dir, "click", campus.moodle_key, "moodle_user_key", F.col("event_id").alias("click_id"))
    bought = _events(spark, sf_dir, "purchase", campus.student_id, "student_id", "event_id")
    bought = bought.groupBy("student_id", "day").agg(
        F.count(F.lit(1)).alias("purchases"), F.min("event_id").alias("first_purchase")
    )
    met = identity.bridge_join(
        clicks, campus.crosswalk(spark, sf_dir), bought, "moodle_user_key", "student_id", on=["day"]
    )
    return met.select("student_id", "day", "click_id", "purchases", "first_purchase")


ACTIVE_SQL = f"""
    enrolled AS (SELECT o_custkey AS person, {sql.ord_('o_orderdate')} AS term_ord FROM orders),
    active AS (
        SELECT DISTINCT o_custkey AS person, {sql.ord_('l_shipdate')} AS term_ord
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    extract AS (
        SELECT * FROM active
        WHERE {sql.fraction('lms', "person || ':' || term_ord")} >= 0.10::DOUBLE)"""


def _enrolled_and_extract(spark, sf_dir):
    enrolled = campus.enrolments(spark, sf_dir).select("person", "term_ord")
    active = campus.line_partials(spark, sf_dir, {}).select("person", "term_ord")
    return enrolled, fragment.thin(active, fragment.LMS_MISSING_RATE, "lms", "person", "term_ord")


@query(
    f"""
    WITH {ACTIVE_SQL}
    SELECT {sql.code('term_ord')} AS term_code, sum(l)::BIGINT AS left_rows, sum(lm)::BIGINT AS left_matched,
           sum(r)::BIGINT AS right_rows, sum(rm)::BIGINT AS right_matched,
           CASE WHEN sum(l) > 0 THEN sum(lm)::DOUBLE / sum(l)::DOUBLE END AS left_coverage,
           CASE WHEN sum(r) > 0 THEN sum(rm)::DOUBLE / sum(r)::DOUBLE END AS right_coverage
    FROM (
        SELECT term_ord, 1 AS l, 0 AS r, 0 AS rm,
               CASE WHEN EXISTS (SELECT 1 FROM extract x
                   WHERE x.person = e.person AND x.term_ord = e.term_ord) THEN 1 ELSE 0 END AS lm
        FROM enrolled e
        UNION ALL
        SELECT term_ord, 0, 1,
               CASE WHEN EXISTS (SELECT 1 FROM enrolled e
                   WHERE e.person = x.person AND e.term_ord = x.term_ord) THEN 1 ELSE 0 END, 0
        FROM extract x)
    GROUP BY term_ord""",
    "J5", "X1", "F32",
)
def coverage_by_term(spark, sf_dir):
    """Share of enrolments with an activity row in a thinned extract, and the reverse."""
    enrolled, extract = _enrolled_and_extract(spark, sf_dir)
    found = quality.coverage(enrolled, extract, ["person", "term_ord"], ["term_ord"])
    return campus.coded(found)


@query(
    f"""
    WITH {ACTIVE_SQL},
    keys AS (SELECT term_ord, count(DISTINCT person) AS n, count(DISTINCT CASE WHEN EXISTS (
                 SELECT 1 FROM extract x WHERE x.person = e.person AND x.term_ord = e.term_ord) THEN person END) AS met
             FROM enrolled e GROUP BY term_ord)
    SELECT {sql.code('term_ord')} AS term_code, n AS people, met AS covered, met::DOUBLE / n::DOUBLE AS coverage, true AS within FROM keys""",
    "X1", "J5",
)
def coverage_sketches(spark, sf_dir):
    """Coverage of people estimated from sketches that each of three loads left, beside the exact share, which lies within the bounds."""
    enrolled, extract = _enrolled_and_extract(spark, sf_dir)
    path, by = fresh_path(spark, "key-sketches"), ["term_ord"]
    for load in range(3):
        for system, rows in (("sis", enrolled), ("lms", extract)):
            part = rows.filter(F.pmod(F.col("person"), F.lit(3)) == load)
            sketches.store_sketches(sketches.key_sketches(part, system, by, F.col("person")), path, f"{system}-{load}")
    merged = sketches.merged_sketches(spark, path, by)
    estimated = sketches.estimated_coverage(merged, "sis", "lms", by).select("term_ord", "lowest", "highest")
    exact = quality.coverage(enrolled.distinct(), extract.distinct(), ["person", "term_ord"], by)
    rows = exact.filter("left_rows > 0").join(estimated, "term_ord")
    within = F.col("left_coverage").between(F.col("lowest") - 1e-12, F.col("highest") + 1e-12)
    return campus.coded(
        rows.select("term_ord", F.col("left_rows").alias("people"), F.col("left_matched").alias("covered"), F.col("left_coverage").alias("coverage"), within.alias("within"))
    )


@query(
    f"""
    WITH {ACTIVE_SQL}
    SELECT person, {sql.code('term_ord')} AS term_code, count(*) AS rows_without
    FROM enrolled e
    WHERE NOT EXISTS (SELECT 1 FROM extract x WHERE x.person = e.person AND x.term_ord = e.term_ord)
    GROUP BY person, term_ord""",
    "J5",
)
def missing_activity(spark, sf_dir):
    """Enrolled people and terms without an activity row."""
    enrolled, extract = _enrolled_and_extract(spark, sf_dir)
    lost = identity.missing_keys(enrolled, extract, ["person", "term_ord"])
    return campus.coded(lost)


@query(
    f"""
    WITH known AS (SELECT c_custkey FROM customer WHERE {sql.fraction('known', 'c_custkey')} >= 0.10::DOUBLE),
    rows AS (
        SELECT o_orderkey, CASE WHEN {sql.fraction('kept', 'o_orderkey')} < 0.87::DOUBLE THEN o_custkey END AS person
        FROM orders)
    SELECT o_orderkey, person, CASE WHEN person IS NULL THEN 'no_key' ELSE 'unmatched' END AS reason
    FROM rows r
    WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.c_custkey = r.person)""",
    "J6", "F33",
)
def orphan_rows(spark, sf_dir):
    """Orders without a person, or whose person the thinned register does not know."""
    rows = campus.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("person"))
    rows = fragment.null_out(rows, "person", fragment.HOLD_KEY_KEPT_RATE, "kept", "o_orderkey")
    known = fragment.thin(campus.table(spark, sf_dir, "customer"), 0.10, "known", "c_custkey")
    return identity.orphans(rows, known.select(F.col("c_custkey").alias("person")), ["person"])


SWAPPED_SQL = f"""
    {sql.CROSSWALK},
    chosen AS (
        SELECT student_id, CASE WHEN {sql.fraction('key', 'student_id')} < 0.9::DOUBLE THEN moodle_user_key
                           END AS moodle_user_key, {sql.fraction('swap', 'student_id')} AS pos FROM crosswalk),
    sized AS (
        SELECT *, floor(pos / 0.02::DOUBLE * (SELECT ceil(count(*) / 1000000.0::DOUBLE) FROM chosen
                                             WHERE pos < 0.02::DOUBLE)) AS bucket
        FROM chosen WHERE pos < 0.02::DOUBLE AND moodle_user_key IS NOT NULL),
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY pos, student_id) AS k FROM sized),
    swapped AS (
        SELECT c.student_id, coalesce(p.moodle_user_key, c.moodle_user_key) AS moodle_user_key
        FROM chosen c
        LEFT JOIN numbered n ON n.student_id = c.student_id
        LEFT JOIN numbered p ON p.bucket = n.bucket AND (p.k - 1) // 2 = (n.k - 1) // 2 AND p.k <> n.k)"""


def _swapped(spark, sf_dir):
    people = campus.crosswalk(spark, sf_dir).select("student_id", "moodle_user_key")
    people = fragment.null_out(people, "moodle_user_key", 0.9, "key", "student_id")
    return fragment.swap_pairs(people, fragment.CROSSWALK_MISMATCH_RATE, "swap", "student_id", "moodle_user_key")


@query(f"WITH {SWAPPED_SQL} SELECT * FROM swapped", "J8")
def swap_keys(spark, sf_dir):
    """The crosswalk, some keys missing, with one swap of keys per hundred people."""
    return _swapped(spark, sf_dir)


@query(
    f"""
    WITH {SWAPPED_SQL}
    SELECT DISTINCT least(a.student_id, b.student_id) AS id_a, greatest(a.student_id, b.student_id) AS id_b
    FROM swapped a JOIN swapped b
      ON a.moodle_user_key = 'mdl_' || lower(b.student_id) AND b.moodle_user_key = 'mdl_' || lower(a.student_id)
    WHERE a.student_id < b.student_id""",
    "J7", "X3",
)
def swap_audit(spark, sf_dir):
    """The swapped pairs, found again from the key convention."""
    return identity.swap_audit(_swapped(spark, sf_dir), "student_id", "moodle_user_key", "mdl_")


ROTATED_SQL = f"""
    rotated AS (
        SELECT c_custkey, {sql.student('c_custkey')} AS student_id, c_custkey // 10 AS g,
               coalesce(lead(c_custkey) OVER (PARTITION BY c_custkey // 10 ORDER BY c_custkey),
                        first_value(c_custkey) OVER (PARTITION BY c_custkey // 10 ORDER BY c_custkey)) AS held
        FROM customer WHERE {sql.fraction('turn', 'c_custkey')} < 0.4::DOUBLE)"""


@query(
    f"""
    WITH {ROTATED_SQL}
    SELECT student_id, {sql.student('min(c_custkey) OVER (PARTITION BY g)')} AS cycle, count(*) OVER (PARTITION BY g) AS length,
           {sql.moodle('c_custkey')} AS own_key, {sql.student('holder')} AS holder
    FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n,
                 coalesce(lag(c_custkey) OVER (PARTITION BY g ORDER BY c_custkey),
                          last_value(c_custkey) OVER (PARTITION BY g ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS holder
          FROM rotated) WHERE n > 1""",
    "J7", "X3",
)
def swap_cycles(spark, sf_dir):
    """Circles of people who hold each other's keys, of any length: some people of each ten hand theirs on to the next."""
    person = F.col("c_custkey")
    people = fragment.keep(campus.table(spark, sf_dir, "customer").select("c_custkey"), 0.4, "turn", "c_custkey")
    ten = Window.partitionBy(F.floor(person / 10)).orderBy("c_custkey")
    held = F.coalesce(F.lead("c_custkey").over(ten), F.first("c_custkey").over(ten))
    turned = people.select(campus.student_id(person).alias("student_id"), campus.moodle_key(held).alias("moodle_user_key"))
    others = fragment.thin(campus.table(spark, sf_dir, "customer").select("c_custkey"), 0.4, "turn", "c_custkey")
    rest = others.select(campus.student_id(person).alias("student_id"), campus.moodle_key(person).alias("moodle_user_key"))
    return entities.swap_cycles(turned.unionByName(rest), "student_id", "moodle_user_key", "mdl_")


LINKED_SQL = f"""
    links AS (
        SELECT c_custkey AS person, 'registration' AS system, 'R' || c_custkey AS key FROM customer
        UNION ALL SELECT c_custkey, 'lms', 'L' || CASE WHEN {sql.fraction('lms', 'c_custkey')} < 0.2::DOUBLE THEN c_custkey + 1 ELSE c_custkey END
        FROM customer WHERE {sql.fraction('none', 'c_custkey')} >= 0.05::DOUBLE
        UNION ALL SELECT c_custkey, 'finance', 'F' || CASE WHEN {sql.fraction('fin', 'c_custkey')} < 0.1::DOUBLE THEN c_custkey + 7 ELSE c_custkey END
        FROM customer
        UNION ALL SELECT c_custkey, 'housing', CASE WHEN c_custkey % 20 = 0 THEN 'unknown' END FROM customer)"""


@query(
    f"""
    WITH RECURSIVE {LINKED_SQL},
    pairs AS (SELECT DISTINCT a.person AS p, b.person AS q
              FROM (SELECT * FROM links WHERE system <> 'housing') a JOIN (SELECT * FROM links WHERE system <> 'housing') b USING (system, key)
              UNION SELECT person, (SELECT min(person) FROM links WHERE key = 'unknown') FROM links WHERE key = 'unknown'
              UNION SELECT (SELECT min(person) FROM links WHERE key = 'unknown'), person FROM links WHERE key = 'unknown'),
    -- The least person of a neighbour is handed on until nothing changes.
    label(step, p, m) AS (
        SELECT 0, p, p FROM (SELECT DISTINCT person AS p FROM links)
        UNION ALL SELECT step + 1, pairs.p, min(label.m) FROM label JOIN pairs ON pairs.q = label.p WHERE step < 30 GROUP BY step, pairs.p),
    members AS (SELECT p AS person, m AS entity FROM label WHERE step = (SELECT max(step) FROM label)),
    per_system AS (SELECT entity, system, count(DISTINCT key) AS n FROM links JOIN members USING (person) GROUP BY entity, system)
    SELECT entity, (SELECT count(*) FROM members m WHERE m.entity = s.entity) AS people, sum(n)::BIGINT AS keys, count_if(n > 0)::BIGINT AS systems,
           count_if(n > 1)::BIGINT AS conflicts
    FROM per_system s GROUP BY entity""",
    "X3",
)
def entity_components(spark, sf_dir):
    """People who share a key in any of four systems, directly or through others, one of the keys being very common."""
    customers, person = campus.table(spark, sf_dir, "customer"), F.col("c_custkey")

    def keys(system, rows, letter, number):
        key = F.concat(F.lit(letter), number.cast("string"))
        return rows.select(person.alias("person"), F.lit(system).alias("system"), key.alias("key"))

    with_lms = fragment.thin(customers, 0.05, "none", "c_custkey")
    late, other = hash_fraction("lms", person) < 0.2, hash_fraction("fin", person) < 0.1
    unknown = F.when(person % 20 == 0, F.lit("unknown")).alias("key")
    links = (
        keys("registration", customers, "R", person)
        .unionByName(keys("lms", with_lms, "L", F.when(late, person + 1).otherwise(person)))
        .unionByName(keys("finance", customers, "F", F.when(other, person + 7).otherwise(person)))
        .unionByName(customers.select(person.alias("person"), F.lit("housing").alias("system"), unknown))
    )
    links = materialize(links, "links")
    members = materialize(entities.entities(links, "person", "system", "key"), "members")
    return entities.entity_summary(links, members, "person", "system", "key")


@query(
    f"""
    WITH {SWAPPED_SQL}
    SELECT * FROM swapped WHERE moodle_user_key <> 'mdl_' || lower(student_id)""",
    "X3", "F15",
)
def convention_breaks(spark, sf_dir):
    """Crosswalk rows whose key does not follow from the student id."""
    return identity.convention_breaks(_swapped(spark, sf_dir), "student_id", "moodle_user_key", "mdl_")


@query(
    """
    SELECT 'key_of_several_people' AS kind, l_partkey AS value, count(DISTINCT l_suppkey) AS partners
    FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1
    UNION ALL
    SELECT 'person_with_several_keys', l_suppkey, count(DISTINCT l_partkey)
    FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 1""",
    "X3",
)
def key_ambiguity(spark, sf_dir):
    """Parts sold by several suppliers and suppliers of several parts, as keys and people."""
    return identity.key_ambiguity(campus.table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


@query(
    """
    WITH c AS (SELECT user_id FROM events WHERE event_type = 'click'),
         p AS (SELECT user_id FROM events WHERE event_type = 'purchase'),
         j AS (SELECT count(*) AS n FROM c JOIN p ON c.user_id = p.user_id),
         m AS (SELECT count(*) AS n FROM (SELECT user_id FROM c GROUP BY 1 HAVING count(*) > 1)
               JOIN (SELECT user_id FROM p GROUP BY 1 HAVING count(*) > 1) USING (user_id))
    SELECT (SELECT count(*) FROM c) AS left_rows, (SELECT count(*) FROM p) AS right_rows,
           j.n AS output_rows, m.n AS many_to_many_keys,
           j.n::DOUBLE / greatest((SELECT count(*) FROM c), (SELECT count(*) FROM p))::DOUBLE AS growth
    FROM j, m""",
    "X4",
)
def join_cardinality(spark, sf_dir):
    """How many rows joining clicks to purchases by user would give."""
    events = campus.table(spark, sf_dir, "events")
    clicks = events.filter(F.col("event_type") == "click")
    bought = events.filter(F.col("event_type") == "purchase")
    return quality.join_cardinality(clicks, bought, ["user_id"])
