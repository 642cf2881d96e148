"""Queries made of column expressions: terms, levels, grades, keys, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from termweave.functions import catalogs, derive, terms
from termweave.functions.hashing import hash_fraction, uniform_choice
from termweave.operators import fragment
from termweave.operators.ordering import latest_per_key, top
from termweave.plans import campus, sql
from termweave.plans.registry import query
from termweave.sources.extracts import nulls_from_text, union_extracts

LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def _lines(spark, sf_dir):
    return campus.table(spark, sf_dir, "lineitem")


def _line_key():
    return [F.col(c.strip()) for c in LINE.split(",")]


@query(
    f"""
    SELECT {sql.term('o_orderdate')} AS term_code, o_orderstatus AS enrollment_status, count(*) AS cnt
    FROM orders GROUP BY 1, 2 ORDER BY 1, 2""",
    "A1", "O1", "F4", "P1", "Q9",
)
def status_by_term(spark, sf_dir):
    """Rows per term and status."""
    counted = (
        campus.table(spark, sf_dir, "orders")
        .groupBy(
            terms.term_ord_of_date(F.col("o_orderdate")).alias("term_ord"),
            F.col("o_orderstatus").alias("enrollment_status"),
        )
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return counted.select(terms.term_code(F.col("term_ord")).alias("term_code"), "enrollment_status", "cnt").orderBy(
        "term_code", "enrollment_status"
    )


@query(
    f"""
    WITH o AS (SELECT {sql.term('o_orderdate')} AS term_code, {sql.ord_('o_orderdate')} AS term_ord FROM orders)
    SELECT term_code, substr(term_code, 1, 4)::INTEGER AS term_year, substr(term_code, 5, 2) AS season, term_ord,
           {sql.code('term_ord + 1')} AS next_code, count(*) AS cnt
    FROM o GROUP BY term_code, term_ord""",
    "F3", "F4", "F5",
)
def term_parse_next(spark, sf_dir):
    """Term codes taken apart, placed in time and moved on by one."""
    code = F.col("term_code")
    counted = (
        campus.table(spark, sf_dir, "orders")
        .groupBy(terms.term_of_date(F.col("o_orderdate")).alias("term_code"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return counted.select(
        code,
        terms.term_year(code).alias("term_year"),
        terms.term_season(code).alias("season"),
        terms.term_ord(code).alias("term_ord"),
        terms.next_term(code).alias("next_code"),
        "cnt",
    )


@query(
    """
    WITH c AS (SELECT year(l_shipdate)::VARCHAR ||
                      CASE l_returnflag WHEN 'A' THEN 'FA' WHEN 'R' THEN 'SP' ELSE 'WI' END AS code FROM lineitem)
    SELECT code, CASE WHEN code LIKE '%SP' THEN substr(code, 1, 4)::INTEGER * 3
                      WHEN code LIKE '%FA' THEN substr(code, 1, 4)::INTEGER * 3 + 2 END AS term_ord, count(*) AS cnt
    FROM c GROUP BY code""",
    "F3",
)
def term_parse_lenient(spark, sf_dir):
    """Codes with an unknown season have no place in time."""
    season = F.when(F.col("l_returnflag") == "A", "FA").when(F.col("l_returnflag") == "R", "SP").otherwise("WI")
    code = F.concat(F.year("l_shipdate").cast("string"), season)
    counted = _lines(spark, sf_dir).groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("cnt"))
    return counted.select("code", terms.term_ord(F.col("code"), strict=False).alias("term_ord"), "cnt")


@query(
    f"""
    WITH o AS (SELECT {sql.ord_('o_orderdate')} AS term_ord, count(*) AS n FROM orders GROUP BY 1),
    s AS (SELECT unnest(range(min(term_ord), max(term_ord) + 1))::INTEGER AS term_ord FROM o)
    SELECT s.term_ord, {sql.code('s.term_ord')} AS term_code, coalesce(n, 0) AS orders
    FROM s LEFT JOIN o ON s.term_ord = o.term_ord""",
    "F6",
)
def term_sequence(spark, sf_dir):
    """The calendar from the first to the last term, with the orders of each."""
    counted = (
        campus.table(spark, sf_dir, "orders")
        .groupBy(terms.term_ord_of_date(F.col("o_orderdate")).alias("term_ord"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ends = counted.agg(F.min("term_ord").alias("a"), F.max("term_ord").alias("z"))
    calendar = ends.select(F.explode(terms.terms_between(F.col("a"), F.col("z"))).alias("term_ord"))
    return calendar.join(counted, "term_ord", "left").select(
        "term_ord",
        terms.term_code(F.col("term_ord")).alias("term_code"),
        F.coalesce("n", F.lit(0)).alias("orders"),
    )


@query(
    f"""
    WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, {sql.rank('o_orderdate')} AS s,
                      least(day(o_orderdate), 28) AS d FROM orders),
    t AS (SELECT o_orderkey, make_date(y, [4, 7, 11][s + 1], d) AS last_activity_date,
                 make_date(y, [1, 5, 8][s + 1], d) AS placed_date FROM o)
    SELECT *, strftime(placed_date, '%Y-%m-%d') AS placed_text, month(placed_date)::INTEGER AS placed_month,
           day(placed_date)::INTEGER AS placed_day FROM t""",
    "F7", "F8", "F9",
)
def term_dates(spark, sf_dir):
    """Dates of activity and holds in the term of each order."""
    day = F.least(F.dayofmonth("o_orderdate"), F.lit(28))
    code = F.col("term_code")
    season = terms.term_season(code)
    dated = (
        campus.table(spark, sf_dir, "orders")
        .withColumn("term_code", terms.term_of_date(F.col("o_orderdate")))
        .select(
            "o_orderkey",
            terms.term_date(code, terms.activity_month(season), day).alias("last_activity_date"),
            terms.term_date(code, terms.hold_month(season), day).alias("placed_date"),
        )
    )
    return dated.select(
        "*",
        terms.iso_date(F.col("placed_date")).alias("placed_text"),
        F.month("placed_date").alias("placed_month"),
        F.dayofmonth("placed_date").alias("placed_day"),
    )


@query(
    f"""
    SELECT {LINE}, (l_quantity * 2)::INTEGER AS credits,
           CASE WHEN l_quantity * 2 < 30 THEN 'Freshman' WHEN l_quantity * 2 < 60 THEN 'Sophomore'
                WHEN l_quantity * 2 < 90 THEN 'Junior' ELSE 'Senior' END AS class_level
    FROM lineitem""",
    "F1",
)
def class_level(spark, sf_dir):
    """Year of study by credits."""
    credits = (F.col("l_quantity") * 2).cast("int")
    return _lines(spark, sf_dir).select(
        *_line_key(), credits.alias("credits"), derive.class_level(credits).alias("class_level")
    )


@query(
    f"""
    WITH p AS (SELECT {LINE}, round(l_quantity / 12.5::DOUBLE * 100) / 100 AS grade_points FROM lineitem)
    SELECT *, CASE WHEN grade_points < 1.0 THEN 'F' WHEN grade_points < 1.5 THEN 'D'
                   WHEN grade_points < 1.85::DOUBLE THEN 'C-' WHEN grade_points < 2.15::DOUBLE THEN 'C'
                   WHEN grade_points < 2.5 THEN 'C+' WHEN grade_points < 2.85::DOUBLE THEN 'B-'
                   WHEN grade_points < 3.2::DOUBLE THEN 'B' WHEN grade_points < 3.5 THEN 'B+'
                   WHEN grade_points < 3.85::DOUBLE THEN 'A-' ELSE 'A' END AS letter_grade
    FROM p""",
    "F2", "F11",
)
def letter_grade(spark, sf_dir):
    """Letter of each section's grade points."""
    points = derive.round2(F.col("l_quantity") / 12.5)
    graded = _lines(spark, sf_dir).select(*_line_key(), points.alias("grade_points"))
    return graded.withColumn("letter_grade", derive.letter_grade(F.col("grade_points")))


@query(
    f"""
    SELECT {LINE}, least(greatest(l_extendedprice, 1000.0), 50000.0) AS clamped,
           round(l_extendedprice * (1 - l_discount) * 100) / 100 AS rounded
    FROM lineitem""",
    "F10", "F11",
)
def clamp_round(spark, sf_dir):
    """Amounts forced into a range, and rounded to cents."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return _lines(spark, sf_dir).select(
        *_line_key(),
        derive.clamp(F.col("l_extendedprice"), 1000.0, 50000.0).alias("clamped"),
        derive.round2(net).alias("rounded"),
    )


@query(
    f"""
    WITH t AS (SELECT {LINE}, 11 + l_linenumber AS attempted,
                      round(least(l_quantity / 12.5::DOUBLE, 4.0) * 100) / 100 AS term_gpa FROM lineitem)
    SELECT *, round(attempted * least(greatest(0.70::DOUBLE + 0.08::DOUBLE * term_gpa, 0.0), 0.98::DOUBLE))::INTEGER
              AS credits_earned
    FROM t""",
    "F12", "F10",
)
def completion(spark, sf_dir):
    """Credits earned out of the attempted ones."""
    attempted = F.lit(11) + F.col("l_linenumber")
    gpa = derive.round2(derive.clamp(F.col("l_quantity") / 12.5, 0.0, 4.0))
    rows = _lines(spark, sf_dir).select(*_line_key(), attempted.alias("attempted"), gpa.alias("term_gpa"))
    return rows.withColumn("credits_earned", derive.completed_credits(F.col("attempted"), F.col("term_gpa")))


@query(
    f"""
    WITH c AS (SELECT c_custkey, {sql.fraction('gpa', 'c_custkey')} AS u FROM customer)
    SELECT c_custkey, round(100 * CASE
        WHEN u >= 0.75 THEN (u - 0.75::DOUBLE) / 0.25::DOUBLE * (4.0::DOUBLE - 3.57::DOUBLE) + 3.57::DOUBLE
        WHEN u >= 0.5 THEN (u - 0.5::DOUBLE) / 0.25::DOUBLE * (3.57::DOUBLE - 3.31::DOUBLE) + 3.31::DOUBLE
        WHEN u >= 0.25 THEN (u - 0.25::DOUBLE) / 0.25::DOUBLE * (3.31::DOUBLE - 3.02::DOUBLE) + 3.02::DOUBLE
        ELSE u / 0.25::DOUBLE * 3.02::DOUBLE END) / 100 AS base_gpa
    FROM c""",
    "F28", "F31", "F11",
)
def piecewise_gpa(spark, sf_dir):
    """Each person's average from a curve through quartiles."""
    fraction = hash_fraction("gpa", F.col("c_custkey"))
    return campus.table(spark, sf_dir, "customer").select(
        "c_custkey", derive.gpa_from_fraction(fraction).alias("base_gpa")
    )


@query(
    f"""
    WITH c AS (SELECT c_custkey, {sql.fraction('credits', 'c_custkey')} AS u,
                      floor({sql.fraction('level', 'c_custkey')} * 4)::INTEGER AS k FROM customer)
    SELECT c_custkey, ['Freshman', 'Sophomore', 'Junior', 'Senior'][k + 1] AS class_level,
           floor(u * 30 + k * 30)::INTEGER AS credits
    FROM c""",
    "F29", "F31",
)
def band_expand(spark, sf_dir):
    """Credits at a random point of each person's year of study."""
    person = F.col("c_custkey")
    level = uniform_choice(hash_fraction("level", person), derive.LEVEL_LABELS)
    rows = campus.table(spark, sf_dir, "customer").select("c_custkey", level.alias("class_level"))
    return rows.withColumn(
        "credits", derive.credits_in_level(F.col("class_level"), hash_fraction("credits", person))
    )


@query(
    f"""
    SELECT c_custkey, {sql.student('c_custkey')} AS student_id, {sql.moodle('c_custkey')} AS moodle_user_key,
           {sql.workday('c_custkey')} AS workday_person_id, {sql.student('c_custkey + 9999990')} AS long_id
    FROM customer""",
    "F14", "F15", "F16",
)
def key_format(spark, sf_dir):
    """Keys of the three systems; numbers longer than the padding keep all digits."""
    person = F.col("c_custkey")
    return campus.table(spark, sf_dir, "customer").select(
        "c_custkey",
        campus.student_id(person).alias("student_id"),
        campus.moodle_key(person).alias("moodle_user_key"),
        campus.workday_id(person).alias("workday_person_id"),
        campus.student_id(person + 9999990).alias("long_id"),
    )


SUBJECT_LIST = ", ".join(f"'{s}'" for s in catalogs.SUBJECTS)


@query(
    f"""
    WITH s AS (SELECT {LINE}, {sql.term('l_shipdate')} AS term_code,
                      [{SUBJECT_LIST}][floor({sql.fraction('subject', 'l_partkey')} * 16)::INTEGER + 1] AS subject,
                      (100 + l_partkey % 100)::VARCHAR AS catalog_number,
                      ['A', 'B', 'C', 'D', 'E'][(l_suppkey % 5 + 1)::INTEGER] AS section FROM lineitem)
    SELECT *, 'WD-' || term_code || '-' || subject || '-' || catalog_number || section AS section_id FROM s""",
    "F17", "F18", "F31", "S10",
)
def section_keys(spark, sf_dir):
    """Course section keys, built and taken apart again."""
    subject = uniform_choice(hash_fraction("subject", F.col("l_partkey")), catalogs.SUBJECTS)
    key = derive.section_id(
        terms.term_of_date(F.col("l_shipdate")), subject, 100 + F.col("l_partkey") % 100, F.col("l_suppkey") % 5 + 1
    )
    rows = _lines(spark, sf_dir).select(*_line_key(), key.alias("section_id"))
    return rows.select("*", derive.section_parts(F.col("section_id")).alias("p")).select(
        *_line_key(), "section_id", "p.term_code", "p.subject", "p.catalog_number", "p.section"
    )


@query(
    f"""
    SELECT {sql.student('c_custkey')} AS student_id, c_name AS full_name,
           lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '@example.edu' AS email,
           c_mktsegment AS initial_major, 'Workday Student' AS primary_system, n_name AS nation
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "P1", "P3", "P4", "F20", "F19", "S10",
)
def student_master(spark, sf_dir):
    """The master record of each person, projected from one table, with a constant column."""
    nations = campus.table(spark, sf_dir, "nation")
    people = campus.table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return people.select(
        campus.student_id(F.col("c_custkey")).alias("student_id"),
        F.col("c_name").alias("full_name"),
        derive.email(derive.slug(F.col("c_name")), "example.edu").alias("email"),
        F.col("c_mktsegment").alias("initial_major"),
        F.lit(catalogs.SYSTEMS["primary"]).alias("primary_system"),
        F.col("n_name").alias("nation"),
    )


@query("SELECT * FROM supplier", "P2")
def all_columns(spark, sf_dir):
    """Every column of a table."""
    return campus.table(spark, sf_dir, "supplier").select("*")


@query(
    "SELECT ts::DATE AS day, count(*) AS cnt, max(event_id) AS last_event FROM events "
    "WHERE event_type = 'error' GROUP BY 1",
    "P5", "Q1",
)
def events_of_type(spark, sf_dir):
    """SQL with a parameter: events of one type per day."""
    return spark.sql(
        """
        SELECT to_date(ts) AS day, count(*) AS cnt, max(event_id) AS last_event
        FROM {events} WHERE event_type = :kind GROUP BY ALL""",
        args={"kind": "error"},
        events=campus.table(spark, sf_dir, "events"),
    )


@query(
    f"""
    WITH o AS (SELECT *, o_orderdate::DATE AS placed_date,
                      CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + (o_custkey % 5)::INTEGER END AS cleared_date
               FROM orders)
    SELECT uuid_text AS hold_id, {sql.term('placed_date')} AS term_code,
           CASE WHEN {sql.fraction('holder', 'o_orderkey')} < 0.87::DOUBLE THEN {sql.student('o_custkey')} END AS student_id,
           ['advising', 'financial', 'immunization', 'conduct', 'housing', 'workday_verification']
               [floor({sql.fraction('hold_type', 'o_orderkey')} * 6)::INTEGER + 1] AS hold_type,
           cleared_date IS NULL AS active, placed_date, cleared_date
    FROM (SELECT *, md5(o_orderkey::VARCHAR) AS h,
                 substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' ||
                 ['8', '9', 'a', 'b'][(('0x' || substr(h, 17, 1))::INTEGER % 4) + 1] || substr(h, 18, 3) || '-' ||
                 substr(h, 21, 12) AS uuid_text FROM o)
    WHERE {sql.fraction('hold', 'o_orderkey')} < 0.12::DOUBLE""",
    "P10", "F9", "F30", "F31", "F32", "F33",
)
def advising_holds(spark, sf_dir):
    """Holds on a share of the orders: active until cleared, some without a person."""
    held = fragment.keep(campus.table(spark, sf_dir, "orders"), fragment.HOLD_RATE, "hold", "o_orderkey")
    placed = F.to_date("o_orderdate")
    cleared = F.when(F.col("o_orderstatus") == "F", F.date_add(placed, (F.col("o_custkey") % 5).cast("int")))
    dated = held.select("o_orderkey", "o_custkey", placed.alias("placed_date"), cleared.alias("cleared_date"))
    holds = dated.select(
        "o_orderkey",
        derive.stable_uuid(F.col("o_orderkey")).alias("hold_id"),
        terms.term_of_date(F.col("placed_date")).alias("term_code"),
        campus.student_id(F.col("o_custkey")).alias("student_id"),
        uniform_choice(hash_fraction("hold_type", F.col("o_orderkey")), catalogs.HOLD_TYPES).alias("hold_type"),
        F.col("cleared_date").isNull().alias("active"),
        "placed_date",
        "cleared_date",
    )
    return fragment.null_out(holds, "student_id", fragment.HOLD_KEY_KEPT_RATE, "holder", "o_orderkey").drop("o_orderkey")


@query(
    f"""
    SELECT {sql.term('l_shipdate')} AS term_code, l_returnflag <> 'N' AS fafsa_received, count(*) AS cnt,
           sum(CASE WHEN l_returnflag <> 'N' THEN floor(l_extendedprice) ELSE 0 END)::BIGINT AS loans,
           sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE 0 END)::BIGINT AS ungated
    FROM lineitem GROUP BY 1, 2""",
    "P11",
)
def gated_amount(spark, sf_dir):
    """Amounts that only count with a flag, and the check that none is left without it."""
    flag = F.col("l_returnflag") != "N"
    rows = _lines(spark, sf_dir).select(
        terms.term_ord_of_date(F.col("l_shipdate")).alias("term_ord"),
        flag.alias("fafsa_received"),
        derive.gated(flag, F.floor("l_extendedprice")).alias("loans"),
    )
    sums = rows.groupBy("term_ord", "fafsa_received").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.sum("loans").alias("loans"),
        F.count_if(~F.col("fafsa_received") & (F.col("loans") != 0)).alias("ungated"),
    )
    return sums.select(terms.term_code(F.col("term_ord")).alias("term_code"), *sums.columns[1:])


@query(
    """
    SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag || 'A' END AS token, count(*) AS cnt
    FROM lineitem GROUP BY 1""",
    "S1",
)
def null_tokens(spark, sf_dir):
    """Texts that mean a missing value become null."""
    rows = _lines(spark, sf_dir).select(F.concat("l_returnflag", F.lit("A")).alias("token"))
    return nulls_from_text(rows).groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "SELECT user_id, event_id, ts, event_type, value FROM events "
    "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "W8",
)
def latest_per_user(spark, sf_dir):
    """The last event of every user."""
    events = campus.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return latest_per_key(events, ["user_id"], ["ts", "event_id"])


@query(
    "SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 1",
    "O3",
)
def latest_error(spark, sf_dir):
    """The last error of all."""
    errors = campus.table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return top(errors.select("event_id", "ts", "user_id"), 1, F.desc("ts"), F.desc("event_id"))


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 5", "O4", "O2")
def preview_rows(spark, sf_dir):
    """The first five events."""
    return top(campus.table(spark, sf_dir, "events").select("event_id", "event_type", "value"), 5, "event_id")


@query(
    """
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate < DATE '1998-01-01' THEN NULL ELSE o_orderpriority END
               AS o_orderpriority,
           CASE WHEN o_orderdate < DATE '1998-01-01' THEN o_totalprice END AS o_totalprice
    FROM orders""",
    "O5", "S3",
)
def union_terms(spark, sf_dir):
    """Two extracts of one table with different columns, put together by name."""
    orders = campus.table(spark, sf_dir, "orders")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("date")
    return union_extracts(
        orders.filter(early).select("o_orderkey", "o_custkey", "o_totalprice"),
        orders.filter(~early).select("o_orderpriority", "o_custkey", "o_orderkey"),
    )
