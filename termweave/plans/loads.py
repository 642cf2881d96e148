"""Queries that write and read back: formats, term folders, streams, the run log."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.functions import derive, terms
from termweave.operators import fragment, quality
from termweave.plans import campus, receipts, sql
from termweave.plans.registry import query
from termweave.plans.workload import WORKLOAD
from termweave.sources import extracts, sinks, versions
from termweave.storage import fresh_path, materialize
from termweave.streaming import redelivery
from termweave.streaming.incremental import load_incremental

UTC_FORM = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"

ORDER_ROWS = f"""
    SELECT o_orderkey, {sql.term('o_orderdate')} AS term_code, o_orderdate::DATE AS placed_date,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS amount,
           'Health: Science, "Society", ' || o_orderpriority AS major, o_orderstatus = 'F' AS active
    FROM orders"""


def _orders(spark, sf_dir):
    return campus.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        terms.term_of_date(F.col("o_orderdate")).alias("term_code"),
        F.to_date("o_orderdate").alias("placed_date"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("amount"),
        F.concat(F.lit('Health: Science, "Society", '), F.col("o_orderpriority")).alias("major"),
        (F.col("o_orderstatus") == "F").alias("active"),
    )


@query(f"SELECT * REPLACE (major || chr(10) || '2nd line' AS major) FROM ({ORDER_ROWS})", "S1", "K1")
def csv_roundtrip(spark, sf_dir):
    """Rows written as CSV and read with their schema: line breaks, quotes, commas, dates, nulls."""
    rows, path = _orders(spark, sf_dir), fresh_path(spark, "csv")
    rows = rows.withColumn("major", F.concat("major", F.lit("\n2nd line")))
    sinks.write_table(rows, path, "csv")
    return extracts.read_csv(spark, path, rows.schema, multiline=True)


RAW_LINE = """o_orderkey || ',"' || replace(major, '"', '""') || '"' ||
    CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN ',' || term_code || ',"left, over"' ELSE ',' || term_code END"""


@query(
    f"""
    WITH l AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 2 WHEN o_orderkey % 7 = 0 THEN 4 ELSE 3 END AS cells, {RAW_LINE} AS line
               FROM ({ORDER_ROWS}))
    SELECT o_orderkey, CASE WHEN cells = 3 THEN major END AS major, CASE WHEN cells = 3 THEN term_code END AS term_code,
           CASE WHEN cells <> 3 THEN cells END::INTEGER AS n_cells, CASE WHEN cells <> 3 THEN line END AS text,
           true AS placed FROM l""",
    "S1",
)
def malformed_rows(spark, sf_dir):
    """Delivered lines, some with a cell too many or too few: whole rows typed, the others kept aside as they stand, with their place."""
    rows, path = _orders(spark, sf_dir), fresh_path(spark, "raw")
    layout = T.StructType.fromDDL("o_orderkey BIGINT, major STRING, term_code STRING")
    # Lines as they are, below a header: a single column without quotes.
    lines = rows.select(F.expr(RAW_LINE).alias(",".join(layout.names)))
    lines.write.options(header=True, sep="\x01", quote="", escapeQuotes=False).csv(path)
    good, bad = extracts.split_malformed(spark, path, layout)
    key = F.regexp_extract("text", "^([0-9]+),", 1).cast("bigint")
    longest = bad.groupBy("source_file").agg(F.max("record").alias("last"), F.countDistinct("record").alias("n"), F.count(F.lit(1)).alias("rows"))
    # No two rows share a place.
    sound = longest.select("source_file", ((F.col("n") == F.col("rows")) & (F.col("last") >= F.col("n"))).alias("placed"))
    aside = bad.join(sound, "source_file").select(
        key.alias("o_orderkey"), F.lit(None).cast("string").alias("major"), F.lit(None).cast("string").alias("term_code"), "n_cells", "text", "placed"
    )
    none = F.lit(None).cast("string").alias("text")
    return good.select("*", F.lit(None).cast("int").alias("n_cells"), none, F.lit(True).alias("placed")).unionByName(aside)


@query(ORDER_ROWS, "S2", "K2")
def json_roundtrip(spark, sf_dir):
    """Rows written as JSON lines with explicit nulls and read back."""
    rows, path = _orders(spark, sf_dir), fresh_path(spark, "json")
    sinks.write_table(rows, path, "json")
    return extracts.read_json(spark, path, rows.schema, lines=True)


@query(
    f"SELECT * FROM ({ORDER_ROWS}) WHERE term_code <> '1997SU' OR active",
    "K3", "S7",
)
def term_folders(spark, sf_dir):
    """One folder per term; one term is then delivered again and replaced alone."""
    rows, root = _orders(spark, sf_dir), fresh_path(spark, "terms")
    path = sinks.write_extracts(rows, root, "orders_by_term")
    again = rows.filter((F.col("term_code") == "1997SU") & F.col("active"))
    sinks.write_extracts(again, root, "orders_by_term")
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


@query(
    f"""
    SELECT o_orderkey, term_code, CASE WHEN active THEN NULL ELSE amount END AS amount,
           CASE WHEN active THEN major END AS major
    FROM ({ORDER_ROWS})""",
    "O5",
)
def append_extracts(spark, sf_dir):
    """Two deliveries with different columns appended to one table."""
    rows, path = _orders(spark, sf_dir), fresh_path(spark, "append")
    late = ~F.col("active")
    sinks.write_table(rows.filter(late).select("o_orderkey", "amount", "term_code"), path, "parquet", "append")
    sinks.write_table(rows.filter(~late).select("term_code", "major", "o_orderkey"), path, "parquet", "append")
    return extracts.read_parts(spark, path).select("o_orderkey", "term_code", "amount", "major")


ODD = "o_orderkey % 2 = 1"
DELIVERED = (
    T.StructType()
    .add("o_orderkey", T.LongType())
    .add("term_code", T.StringType())
    .add("amount", T.DoubleType())
    .add("major", T.StringType())
    .add("active", T.BooleanType())
)


#: Rows a delivered file holds at most, about, so that large terms come in parts.
IN_PARTS, WHOLE = 2000, 1_000_000


def _deliver(rows, root, when, fmt, suffix=None, rows_per_file=IN_PARTS, by="term_code"):
    some = rows.filter(when).select(*DELIVERED.names)
    sinks.write_delivery(some, root, "sis_orders", fmt, by, suffix, rows_per_file)


def _delivery(spark, sf_dir, rows_per_file=IN_PARTS):
    """A delivery of orders: CSV, JSON and shouting CSV by season, and one quarter at top level."""
    rows, root = _orders(spark, sf_dir), fresh_path(spark, "delivery")
    top = F.col("o_orderkey") % 4 == 0
    season = F.substring("term_code", 5, 2)
    rows = rows.withColumn("major", F.concat("major", F.lit("\n2nd line")))
    _deliver(rows, root, ~top & (season == "SP"), "csv", None, rows_per_file)
    _deliver(rows, root, ~top & (season == "SU"), "json", None, rows_per_file)
    _deliver(rows, root, ~top & (season == "FA"), "csv", "CSV", rows_per_file)
    _deliver(rows, root, top, "csv", None, rows_per_file, by=None)
    sinks.write_run_metadata(spark, f"{root}/runs", seed=1)
    return root


DELIVERED_SQL = f"""
    SELECT o_orderkey, term_code, amount, major || chr(10) || '2nd line' AS major, active,
           CASE WHEN o_orderkey % 4 <> 0 THEN term_code END AS source_term
    FROM ({ORDER_ROWS})"""


@query(DELIVERED_SQL, "S1", "S2", "S3", "S4", "S5", "S6", "O5")
def assemble_terms(spark, sf_dir):
    """A table assembled from term folders and the top level, in two formats and two spellings of a suffix."""
    root = _delivery(spark, sf_dir)
    whole = extracts.assemble(
        spark, root, ["sis_orders"], with_source=True, multiline=True, table_schemas={"sis_orders": DELIVERED}
    )["sis_orders"]
    return whole.select(*DELIVERED.names, "source_term")


@query(
    f"""
    SELECT coalesce(source_term, '') AS term, CASE WHEN source_term LIKE '%SU' THEN 'json' ELSE 'csv' END AS format,
           count(*) AS files FROM (SELECT DISTINCT source_term FROM ({DELIVERED_SQL})) GROUP BY ALL""",
    "S4", "S5", "S6",
)
def listed_files(spark, sf_dir):
    """The files of a delivery, found by listing."""
    found = extracts.list_extracts(spark, _delivery(spark, sf_dir, WHOLE)).filter("table_name = 'sis_orders'")
    return found.groupBy(F.coalesce("term_folder", F.lit("")).alias("term"), "format").agg(F.count("*").alias("files"))


@query(
    f"""
    SELECT o_orderkey, term_code, amount, CASE WHEN {ODD} THEN major END AS major
    FROM ({ORDER_ROWS}) WHERE amount IS NULL OR amount >= 1000""",
    "K4", "K5", "K6", "P3",
)
def table_sinks(spark, sf_dir):
    """A table created, extended by deliveries with other columns, and recreated from itself."""
    rows, name = _orders(spark, sf_dir), f"orders_{uuid.uuid4().hex}"
    root = fresh_path(spark, "projections")
    sinks.write_projections(
        rows, root, {"all": ["o_orderkey", "amount", "term_code"], "majors": ["term_code", "major", "amount", "o_orderkey"]}
    )
    read = lambda part: spark.read.parquet(f"{root}/{part}")
    try:
        sinks.ensure_table(spark, name, T.StructType.fromDDL("o_orderkey BIGINT, amount DOUBLE"))
        sinks.append_aligned(read("all").filter(f"NOT ({ODD})"), name)
        sinks.append_aligned(read("majors").filter(ODD), name)
        sinks.recreate(spark.table(name).filter("amount IS NULL OR amount >= 1000"), name)
        return materialize(spark.table(name).select("o_orderkey", "term_code", "amount", "major"), "table-sinks")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@query(f"SELECT o_orderkey, term_code, amount, major, active FROM ({DELIVERED_SQL})", "K5", "O5")
def append_once(spark, sf_dir):
    """A delivery appended twice leaves one copy."""
    root, name = _delivery(spark, sf_dir), f"sis_orders_{uuid.uuid4().hex}"
    try:
        for _ in range(2):
            found = extracts.assemble(
                spark, root, ["sis_orders"], with_source=True, multiline=True, table_schemas={"sis_orders": DELIVERED}
            )
            sinks.load_tables({name: found["sis_orders"]})
        return materialize(spark.table(name).select(*DELIVERED.names), "append-once")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@query(
    f"""
    SELECT o_orderkey, term_code, amount, major, active, CASE WHEN o_orderkey % 4 <> 0 THEN term_code END AS source_term
    FROM ({ORDER_ROWS})""",
    "T1",
)
def incremental_load(spark, sf_dir):
    """A delivery loaded by a stream in two runs, as its terms arrive, and each file once."""
    rows, root = _orders(spark, sf_dir), fresh_path(spark, "arrivals")
    target, checkpoint = fresh_path(spark, "stream"), fresh_path(spark, "stream-checkpoint")
    top, season = F.col("o_orderkey") % 4 == 0, F.substring("term_code", 5, 2)
    _deliver(rows, root, top, "csv", by=None)
    _deliver(rows, root, ~top & (season == "SP"), "csv")
    load_incremental(spark, root, "sis_orders", target, checkpoint, schema=DELIVERED)
    _deliver(rows, root, ~top & (season == "SU"), "json")
    _deliver(rows, root, ~top & (season == "FA"), "csv", "CSV")
    for _ in range(2):
        loaded = load_incremental(spark, root, "sis_orders", target, checkpoint, schema=DELIVERED)
    return loaded.select(*DELIVERED.names, F.nullif("source_term", F.lit("")).alias("source_term"))


@query(
    f"""
    WITH o AS ({ORDER_ROWS})
    SELECT o_orderkey, term_code, CASE WHEN term_code LIKE '%SU' THEN amount * 2 ELSE amount END AS amount, active
    FROM o WHERE term_code NOT LIKE '%FA' OR o_orderkey % 2 = 0
              OR term_code NOT IN (SELECT term_code FROM o WHERE o_orderkey % 2 = 0)  -- of these no file comes again""",
    "T1", "K5", "S4",
)
def redelivered_files(spark, sf_dir):
    """A delivery of which some files come again, corrected, under their old paths; then nothing new, and the last batch once more."""
    rows, root, target = _orders(spark, sf_dir), fresh_path(spark, "redelivery"), fresh_path(spark, "versions")
    rows = rows.select("o_orderkey", "term_code", "amount", "active")
    season, schema = F.substring("term_code", 5, 2), rows.schema

    def deliver(some, fmt):
        sinks.write_delivery(some, root, "ledger", fmt)

    def load():
        return redelivery.load_versions(spark, root, "ledger", target, schema)

    deliver(rows.filter(season == "SP"), "csv")
    deliver(rows.filter(season == "SU"), "json")
    load()
    deliver(rows.filter(season == "SU").withColumn("amount", F.col("amount") * 2), "json")
    deliver(rows.filter(season == "FA"), "csv")
    load()
    deliver(rows.filter((season == "FA") & (F.col("o_orderkey") % 2 == 0)), "csv")
    for _ in range(2):
        load()
    last = materialize(spark.read.parquet(f"{target}/files").filter("batch = 2"), "last")
    redelivery.store_batch(spark, last.drop("batch"), 2, target, schema, False)
    return redelivery.current(spark, target, schema).select(*schema.names)


@query(
    f"""
    SELECT o_orderkey, amount, version FROM (
        SELECT o_orderkey, amount, 'table' AS version FROM ({ORDER_ROWS}) WHERE active AND amount >= 1000
        UNION ALL SELECT o_orderkey, amount, 'begun' FROM ({ORDER_ROWS}) WHERE active)""",
    "K6", "K4",
)
def replaced_table(spark, sf_dir):
    """A table replaced from its own rows, with one version never published, beside a reader who began before."""
    rows, root = _orders(spark, sf_dir).select("o_orderkey", "amount", "active"), fresh_path(spark, "replaced")
    versions.replace(rows, root)
    versions.replace(versions.read(spark, root).filter("active"), root)
    begun = versions.read(spark, root)
    versions.stage(rows.limit(0), root)  # what a run leaves that ends before it publishes
    versions.replace(versions.read(spark, root).filter("amount >= 1000"), root)
    seen = [(versions.read(spark, root), "table"), (begun, "begun")]
    parts = [df.select("o_orderkey", "amount", F.lit(name).alias("version")) for df, name in seen]
    return parts[0].unionByName(parts[1])


@query(
    """
    WITH parts AS (SELECT DISTINCT year(o_orderdate)::VARCHAR AS part, year(o_orderdate) % 2 = 1 AS odd FROM orders),
    names(column_name, type, odd_only) AS (VALUES ('o_orderkey', 'int', NULL), ('o_totalprice', 'double', NULL),
                                                  ('o_orderstatus', 'string', true), ('o_orderpriority', 'string', false))
    SELECT part, column_name, CASE WHEN odd_only IS NULL OR odd_only = odd THEN type END AS type,
           CASE WHEN odd_only IS NULL OR odd_only = odd THEN 'same' ELSE 'missing' END AS status
    FROM parts, names""",
    "X2",
)
def folder_drift(spark, sf_dir):
    """Columns of each delivered folder against those of all; odd and even years have different ones."""
    orders, root = campus.table(spark, sf_dir, "orders"), fresh_path(spark, "drift")
    rows = orders.withColumn("year", F.year("o_orderdate").cast("string"))
    shared = ["o_orderkey", "o_totalprice"]
    for rest, column in ((1, "o_orderstatus"), (0, "o_orderpriority")):
        some = rows.filter(F.year("o_orderdate") % 2 == rest)
        part = some.select(*shared, column, "year")
        sinks.write_delivery(part, root, "orders", "csv", by="year")
    found = quality.schema_drift(extracts.folder_types(spark, root, "orders"))
    return found.filter("column_name <> 'year'").select("part", "column_name", "type", "status")


Q_COUNTS = f"""
    WITH {sql.CROSSWALK}, {sql.LMS}, {sql.AID}, {sql.SIS}
    SELECT 'status_counts' AS query_name, 1 AS source_fanout,
           (SELECT count(*) FROM (SELECT DISTINCT term_code, enrollment_status FROM sis)) AS row_count
    UNION ALL
    SELECT 'person_activity', 3, (SELECT count(DISTINCT s.student_id) FROM crosswalk cw
        JOIN lms l ON cw.moodle_user_key = l.moodle_user_key
        JOIN sis s ON cw.student_id = s.student_id AND s.term_code = l.term_code
        WHERE s.enrollment_status = 'enrolled')
    UNION ALL
    SELECT 'aid_and_grades', 3, (SELECT count(DISTINCT term_code) FROM sis)"""


def _workload_log(spark, sf_dir):
    """The log of a run of the workload."""
    tables = campus.stored_workload_tables(spark, sf_dir)
    extracts.register(tables)
    log = fresh_path(spark, "receipts")
    try:
        receipts.run_workload(spark, WORKLOAD, "low", log)
    finally:
        extracts.unregister(spark, *tables)
    return receipts.read_receipts(spark, log)


@query(
    f"SELECT query_name, 'low' AS frag_level, source_fanout::INTEGER AS source_fanout, row_count, "
    f"source_fanout::INTEGER AS tables_used, NULL::VARCHAR AS error FROM ({Q_COUNTS})",
    "Q1", "Q2", "Q4", "Q5", "Q6", "Q9", "K8", "K9", "K10", "S8", "S9", "A4",
)
def receipt_log(spark, sf_dir):
    """The example workload over row-level tables, and the log it leaves."""
    detail = F.from_json("receipt", "tables_used INT, error STRING, plan STRING")
    log = _workload_log(spark, sf_dir).select("*", detail.alias("d"))
    return log.filter(F.col("d.plan").isNotNull() & (F.col("runtime_ms") > 0)).select(
        "query_name", "frag_level", "source_fanout", "row_count", "d.tables_used", "d.error"
    )


@query(
    f"SELECT query_name, 'low' AS frag_level, source_fanout::INTEGER AS source_fanout, row_count, "
    f"true AS timed FROM ({Q_COUNTS})",
    "Q8", "W8", "S9",
)
def receipt_summary(spark, sf_dir):
    """One line per query from the last receipt of each."""
    lines = receipts.summary(_workload_log(spark, sf_dir))
    timed = F.col("runtime").rlike(r"^[0-9]+\.[0-9]{2} ms$")
    return lines.withColumn("timed", timed).drop("runtime")


FAILING = {
    "no_table": "SELECT * FROM orders_seen o JOIN nowhere USING (o_orderkey)",
    "bad_number": "SELECT CAST(concat('x', o_orderkey) AS INT) AS n FROM orders_seen",
    "good": "SELECT o_orderkey FROM orders_seen",
}


@query(
    """
    SELECT 'no_table' AS query_name, 2 AS source_fanout, 0::BIGINT AS row_count, true AS failed
    UNION ALL SELECT 'bad_number', 1, 0, true
    UNION ALL SELECT 'good', 1, count(*), false FROM orders""",
    "Q3",
)
def failed_receipt(spark, sf_dir):
    """Failing statements are logged with their tables and do not stop the others."""
    log = fresh_path(spark, "failures")
    extracts.register({"orders_seen": campus.table(spark, sf_dir, "orders")})
    try:
        receipts.run_workload(spark, FAILING, None, log)
    finally:
        extracts.unregister(spark, "orders_seen")
    failed = F.from_json("receipt", "error STRING")["error"].isNotNull()
    return receipts.read_receipts(spark, log).select("query_name", "source_fanout", "row_count", failed.alias("failed"))


@query("SELECT o_orderkey, true AS is_utc, true AS is_now FROM orders", "F27")
def utc_stamp(spark, sf_dir):
    """Rows stamped with the current time: in UTC form, and between two readings of the clock."""
    stamp = derive.utc_timestamp_text()
    begun = datetime.now(timezone.utc).timestamp() - 60
    rows = campus.table(spark, sf_dir, "orders").select("o_orderkey", stamp.alias("stamp"))
    seconds = F.unix_timestamp(F.to_timestamp("stamp"))
    return rows.select(
        "o_orderkey",
        F.col("stamp").rlike(UTC_FORM).alias("is_utc"),
        (seconds.between(int(begun), int(begun) + 7200)).alias("is_now"),
    )


LEVELS = {"low": {}, "med": {"lms_activity": 0.10}, "high": {"lms_activity": 0.90, "sis_enrollments": 0.50}}
LEVEL_KEYS = {"lms_activity": ["moodle_user_key"], "sis_enrollments": ["student_id", "term_code"]}
LEVEL_QUERIES = {
    "active_people": """
        SELECT student_id, count(*) AS n FROM lms_activity JOIN identity_crosswalk USING (moodle_user_key)
        JOIN sis_enrollments USING (student_id, term_code) GROUP BY student_id""",
    "logins_by_term": "SELECT term_code, sum(login_count) AS logins FROM lms_activity GROUP BY term_code",
}


@query(
    f"""
    WITH {sql.CROSSWALK}, {sql.LMS}, {sql.SIS},
    levels(label, lms_rate, sis_rate) AS (VALUES ('low', 0::DOUBLE, 0::DOUBLE), ('med', 0.10::DOUBLE, 0::DOUBLE),
                                                 ('high', 0.90::DOUBLE, 0.50::DOUBLE)),
    l AS (SELECT label, lms.* FROM lms, levels
          WHERE {sql.fraction('level:lms_activity', 'moodle_user_key')} >= lms_rate),
    s AS (SELECT label, sis.* FROM sis, levels
          WHERE {sql.fraction('level:sis_enrollments', "student_id || ':' || term_code")} >= sis_rate)
    SELECT label AS frag_level, 'active_people' AS query_name, 3 AS source_fanout,
           count(DISTINCT s.student_id) AS row_count
    FROM l JOIN crosswalk cw USING (moodle_user_key)
    JOIN s USING (label, student_id, term_code) GROUP BY label
    UNION ALL
    SELECT label, 'logins_by_term', 1, count(DISTINCT term_code) FROM l GROUP BY label""",
    "Q7", "F32", "Q6",
)
def receipt_levels(spark, sf_dir):
    """A workload over copies of the tables with more and more rows missing."""
    log = fresh_path(spark, "levels")
    tables = campus.stored_workload_tables(spark, sf_dir)
    receipts.run_levels(spark, tables, LEVEL_QUERIES, LEVELS, LEVEL_KEYS, log)
    return receipts.read_receipts(spark, log).select("frag_level", "query_name", "source_fanout", "row_count")


@query(
    f"""
    SELECT (SELECT count(*) FROM customer) AS students, min(o_orderdate)::DATE AS first_day,
           {sql.code(f"min({sql.ord_('o_orderdate')})")} AS start_term,
           count(DISTINCT {sql.ord_('o_orderdate')}) AS terms, 0.45::DOUBLE AS fin_missing_rate
    FROM orders""",
    "K7",
)
def run_metadata(spark, sf_dir):
    """What a delivery consists of, written as one document and read back."""
    orders = campus.table(spark, sf_dir, "orders")
    position = terms.term_ord_of_date(F.col("o_orderdate"))
    facts = orders.agg(
        F.to_date(F.min("o_orderdate")).alias("first_day"),
        terms.term_code(F.min(position)).alias("start_term"),
        F.countDistinct(position).alias("terms"),
    ).first()
    path = fresh_path(spark, "metadata")
    sinks.write_run_metadata(
        spark,
        path,
        students=campus.table(spark, sf_dir, "customer").count(),
        fin_missing_rate=fragment.FINANCE_MISSING_RATE,
        **facts.asDict(),
    )
    kept = "students BIGINT, first_day DATE, start_term STRING, terms BIGINT, fin_missing_rate DOUBLE"
    return extracts.read_json(spark, path, T.StructType.fromDDL(kept), lines=True)
