from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from termweave import schemas
from termweave.functions.derive import utc_now
from termweave.functions.sqltext import fanout, tables_in_sql, tables_read
from termweave.plans import receipts, texts
from termweave.plans.workload import WORKLOAD
from termweave.sources import extracts, sinks

TEXTS = {
    "SELECT * FROM a JOIN b ON a.x = b.x": ["a", "b"],
    "select *\n from\tschema.a, c where 1=1 ": ["a"],
    "WITH x AS (SELECT * FROM t) SELECT * FROM x left Join u,; ": ["t)", "x", "u"],
    "SELECT * FROM A JOIN s.a JOIN A": ["A", "a"],
    "DELETE FROM where": [],
    "SELECT * FROM (SELECT 1) s": ["(SELECT"],
    "SELECT 1": [],
    "SELECT fromage FROM db.s.cheese;": ["cheese"],
    "": [],
}


@pytest.mark.parametrize("text, tables", TEXTS.items())
def test_tables_in_sql_text(spark, rows, text, tables):
    got = rows("sql string", (text,)).select(tables_in_sql(F.col("sql")), fanout(F.col("sql"))).first()
    assert (got[0], got[1]) == (tables, len(tables))
    assert receipts.tables_named(spark, text) == tables


READ = {
    "SELECT * FROM a JOIN b ON a.x = b.x": ["a", "b"],
    "select *\n from\tschema.a, c where 1=1 ": ["a", "c"],
    "WITH x AS (SELECT * FROM t), y(n) AS (SELECT 1 FROM x) SELECT * FROM x, y, u": ["t", "u"],
    "WITH t AS (SELECT * FROM t) SELECT * FROM t": ["t"],
    "WITH RECURSIVE t(n) AS (SELECT 1 UNION SELECT n FROM t, r) SELECT * FROM T, db.t; SELECT * FROM T": ["r", "t", "T"],
    "SELECT * FROM (WITH x AS (SELECT 1) SELECT * FROM x) s, x": ["x"],
    "SELECT * FROM (SELECT 1, 2) s join LATERAL (SELECT max(v) FROM w) y": ["w"],
    "SELECT * FROM A -- from hidden\n JOIN a /* join b\n */ , 'from c' ": ["A", "a"],
    "SELECT extract(year FROM day), trim(BOTH 'x' FROM name), f(a, b) FROM t": ["t"],
    "SELECT a IS DISTINCT FROM b FROM t WHERE x IN (SELECT y FROM u), z": ["t", "u"],
    "SELECT * FROM ((a JOIN b USING (k)) JOIN c USING (k)), d ORDER BY x, y": ["a", "b", "c", "d"],
    "SELECT * FROM \"My Table\" m, `db`.`t`": ["My Table", "t"],
    "SELECT * FROM range(3) r, explode(x) e, t": ["t"],
    "SELECT * FROM t LATERAL VIEW explode(m) e AS k, v SORT BY a, b": ["t"],
    "SELECT 1) FROM a, b": ["a", "b"],
    "DELETE FROM where": [],
    "SELECT 1": [],
    "SELECT fromage FROM db.s.cheese;": ["cheese"],
    "": [],
    None: None,
}


def test_tables_read_by_sql_text(rows):
    got = rows("i int, sql string", *enumerate(READ)).orderBy("i").select(tables_read(F.col("sql"))).collect()
    assert dict(zip(READ, (r[0] for r in got))) == READ


def test_logged_statements_with_lists_subqueries_and_comments(spark, rows, tmp_path):
    kinds = ["click", "view", "purchase", "signup", "error", "other", None]
    events = [(i, kind, 7) for i, kind in enumerate(kinds)] + [(9, "view", None)]
    rows("event_id long, event_type string, user_id long", *events).write.parquet(str(tmp_path / "events.parquet"))
    found = texts.sql_fanout(spark, str(tmp_path)).collect()
    assert {r.event_id: (r.tables, r.fanout) for r in found} == {
        0: ("clicks,u7,users", 3), 1: ("limits,u7,users,views", 4), 2: ("Purchases,purchases,u7", 3), 3: ("days,signups,u7", 3),
        4: ("u7", 1), 5: (None, None), 6: (None, None), 9: (None, None),
    }
    assert {tuple(r) for r in texts.table_usage(spark, str(tmp_path)).collect()} == {
        ("clicks", 1), ("users", 2), ("views", 1), ("limits", 1), ("Purchases", 1), ("purchases", 1), ("signups", 1), ("days", 1), ("u7", 5),
    }


@pytest.fixture
def campus(spark, rows):
    """Three people in two terms; one pair of keys is crossed, one term is skipped."""
    tables = {
        "identity_crosswalk": rows(
            "student_id string, moodle_user_key string, workday_person_id string",
            ("S1", "m2", "w1"), ("S2", "m1", "w2"), ("S3", "m3", "w3"),
        ),
        "sis_enrollments": rows(
            "student_id string, term_code string, enrollment_status string, term_gpa double",
            ("S1", "2023FA", "enrolled", 3.0), ("S1", "2024SP", "not_enrolled", None),
            ("S2", "2023FA", "enrolled", 2.0), ("S3", "2024SP", "enrolled", 4.0),
        ),
        "lms_activity": rows(
            "moodle_user_key string, term_code string, login_count int",
            ("m1", "2023FA", 10), ("m1", "2023FA", 20), ("m2", "2023FA", 5), ("m2", "2024SP", 7), ("m9", "2023FA", 99),
        ),
        "financial_aid": rows(
            "workday_person_id string, term_code string, loans int",
            ("w1", "2023FA", 100), ("w2", "2023FA", 300), ("w1", "2024SP", 50), ("w3", "2024SP", None),
        ),
    }
    extracts.register(tables)
    yield tables
    extracts.unregister(spark, *tables)


def test_workload_results(spark, campus, tmp_path):
    done = receipts.run_workload(spark, WORKLOAD, "low", str(tmp_path / "log"), str(tmp_path / "out"))
    status, people, aid = (sorted(tuple(r) for r in spark.read.parquet(r.sink).collect()) for r in done)
    assert status == [("enrolled", "2023FA", 2, 2.5), ("enrolled", "2024SP", 1, 4.0), ("not_enrolled", "2024SP", 1, None)]
    assert people == [("S1", 1, 1, 5.0), ("S2", 1, 2, 15.0)]
    assert aid == [("2023FA", 2, 2, 400, 2.5), ("2024SP", 2, 1, 50, None)]
    assert [(r.row_count, r.source_fanout) for r in done] == [(3, 1), (2, 3), (2, 3)]
    assert receipts.preview(spark, done[0], 2).count() == 2


def test_a_failing_query_is_logged_and_skipped(spark, campus, tmp_path):
    log = str(tmp_path / "log")
    queries = {"bad": "SELECT * FROM nowhere JOIN lms_activity", "worse": "SELECT raise_error('no') FROM lms_activity", "good": "SELECT * FROM lms_activity"}
    done = receipts.run_workload(spark, queries, None, log)
    assert [r.error is None for r in done] == [False, False, True]
    logged = {r.query_name: r for r in receipts.read_receipts(spark, log).collect()}
    assert logged["bad"].row_count == 0 and logged["bad"].source_fanout == 2 and logged["bad"].runtime_ms > 0
    detail = json.loads(logged["bad"].receipt)
    assert "nowhere" in detail["error"] and detail["plan"] is None
    assert set(detail) == {"query_name", "tables_used", "table_names", "runtime_ms", "row_count", "error", "plan"}
    assert json.loads(logged["good"].receipt)["table_names"] == ["lms_activity"]
    assert receipts.read_receipts(spark, log).schema == schemas.schema("receipts")


def test_a_single_failing_run_is_raised_after_its_receipt(spark, tmp_path):
    log = str(tmp_path / "log")
    with pytest.raises(receipts.QueryFailed, match="nowhere"):
        receipts.run(spark, "bad", "SELECT * FROM nowhere", log_path=log)
    assert receipts.read_receipts(spark, log).count() == 1


def test_one_execution_per_query(spark, tmp_path):
    spark.range(100).withColumn("v", F.lit(1)).createOrReplaceTempView("numbers")
    seen = spark.sparkContext.accumulator(0)
    counted = spark.udf.register("seen", lambda x: (seen.add(1), x)[1], "bigint")
    receipt = receipts.run(spark, "count", "SELECT seen(id) AS x FROM numbers", sink=str(tmp_path / "out"))
    assert counted is not None and receipt.row_count == 100 and seen.value == 100
    assert "Physical Plan" in receipt.plan


def test_parameters(spark, campus):
    receipt = receipts.run(spark, "p", "SELECT * FROM lms_activity WHERE moodle_user_key = :k", args={"k": "m1"})
    assert receipt.row_count == 2


def test_relations_from_the_plan(spark, campus):
    sql = """
        WITH busy AS (SELECT * FROM lms_activity /* from ghosts */)
        SELECT * FROM busy, identity_crosswalk i WHERE i.moodle_user_key IN (SELECT moodle_user_key FROM busy)"""
    assert sorted(receipts.run(spark, "x", sql).tables) == ["identity_crosswalk", "lms_activity"]
    assert receipts.relations_of(None) is None and receipts.relations_of("nothing") is None


def test_a_view_counts_as_one_table(spark, rows):
    sinks.recreate(rows("a int", (1,)), "t_below")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW above AS SELECT * FROM t_below WHERE a > 0")
    assert receipts.run(spark, "v", "SELECT * FROM above").tables == ["above"]
    assert sorted(receipts.run(spark, "w", "SELECT * FROM above, t_below").tables) == ["above", "t_below"]
    unregistered = extracts.unregister(spark, "above")
    assert unregistered is None
    spark.sql("DROP TABLE t_below")


def test_an_interrupt_is_an_error(spark, campus, tmp_path, monkeypatch):
    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(receipts, "_storable", stop)
    log = str(tmp_path / "log")
    with pytest.raises(KeyboardInterrupt):
        receipts.run(spark, "long", "SELECT * FROM lms_activity", log_path=log)
    logged = receipts.read_receipts(spark, log).first()
    assert json.loads(logged.receipt)["error"] == "interrupted" and logged.row_count == 0 and logged.runtime_ms > 0


def test_receipt_layer(spark, campus, tmp_path):
    layer = receipts.ReceiptLayer(spark, str(tmp_path))
    assert layer.receipts().count() == 0 and layer.receipts().schema == schemas.schema("receipts")
    rows = layer.execute("logins", "SELECT * FROM lms_activity WHERE login_count > :n", "low", args={"n": 9})
    assert rows.count() == 3
    assert layer.execute("logins", "SELECT * FROM lms_activity", return_result=False) is None
    with pytest.raises(receipts.QueryFailed) as failure:
        layer.execute("bad", "SELECT * FROM nowhere")
    assert failure.value.receipt.row_count == 0 and "nowhere" in failure.value.receipt.error
    again = receipts.ReceiptLayer(spark, str(tmp_path))
    assert again.receipts().count() == 3
    assert {r.query_name: r.row_count for r in again.summary().collect()} == {"logins": 5, "bad": 0}


def test_any_statement_can_be_run(spark, campus, tmp_path):
    layer = receipts.ReceiptLayer(spark, str(tmp_path))
    twice = layer.execute("twice", "SELECT a.*, b.*, NULL AS nothing FROM lms_activity a JOIN lms_activity b USING (moodle_user_key, term_code)")
    assert len(set(twice.columns)) == len(twice.columns) and twice.columns[-1] == "nothing"
    assert twice.count() == 7
    assert layer.execute("view", "CREATE OR REPLACE TEMPORARY VIEW v AS SELECT 1 AS x") is None
    assert layer.execute("use", "SELECT * FROM v").collect() == [(1,)]
    assert {r.query_name: r.row_count for r in layer.receipts().collect()} == {"twice": 7, "view": 0, "use": 1}


def test_levels_are_nested_and_labelled(spark, tmp_path):
    people = {"people": spark.range(1000).select(F.col("id").alias("p"))}
    levels = {"low": {}, "med": {"people": 0.3}, "high": {"people": 0.6}}
    log = str(tmp_path / "log")
    receipts.run_levels(spark, people, {"all": "SELECT p FROM people"}, levels, {"people": ["p"]}, log)
    counts = {r.frag_level: r.row_count for r in receipts.read_receipts(spark, log).collect()}
    assert counts["low"] == 1000 and 650 < counts["med"] < 750 and 350 < counts["high"] < 450
    assert not spark.catalog.tableExists("people")


def test_timestamps_are_utc(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    receipts.run(spark, "now", "SELECT 1", log_path=str(tmp_path / "log"))
    age = receipts.read_receipts(spark, str(tmp_path / "log")).select((utc_now() - F.col("timestamp")).alias("age")).first().age
    assert timedelta(0) <= age < timedelta(minutes=5)
    logged = receipts.read_receipts(spark, str(tmp_path / "log")).select(F.unix_seconds("timestamp")).first()[0]
    assert abs(logged - datetime.now(timezone.utc).timestamp()) < 300


def test_summary_takes_the_latest_receipt(spark, campus, tmp_path, values):
    log = str(tmp_path / "log")
    one = {"a": "SELECT * FROM lms_activity"}
    receipts.run_workload(spark, one, "low", log)
    receipts.run_workload(spark, {"a": "SELECT * FROM lms_activity LIMIT 2", "b": "SELECT 1"}, None, log)
    lines = {r.query_name: r for r in receipts.summary(receipts.read_receipts(spark, log)).collect()}
    assert set(lines) == {"a", "b"} and lines["a"].row_count == 2 and lines["a"].frag_level == "-"
    assert lines["b"].source_fanout == 0 and lines["b"].runtime.endswith(" ms")
    assert receipts.read_receipts(spark, log).count() == 3


@pytest.mark.skipif(not os.environ.get("TERMWEAVE_SAMPLE"), reason="no delivered sample named in TERMWEAVE_SAMPLE")
def test_delivered_sample(spark, tmp_path):
    """The totals and averages of FIXTURES.md, over the delivered sample of 500 people."""
    tables = extracts.assemble(spark, os.environ["TERMWEAVE_SAMPLE"])
    assert {n: d.count() for n, d in tables.items()} == {
        "advising_holds": 289, "financial_aid": 1263, "identity_crosswalk": 500, "lms_activity": 2072, "sis_enrollments": 2453,
    }
    extracts.register(tables)
    done = receipts.run_workload(spark, WORKLOAD, None, str(tmp_path / "log"), str(tmp_path / "out"))
    logins = spark.sql(
        "SELECT student_id, avg(login_count) FROM sis_enrollments JOIN identity_crosswalk USING (student_id) "
        "JOIN lms_activity USING (moodle_user_key, term_code) GROUP BY student_id ORDER BY student_id LIMIT 10"
    ).collect()
    extracts.unregister(spark, *tables)
    status = {(r.term_code, r.enrollment_status): r.people for r in spark.read.parquet(done[0].sink).collect()}
    assert len(status) == 12 and status["2023FA", "enrolled"] == 353 and status["2025SU", "not_enrolled"] == 33
    assert [tuple(r) for r in logins][:3] == [("S000001", 72.5), ("S000002", 73.4), ("S000003", 120.0)]
