"""Running SQL workloads and keeping a queryable log of every run.

A query runs once. Its rows go to a sink, which also counts them through an
observation; the plan text comes from the same DataFrame without running it
again. The log is a Parquet table that gets one append per workload.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from termweave import schemas
from termweave.functions.sqltext import tables_in_sql
from termweave.operators.fragment import thin
from termweave.operators.ordering import latest_per_key
from termweave.sources.extracts import register, unregister
from termweave.sources.sinks import write_table


@dataclass
class Receipt:
    """What is known about one run of one query."""

    query_name: str
    frag_level: str | None
    timestamp: datetime
    tables: list[str]
    runtime_ms: float = 0.0
    row_count: int = 0
    error: str | None = None
    plan: str | None = None
    sink: str | None = None
    has_result: bool = False

    @property
    def source_fanout(self) -> int:
        return len(self.tables)

    def as_row(self) -> Row:
        detail = {
            "query_name": self.query_name,
            "tables_used": self.source_fanout,
            "table_names": self.tables,
            "runtime_ms": self.runtime_ms,
            "row_count": self.row_count,
            "error": self.error,
            "plan": self.plan,
        }
        return Row(
            query_name=self.query_name,
            frag_level=self.frag_level,
            timestamp=self.timestamp,
            source_fanout=self.source_fanout,
            runtime_ms=self.runtime_ms,
            row_count=self.row_count,
            receipt=json.dumps(detail),
        )


def tables_named(spark: SparkSession, sql: str) -> list[str]:
    """The tables that a text names, for statements that cannot be analysed."""
    return list(spark.range(1).select(tables_in_sql(F.lit(sql))).first()[0])


def plan_text(df: DataFrame, mode: str = "extended") -> str | None:
    """Text of a query's plans, or None where it cannot be had."""
    try:
        return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode) or None
    except Exception:
        return None


def relations_of(plan: str | None) -> list[str] | None:
    """The views and tables that the analysed plan reads.

    A named view counts as one table: what stands below it in the plan is its own
    matter. None without a plan; empty if files are read by their paths only.
    """
    if not plan or "== Analyzed Logical Plan ==" not in plan:
        return None
    analysed = plan.split("== Analyzed Logical Plan ==", 1)[1].split("== Optimized Logical Plan ==", 1)[0]
    names: list[str] = []
    view_depth: int | None = None
    for line in analysed.splitlines():
        node = line.lstrip(" :+-!*")
        depth = len(line) - len(node)
        if view_depth is not None and depth > view_depth:
            continue
        view_depth = None
        if node.startswith("View ("):
            names.append(node.removeprefix("View (").split(", [", 1)[0])
            view_depth = depth
        elif node.startswith("Relation ") and not node.startswith("Relation ["):
            names.append(node.removeprefix("Relation ").split("[", 1)[0])
    return list(dict.fromkeys(n.replace("`", "").rsplit(".", 1)[-1] for n in names))


def _storable(df: DataFrame) -> DataFrame:
    """Columns as a file can hold them: repeated names numbered, untyped nulls as text."""
    taken: set[str] = set()
    names = []
    for column in df.columns:
        name, n = column, 0
        while name.lower() in taken:
            n += 1
            name = f"{column}_{n}"
        taken.add(name.lower())
        names.append(name)
    typed = df.toDF(*names)
    untyped = [f.name for f in typed.schema.fields if isinstance(f.dataType, NullType)]
    return typed.withColumns({c: F.col(f"`{c}`").cast("string") for c in untyped}) if untyped else typed


def run(
    spark: SparkSession,
    name: str,
    sql: str,
    label: str | None = None,
    sink: str | None = None,
    args=None,
    log_path: str | None = None,
) -> Receipt:
    """Run one query and return its receipt.

    Rows go to the Parquet path ``sink``, or nowhere when only the receipt is
    wanted. A statement without a result, such as the creation of a view, has no
    rows and leaves the sink alone. A failure or an interrupt is receipted too, with its
    error and row count 0, and raised again. Source tables come from the plan, or from
    the text of a statement that cannot be analysed.
    """
    receipt = Receipt(name, label, datetime.now(timezone.utc), [], sink=sink, error="interrupted")
    started = time.perf_counter()
    try:
        df = spark.sql(sql, args=args) if args is not None else spark.sql(sql)
        receipt.has_result = bool(df.columns)
        receipt.plan = plan_text(df)
        receipt.tables = relations_of(receipt.plan) or []
        if receipt.has_result:
            counted = Observation()
            observed = _storable(df).observe(counted, F.count(F.lit(1)).alias("rows"))
            receipt.plan = plan_text(observed)  # of what runs, not of a second planning
            if sink:
                write_table(observed, sink, "parquet", "overwrite")
            else:
                observed.write.format("noop").mode("overwrite").save()
            receipt.row_count = int(counted.get["rows"])
        receipt.runtime_ms = (time.perf_counter() - started) * 1000.0
        receipt.error = None
    except Exception as problem:
        receipt.runtime_ms = (time.perf_counter() - started) * 1000.0
        receipt.error = str(problem)
        receipt.tables = receipt.tables or tables_named(spark, sql)
        raise QueryFailed(receipt) from problem
    except BaseException:
        receipt.runtime_ms = (time.perf_counter() - started) * 1000.0
        raise
    finally:
        if log_path:
            append_receipts(spark, [receipt], log_path)
    return receipt


class QueryFailed(Exception):
    """A query of a workload failed; ``receipt`` says which and why."""

    def __init__(self, receipt: Receipt):
        super().__init__(f"{receipt.query_name}: {receipt.error}")
        self.receipt = receipt


def run_workload(
    spark: SparkSession,
    queries: Mapping[str, str],
    label: str | None = None,
    log_path: str | None = None,
    sink_root: str | None = None,
) -> list[Receipt]:
    """Run named queries one after the other; a failing one does not stop the rest.

    All receipts are appended to the log in one write, also when interrupted.
    """
    receipts: list[Receipt] = []
    try:
        for name, sql in queries.items():
            sink = f"{sink_root.rstrip('/')}/{name}" if sink_root else None
            try:
                receipts.append(run(spark, name, sql, label, sink))
            except QueryFailed as failure:
                receipts.append(failure.receipt)
    finally:
        if log_path and receipts:
            append_receipts(spark, receipts, log_path)
    return receipts


def run_levels(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    queries: Mapping[str, str],
    levels: Mapping[str, Mapping[str, float]],
    keys: Mapping[str, Sequence[str]],
    log_path: str | None = None,
    salt: str = "level",
) -> list[Receipt]:
    """Run a workload once per fragmentation level, each run labelled with its level.

    A level names the share of rows missing per table; ``keys`` names the columns
    that decide which rows of a table are missing. Levels are nested: what a lower
    rate removes is also removed by a higher one.
    """
    receipts: list[Receipt] = []
    for label, rates in levels.items():
        copies = {
            name: thin(df, rates[name], f"{salt}:{name}", *keys[name]) if rates.get(name) else df
            for name, df in tables.items()
        }
        register(copies)
        try:
            receipts += run_workload(spark, queries, label)
        finally:
            unregister(spark, *copies)
    if log_path and receipts:
        append_receipts(spark, receipts, log_path)
    return receipts


def append_receipts(spark: SparkSession, receipts: list[Receipt], log_path: str) -> None:
    rows = spark.createDataFrame([r.as_row() for r in receipts], schemas.schema("receipts"))
    write_table(rows.coalesce(1), log_path, "parquet", "append")


def ensure_log(spark: SparkSession, log_path: str) -> None:
    """Create an empty log unless there is one."""
    try:
        read_receipts(spark, log_path)
    except AnalysisException:
        empty = spark.createDataFrame([], schemas.schema("receipts"))
        write_table(empty.coalesce(1), log_path, "parquet", "append")


def read_receipts(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema(schemas.schema("receipts")).parquet(log_path)


def latest_receipts(log: DataFrame) -> DataFrame:
    """The last receipt of every query."""
    return latest_per_key(log, ["query_name"], ["timestamp", "receipt"])


def summary(log: DataFrame) -> DataFrame:
    """One line per query that has a receipt: label, fan-out, run time, rows of its last run."""
    return latest_receipts(log).select(
        "query_name",
        F.coalesce("frag_level", F.lit("-")).alias("frag_level"),
        "source_fanout",
        F.format_string("%.2f ms", "runtime_ms").alias("runtime"),
        "row_count",
    )


def result(spark: SparkSession, receipt: Receipt) -> DataFrame:
    """The rows a query left in its sink."""
    return spark.read.parquet(receipt.sink)


def preview(spark: SparkSession, receipt: Receipt, n: int = 5) -> DataFrame:
    """The first rows a query left in its sink."""
    return result(spark, receipt).limit(n)


class ReceiptLayer:
    """Runs queries one at a time, with the log and the results below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log_path = f"{self.root}/receipts"
        ensure_log(spark, self.log_path)

    def execute(
        self, query_name: str, sql: str, frag_level: str | None = None, return_result: bool = True, args=None
    ) -> DataFrame | None:
        """Run a query and log it; its stored rows, or None when only the receipt is wanted.

        A failing query is logged and raised as :class:`QueryFailed`.
        """
        sink = f"{self.root}/results/{query_name}-{uuid.uuid4().hex}" if return_result else None
        receipt = run(self.spark, query_name, sql, frag_level, sink, args, self.log_path)
        stored = return_result and receipt.has_result
        return result(self.spark, receipt) if stored else None

    def receipts(self) -> DataFrame:
        return read_receipts(self.spark, self.log_path)

    def summary(self) -> DataFrame:
        return summary(self.receipts())
