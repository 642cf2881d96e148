"""Writing tables: per term, appended, recreated, with run metadata."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Sequence
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.storage import file_system

WRITE_OPTIONS = {
    "csv": {"header": True, "escape": '"', "dateFormat": "yyyy-MM-dd"},
    "json": {"ignoreNullFields": False, "dateFormat": "yyyy-MM-dd"},
    "parquet": {},
}


def write_table(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> None:
    """CSV with a header and empty cells for null, JSON lines with explicit nulls, or Parquet."""
    df.write.options(**WRITE_OPTIONS[fmt]).mode(mode).format(fmt).save(path)


def write_extracts(
    df: DataFrame,
    root: str,
    table: str,
    fmt: str = "parquet",
    by: str | Sequence[str] = "term_code",
    mode: str = "overwrite",
) -> str:
    """One folder per term below ``root/table``; overwriting replaces only the terms present.

    Rows are rebalanced by term first: a small term becomes one file, a large
    one is split over many tasks.
    """
    by = [by] if isinstance(by, str) else list(by)
    path = f"{root.rstrip('/')}/{table}"
    (
        df.hint("rebalance", *[F.col(c) for c in by])
        .write.options(**WRITE_OPTIONS[fmt])
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .mode(mode)
        .format(fmt)
        .save(path)
    )
    return path


def _dealt(df: DataFrame, by: str | None, rows_per_file: int) -> DataFrame:
    """``row`` with its ``_folder`` and ``_part``: a folder gets as many parts as its rows need."""
    folder = F.col(f"`{by}`").cast("string") if by else F.lit("")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), folder.alias("_folder"))
    sizes = rows.groupBy("_folder").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_parts"))
    mine = F.col("_folder").eqNullSafe(F.col("_of"))
    counted = rows.join(sizes.withColumnRenamed("_folder", "_of"), mine, "left").drop("_of")
    plain = [f"row.`{f.name}`" for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    # The partition id spreads equal rows and is the same when a task is retried.
    part = F.pmod(F.xxhash64(*plain, F.spark_partition_id()), F.col("_parts"))
    return counted.withColumn("_part", part).drop("_parts")


def write_delivery(
    df: DataFrame,
    root: str,
    table: str,
    fmt: str = "csv",
    by: str | None = "term_code",
    suffix: str | None = None,
    rows_per_file: int = 1_000_000,
) -> None:
    """Files as they are delivered: ``root/terms/<term>/<table>.csv|json``, or ``root/<table>.csv|json`` without ``by``.

    More than ``rows_per_file`` rows of a folder come as several files of about that
    many, ``<table>.part-<n>.csv|json``, each with its header or its own JSON array, and each
    written by its own task. Spark writes all files below a staging folder; then each
    is moved to its place.
    """
    staged = f"{root.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    dealt, file = _dealt(df, by, rows_per_file), ["_folder", "_part"]
    if fmt == "json":
        # Each row is a line of its file's array: the first opens it and the last closes it.
        text = F.to_json("row", {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd"})
        lines = dealt.select(*file, text.alias("_text"))
        each = Window.partitionBy(*file)
        number, last = F.row_number().over(each.orderBy("_text")), F.count(F.lit(1)).over(each)
        opening = F.when(number == 1, F.lit("[")).otherwise(F.lit(","))
        closing = F.when(number == last, F.lit("]")).otherwise(F.lit(""))
        placed = lines.select(*file, number.alias("_n"), F.concat(opening, F.col("_text"), closing).alias("value"))
        placed.sortWithinPartitions(*file, "_n").select("value", *file).write.partitionBy(*file).text(staged)
    else:
        flat = dealt.repartition(*file).select("row.*", *file)
        flat.write.options(**WRITE_OPTIONS[fmt]).partitionBy(*file).format(fmt).save(staged)
    store, place = file_system(staged)
    top = place.rsplit("/", 1)[0]
    found = [f for f in store.get_file_info(fs.FileSelector(place, recursive=True)) if f.type == fs.FileType.File]
    files = sorted(f.path for f in found if f.base_name.startswith("part-"))
    in_folder = Counter(path.rsplit("/", 2)[0] for path in files)
    for path in files:
        folder, part, _ = path.rsplit("/", 2)
        term = unquote(folder.rsplit("/_folder=", 1)[1])
        target = f"{top}/terms/{term}" if by else top
        number = f".part-{int(part.removeprefix('_part=')):05d}" if in_folder[folder] > 1 else ""
        store.create_dir(target, recursive=True)
        store.move(path, f"{target}/{table}{number}.{suffix or fmt}")
    store.delete_dir(place)


def write_projections(df: DataFrame, root: str, projections: dict[str, Sequence[str]], fmt: str = "parquet") -> None:
    """Several extracts from one source; each scans only its own columns."""
    for name, columns in projections.items():
        write_table(df.select(*columns), f"{root.rstrip('/')}/{name}", fmt, "overwrite")


def ensure_table(spark: SparkSession, table: str, schema: T.StructType) -> None:
    """Create an empty table with this schema unless it exists."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet")


def append_aligned(df: DataFrame, table: str, evolve: bool = True) -> None:
    """Append by column name. Columns the rows lack are null; new ones extend the table.

    With ``evolve`` off, a column the table does not have is an error.
    """
    spark = df.sparkSession
    ensure_table(spark, table, df.schema)
    existing = {f.name: f.dataType for f in spark.table(table).schema.fields}
    new = [f for f in df.schema.fields if f.name not in existing]
    if new and not evolve:
        raise ValueError(f"{table} has no column {', '.join(f.name for f in new)}")
    if new:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")
    target = spark.table(table).schema
    have = set(df.columns)
    df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    ).write.mode("append").insertInto(table)


def recreate(df: DataFrame, table: str) -> None:
    """Write the table anew. The old one stays until the new rows are stored, so ``df`` may read it.

    Every version has a folder of its own. A table made here before, with the same
    columns, is switched to the new folder by one change in the catalog: readers, and a
    crash at any point, find the old rows or the new ones. Any other table is
    dropped first, with a moment in between; see :mod:`termweave.sources.versions` for
    tables that are always there. The folder before the last is kept for its readers.
    """
    spark = df.sparkSession
    home = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_versions/{table.replace('`', '')}"
    new = f"{home}/{uuid.uuid4().hex}"
    try:
        df.write.parquet(new)
    except BaseException:
        _delete(new)
        raise
    old = _location(spark, table) if spark.catalog.tableExists(table) else None
    if old and f"/_versions/{home.rsplit('/', 1)[1]}/" in old and spark.table(table).schema == spark.read.parquet(new).schema:
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{new}'")
        spark.catalog.refreshTable(table)
    else:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{new}'")
    kept = {new.rsplit("/", 1)[1], (old or "").rsplit("/", 1)[-1]}
    store, place = file_system(home)
    for found in store.get_file_info(fs.FileSelector(place)):
        if found.base_name not in kept:
            store.delete_dir(found.path)


def _delete(folder: str) -> None:
    store, place = file_system(folder)
    if store.get_file_info(place).type != fs.FileType.NotFound:
        store.delete_dir(place)


def _location(spark: SparkSession, table: str) -> str:
    """The folder of a table of the catalog."""
    return spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").first()["data_type"]


def load_tables(tables: dict[str, DataFrame], clear: bool = False) -> None:
    """Store assembled tables; loading the same files again leaves one copy of them.

    With ``clear`` every table is recreated. Otherwise rows of files that a table
    has not loaded yet are appended: files are known by the column
    ``source_file`` (see ``extracts.assemble(with_source=True)``), and rows
    without it cannot be told from loaded ones and are refused.
    """
    for name, df in tables.items():
        if clear:
            recreate(df, name)
            continue
        if "source_file" not in df.columns:
            raise ValueError(f"{name} has no source_file: assemble with with_source=True, or clear the table")
        spark = df.sparkSession
        if spark.catalog.tableExists(name) and "source_file" in spark.table(name).columns:
            df = df.join(spark.table(name).select("source_file").distinct(), "source_file", "left_anti")
        append_aligned(df, name)


def write_run_metadata(spark: SparkSession, path: str, **parameters) -> None:
    """One JSON document with everything a run was started with, rates included."""
    from pyspark.sql import Row

    spark.createDataFrame([Row(**parameters)]).coalesce(1).write.mode("overwrite").option(
        "ignoreNullFields", False
    ).json(path)


def read_run_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
