"""Loading files that may be delivered again with other content under the same path.

A file stream remembers paths only, so it never sees a corrected file. Here a listing
notes each version of a file (path, time of modification, size) in a table of
arrivals; a stream follows that table, and each of its batches reads the noted files
and stores their rows under the number of the batch. The table as it is are the
rows of each file's latest batch, so a file delivered again replaces its rows.

A batch writes its rows first and then the list of its files, both over what an
interrupted run of the same batch left. Rows count only once their list is there, so
running a batch again changes nothing and readers never see half of one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave import schemas
from termweave.sources import extracts
from termweave.storage import file_system

NOTES = "source_file STRING, format STRING, source_term STRING, modified TIMESTAMP, size BIGINT"
FILES = f"{NOTES}, batch BIGINT"


def _there(folder: str) -> bool:
    store, place = file_system(folder)
    return store.get_file_info(place).type != fs.FileType.NotFound


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A table of the load, empty before its first batch."""
    return spark.read.schema(schema).parquet(folder) if _there(folder) else spark.createDataFrame([], schema)


def file_versions(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The files of a table that are there now, each with its time of modification and size."""
    listed = extracts.list_extracts(spark, root, with_version=True).filter(F.col("table_name") == table)
    return listed.select(
        F.col("path").alias("source_file"), "format", F.coalesce("term_folder", F.lit("")).alias("source_term"), "modified", "size"
    )


def note_arrivals(spark: SparkSession, root: str, table: str, target: str) -> int:
    """Note the file versions that were not noted before; how many they are."""
    noted = f"{target}/arrivals"
    version = ["source_file", "modified", "size"]
    new = file_versions(spark, root, table).join(_read(spark, noted, NOTES).select(*version), version, "left_anti").cache()
    try:
        count = new.count()
        if count:
            new.coalesce(1).write.mode("append").parquet(noted)
        return count
    finally:
        new.unpersist()


def store_batch(spark: SparkSession, arrivals: DataFrame, batch: int, target: str, schema: T.StructType, multiline: bool) -> None:
    """Read the files of a batch and store their rows and then their list under its number."""
    last = F.max(F.struct("modified", "size", "format", "source_term"))
    files = arrivals.groupBy("source_file").agg(last.alias("v")).select("source_file", "v.format", "v.source_term", "v.modified", "v.size")
    paths: dict[str, list[str]] = {}
    for path, fmt in files.select("source_file", "format").collect():  # as many as a batch may have
        if _there(path):
            paths.setdefault(fmt, []).append(path)
    parts = []
    if "csv" in paths:
        parts.append(extracts.read_csv(spark, sorted(paths["csv"]), schema, multiline=multiline, with_source=True))
    if "json" in paths:
        parts.append(extracts.read_json(spark, sorted(paths["json"]), schema, with_source=True))
    if parts:
        whole = extracts.union_extracts(*parts).withColumn("source_term", F.coalesce("source_term", F.lit("")))
        whole.write.mode("overwrite").parquet(f"{target}/rows/batch={batch}")
    files.write.mode("overwrite").parquet(f"{target}/files/batch={batch}")


def current(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The rows of the latest version of every file, with their term folder and file."""
    kept = T.StructType([*schema.fields, *(T.StructField(c, T.StringType()) for c in ("source_term", "source_file"))])
    files = _read(spark, f"{target}/files", FILES)
    latest = files.groupBy("source_file").agg(F.max("batch").alias("batch"))
    if not _there(f"{target}/rows"):
        return spark.createDataFrame([], kept)
    rows = spark.read.schema(T.StructType([*kept.fields, T.StructField("batch", T.LongType())])).parquet(f"{target}/rows")
    return rows.join(latest, ["source_file", "batch"], "left_semi").select(*kept.names)


def load_versions(
    spark: SparkSession,
    root: str,
    table: str,
    target: str,
    schema: T.StructType | None = None,
    files_per_batch: int = 1000,
    multiline: bool = False,
) -> DataFrame:
    """Load new files and new versions of files, and return the table as it now is.

    ``target`` holds the load's tables and checkpoint. Files that are no longer
    delivered keep their rows.
    """
    schema = schema or schemas.schema(table)
    if note_arrivals(spark, root, table, target) or _there(f"{target}/arrivals"):
        arrivals = spark.readStream.schema(NOTES).option("maxFilesPerTrigger", files_per_batch).parquet(f"{target}/arrivals")
        store = lambda batch, number: store_batch(batch.sparkSession, batch, number, target, schema, multiline)
        stream = arrivals.writeStream.foreachBatch(store).option("checkpointLocation", f"{target}/checkpoint")
        stream.trigger(availableNow=True).start().awaitTermination()
    return current(spark, target, schema)


def compact(spark: SparkSession, target: str, schema: T.StructType, tables: Sequence[str] = ("rows",)) -> int:
    """Delete the rows of batches none of whose files is the latest; how many batches those are."""
    files = _read(spark, f"{target}/files", FILES)
    latest = files.groupBy("source_file").agg(F.max("batch").alias("batch")).select("batch").distinct()
    stale = [r[0] for r in files.select("batch").distinct().join(latest, "batch", "left_anti").collect()]
    store, place = file_system(target)
    for batch in stale:
        for name in tables:
            if store.get_file_info(f"{place}/{name}/batch={batch}").type != fs.FileType.NotFound:
                store.delete_dir(f"{place}/{name}/batch={batch}")
    return len(stale)
