"""Loading each delivered file exactly once.

A file source remembers the files it has seen in its checkpoint, and the file
sink commits whole batches, so running the load again after a new term arrived
appends that term only, and running it after a failure repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from termweave import schemas
from termweave.sources.composite import split_composite
from termweave.sources.extracts import (
    FORMATS,
    csv_options,
    depth_of,
    file_path,
    file_pattern,
    flatten,
    nulls_from_text,
    refuse_broken,
    term_below,
    text_schema,
    typed_from_text,
    with_broken,
)


def extract_stream(
    spark: SparkSession,
    root: str,
    table: str,
    fmt: str | None = None,
    schema: T.StructType | None = None,
    files_per_batch: int = 1000,
    lines: bool = False,
) -> DataFrame:
    """New files of one table, in ``root`` and in ``root/terms/*``, as a stream with their term folder and path.

    Both formats are followed unless ``fmt`` names one. JSON files hold an array or
    one object, or with ``lines`` one object per line.
    """
    if fmt is None:
        both = [extract_stream(spark, root, table, f, schema, files_per_batch, lines) for f in FORMATS]
        return both[0].unionByName(both[1])
    schema = schema or schemas.schema(table)
    reader = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", file_pattern(table, fmt))
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
    )
    if fmt == "csv":
        rows = reader.schema(with_broken(text_schema(schema))).options(**csv_options(), enforceSchema=False).csv(root)
    else:
        rows = reader.option("multiLine", not lines).json(root)
    path = file_path()
    place = term_below(path, depth_of(root))
    rows = rows.select("*", place.alias("source_term"), path.alias("source_file")).filter(F.col("source_term").isNotNull())
    if fmt == "csv":
        return typed_from_text(nulls_from_text(refuse_broken(rows)), schema).withColumn("source_term", F.coalesce("source_term", F.lit("")))
    return flatten(rows)


def append_stream(
    rows: DataFrame, target: str, checkpoint: str, by: str | None = None, wait: bool = True
) -> StreamingQuery:
    """Append everything that has arrived to the Parquet table ``target`` and stop."""
    writer = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if by:
        writer = writer.partitionBy(by)
    query = writer.start()
    if wait:
        query.awaitTermination()
    return query


def load_incremental(
    spark: SparkSession,
    root: str,
    table: str,
    target: str,
    checkpoint: str,
    fmt: str | None = None,
    schema: T.StructType | None = None,
    split_width: dict[str, int] | None = None,
) -> DataFrame:
    """Append the files not loaded yet and return the table as it now is.

    Files of the top level have the empty term. Composite columns are split to the
    given widths; a stream cannot look at all rows first to find them.
    """
    rows = extract_stream(spark, root, table, fmt, schema)
    if split_width:
        rows = split_composite(rows, width=split_width)
    append_stream(rows, target, checkpoint, by="source_term")
    return spark.read.parquet(target)
