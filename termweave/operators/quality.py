"""Measures of how well systems fit together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.partials import key_counts


def coverage(left: DataFrame, right: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Matched rows of each side in the join on ``on``, per ``by`` (columns of ``on``).

    A row whose key has a null never matches. Both directions come from one
    aggregation of key counts.
    """
    on, by = list(on), list(by)
    whole_key = F.lit(True)
    for name in on:
        whole_key = whole_key & F.col(name).isNotNull()
    met = whole_key & (F.col("left_rows") > 0) & (F.col("right_rows") > 0)
    counts = key_counts(left, right, on).withColumn("_met", met)
    sums = counts.groupBy(*by).agg(
        F.sum("left_rows").alias("left_rows"),
        F.sum(F.when(F.col("_met"), F.col("left_rows")).otherwise(0)).alias("left_matched"),
        F.sum("right_rows").alias("right_rows"),
        F.sum(F.when(F.col("_met"), F.col("right_rows")).otherwise(0)).alias("right_matched"),
    )
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole))
    return sums.withColumn("left_coverage", share("left_matched", "left_rows")).withColumn(
        "right_coverage", share("right_matched", "right_rows")
    )


def join_cardinality(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows in, rows out and growth of an inner join, counted without joining."""
    on = list(on)
    whole_key = F.lit(True)
    for name in on:
        whole_key = whole_key & F.col(name).isNotNull()
    counts = key_counts(left, right, on)
    sizes = counts.agg(
        F.coalesce(F.sum("left_rows"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("right_rows"), F.lit(0)).alias("right_rows"),
        F.coalesce(
            F.sum(F.when(whole_key, F.col("left_rows") * F.col("right_rows")).otherwise(0)), F.lit(0)
        ).alias("output_rows"),
        F.count_if(whole_key & (F.col("left_rows") > 1) & (F.col("right_rows") > 1)).alias("many_to_many_keys"),
    )
    larger = F.greatest("left_rows", "right_rows")
    return sizes.withColumn("growth", F.when(larger > 0, F.col("output_rows") / larger))


def schema_drift(types: DataFrame) -> DataFrame:
    """Columns of each part of a table against the columns of all parts.

    ``types`` holds part, column_name and type, as from
    :func:`termweave.sources.extracts.folder_types`; it is as large as the number of
    parts times columns, not as the data.
    """
    seen = types.groupBy("column_name").agg(F.array_sort(F.collect_set("type")).alias("types_seen"))
    # Every part against every column: each part gets the list of columns, which is one short row.
    listed = seen.agg(F.collect_list(F.struct("column_name", "types_seen")).alias("all")).scalar()
    every = types.select("part").distinct().select("part", F.inline(listed))
    status = (
        F.when(F.col("type").isNull(), F.lit("missing"))
        .when(F.size("types_seen") > 1, F.lit("type_varies"))
        .otherwise(F.lit("same"))
    )
    return every.join(types, ["part", "column_name"], "left").select(
        "part", "column_name", "type", "types_seen", status.alias("status")
    )


def json_key_drift(df: DataFrame, document: str, part: str) -> DataFrame:
    """Which top-level keys of JSON documents each part has, against the keys of all parts."""
    keys = df.select(part, F.explode(F.json_object_keys(document)).alias("key"))
    found = keys.groupBy(part, "key").agg(F.count(F.lit(1)).alias("documents"))
    parts = df.groupBy(part).agg(F.count(F.lit(1)).alias("part_documents"))
    return found.join(parts, part).withColumn("share", F.col("documents") / F.col("part_documents"))
