"""Sums and counts that can be merged, so data shrinks before every shuffle.

A table of partials has one row per key with ``n`` (rows), and ``sum_v`` and
``cnt_v`` (sum and non-null count) per value ``v``. Merging partials of any
grouping and dividing at the end gives the exact average over the raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partials(df: DataFrame, keys: Sequence[str], values: Sequence[str] = ()) -> DataFrame:
    """One row per key with the row count and each value's sum and count."""
    measures = [F.count(F.lit(1)).alias("n")]
    for v in values:
        measures += [F.sum(v).alias(f"sum_{v}"), F.count(v).alias(f"cnt_{v}")]
    return df.groupBy(*keys).agg(*measures)


def merge(df: DataFrame, keys: Sequence[str], values: Sequence[str] = ()) -> DataFrame:
    """Partials of a coarser key from partials of a finer one."""
    measures = [F.sum("n").alias("n")]
    for v in values:
        measures += [F.sum(f"sum_{v}").alias(f"sum_{v}"), F.sum(f"cnt_{v}").alias(f"cnt_{v}")]
    return df.groupBy(*keys).agg(*measures)


def average(value: str) -> Column:
    """The average a row of partials stands for, null without a value."""
    return F.when(F.col(f"cnt_{value}") > 0, F.col(f"sum_{value}") / F.col(f"cnt_{value}"))


def key_counts(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Per key, how many rows each side has: columns ``left_rows`` and ``right_rows``.

    One aggregation over the union of both sides' keys: no join, no pairs, and
    a heavy key arrives as one row per map task.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    tagged = left.select(*on, one.alias("_l"), none.alias("_r")).unionByName(
        right.select(*on, none.alias("_l"), one.alias("_r"))
    )
    return tagged.groupBy(*on).agg(F.sum("_l").alias("left_rows"), F.sum("_r").alias("right_rows"))
