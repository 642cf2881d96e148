"""Row numbers and latest rows without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termweave.storage import materialize


def number_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "row_number", slices: int | None = None
) -> DataFrame:
    """Exact ``row_number()`` per group in ``order``, however large a group is.

    ``order`` must end in a unique key. An empty ``by`` numbers the whole table.
    See :func:`running_total` for how.
    """
    one = "_one"
    return running_total(df.withColumn(one, F.lit(1).cast("bigint")), by, order, one, name, slices).drop(one)


def _null_safe(columns: Sequence[str], prefix: str) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return same


def running_total(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str, slices: int | None = None
) -> DataFrame:
    """Sum of ``value`` over the rows of a group up to each row in ``order``.

    Rows are range-partitioned by group and order, so a large group spans several
    slices. Each slice sums its own rows; a group's later slices add the totals of
    its earlier ones, of which there are fewer than slices. The slices are stored
    once in the shared folder: both the totals and the result read them, and a
    second range partitioning could cut elsewhere. ``slices`` defaults to the
    session's number of shuffle partitions.
    """
    by, order = list(by), list(order)
    keys = [*by, *order]
    sliced = df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    sliced = sliced.withColumn("_slice", F.spark_partition_id())
    within = W.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    stored = materialize(sliced.withColumn("_local", F.sum(value).over(within)), "sliced")
    totals = stored.groupBy(*by, "_slice").agg(F.sum(value).alias("_total"))
    earlier = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        totals.withColumn("_offset", F.sum("_total").over(earlier))
        .filter(F.col("_offset").isNotNull())
        .select(*[F.col(c).alias(f"_o_{c}") for c in [*by, "_slice"]], "_offset")
    )
    upto = F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0))
    return stored.join(offsets, _null_safe([*by, "_slice"], "_o_"), "left").select(
        *[F.col(f"`{c}`") for c in df.columns], upto.alias(name)
    )


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the highest ``order``, by an aggregate rather than a window.

    Every map task keeps one row per key, so a heavy key costs nothing extra.
    ``order`` should end in a unique column.
    """
    key, order = list(key), list(order)
    rest = [c for c in df.columns if c not in key and c not in order]
    packed = F.max(F.struct(*order, *rest)).alias("_row")
    picked = df.groupBy(*key).agg(packed)
    return picked.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in order: a per-task top-n, then one merge."""
    return df.orderBy(*order).limit(n)
