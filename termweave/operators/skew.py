"""Joins in which a key of both sides may hold a large part of all rows.

Where only one side can be heavy, a plain join is enough: adaptive execution
splits its large partitions. Here the heavy keys of a side are counted (a partial
aggregate per task, so cheap in the shuffle) and only they are salted: a heavy key
of ``n`` rows is spread over ``n / rows_per_task`` salts, and its partner rows are
repeated once per salt. All other keys join as usual. The result is exact for
every key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_TASK = 1_000_000


def heavy_keys(df: DataFrame, on: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more than ``rows_per_task`` rows and the salts to spread each over.

    There are at most as many as the rows divided by ``rows_per_task``.
    """
    known = df
    for name in on:
        known = known.filter(F.col(name).isNotNull())
    return (
        known.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > rows_per_task)
        .select(*on, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_salts"))
    )


def _row_hash(df: DataFrame) -> Column:
    """A hash that also spreads identical rows, the same when a task is retried."""
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain], F.spark_partition_id())


def _spread(df: DataFrame, heavy: DataFrame, salt: str) -> DataFrame:
    """Each row with one of its key's salts; rows without a key match nothing and go anywhere."""
    on = [c for c in heavy.columns if c != "_salts"]
    no_key = F.lit(False)
    for name in on:
        no_key = no_key | F.col(name).isNull()
    one_of = F.pmod(_row_hash(df), F.coalesce(F.col("_salts"), F.lit(1)).cast("bigint"))
    placed = F.when(no_key, _row_hash(df)).otherwise(one_of)
    return df.join(heavy, on, "left").withColumn(salt, placed).drop("_salts")


def _repeat(df: DataFrame, heavy: DataFrame, salt: str) -> DataFrame:
    """Each row once for every salt of its key."""
    on = [c for c in heavy.columns if c != "_salts"]
    last = F.coalesce(F.col("_salts"), F.lit(1)).cast("bigint") - 1
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    return df.join(heavy, on, "left").withColumn(salt, every).drop("_salts")


def salted_join(
    big: DataFrame,
    other: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
    other_heavy: DataFrame | None = None,
) -> DataFrame:
    """``big.join(other, on, how)`` with the heavy keys of ``big`` spread over tasks.

    ``how`` is inner, left, left_semi or left_anti. Rows of ``big`` with a null
    key match nothing and are spread over all tasks too. For an inner join
    ``other_heavy``, from :func:`heavy_keys` on some of the key columns, spreads
    the heavy keys of ``other`` as well.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"only joins that keep to the big side can be salted, not {how}")
    if other_heavy is not None and how != "inner":
        raise ValueError("the other side can be spread in an inner join only")
    on = list(on)
    heavy = heavy_keys(big, on, rows_per_task)
    if how in ("left_semi", "left_anti"):
        other = other.select(*on).distinct()
    left, right = _spread(big, heavy, "_salt"), _repeat(other, heavy, "_salt")
    salts = ["_salt"]
    if other_heavy is not None:
        left, right = _repeat(left, other_heavy, "_other_salt"), _spread(right, other_heavy, "_other_salt")
        salts.append("_other_salt")
    return left.join(right, [*on, *salts], how).drop(*salts)
