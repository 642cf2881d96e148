"""Coverage between systems kept up to date from sketches, without joining keys.

Each load leaves one theta sketch of the different keys per term and system, a
few ten kilobytes whatever the load's size. Sketches of several loads are merged, and
two systems' sketches are intersected, so a report reads no key: its cost grows with
terms and systems. Up to ``2 ** LG_ENTRIES`` different keys a sketch is exact; beyond
that estimates have the bounds that are told with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A sketch keeps up to 2 ** 14 = 16,384 hashes, for a standard error of 0.8 %.
LG_ENTRIES = 14
#: Standard deviations of the bounds.
DEVIATIONS = 3


def key_sketches(df: DataFrame, system: str, by: Sequence[str], key: Column, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """system, ``by`` and the sketch of the different keys; rows without a key count in no sketch.

    Sketches are made before the shuffle and merged after it, so a term with a large
    part of all rows costs its tasks no more than others.
    """
    named = df.select(F.lit(system).alias("system"), *by, key.cast("string").alias("_key"))
    return named.groupBy("system", *by).agg(F.theta_sketch_agg("_key", lg_entries).alias("sketch"))


def store_sketches(sketches: DataFrame, path: str, load: str) -> None:
    """Keep a load's sketches under its name; storing the same load again replaces them."""
    sketches.write.mode("overwrite").parquet(f"{path.rstrip('/')}/load={load}")


def merged_sketches(spark: SparkSession, path: str, by: Sequence[str], lg_entries: int = LG_ENTRIES) -> DataFrame:
    """One sketch per system and ``by`` over all loads."""
    stored = spark.read.parquet(path)
    return stored.groupBy("system", *by).agg(F.theta_union_agg("sketch", lg_entries).alias("sketch"))


def estimated_coverage(sketches: DataFrame, left: str, right: str, by: Sequence[str], lg_entries: int = LG_ENTRIES) -> DataFrame:
    """Per ``by``: different keys of each system and of both, the share of ``left`` covered, and its bounds.

    The error of an intersection grows with the union it is drawn from; sketches whose
    union is within their size are exact and have no margin.
    """
    one, other = (
        sketches.filter(F.col("system") == s).select(*by, F.col("sketch").alias(f"_{side}")) for s, side in ((left, "l"), (right, "r"))
    )
    met = one.join(other, list(by), "left")
    estimate = F.theta_sketch_estimate
    keys = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    sizes = met.select(
        *by,
        keys(estimate("_l")).alias("left_keys"),
        keys(estimate("_r")).alias("right_keys"),
        keys(estimate(F.theta_intersection("_l", "_r"))).alias("both_keys"),
        F.coalesce(estimate(F.theta_union("_l", "_r", lg_entries)), estimate("_l")).alias("_all"),
    )
    exact = F.col("_all") <= F.lit(1 << lg_entries)
    share = F.col("both_keys") / F.col("left_keys")
    spread = DEVIATIONS * F.sqrt(F.col("_all") * F.greatest("both_keys", F.lit(1))) / (2.0 ** (lg_entries / 2)) / F.col("left_keys")
    # The left system's own error moves the share as well.
    margin = F.when(exact, F.lit(0.0)).otherwise(spread + share * DEVIATIONS / (2.0 ** (lg_entries / 2)))
    return (
        sizes.withColumn("coverage", F.when(F.col("left_keys") > 0, share))
        .withColumn("lowest", F.greatest(F.lit(0.0), F.col("coverage") - margin))
        .withColumn("highest", F.least(F.lit(1.0), F.col("coverage") + margin))
        .drop("_all")
    )
