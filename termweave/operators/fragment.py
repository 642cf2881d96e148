"""Making a fragmented copy of a table: missing rows, missing keys, swapped keys.

What is degraded depends on a salt and the row's key, so a run can be repeated
exactly, and a higher rate removes everything a lower rate removes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termweave.functions.hashing import hash_fraction
from termweave.operators.ordering import running_total
from termweave.operators.skew import ROWS_PER_TASK

# Default rates of missing rows, holds placed and keys kept on holds.
LMS_MISSING_RATE = 0.10
FINANCE_MISSING_RATE = 0.45
HOLD_RATE = 0.12
HOLD_KEY_KEPT_RATE = 0.87
CROSSWALK_MISMATCH_RATE = 0.01


def _fraction(salt: str, key: Sequence[str]) -> Column:
    return hash_fraction(salt, *[F.col(k) for k in key])


def thin(df: DataFrame, rate: float, salt: str, *key: str) -> DataFrame:
    """``df`` without a share ``rate`` of its rows."""
    return df.filter(_fraction(salt, key) >= F.lit(rate))


def removed(df: DataFrame, rate: float, salt: str, *key: str) -> DataFrame:
    """The rows :func:`thin` takes out."""
    return df.filter(_fraction(salt, key) < F.lit(rate))


def keep(df: DataFrame, rate: float, salt: str, *key: str) -> DataFrame:
    """A share ``rate`` of the rows, such as the people with a hold."""
    return removed(df, rate, salt, *key)


def null_out(df: DataFrame, column: str, kept: float, salt: str, *key: str) -> DataFrame:
    """``column`` kept in a share ``kept`` of the rows and null in the others."""
    return df.withColumn(column, F.when(_fraction(salt, key) < F.lit(kept), F.col(column)))


def sweep(
    df: DataFrame, rates: Sequence[float], salt: str, key: Sequence[str], by: Sequence[str], sums: Sequence[str]
) -> DataFrame:
    """Sums per group over copies of ``df`` thinned at each rate, as one row per rate and group.

    All copies are summed in one pass: a row adds to every rate it survives, and
    rates become rows only after the aggregation. A group without rows at a rate
    has no row there.
    """
    fraction = _fraction(salt, key)
    levels = []
    for i, rate in enumerate(rates):
        kept = fraction >= F.lit(float(rate))
        levels.append([F.count_if(kept).alias(f"_n{i}")])
        levels[i] += [F.sum(F.when(kept, F.col(c))).alias(f"_s{i}_{j}") for j, c in enumerate(sums)]
    wide = df.groupBy(*by).agg(*[m for level in levels for m in level])
    rows = F.array(
        *[
            F.struct(
                F.lit(float(rate)).alias("missing_rate"),
                F.col(f"_n{i}").alias("_n"),
                *[F.col(f"_s{i}_{j}").alias(c) for j, c in enumerate(sums)],
            )
            for i, rate in enumerate(rates)
        ]
    )
    return wide.select(*by, F.inline(rows)).filter(F.col("_n") > 0).drop("_n")


def swap_pairs(
    crosswalk: DataFrame, rate: float, salt: str, id: str, key: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Let people exchange keys in disjoint pairs: ``rate`` swaps per person, two people each.

    Neighbours in hash order form the pairs. The hash range is cut into as many
    buckets as the number of chosen people needs, each bucket a window of its
    own; an odd person left at the end of a bucket keeps the key. Only people
    with a single crosswalk row that has a key take part. Doing it again with the
    same salt gives back the original.
    """
    share = min(1.0, 2 * rate)
    fraction = hash_fraction(salt, F.col(id))
    takes_part = (fraction < F.lit(share)) & F.col(id).isNotNull()
    chosen = crosswalk.filter(takes_part)
    kept = crosswalk.filter(~F.coalesce(takes_part, F.lit(False)))
    single = (
        chosen.groupBy(id)
        .agg(F.count(F.lit(1)).alias("_n"), F.max(key).alias("_key"))
        .filter((F.col("_n") == 1) & F.col("_key").isNotNull())
    )
    buckets = chosen.agg(F.ceil(F.count(F.lit(1)) / rows_per_task)).scalar()
    placed = single.select(id, "_key", fraction.alias("_at")).withColumn(
        "_bucket", F.floor(F.col("_at") / share * buckets)
    )
    within = W.partitionBy("_bucket").orderBy("_at", id)
    number = F.row_number().over(within)
    partner = F.when(number % 2 == 1, F.lead("_key").over(within)).otherwise(F.lag("_key").over(within))
    swapped = placed.select(id, F.coalesce(partner, F.col("_key")).alias("_new"))
    changed = chosen.join(swapped, id, "left")
    return kept.unionByName(
        changed.withColumn(key, F.coalesce(F.col("_new"), F.col(key))).select(*crosswalk.columns)
    )


def weighted_assign(df: DataFrame, fraction: Column, weights: DataFrame, value: str, weight: str) -> DataFrame:
    """Give each row the category in whose share of the total weight its fraction falls.

    For catalogues kept as a table, of any length (for a fixed list see
    ``weighted_choice``). Categories lie side by side in order of ``value``, which
    must be unique, each as wide as its weight. The whole width is cut into as many
    slots as there are categories; a category stands in every slot it reaches into,
    so a row meets those of its slot only, two on average, by an equi-join with a
    test of the range.
    """
    usable = weights.filter(F.col(weight) > 0).select(F.col(value), F.col(weight).cast("double").alias("_weight"))
    ranges = running_total(usable, [], [value], "_weight", "_upto")
    facts = ranges.agg(F.max("_upto"), F.count(F.lit(1))).first()
    total, slots = facts[0] or 0.0, max(1, facts[1])

    def slot(place: Column) -> Column:
        # Growing with the place, so a row's slot is one of its category's.
        return F.floor(place * F.lit(slots / total if total else 0.0))

    from_ = F.col("_upto") - F.col("_weight")
    reached = F.explode(F.sequence(slot(F.col("_from")), slot(F.col("_upto"))))
    placed_ranges = ranges.withColumn("_from", from_).withColumn("_slot", reached)
    # The end of one category is the same number as the begin of the next.
    before = W.partitionBy("_slot").orderBy("_upto")
    placed_ranges = placed_ranges.withColumn("_from", F.coalesce(F.lag("_upto").over(before), F.lit(-1.0)))
    placed = df.withColumn("_place", fraction * F.lit(total)).withColumn("_slot", slot(F.col("_place")))
    inside = (
        (F.col("p._slot") == F.col("r._slot"))
        & (F.col("p._place") >= F.col("r._from"))
        & (F.col("p._place") < F.col("r._upto"))
    )
    found = placed.alias("p").join(placed_ranges.alias("r"), inside, "left")
    return found.select(*[F.col(f"p.`{c}`") for c in df.columns if c != value], F.col(f"r.`{value}`").alias(value))
