"""Joining systems that know the same person by different keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.derive import prefixed_key
from termweave.operators.ordering import number_rows
from termweave.operators.partials import average, key_counts, merge


def bridge_join(
    left: DataFrame,
    crosswalk: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    on: Sequence[str] = ("term_code",),
) -> DataFrame:
    """Rows of two systems matched through a crosswalk and on shared columns.

    The crosswalk is put on the right side first, so that the left side, the
    large one, is shuffled once, by (left_key, on); adaptive execution splits its
    heavy keys. With a ``right`` side that has one row per key and ``on``, and a
    key of one person, the result is no longer than the left side. A key listed
    twice multiplies rows, as in the plain join.
    """
    pairs = crosswalk.select(left_key, right_key)
    return left.join(right.join(pairs, right_key), [left_key, *on])


def bridge_averages(
    left: DataFrame,
    crosswalk: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    by: Sequence[str],
    on: Sequence[str] = ("term_code",),
    left_values: Sequence[str] = (),
    right_values: Sequence[str] = (),
) -> DataFrame:
    """Averages over the rows of a bridge join, without producing those rows.

    ``left`` and ``right`` are tables of ``partials`` on their own key and
    ``on``: both have shrunk to one row per person and term before they meet. A left
    value counts once per matching right row and the other way round, so the
    averages equal those over the joined rows. ``by`` names columns of the key.
    """
    on, by = list(on), list(by)
    pairs = crosswalk.select(left_key, right_key)
    mine = merge(left.join(pairs, left_key), [right_key, *on], left_values)
    mine = mine.withColumnRenamed("n", "left_n")
    theirs = right.withColumnRenamed("n", "right_n")
    met = mine.join(theirs, [right_key, *on])
    sums = []
    for values, times in ((left_values, "right_n"), (right_values, "left_n")):
        for v in values:
            sums += [
                F.sum(F.col(f"sum_{v}") * F.col(times)).alias(f"sum_{v}"),
                F.sum(F.col(f"cnt_{v}") * F.col(times)).alias(f"cnt_{v}"),
            ]
    rows = F.sum(F.col("left_n") * F.col("right_n")).alias("n")
    totals = met.groupBy(*by).agg(rows, *sums)
    return totals.select(*by, "n", *[average(v).alias(f"avg_{v}") for v in [*left_values, *right_values]])


def orphans(df: DataFrame, ref: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is null or unknown to ``ref``, with the reason."""
    key = list(key)
    no_key = F.lit(False)
    for name in key:
        no_key = no_key | F.col(name).isNull()
    lost = df.join(ref.select(*key), key, "left_anti")
    return lost.withColumn("reason", F.when(no_key, F.lit("no_key")).otherwise(F.lit("unmatched")))


def swap_audit(crosswalk: DataFrame, id: str, key: str, prefix: str) -> DataFrame:
    """Pairs of people who hold each other's key, as (id_a, id_b).

    Only rows breaking the convention ``prefix + lower(id)`` are looked at. Such
    a row says "id holds the key of other"; two people are swapped when both
    directions occur under the same unordered pair, which one grouping shows.
    """
    own = prefixed_key(prefix, F.col(id))
    broken = crosswalk.filter(F.col(key) != own).select(
        F.col(id).alias("_id"), own.alias("_own"), F.col(key).alias("_held")
    )
    pair = [F.least("_own", "_held").alias("_low"), F.greatest("_own", "_held").alias("_high")]
    return (
        broken.groupBy(*pair)
        .agg(
            F.min(F.when(F.col("_own") < F.col("_held"), F.col("_id"))).alias("id_a"),
            F.min(F.when(F.col("_own") > F.col("_held"), F.col("_id"))).alias("id_b"),
        )
        .filter(F.col("id_a").isNotNull() & F.col("id_b").isNotNull())
        .select("id_a", "id_b")
    )


def convention_breaks(crosswalk: DataFrame, id: str, key: str, prefix: str) -> DataFrame:
    """Crosswalk rows whose key is not ``prefix + lower(id)``."""
    return crosswalk.filter(F.col(key) != prefixed_key(prefix, F.col(id)))


def key_ambiguity(df: DataFrame, id: str, key: str) -> DataFrame:
    """Keys standing for several people and people with several keys.

    Both counts start from the same distinct pairs, which are shuffled once.
    """
    pairs = df.select(id, key).dropna().distinct()
    kinds = []
    for kind, column in (("key_of_several_people", key), ("person_with_several_keys", id)):
        partners = pairs.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("partners"))
        kinds.append(partners.filter(F.col("partners") > 1).select(F.lit(kind).alias("kind"), "value", "partners"))
    return kinds[0].unionByName(kinds[1])


def dedupe_suffix(
    df: DataFrame, base: str, order: Sequence[str], name: str = "unique_name", slices: int | None = None
) -> DataFrame:
    """Make a base key unique: the first keeps it, the next get 2, 3 and so on."""
    numbered = number_rows(df, [base], order, "_number", slices)
    suffix = F.when(F.col("_number") > 1, F.col("_number").cast("string")).otherwise(F.lit(""))
    return numbered.withColumn(name, F.concat(F.col(base), suffix)).drop("_number")


def occurrences(df: DataFrame, base: Column) -> DataFrame:
    """How often each base key occurs."""
    return df.groupBy(base.alias("base")).agg(F.count(F.lit(1)).alias("occurrences"))


def missing_keys(expected: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of ``expected`` without a row in ``present``, and how many rows miss it."""
    on = list(on)
    both = key_counts(expected.dropna(subset=on), present, on)
    return both.filter((F.col("left_rows") > 0) & (F.col("right_rows") == 0)).select(
        *on, F.col("left_rows").alias("rows_without")
    )
