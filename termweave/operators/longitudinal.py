"""What happens to a person from term to term.

Every window here runs over rows that were first reduced to one per person and
term, so its largest group is the number of terms, whatever the raw data holds.
All windows use the same partitioning and order, so Spark sorts once for all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termweave.functions.derive import ratio_or_null, round2


def per_term(df: DataFrame, person: str, ord: str, *measures: Column) -> DataFrame:
    """One row per person and term, aggregated in every map task before the shuffle."""
    return df.groupBy(person, ord).agg(*measures)


def history(person: str, ord: str) -> WindowSpec:
    """A person's terms in order."""
    return W.partitionBy(person).orderBy(ord)


def so_far(person: str, ord: str) -> WindowSpec:
    """A person's terms up to the current one."""
    return history(person, ord).rowsBetween(W.unboundedPreceding, W.currentRow)


def running_totals(
    df: DataFrame,
    person: str,
    ord: str,
    values: Sequence[str],
    start: dict[str, str] | None = None,
    one_row_per_term: bool = False,
) -> DataFrame:
    """Sum per term and running sum of each value; null counts as nothing.

    ``start`` maps a value to a column of ``df`` with the person's opening balance.
    ``one_row_per_term`` promises that (person, ord) is a key of ``df``, as in an
    enrolment extract, and saves the shuffle that would make it one.
    """
    start = start or {}
    if one_row_per_term:
        terms = df.select(person, ord, *values, *[F.col(c).alias(f"_start_{v}") for v, c in start.items()])
    else:
        measures = [F.sum(v).alias(v) for v in values]
        measures += [F.max(c).alias(f"_start_{v}") for v, c in start.items()]
        terms = per_term(df, person, ord, *measures)
    over = so_far(person, ord)
    columns = []
    for v in values:
        total = F.coalesce(F.sum(v).over(over), F.lit(0))
        if v in start:
            total = total + F.coalesce(F.max(f"_start_{v}").over(over), F.lit(0))
        columns.append(total.alias(f"running_{v}"))
    return terms.select(person, ord, *values, *columns)


def running_weighted_mean(
    df: DataFrame, person: str, ord: str, points: str, weight: str,
    start_points: str | None = None, start_weight: str | None = None,
) -> DataFrame:
    """Weighted mean per term and over all terms so far, both to two decimals.

    ``points`` is value times weight, so both means are ratios of sums.
    """
    start = {}
    if start_points:
        start[points] = start_points
    if start_weight:
        start[weight] = start_weight
    totals = running_totals(df, person, ord, [points, weight], start)
    return totals.withColumn("term_mean", round2(ratio_or_null(F.col(points), F.col(weight)))).withColumn(
        "running_mean", round2(ratio_or_null(F.col(f"running_{points}"), F.col(f"running_{weight}")))
    )


def weighted_mean(df: DataFrame, keys: Sequence[str], value: Column, weight: Column) -> DataFrame:
    """Mean of ``value`` weighted by ``weight`` per key, null where the weights add up to zero."""
    return df.groupBy(*keys).agg(
        F.sum(value * weight).alias("points"), F.sum(weight).alias("weight")
    ).withColumn("weighted_mean", ratio_or_null(F.col("points"), F.col("weight")))


def fill_terms(
    df: DataFrame, person: str, ord: str, blank: Sequence[str], status: str = "enrollment_status",
    present: str = "enrolled", absent: str = "not_enrolled", end: str | None = None,
) -> DataFrame:
    """A row for every term from a person's first to last, with skipped terms filled in.

    ``df`` has one row per person and term. Each row is repeated for the skipped
    terms after it: columns in ``blank`` are null there, all others carry on.
    The gap ends at the next row, so no calendar is joined. Column ``end``, the
    same in all rows of a person, names the last term to fill after the last row;
    null, or a term before it, ends with the last row.
    """
    last = F.greatest(F.col(ord), F.col(end)) if end else F.col(ord)
    until = F.coalesce(F.lead(ord).over(history(person, ord)) - 1, last)
    spread = df.withColumn("_until", until).withColumn("_term", F.explode(F.sequence(ord, "_until")))
    here = F.col("_term") == F.col(ord)
    others = [c for c in df.columns if c not in (person, ord)]
    return spread.select(
        person,
        F.col("_term").alias(ord),
        *[F.when(here, F.col(c)).alias(c) if c in blank else F.col(c) for c in others],
        F.when(here, F.lit(present)).otherwise(F.lit(absent)).alias(status),
    )


def carry_forward(df: DataFrame, person: str, ord: str, column: str, name: str) -> DataFrame:
    """The last known value of a column up to each term of a person."""
    return df.withColumn(name, F.last(column, ignorenulls=True).over(so_far(person, ord)))


def latest_in_term(df: DataFrame, person: str, ord: str, attr: str, order: Sequence[str]) -> DataFrame:
    """A person's attribute at the end of each term."""
    last = F.max(F.struct(*order, F.col(attr).alias("_attr"))).alias("_last")
    return per_term(df, person, ord, last).select(person, ord, F.col("_last._attr").alias(attr))


def changes(terms: DataFrame, person: str, ord: str, attr: str) -> DataFrame:
    """Terms in which a person's attribute differs from the term before.

    ``terms`` has one row per person and term, as from :func:`latest_in_term`.
    """
    before = F.lag(attr).over(history(person, ord))
    return terms.withColumn("previous", before).filter(F.col("previous") != F.col(attr)).select(
        person, ord, "previous", attr
    )


def spans(df: DataFrame, person: str, ord: str) -> DataFrame:
    """First and last term of each person."""
    return df.groupBy(person).agg(F.min(ord).alias("first_ord"), F.max(ord).alias("last_ord"))


def first_seen(df: DataFrame, person: str, ord: str) -> DataFrame:
    """Admission: the first term a person is seen in."""
    return df.groupBy(person).agg(F.min(ord).alias("first_ord"))


def stopouts(df: DataFrame, person: str, ord: str) -> DataFrame:
    """People whose last term lies before the last term of all."""
    end = df.agg(F.max(ord)).scalar()
    last = df.groupBy(person).agg(F.max(ord).alias("last_ord"))
    return last.filter(F.col("last_ord") < end)


def eligible(df: DataFrame, ord: str, admit_ord: str, stopped_ord: str | None = None) -> DataFrame:
    """Rows from the admission term on and before the stop-out term, if there is one."""
    kept = df.filter(F.col(ord) >= F.col(admit_ord))
    if stopped_ord:
        kept = kept.filter(F.col(stopped_ord).isNull() | (F.col(ord) < F.col(stopped_ord)))
    return kept


def eligible_by_term(df: DataFrame, person: str, ord: str) -> DataFrame:
    """How many people are between their first and last term, per term.

    People with the same span are counted together before spans are unfolded,
    so at most one row per pair of terms is unfolded.
    """
    same = spans(df, person, ord).groupBy("first_ord", "last_ord").agg(F.count(F.lit(1)).alias("people"))
    unfolded = same.select(F.explode(F.sequence("first_ord", "last_ord")).alias(ord), "people")
    return unfolded.groupBy(ord).agg(F.sum("people").alias("eligible"))


def reconcile(
    parent: DataFrame, child: DataFrame, on: Sequence[str], parent_value: str, child_value: str
) -> DataFrame:
    """Parent totals against the sum of their children, per key.

    Both sides are summed by one aggregation over their union instead of a join.
    ``status`` is ok, exceeds, no_children or no_parent.
    """
    on = list(on)
    rows = parent.select(*on, F.col(parent_value).alias("_p"), F.lit(None).alias("_c"), F.lit("p").alias("_side"))
    rows = rows.unionByName(
        child.select(*on, F.lit(None).alias("_p"), F.col(child_value).alias("_c"), F.lit("c").alias("_side"))
    )
    sums = rows.groupBy(*on).agg(
        F.sum("_p").alias("parent_total"),
        F.sum("_c").alias("child_total"),
        F.count_if(F.col("_side") == "p").alias("parents"),
        F.count_if(F.col("_side") == "c").alias("children"),
    )
    status = (
        F.when(F.col("parents") == 0, F.lit("no_parent"))
        .when(F.col("children") == 0, F.lit("no_children"))
        .when(F.col("child_total") > F.col("parent_total"), F.lit("exceeds"))
        .otherwise(F.lit("ok"))
    )
    return sums.select(*on, "parent_total", "child_total", "children", status.alias("status"))
