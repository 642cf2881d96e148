"""Mixing sources to target weights by Pareto order sampling.

The size of a document is its number of words. Sources, by code point and null
last, weigh 1, 2, 3, repeating. Targets share the size of all documents by weight,
none above ``max_repeat`` times its source's size; the excess is shared again by
weight. A source with target ``f`` times its size takes ``floor(f)`` certain whole
copies of each document. The words that are left are drawn in whole documents with
inclusion odds that follow size: ``p = min(1, c * size)``, ``c`` such that the
expected words are the words wanted. A document's rank is its random odds, from a
hash of its id, over its inclusion odds; documents are taken in that order as long
as this brings the sum nearer to what is wanted.

The place of the cut is found from two levels of per-source histograms of the
rank, so a source of any size is never sorted in one task. Rows with equal ids are
taken or left together. A null text has size 0, empty sources have target 0. Other
columns of the input are ignored.

An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.common import WORD, joined_null_safe, text_of
from termweave.storage import materialize

WEIGHTS = (1, 2, 3)
FINE = 1 << 24
COARSE = 1 << 12


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, a uniform number from the id, and the whole row as ``doc``."""
    count = F.regexp_count(text_of(docs), F.lit(WORD)).cast("bigint")
    # 52 bits of a hash, so that the value and one minus it are exact.
    bits = F.conv(F.substring(F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))), 1, 13), 16, 10)
    u = (bits.cast("double") + 0.5) / float(1 << 52)
    return docs.select("doc_id", "source", count.alias("size"), u.alias("u"), F.struct(*docs.columns).alias("doc"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """Per source: its size, target, certain copies and the words left to draw. One row per source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordinal = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*map(F.lit, weights)), ordinal % len(weights)).cast("bigint")
    t = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * max_repeat)
    # Sources reach their most in the order of most per weight; the first that does not ends the search.
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*",
        F.coalesce(F.sum("most").over(before), F.lit(0)).alias("capped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("gone"),
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("weight").over(everything).alias("all_weight"),
    )
    t = t.withColumn("level", (F.col("all_size") - F.col("capped")) / (F.col("all_weight") - F.col("gone")))
    fits = F.col("level") * F.col("weight") <= F.col("most")
    t = t.withColumn("level", F.min(F.when(fits, F.struct("gone", "level"))).over(everything)["level"])
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    t = t.withColumn("target", target)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = t.withColumn("copies", F.floor(ratio))
    left = F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0))
    return t.select("source", "source_size", "target", "copies", left.alias("wanted"))


def slopes(sized: DataFrame, target: DataFrame) -> DataFrame:
    """Add ``slope``: the c of ``p = min(1, c * size)``.

    Sizes are grouped first, so a source has as many rows here as it has different
    sizes. From the largest size down, documents become certain until c times the
    next size is below one.
    """
    grouped = sized.where(F.col("size") > 0).groupBy("source", "size").agg(F.count("*").alias("n"))
    grouped = joined_null_safe(grouped, target.select("source", "wanted"), ["source"], "inner")
    above = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(0, Window.unboundedFollowing)
    words, squares = F.col("n") * F.col("size"), F.col("n") * F.col("size") * F.col("size")
    certain = F.coalesce(F.sum(words).over(above), F.lit(0))
    slope = (F.col("wanted") - certain) / F.sum(squares.cast("decimal(38,0)")).over(within).cast("double")
    found = grouped.withColumn("slope", slope).where(F.col("slope") * F.col("size") <= 1.0)
    first = found.groupBy("source").agg(F.max(F.struct("size", "slope"))["slope"].alias("slope"))
    return joined_null_safe(target, first, ["source"], "left")


def _bin(bins: int):
    return F.least(F.floor(F.col("t") * bins), F.lit(bins - 1)).cast("bigint")


def _boundary(binned: DataFrame) -> DataFrame:
    """Per source the first bin in which the running sum exceeds the words wanted, and the sum before it."""
    sums = binned.groupBy("source", "wanted", "before", "bin").agg(F.sum("size").alias("s"))
    upto = F.col("before") + F.sum("s").over(Window.partitionBy("source").orderBy("bin"))
    over = sums.withColumn("upto", upto).where(F.col("upto") > F.col("wanted"))
    first = over.groupBy("source").agg(F.min(F.struct("bin", F.col("upto") - F.col("s")))).toDF("source", "f")
    return first.select("source", F.col("f.bin").alias("bin"), F.col("f.col2").alias("before"))


def _ranked(sized: DataFrame, per_source: DataFrame) -> DataFrame:
    """Add ``t`` and what the source's row says to every document."""
    rows = joined_null_safe(sized, per_source, ["source"], "left")
    rows = rows.withColumn("p", F.least(F.lit(1.0), F.coalesce(F.col("slope"), F.lit(0.0)) * F.col("size")))
    # With odds q = (u / (1 - u)) / (p / (1 - p)), t = q / (1 + q): the same order, from 0 to 1.
    a, b = F.col("u") * (1.0 - F.col("p")), F.col("p") * (1.0 - F.col("u"))
    return rows.withColumn("t", a / (a + b)).drop("u", "p", "slope")


def plan_mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """One row per source: target, copies, and up to which bin, rank and id documents are drawn."""
    target = materialize(slopes(sized, targets(sized, weights, max_repeat)), "mix-targets")
    drawn = _ranked(sized, target).where((F.col("size") > 0) & (F.col("wanted") > 0))
    drawn = drawn.select("doc_id", "source", "size", "wanted", "t")
    coarse = _boundary(drawn.withColumn("before", F.lit(0).cast("bigint")).withColumn("bin", _bin(COARSE)))
    part = joined_null_safe(drawn.withColumn("bin", _bin(COARSE)), coarse, ["source", "bin"], "inner")
    fine = materialize(_boundary(part.withColumn("bin", _bin(FINE))), "mix-cuts")
    last = joined_null_safe(drawn.withColumn("bin", _bin(FINE)), fine, ["source", "bin"], "inner")
    # A fine bin holds a 2 ** -24 share of the ranks of its source.
    last = last.groupBy("source", "wanted", "before", "t", "doc_id").agg(F.sum("size").alias("size"))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("t", "doc_id"))
    nearer = last.withColumn("upto", upto).where(2 * F.col("upto") - F.col("size") <= 2 * F.col("wanted"))
    cut = nearer.groupBy("source").agg(F.max(F.struct("t", "doc_id")).alias("cut"))
    ends = joined_null_safe(fine.select("source", F.col("bin").alias("cut_bin")), cut, ["source"], "left")
    return materialize(joined_null_safe(target, ends, ["source"], "left"), "mix-plan")


def _copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    rows = _ranked(sized, plan).withColumn("bin", _bin(FINE))
    here = (F.col("bin") == F.col("cut_bin")) & (F.struct("t", "doc_id") <= F.col("cut"))
    drawn = (F.col("size") > 0) & (F.col("wanted") > 0) & (
        F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")) | F.coalesce(here, F.lit(False))
    )
    copies = F.col("copies") + F.coalesce(drawn, F.lit(False)).cast("bigint")
    return rows.withColumn("copies", copies.cast("bigint"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and ``copies``, how often it goes into the mix."""
    sized = materialize(sizes(docs).drop("doc"), "mix-sizes")
    rows = _copies(sized, plan_mix(sized, weights, max_repeat))
    taken = F.col("copies") * F.col("size")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """The documents of the mix, each as many times as it is taken, with the columns of ``docs``. Texts are not shuffled."""
    sized = sizes(docs)
    plan = plan_mix(materialize(sized.drop("doc"), "mix-sizes"), weights, max_repeat)
    rows = _copies(sized, plan).where("copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
