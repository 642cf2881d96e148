"""Quality rules whose limits follow from the data (DataFrame functions only).

Every document gets integer measures of its whole text. Their distribution is
kept, per language, source and measure, as a log-linear histogram sketch: a value
keeps its ``MANTISSA`` leading bits, and a sketch is the count per kept value.
Sketches merge by adding counts, in any order and with the same result, and a
quantile is off by less than ``2 ** (1 - MANTISSA)`` of its value. Limits lie a
multiple of a quantile spread beyond a quantile, so a group in which all documents
are alike loses none. A group of fewer than ``min_docs`` documents uses the merged
sketch of its language, and that of all documents if its language is as small.

A null text is empty and fails the base rules. Null languages and sources are
groups of their own. Repeated rows count as often as they occur. Other columns of
the input are ignored.

An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.common import SPACE_CHARS, WORD, joined_null_safe, text_of, words
from termweave.storage import materialize

SYMBOLS = "#*$%&|<>"
MANTISSA = 10
MEASURES = ("word_length", "symbols", "dup_lines", "repeats")
#: Least distance of a limit from its quantile, in units of the measure.
LEAST_SPREAD = {"word_length": 100, "symbols": 50, "dup_lines": 100, "repeats": 100}


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: windows are sorted with their positions, equal neighbours are repeats."""
    hashes = F.when(
        F.col("n_words") >= 3,
        F.transform(
            F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")),
            lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("h", hashes)
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    pairs = F.when(
        repeated, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    df = df.withColumn("pairs", pairs).drop("h", "w")
    same = lambda x, i: F.coalesce(F.get("pairs", i)["h"] == x["h"], F.lit(False))
    places = F.filter("pairs", lambda x, i: same(x, i - 1) | same(x, i + 1))
    df = df.withColumn("at", F.sort_array(F.transform(places, lambda x: x["p"]))).drop("pairs")
    covered = F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", total).drop("at")


def measures(docs: DataFrame) -> DataFrame:
    """The base counts of every document, its language and source."""
    df = docs.select("doc_id", "lang", "source", text_of(docs).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    df = df.select(
        "doc_id",
        "lang",
        "source",
        words(F.col("text")).alias("w"),
        lines.alias("lines"),
        F.length(F.translate("text", SPACE_CHARS, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )
    df = df.select(
        "doc_id",
        "lang",
        "source",
        "w",
        F.size("w").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
    )
    df = _repeat_words(df)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _scaled() -> dict[str, Column]:
    """Each measure as a whole number, in hundredths of a character or per 1,000 words or lines."""
    per = lambda a, b, unit: F.expr(f"{a} * {unit} DIV greatest({b}, 1)")
    return {
        "word_length": per("word_chars", "n_words", 100),
        "symbols": per("n_symbols", "n_words", 1000),
        "dup_lines": per("n_dup_lines", "n_lines", 1000),
        "repeats": per("n_repeat_words", "n_words", 1000),
    }


def kept_value(value: Column) -> Column:
    """The value with all but its leading ``MANTISSA`` bits cleared."""
    cut = F.greatest(F.length(F.bin(value)) - MANTISSA, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def sketches(measured: DataFrame) -> DataFrame:
    """Counts per language, source, measure and kept value, of documents that pass the base rules."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), kept_value(v).alias("value")) for k, v in _scaled().items())))
    return (
        measured.where(~F.col("base_failed"))
        .select("lang", "source", rows.alias("m"))
        .groupBy("lang", "source", "m.measure", "m.value")
        .agg(F.count("*").alias("n"))
    )


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and measure its ``total`` and, as ``q10`` and so on, the least value that covers each share."""
    group = Window.partitionBy(*keys, "measure")
    below = sketch.withColumn("upto", F.sum("n").over(group.orderBy("value"))).withColumn("total", F.sum("n").over(group))
    picks = [F.min(F.when(F.col("upto") >= F.col("total") * p, F.col("value"))).alias(f"q{int(p * 100)}") for p in POINTS]
    return below.groupBy(*keys, "measure").agg(F.first("total").alias("total"), *picks)


POINTS = (0.1, 0.5, 0.9)


def limits(sketch: DataFrame, min_docs: int, factor: float) -> DataFrame:
    """``<measure>_low`` and ``<measure>_high`` per language and source."""
    names = ["total", *(f"q{int(p * 100)}" for p in POINTS)]
    level = lambda df, keys, name: quantiles(df, keys).select(*keys, "measure", F.struct(*names).alias(name))
    groups = level(sketch, ["lang", "source"], "own")
    groups = joined_null_safe(groups, level(merged(sketch, "lang"), ["lang"], "of_lang"), ["lang", "measure"], "left")
    groups = joined_null_safe(groups, level(merged(sketch), [], "of_all"), ["measure"], "left")
    use = (
        F.when(F.col("own.total") >= min_docs, F.col("own"))
        .when(F.col("of_lang.total") >= min_docs, F.col("of_lang"))
        .otherwise(F.col("of_all"))
    )
    groups = groups.select("lang", "source", "measure", use.alias("q"))
    found = []
    for m in MEASURES:
        of = lambda c, m=m: F.max(F.when(F.col("measure") == m, c))
        low, mid, high = (F.col(f"q.q{int(p * 100)}") for p in POINTS)
        least = F.lit(float(LEAST_SPREAD[m]))
        found += [
            of(low - factor * F.greatest(mid - low, least)).alias(f"{m}_low"),
            of(high + factor * F.greatest(high - mid, least)).alias(f"{m}_high"),
        ]
    return groups.groupBy("lang", "source").agg(*found)


def quality(docs: DataFrame, min_docs: int = 100, factor: float = 4.0) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` of every document.

    A document is kept if it passes the base rules and every measure lies within
    the limits of its language and source. Mean word length has both limits, the
    other measures an upper one.
    """
    measured = materialize(measures(docs), "quality")
    found = limits(sketches(measured), min_docs, factor)
    joined = joined_null_safe(measured, found, ["lang", "source"], "left")
    within = F.lit(True)
    for m, value in _scaled().items():
        within &= value.cast("double") <= F.col(f"{m}_high")
    within &= _scaled()["word_length"].cast("double") >= F.col("word_length_low")
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"),
    )
