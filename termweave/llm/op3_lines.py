"""Removal of lines that many sites share (DataFrame functions only).

Lines are keyed by 128 bits of hashes. Each key has a HyperLogLog sketch of the
sites it stands on; partial sketches merge in the aggregation, so a line that
stands in a third of all documents costs one sketch per task. Estimates far from
the threshold decide; lines nearer than ``margin`` get an exact distinct count.
Margin 0.1 is six standard errors of a sketch with 2 ** 12 registers.

Lines without a word are never removed. A null text has no lines, a null site is a
site of its own. Rows of equal id and text are cut alike. Other columns of the
input are ignored.

An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import WORD, joined_null_safe
from termweave.storage import materialize

LG_REGISTERS = 12
MARGIN = 0.1


def _key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def lines_of(docs: DataFrame, site: str) -> DataFrame:
    """One row per line that has a word: document, place, site and key."""
    where = F.coalesce(F.concat(F.lit("="), docs[site].cast("string")), F.lit("")).alias("site")
    rows = docs.where("text IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("tid"), where, F.posexplode(F.split("text", "\n")).alias("at", "line")
    )
    return rows.where(F.col("line").rlike(WORD)).select("doc_id", "tid", "site", "at", *_key(F.col("line")))


def shared_lines(lines: DataFrame, min_sites: int, margin: float = MARGIN) -> DataFrame:
    """Keys of the lines that stand on ``min_sites`` sites or more."""
    sketched = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_REGISTERS))).alias("sites")
    )
    possible = materialize(sketched.where(F.col("sites") >= min_sites * (1 - margin)), "lines-possible")
    sure = possible.where(F.col("sites") > min_sites * (1 + margin)).select("h1", "h2")
    near = possible.where(F.col("sites") <= min_sites * (1 + margin)).select("h1", "h2")
    pairs = lines.select("h1", "h2", "site").join(near, ["h1", "h2"], "left_semi").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return sure.unionAll(exact.select("h1", "h2"))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed and the text without the shared lines."""
    lines = lines_of(docs, site)
    shared = materialize(shared_lines(lines, min_sites), "lines-shared")
    gone = lines.join(shared, ["h1", "h2"], "left_semi").groupBy("doc_id", "tid").agg(F.collect_set("at").alias("gone"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tid"))
    rows = joined_null_safe(rows, gone, ["doc_id", "tid"], "left")
    split = F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.split("text", "\n"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    )
    return rows.select(
        "doc_id",
        F.size(split).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(kept, F.lit("")).alias("text"),
    )
