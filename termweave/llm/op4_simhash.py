"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is set if it is set in over half of the hashes of a text's word
shingles. Fingerprints link if they differ in at most ``radius`` bits; documents
with linked fingerprints are one component.

Candidates come from ``2 ** (radius + 1) - 1`` tables. Every bit position gets a
vector of ``radius + 1`` bits, other than zero; table ``v`` keeps the positions
whose vector has an odd product with v. For any ``radius`` positions some v is
orthogonal to all their vectors, so each pair within the radius agrees in all kept
bits of some table: no pair is missed. Equal fingerprints are one node before any
table is built. A bucket of up to ``bucket`` nodes is compared pair by pair. In a
larger one every node stands at itself and at all fingerprints one bit away that
stay in the bucket; for radius 2 any linked pair meets at such a place, at most 65
nodes stand at one, and they are again compared. So a bucket of any size costs no
more than a constant per node.

Null and empty texts have no word and the fingerprint zero, which links like any
other. Repeated rows share their fingerprint. A component without any id has a null
component_id. Other columns of the input are ignored.

An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import digest_of, joined_null_safe
from termweave.llm.components import components
from termweave.llm.subwords import slices
from termweave.storage import materialize

SEED = 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LANES = np.uint64(0x0101010101010101)
SLICE_BYTES = 1 << 21
BLOCK_WORDS = 1 << 16


def shingle_hashes(text: bytes, length: int) -> list[int]:
    """XXH64 of every run of ``length`` lower-cased words; of all words if there are fewer."""
    words = text.translate(LOWER).split()
    if len(words) < length:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    out = []
    digest = xxhash.xxh64_intdigest
    for first in range(0, len(words) - length + 1, BLOCK_WORDS):
        block = words[first : first + BLOCK_WORDS + length - 1]
        joined = b" ".join(block)
        ends = list(accumulate(map((1).__add__, map(len, block)), initial=0))
        out += [digest(joined[a : b - 1], SEED) for a, b in zip(ends, ends[length:], strict=False)]
    return out


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document the bits that are set in over half of its hashes.

    Eight bits of a hash are counted by one addition: byte j of lane k counts bit
    8 * j + k, in runs of at most 255 hashes.
    """
    out = np.zeros(len(counts), np.uint64)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    n = counts[filled]
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    runs = -(-n // 255)
    run_first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    at = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(run_first, runs))
    bits = np.zeros(len(filled), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, at)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), run_first, axis=0)
        for j in range(8):
            bits |= (2 * sums[:, j] > n).astype(np.uint64) << np.uint64(8 * j + k)
    out[filled] = bits
    return out


def fingerprints(docs: DataFrame, length: int = 3, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns (doc_id alone unless named) and the fingerprint of the text as a signed long, ``fp``."""
    n = len(columns)

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(n).to_pylist()]
            found = []
            for a, b in slices([len(t) for t in texts], SLICE_BYTES):
                lists = [shingle_hashes(t, length) for t in texts[a:b]]
                counts = np.array([len(x) for x in lists], np.int64)
                flat = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
                found.append(majority_bits(flat, counts).view(np.int64))
            fps = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(fps)], [*columns, "fp"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, docs["text"].cast("binary").alias("text")).mapInArrow(printed, f"{kinds}, fp long")


def masks(radius: int) -> list[int]:
    """The kept bit positions of each table, as signed longs."""
    vectors = [1 + i % ((2 << radius) - 1) for i in range(64)]
    kept = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 2 << radius)]
    return [m - (1 << 64) if m >> 63 else m for m in kept]


def _pairs(nodes: Column, radius: int) -> Column:
    """All linked pairs of an array, as structs of the larger and the smaller fingerprint."""
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    per = F.transform(
        nodes,
        lambda x: F.transform(
            F.filter(nodes, lambda y: (y < x) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b"))
        ),
    )
    return F.explode(F.flatten(per))


def links(nodes: DataFrame, radius: int = 2, bucket: int = 16) -> DataFrame:
    """Pairs a, b of different fingerprints within the radius; ``nodes`` has one row per fingerprint."""
    tables = F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.lit(m).alias("mask")) for v, m in enumerate(masks(radius)))))
    rows = nodes.select("fp", tables.alias("t"))
    rows = rows.select("fp", F.col("t.v").alias("v"), F.col("t.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"))
    sizes = rows.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(rows.join(sizes, ["v", "key"]), "simhash-buckets")
    small = shared.where(F.col("n") <= bucket).groupBy("v", "key").agg(F.collect_list("fp").alias("nodes"))
    found = small.select(_pairs(F.col("nodes"), radius).alias("p")).select("p.a", "p.b")
    if radius > 2:
        raise ValueError("large buckets are searched for a radius of 1 or 2")
    # Any two fingerprints two bits apart, or one, have a third that is at most one bit from both.
    free = F.filter(F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64))), lambda b: b.bitwiseAND(F.col("mask")) == 0)
    places = F.concat(F.array("fp"), F.transform(free, lambda b: b.bitwiseXOR(F.col("fp"))))
    met = shared.where(F.col("n") > bucket).select("fp", F.explode(places).alias("place")).distinct()
    large = met.groupBy("place").agg(F.collect_list("fp").alias("nodes")).where(F.size("nodes") > 1)
    more = large.select(_pairs(F.col("nodes"), radius).alias("p")).select("p.a", "p.b")
    return found.unionAll(more).distinct()


def _rooted(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes``, one row per fingerprint, with the least fingerprint of their component, ``root``."""
    joined = components(links(nodes, radius)).withColumnsRenamed({"a": "fp", "b": "root"})
    return nodes.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, length: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    printed = materialize(fingerprints(docs, length), "simhash")
    named = _rooted(printed.groupBy("fp").agg(F.min("doc_id").alias("least_id")), radius)
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return printed.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_copies(docs: DataFrame, length: int = 3, radius: int = 2) -> DataFrame:
    """One document of each component, that with the smallest id, with the columns of ``docs``.

    Null ids come after all others. Rows are told apart by id and text: of a component's
    rows of the smallest id that with the least digest of its text stays, and of rows
    equal in both the first in the order of their columns.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), docs["doc_id"], digest_of(docs).alias("digest"), docs["text"])
    printed = materialize(fingerprints(rows, length, ("doc_id", "digest")), "simhash")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    named = _rooted(printed.groupBy("fp").agg(F.min(first).alias("first")), radius)
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.digest")
    rows = joined_null_safe(rows.drop("text"), kept, ["doc_id", "digest"], "left_semi")
    return rows.groupBy("doc_id", "digest").agg(F.min("doc").alias("doc")).select("doc.*")
