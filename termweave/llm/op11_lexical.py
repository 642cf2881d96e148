"""The highest-scoring documents of each query text, found without random access (NRA).

A forward index (one row per document: its terms and their counts) is stored once,
and the collection's figures come from it. Postings of query terms are dealt to
shards by document, so that the list of a frequent term is spread like all others,
and a shard holds about ``POSTINGS`` of them, whatever the size of the table.

A shard sorts its lists by falling impact and reads those of a query in parallel,
deeper each round. What a document has been seen to score is its lower bound; what
the lists that it has not been seen in may still give, each at most the impact
where reading stopped, makes the upper bound. Reading goes on until every document
whose upper bound reaches the k-th best lower bound, unseen ones included, has
equal bounds: then members, ties and scores are settled. The best of all shards
are merged per query.

Queries pass every shard in batches, so neither side is held whole anywhere.

Rows. Every row of both tables counts for itself, repeated rows too; equal scores
are in order of doc_id, null first. Null and empty texts have no terms: such
documents are never found, and such queries find nothing. Empty tables give an
empty result. Texts of any length are taken whole. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.common import send_code
from termweave.storage import materialize

#: Letters, digits and all beyond ASCII make terms; only A-Z are lower-cased.
_BREAKS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
TO_TERMS = bytes.maketrans(_BREAKS + _UPPER, b" " * len(_BREAKS) + _UPPER.lower())

#: Postings a shard holds, about.
POSTINGS = 1_000_000
#: Texts that stand in memory as Python objects at once.
SMALL_ROWS = 256
#: Postings read of each list in the first round; each round doubles the depth.
FIRST_DEPTH = 64


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return (text or b"").translate(TO_TERMS).split()


def _counted(texts: DataFrame, id_column: str) -> DataFrame:
    """row (a number of the row), its id, n (terms with repeats), and the different terms with their counts."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SMALL_ROWS):
                part = batch.slice(at, SMALL_ROWS)
                counts = [Counter(terms_of(t)) for t in part.column(2).to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, counts)]), pa.int32())
                terms = pa.array(list(chain.from_iterable(counts)), pa.binary())
                times = pa.array(list(chain.from_iterable(c.values() for c in counts)), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([c.total() for c in counts], pa.int64()),
                        pa.ListArray.from_arrays(ends, terms),
                        pa.ListArray.from_arrays(ends, times),
                    ],
                    ["row", "id", "n", "terms", "times"],
                )

    kind = texts.schema[id_column].dataType.simpleString()
    rows = texts.select(
        F.monotonically_increasing_id().alias("row"), texts[id_column].alias("id"), texts["text"].cast("binary").alias("text")
    )
    # Row numbers are settled by storing them.
    return rows.mapInArrow(found, f"row long, id {kind}, n long, terms array<binary>, times array<long>")


def _exploded(counted: DataFrame, *columns: str) -> DataFrame:
    pairs = F.explode(F.arrays_zip("terms", "times"))
    return counted.select(*columns, pairs.alias("p")).select(
        *columns, F.col("p.terms").alias("term"), F.col("p.times").alias("times")
    )


def saturation(times: Column, n: Column, documents: int, length: int) -> Column:
    """What a term's occurrences give to its weight, in whole numbers."""
    m = F.lit(75) + F.call_function("div", F.lit(25) * n * F.lit(documents), F.lit(max(length, 1)))
    return F.call_function("div", F.lit(1_000_000_000) * times, F.lit(1000) * times + F.lit(12) * m)


class Shard:
    """The impact-sorted lists of some documents."""

    def __init__(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, doc_id: pa.Array):
        rows, first, document = np.unique(row, return_index=True, return_inverse=True)
        order = np.lexsort((-impact, term))
        self.terms, starts = np.unique(term[order], return_index=True)
        self.starts = np.append(starts, len(order))
        self.document, self.impact = document[order], impact[order]
        self.ids = doc_id.take(pa.array(first))
        self.size = len(rows)
        place = np.empty(self.size, np.int64)
        place[pc.sort_indices(self.ids, null_placement="at_start").to_numpy()] = np.arange(self.size)
        self.place = place  # of each document in the order of ids

    def lists(self, terms: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Documents, impacts and weight of each of these terms that has a list."""
        at = np.searchsorted(self.terms, terms)
        found = []
        for k, term, weight in zip(at, terms, weights, strict=True):
            if k < len(self.terms) and self.terms[k] == term:
                a, b = self.starts[k], self.starts[k + 1]
                found.append((self.document[a:b], self.impact[a:b], int(weight)))
        return found

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best documents and their scores above 0, highest first, equal ones by id."""
        lists = self.lists(terms, weights)
        lower = np.zeros(self.size, np.int64)
        depth, before = FIRST_DEPTH, 0
        while lists:
            seen = np.zeros(self.size, np.int64)  # what the stops of the lists it was seen in would give
            unseen = 0
            for documents, impacts, weight in lists:
                lower[documents[before:depth]] += impacts[before:depth] * weight
                if depth < len(documents):
                    stop = int(impacts[depth]) * weight
                    unseen += stop
                    seen[documents[:depth]] += stop
            upper = lower + (unseen - seen)
            least = max(1, int(np.partition(lower, -k)[-k])) if self.size >= k else 1
            alive = np.flatnonzero(upper >= least)
            if (upper[alive] == lower[alive]).all():
                picked = alive[np.lexsort((self.place[alive], -lower[alive]))][:k]
                return [(int(d), int(lower[d])) for d in picked]
            before, depth = depth, depth * 2
        return []


def _searched(k: int):
    """Searches in the rows of one partition: per shard its postings, then the queries in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard, number = None, None
        for batch in batches:
            slots = batch.column(0).to_numpy()
            for at in np.flatnonzero(np.diff(slots, prepend=-1)):
                slot = int(slots[at])
                part = batch.slice(at, int(np.searchsorted(slots, slot, "right")) - int(at))
                if slot % 2 == 0:
                    if number != slot:
                        held, shard, number = [], None, slot
                    held.append(part)
                    continue
                if number != slot - 1:  # queries of a shard without postings
                    continue
                if shard is None:
                    whole = pa.Table.from_batches(held)
                    columns = [whole.column(c).to_numpy() for c in ("row", "term", "impact")]
                    shard, held = Shard(*columns, whole.column("id").combine_chunks()), []
                yield from _answers(shard, part, k)

    return run


def _answers(shard: Shard, queries: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    rows, documents, scores = [], [], []
    terms, weights = queries.column(5), queries.column(6)
    for i, query in enumerate(queries.column(1).to_pylist()):
        for document, score in shard.best(terms[i].values.to_numpy(), weights[i].values.to_numpy(), k):
            rows.append(query)
            documents.append(document)
            scores.append(score)
    ids = shard.ids.take(pa.array(documents, pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), ids, pa.array(scores, pa.int64())], ["query", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = 20, postings: int = POSTINGS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item."""
    spark = docs.sparkSession
    send_code(spark)
    forward = materialize(_counted(docs, "doc_id"), "forward")
    documents, length = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = materialize(_counted(items, "item_id"), "queries")
    asked_terms = _exploded(asked, "row")
    numbered = asked_terms.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid"))
    vocabulary = materialize(numbered, "vocabulary")
    hits = materialize(
        _exploded(forward, "row", "id", "n")
        .join(vocabulary, "term")
        .select("row", "id", "tid", saturation(F.col("times"), F.col("n"), documents, length).alias("impact")),
        "postings",
    )
    odds = F.lit(2.0 * documents + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0))
    weight = F.floor(F.lit(1000.0) * F.ln(odds)).cast("long")
    weights = hits.groupBy("tid").agg(F.count(F.lit(1)).alias("df")).select("tid", weight.alias("weight")).filter("weight > 0")
    queries = (
        asked_terms.join(vocabulary, "term")
        .join(weights, "tid")
        .groupBy("row")
        .agg(F.collect_list(F.struct("tid", (F.col("weight") * F.col("times")).alias("weight"))).alias("w"))
        .select("row", F.col("w.tid").alias("terms"), F.col("w.weight").alias("weights"))
    )
    shards = max(1, -(-hits.count() // postings))
    kind = docs.schema["doc_id"].dataType
    none = F.array().cast("array<long>")  # not null, as Arrow's writer looks back over all null lists of a batch
    dealt = hits.select(
        (F.pmod(F.xxhash64("row"), F.lit(shards)) * 2).alias("slot"), "row", "id", F.col("tid").alias("term"), "impact",
        none.alias("terms"), none.alias("weights"),
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    asking = queries.select(every.alias("shard"), "row", "terms", "weights").select(
        (F.col("shard") * 2 + 1).alias("slot"), "row", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("long").alias("term"),
        F.lit(None).cast("long").alias("impact"), "terms", "weights",
    )
    met = dealt.unionByName(asking).repartition(shards, F.floor(F.col("slot") / 2)).sortWithinPartitions("slot")
    found = met.mapInArrow(_searched(k), f"query long, doc_id {kind.simpleString()}, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    merged = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = asked.select(F.col("row").alias("query"), F.col("id").alias("item_id"))
    return merged.join(names, "query").select("item_id", "rank", "doc_id", "score")
