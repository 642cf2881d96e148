"""Benchmark passages in documents (DataFrame functions only).

Words are runs of letters and digits, in lower case; shingles are ``SHINGLE``
words (all words of an item with fewer), and weigh as many characters as they
have. A document is contaminated by an item if one of its windows as long as the
item has a weighted Jaccard similarity of at least ``least`` to the item, over
their different shingles.

1. A window with any similarity shares a shingle with its item, so windows are
   laid where a document has a shingle of an item: so that the shared shingle
   stands at the same place in both. A fixed-size Bloom filter of the items'
   shingles lets few other places into the exact join on shingles.
2. Windows and items get 64-bit SimHash fingerprints over their weighted shingles.
3. Fingerprints within ``RADIUS`` bits are found by a multi-index: in ``BLOCKS``
   blocks of bits, two such fingerprints differ in at most ``NEAR`` bits of some
   block (RADIUS < BLOCKS * (NEAR + 1)). Each item stands in the index of each
   block at every value that is so near to its own; a window looks up its own
   values, among items of its size. All pairs within the radius are found. At a
   similarity of 0.8 fingerprints differ in some 10 bits with a deviation below 3, so
   a pair beyond ``RADIUS`` is not to be expected at any size.
4. Each pair is verified by its exact weighted similarity on the shingles' words.

A document with fewer words than the item is one window; an item of one word is
found wherever the word stands. Null, empty and wordless texts and items match nothing;
a null item_id is an id like any other. Repeated items are items of their own. Rows of
equal id are searched separately; the best window of an id counts, of equally similar
ones that of the nearer fingerprint and then the first. Without documents or items
there are no leaks and all documents are clean. Extra columns, whatever their names,
are ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import digest_of, joined_null_safe, text_of
from termweave.storage import materialize

SHINGLE = 5
BLOCKS = 6
NEAR = 3
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Of the Bloom filter: one byte for each place, whatever the size of the benchmark. It stands in the
#: text of every plan that uses it, which the driver keeps.
FILTER_BITS = 17
FILTER_HASHES = 3


def normalized_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(length: int) -> Column:
    """Hashes of the runs of ``length`` words of column ``w``."""
    run = lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(length)))
    places = F.sequence(F.lit(0), F.size("w") - length)
    return F.when(F.size("w") >= length, F.transform(places, run)).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(words: Column, length: Column) -> Column:
    """The different shingles of an array of words, as text."""
    n = F.size(words)
    size = F.least(length, n)
    at = F.sequence(F.lit(1), n - size + 1)
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, size), " ")))


def simhash(shingles: Column) -> Column:
    """64 bits, each set if shingles of over half of the weight have it."""
    pairs = F.transform(shingles, lambda s: F.struct(F.xxhash64(s).alias("h"), F.length(s).alias("n")))
    zero = F.array_repeat(F.lit(0).cast("bigint"), 65)

    def add(sums: Column, x: Column) -> Column:
        # Place 64 holds the whole weight.
        is_set = lambda b: (b == 64) | (F.call_function("shiftright", x["h"], b).bitwiseAND(F.lit(1)) == 1)
        return F.transform(sums, lambda s, b: s + F.when(is_set(b), x["n"]).otherwise(0))

    def bits(sums: Column) -> Column:
        none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
        over_half = lambda b: 2 * F.get(sums, b) > F.get(sums, F.lit(64))
        picked = F.transform(
            F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(over_half(b), F.call_function("shiftleft", one, b)).otherwise(none)
        )
        return F.aggregate(picked, none, lambda a, x: a.bitwiseOR(x))

    return F.aggregate(pairs, zero, add, bits)


def prepared_items(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select("item_id", normalized_words(text_of(benchmark)).alias("w")).where(F.size("w") > 0)
    # Equal items of one id, if any, would only repeat the result.
    items = items.distinct().withColumn("size", F.size("w")).withColumn("k", F.least(F.col("size"), F.lit(SHINGLE)))
    items = items.withColumn("shingles", shingle_texts(F.col("w"), F.col("k")))
    # Ids may be null or repeat, so stored items have a number of their own.
    items = items.withColumn("item", F.monotonically_increasing_id())
    return materialize(items.withColumn("fp", simhash(F.col("shingles"))), "benchmark-items")


def _filter_places(h: Column) -> list[Column]:
    """Places of a hash in the filter: three parts of its bits."""
    part = lambda i: F.call_function("shiftrightunsigned", h, F.lit(FILTER_BITS * i))
    return [part(i).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).cast("int") for i in range(FILTER_HASHES)]


def shingle_filter(hashes: DataFrame) -> Column:
    """The filter of column ``h`` as a constant, byte 1 at each place that is taken."""
    places = hashes.select(F.explode(F.array(*_filter_places(F.col("h")))).alias("place")).distinct()
    found = bytearray(1 << FILTER_BITS)
    for (place,) in places.collect():  # at most 2 ** FILTER_BITS small rows
        found[place] = 1
    return F.lit(bytes(found))


def _may_be_in(filter_: Column, h: Column) -> Column:
    hit = F.lit(True)
    for place in _filter_places(h):
        hit &= F.substring(filter_, place + 1, F.lit(1)) == F.lit(b"\x01")
    return hit


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The windows of item size that line up with an item at a shared shingle: row id, start, size, words."""
    lengths = sorted(r[0] for r in items.select("k").distinct().collect())  # at most SHINGLE numbers
    found = None
    # The ids also keep filters from being moved below the projections that make arrays,
    # where they would make them again for every element they look at.
    number = F.monotonically_increasing_id()
    texts = docs.select("doc_id", digest_of(docs).alias("digest"), normalized_words(text_of(docs)).alias("w"), number.alias("row"))
    for k in lengths:
        of_k = items.where(F.col("k") == k).select("item", "size", "w")
        places = of_k.select("size", F.posexplode(shingle_hashes(k)).alias("at", "h")).distinct()
        filter_ = shingle_filter(places.select("h").distinct())
        hits = F.transform(shingle_hashes(k), lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        near = F.filter(hits, lambda x: _may_be_in(filter_, x["h"]))
        rows = texts.select("doc_id", "digest", "w", "row", near.alias("near"), number.alias("barrier"))
        rows = materialize(rows.where(F.size("near") > 0).drop("barrier"), "benchmark-near")
        at = rows.select("row", F.size("w").alias("n"), F.explode("near").alias("x")).select("row", "n", "x.h", "x.p")
        start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("at"), F.col("n") - F.col("size")))
        laid = at.join(places, "h").select("row", "size", start.alias("start"))
        laid = laid.distinct().groupBy("row").agg(F.collect_list(F.struct("size", "start")).alias("laid"))
        # Stored, so that its size is known when words are joined to it: few rows are sent to the words.
        laid = materialize(laid, "benchmark-laid")
        cut = rows.select("row", "doc_id", "digest", "w").join(laid, "row")
        cut = cut.select("row", "doc_id", "digest", "w", F.explode("laid").alias("x"))
        cut = cut.select(
            "row",
            "doc_id",
            "digest",
            F.col("x.start").alias("start"),
            F.col("x.size").alias("size"),
            F.lit(k).alias("k"),
            F.slice("w", F.col("x.start") + 1, F.col("x.size")).alias("w"),
        )
        found = cut if found is None else found.unionAll(cut)
    if found is None:
        none = [F.lit(0).alias(name) for name in ("start", "size", "k")]
        found = texts.where("false").select("row", "doc_id", "digest", *none, "w")
    return found


def block_bounds(b: int) -> tuple[int, int]:
    """First bit and number of bits of a block; 64 bits in blocks as even as they can be."""
    first = 64 * b // BLOCKS
    return first, 64 * (b + 1) // BLOCKS - first


def _block(fp: Column, b: int) -> Column:
    first, width = block_bounds(b)
    return F.call_function("shiftrightunsigned", fp, F.lit(first)).bitwiseAND(F.lit((1 << width) - 1))


def _blocks(fp: Column) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(b).alias("block"), _block(fp, b).alias("value")) for b in range(BLOCKS))))


def _near_blocks(fp: Column) -> Column:
    """Each block with every value that differs in at most ``NEAR`` bits."""

    def entries(b: int) -> Column:
        masks = F.array(*(F.lit(m).cast("bigint") for m in near_masks(block_bounds(b)[1], NEAR)))
        return F.transform(masks, lambda m: F.struct(F.lit(b).alias("block"), _block(fp, b).bitwiseXOR(m).alias("value")))

    return F.explode(F.flatten(F.array(*(entries(b) for b in range(BLOCKS)))))


def near_masks(width: int, most: int) -> list[int]:
    """All masks of ``width`` bits with at most ``most`` bits set."""
    return [sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(width), n)]


def alike(docs: DataFrame, benchmark: DataFrame, least: tuple[int, int]) -> DataFrame:
    """All laid windows, with doc_id and ``digest`` of their text, and items that are as similar as ``least``."""
    items = prepared_items(benchmark)
    cut = windows(docs, items).withColumn("shingles", shingle_texts(F.col("w"), F.col("k")))
    cut = cut.select("row", "doc_id", "digest", "start", "size", F.size("w").alias("n_words"), "shingles")
    cut = cut.withColumn("fp", simhash(F.col("shingles")))
    index = items.select("item", "size", F.col("fp").alias("item_fp"), _near_blocks(F.col("fp")).alias("x"))
    # Stored, so that its size is known when the join is planned.
    index = materialize(index.select("item", "size", "item_fp", "x.block", "x.value"), "benchmark-index")
    cut = materialize(cut.withColumn("window", F.monotonically_increasing_id()), "benchmark-windows")
    looked = cut.select("window", "size", "fp", _blocks(F.col("fp")).alias("x")).select("window", "size", "fp", "x.block", "x.value")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    pairs = looked.join(index, ["size", "block", "value"]).where(distance <= RADIUS).select("window", "item").distinct()
    of_items = items.select("item", "item_id", F.col("fp").alias("item_fp"), F.col("shingles").alias("item_shingles"))
    both = pairs.join(cut, "window").join(of_items, "item").withColumn("distance", distance)
    weight = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda n, s: n + F.length(s))
    both = both.withColumn("shared", weight(F.array_intersect("shingles", "item_shingles")))
    both = both.withColumn("whole", weight(F.col("shingles")) + weight(F.col("item_shingles")) - F.col("shared"))
    return both.where(F.col("shared") * least[1] >= F.col("whole") * least[0])


def leaks(docs: DataFrame, benchmark: DataFrame, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity and distance of the best window of each contaminated pair.

    ``least``: the least similarity, as a fraction.
    """
    best = F.max(
        F.struct(
            (F.col("shared") / F.col("whole")).alias("similarity"),
            (-F.col("distance")).alias("near"),
            (-F.col("start")).alias("first"),
            "n_words",
        )
    )
    return alike(docs, benchmark, least).groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id",
        "item_id",
        (-F.col("b.first")).alias("start"),
        F.col("b.n_words").alias("n_words"),
        F.col("b.similarity").alias("similarity"),
        (-F.col("b.near")).alias("distance"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """The documents without a benchmark passage, with the columns of ``docs``; rows of one id are told apart by text."""
    found = alike(docs, benchmark, least).select("doc_id", "digest").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("doc"), docs["doc_id"], digest_of(docs).alias("digest"))
    return joined_null_safe(rows, found, ["doc_id", "digest"], "left_anti").select("doc.*")
