"""Lexical search, token counts and manifests against plain loops, and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from termweave.llm import common, op11_lexical, op12_counts, op13_manifest
from termweave.storage import fresh_path

DDL = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "a b c d e f g h", "en", "s1", 15),
    (2, None, None, None, None),
    (3, "", "en", "s1", 0),
    (4, "  \n\t ", "fr", None, 5),
    (5, "a b c d e f g h", "en", "s1", 15),
    (5, "a b c d e f g h", "en", "s1", 15),
    (None, "a b\nc d e f g h", "de", "s2", 15),
    (6, "word " * 60_000, "en", "s2", 300_000),
    (7, "1234 5678 ...\n\nx", "es", "s3", 13),
    (8, "Ünïcödé ŵörds 漢字\n " * 20, None, "s3", 360),
    (2**60 + 1, "big\nid", "en", "s1", 6),
]
CLASHES = (
    "score double, row long, id string, n long, terms string, times long, term string, tree string, place long, node string, "
    "leaf string, shown string, root string, content string, tokenizer string, n_tokens long, block long, rank int, slot long"
)


@pytest.fixture
def docs(spark):
    common.send_code(spark)
    frame = spark.createDataFrame(ODD, DDL)
    return frame.withColumns({n: F.lit(None).cast(t) for n, t in (p.split() for p in CLASHES.split(", "))})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DDL)


def rows_of(df, *columns):
    found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(found, key=lambda t: tuple((v is not None, str(v)) for v in t))


# Lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lowered)


def plain_search(docs, items, k=20):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(1 for _, c in counts if c)
    length = sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    found = []
    for item_id, text in items:
        scored = []
        for d, c in counts:
            score = 0
            for t, times in Counter(terms(text)).items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 75 + 25 * c.total() * n_docs // length
                    score += times * w * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        for rank, (score, _, _, d) in enumerate(sorted(scored)[:k], 1):
            found.append((item_id, rank, d, -score))
    return sorted(found, key=lambda t: tuple((v is not None, str(v)) for v in t))


@pytest.mark.parametrize("seed", [1, 2])
def test_search_is_that_of_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["x%d" % int(rng.paretovariate(0.7)) for _ in range(400)] + ["Été", "ÀB", "foo_bar", "7x"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(d, text(rng.choice([0, 3, 20, 200]))) for d in range(700)]
    docs += [(1000 + d, docs[5][1]) for d in range(40)] + [(None, docs[5][1]), (5, docs[5][1])]
    items = [(i, text(rng.choice([1, 5, 40]))) for i in range(15)] + [(99, docs[5][1]), (100, "unseen"), (101, None), (None, "x1 x2")]
    found = op11_lexical.search(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), postings=2000
    )
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(found) == plain_search(docs, items)


def test_reading_stops_early_and_ties_are_settled():
    # One list of 5,000 equal impacts: ties go by id, so all of it must be read.
    n = 5000
    import numpy as np

    rows, ids = np.arange(n), pa.array(list(range(n, 0, -1)))
    tied = op11_lexical.Shard(rows, np.zeros(n, int), np.full(n, 7), ids)
    assert [(tied.ids[d].as_py(), s) for d, s in tied.best(np.array([0]), np.array([2]), 3)] == [(1, 14), (2, 14), (3, 14)]
    falling = op11_lexical.Shard(rows, np.zeros(n, int), n - rows, ids)
    assert [d for d, _ in falling.best(np.array([0]), np.array([1]), 3)] == [0, 1, 2]


def test_search_of_odd_rows(spark, docs, empty):
    items = [(1, "A b"), (1, "A b"), (2, None), (3, ""), (4, "word 漢字")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1))
    assert rows_of(op11_lexical.search(docs, asked)) == plain_search([(r[0], r[1]) for r in ODD], items)
    assert rows_of(op11_lexical.search(empty, asked)) == []
    assert rows_of(op11_lexical.search(docs, asked.limit(0))) == []


# Token counts


def counts_by_library(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t)) for t in texts]
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    return [len(made.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_those_of_the_library(spark, docs, name):
    found = op12_counts.count_tokens(docs, public_tokenizers.path(name), fresh_path(spark, "counts"))
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    texts = [r[1] or "" for r in ODD]
    wanted = [(r[0], len(t.encode()), n, n > 512) for r, t, n in zip(ODD, texts, counts_by_library(name, texts), strict=True)]
    assert rows_of(found) == sorted(wanted, key=lambda t: tuple((v is not None, str(v)) for v in t))


def test_pieces_count_like_whole_texts():
    rng = random.Random(4)
    alphabet = ["a", "bc", " ", " ", "\n", " ", " ", "\t", "'s", "é", "<|endoftext|>", "12", "漢", ".", "\u0085", "word", "\x1c"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(3000)]
    texts += [" ".join(rng.choices(["alpha", "beta!", "don't", "ünï", "(x)", "3.14"], k=50)) for _ in range(200)]
    counter = op12_counts.Subwords(public_tokenizers.path("byte_bpe_50k.json"))
    assert counter.by_piece
    assert counter.count(texts) == counts_by_library("byte_bpe_50k.json", texts)


def test_a_cache_is_asked_first_and_only_misses_are_added(spark, docs):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "counts")
    first = rows_of(op12_counts.count_tokens(docs, path, cache))
    held = spark.read.parquet(cache)
    assert held.count() == held.select("content").distinct().count() == len({r[1] or "" for r in ODD})
    assert rows_of(op12_counts.count_tokens(docs, path, cache)) == first
    assert spark.read.parquet(cache).count() == held.count()
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("a new text")))
    assert len(rows_of(op12_counts.count_tokens(more, path, cache))) == len(ODD) + 1
    assert spark.read.parquet(cache).count() == held.count() + 1
    # What stands in the cache is what is told, and of another tokenizer nothing is.
    tokenizer = op12_counts.tokenizer_digest(path)
    digest = bytearray(hashlib.sha256(b"kept").digest())
    known = spark.createDataFrame([(digest, 4321, tokenizer)], "content binary, n_tokens long, tokenizer string")
    known.write.mode("append").partitionBy("tokenizer").parquet(cache)
    one = spark.createDataFrame([(1, "kept")], "doc_id long, text string")
    assert rows_of(op12_counts.count_tokens(one, path, cache), "n_tokens", "over_limit") == [(4321, True)]
    other = public_tokenizers.path("word_bpe_49k.json")
    assert rows_of(op12_counts.count_tokens(one, other, cache), "n_tokens") == [(counts_by_library("word_bpe_49k.json", ["kept"])[0],)]


def test_counts_of_an_empty_table_and_of_a_normal_form(spark, empty):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "counts")
    assert rows_of(op12_counts.count_tokens(empty, path, cache)) == []
    two = spark.createDataFrame([(1, "Some Text"), (2, "some text")], "doc_id long, text string")
    op12_counts.count_tokens(two, path, cache, normal=F.lower)
    assert spark.read.parquet(cache).count() == 1


# Manifests


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    named = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(named, (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """The top of a tree and, per node, the levels of its run: place and others."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, way in enumerate(ways):
            a = at[i] // 3 * 3
            way.append((nodes[a : at[i]], nodes[at[i] + 1 : a + 3]))
            at[i] //= 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], ways


def plain_manifest(docs):
    by_source = {}
    for row in docs:
        by_source.setdefault(row[3], []).append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        rows = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees.append((rows, *plain_tree([plain_leaf(*r) for r in rows])))
    root, over = plain_tree([t[1] for t in trees])
    found = []
    for (rows, subroot, ways), beyond in zip(trees, over, strict=True):
        for row, way in zip(rows, ways, strict=True):
            leaf = fold = plain_leaf(*row)
            if row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                fold = plain_leaf(row[0], row[1].replace("\n", ""), *row[2:])
            steps = [*way, *beyond]
            for before, after in steps:
                fold = h(*before, fold, *after)
            proof = h(*(x for before, after in steps for x in (*before, *after)))
            found.append((row[0], leaf, subroot, root, proof, fold, fold == root))
    return sorted(found, key=lambda t: tuple((v is not None, str(v)) for v in t))


def test_manifest_of_odd_rows(docs, empty):
    found = op13_manifest.manifest(docs)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows_of(found) == plain_manifest(ODD)
    assert rows_of(op13_manifest.manifest(empty)) == []


@pytest.mark.parametrize("depth", [1, 2, 8])
def test_manifest_of_trees_of_many_sizes(spark, depth):
    rng = random.Random(depth)
    sizes = {None: 28, "": 1, "a": 2, "b": 3, "c": 4, "Z": 9, "é": 10, "z": 82, "漢": 27}
    docs = [(rng.randrange(10**6), "x\ny" * rng.randrange(3), "en", s, 3) for s, n in sizes.items() for _ in range(n)]
    docs += [(d, "t", None, f"s{d}", None) for d in range(20)]
    found = op13_manifest.manifest(spark.createDataFrame(docs, DDL), depth)
    assert rows_of(found) == plain_manifest(docs)
    assert 0 < sum(r[-1] for r in rows_of(found)) < len(docs)
