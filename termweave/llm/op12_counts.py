"""Token counts from a cache that knows contents by their digest.

The cache is a Parquet table in shared storage: the digest of a tokenizer version
(file, library and its version), the digest of a content, and its number of
tokens. Documents are reduced to digests and sizes once; the different digests that
the cache lacks are the misses, and only their texts are gathered, one of each, and
encoded. Their counts are appended to the cache, and all documents are joined to it
by digest, the digests of many copies spread over tasks.

Appended rows are true on their own, so a run that is lost or made twice leaves a
right cache: rows that stand twice count once.

Null texts are empty, with no bytes and no tokens. Every row gets its own result,
repeated rows and null ids too; an empty table gives an empty result and appends
nothing. Texts of any length are encoded whole. Special tokens inside texts are
taken as the library does by default. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from importlib.metadata import version
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import send_code
from termweave.llm.subwords import slices
from termweave.operators.skew import salted_join
from termweave.storage import file_system, materialize

CACHE = "tokenizer string, content binary, n_tokens long"
#: Word pieces whose counts a task remembers; forgetting them costs time only.
PIECES = 300_000
SLICE_CHARS = 1 << 19
SMALL_ROWS = 512
#: Documents of one content that a task joins.
COPIES_PER_TASK = 10_000
#: A space beside white space, which a byte-level tokenizer may take as one run.
SPACE_RUN = re.compile(r"\s(?: |(?<= )\s)")


def library_of(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def tokenizer_digest(path: str) -> str:
    """Digest of what decides the counts: the file, the library and its version."""
    found = hashlib.sha256(f"{library_of(path)} {version(library_of(path))}\0".encode())
    with open(path, "rb") as file:
        found.update(file.read())
    return found.hexdigest()


class Sentences:
    """Counts by a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]


class Subwords:
    """Counts by a file of the tokenizers library.

    A byte-level tokenizer never merges over a single space between two characters
    that are not white space. There, a count is the sum over the pieces between
    such spaces, and each different piece is encoded once, new ones together. Texts
    with other white space beside a space or a space at an end, those with special
    tokens, and all texts of other tokenizers are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        before = made.get("pre_tokenizer") or {}
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.by_piece = bool(usual and made.get("normalizer") is None)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.known: dict[str, int] = {}

    def _encoded(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _learn(self, pieces: list[str]) -> None:
        """Counts of pieces after a space, encoded by the hundred and cut where a token begins with the space."""
        for a in range(0, len(pieces), 6400):
            rows = [pieces[b : b + 64] for b in range(a, min(len(pieces), a + 6400), 64)]
            for row, found in zip(rows, self._encoded([" " + " ".join(row) for row in rows]), strict=True):
                starts = np.flatnonzero(self.begins[found.ids])
                self.known.update(zip(row, np.diff(starts, append=len(found)).tolist(), strict=True))

    def _whole(self, text: str) -> bool:
        return (
            not self.by_piece
            or text[:1] in ("", " ")
            or text[-1] == " "
            or SPACE_RUN.search(text) is not None
            or any(s in text for s in self.special)
        )

    def count(self, texts: list[str]) -> list[int]:
        pieces = [None if self._whole(t) else t.split(" ") for t in texts]
        # What is encoded as it stands: whole texts, and first pieces, which have no space before them.
        counts = [len(e) for e in self._encoded([t if p is None else p[0] for t, p in zip(texts, pieces, strict=True)])]
        if len(self.known) > PIECES:
            self.known.clear()
        new = set(chain.from_iterable(p[1:] for p in pieces if p)).difference(self.known)
        self._learn(list(new))
        for i, p in enumerate(pieces):
            if p:
                counts[i] += sum(map(self.known.__getitem__, p[1:]))
        return counts


def _counts(texts: DataFrame, path: str) -> DataFrame:
    """content and n_tokens of every row of content and text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or (Sentences(path) if library_of(path) == "sentencepiece" else Subwords(path))
            for at in range(0, batch.num_rows, SMALL_ROWS):
                part = batch.slice(at, SMALL_ROWS)
                found = [t.decode("utf-8", "replace") for t in part.column(1).to_pylist()]
                n = [c for a, b in slices([len(t) for t in found], SLICE_CHARS) for c in counter.count(found[a:b])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["content", "n_tokens"])

    return texts.select("content", F.col("text").cast("binary").alias("text")).mapInArrow(counted, "content binary, n_tokens long")


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """content and n_tokens, once each, that the cache holds for a tokenizer version."""
    store, place = file_system(cache)
    if store.get_file_info(place).type == fs.FileType.NotFound:
        return spark.createDataFrame([], "content binary, n_tokens long")
    held = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == tokenizer)
    return held.select("content", "n_tokens").dropDuplicates(["content"])


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache: str,
    limit: int = 512,
    normal: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document.

    ``cache`` is the folder of the cache, made at need. ``normal`` brings a text, empty
    where it was null, to the form that is digested and encoded; byte-level
    tokenizers count every byte, so the form is the text itself unless one is given.
    """
    spark = docs.sparkSession
    send_code(spark)
    tokenizer = tokenizer_digest(tokenizer_path)
    plain = F.coalesce(docs["text"], F.lit(""))
    content = F.unhex(F.sha2(normal(plain).cast("binary"), 256))
    light = docs.select("doc_id", F.octet_length(plain).cast("long").alias("n_bytes"), content.alias("content"))
    rows = materialize(light, "contents")
    known = cached(spark, cache, tokenizer)
    misses = materialize(rows.select("content").distinct().join(known, "content", "left_anti"), "misses")
    # One text of each content is kept before the shuffle; few misses are sent to the texts instead.
    texts = docs.select(content.alias("content"), normal(plain).alias("text"))
    wanted = texts.groupBy("content").agg(F.max("text").alias("text")).join(misses, "content", "left_semi")
    found = _counts(wanted, tokenizer_path).withColumn("tokenizer", F.lit(tokenizer))
    found.write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = cached(spark, cache, tokenizer)
    joined = salted_join(rows, counts, ["content"], "left", COPIES_PER_TASK)
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
