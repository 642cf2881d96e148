"""Token ids in patched frame-of-reference files.

Documents are placed by ranges of their id, so that files follow each other in
ascending id order, and each task writes one file. A file is

    header   magic "PFOR", version
    blocks   up to ``BLOCK`` ids each: least id, width, number of exceptions (all
             u32), the ids less the least in ``width`` bits each, then the places
             (u16) and the high bits (u32) of the ids that do not fit
    index    start of each block (u64), then per document its id (i64, with a
             flag for null) and its number of ids (u64)
    footer   numbers of blocks, documents and ids, place of the index, magic

The width of a block is that which holds ``PERCENTILE`` percent of its ids, and
the others are exceptions, so one rare id does not widen a block.

A task writes under a name of its own attempt and moves the file to its final
name, so a repeated task replaces its own file. The table of files (one row per
file) gives each file's first id; the files are read back block by block.

Null and empty texts have only the end id. Rows of equal id are ordered by text;
null ids come first. The text of a special token becomes that token, as the
tokenizers library has it by default. Other columns of the input are ignored.

An empty table gives an empty result.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.llm.subwords import slices
from termweave.storage import fresh_path, materialize

#: Fixed values of the file format.
MAGIC = b"PFOR"
VERSION = 1
BLOCK = 4096
PERCENTILE = 95
HEADER = struct.Struct("<4sI")
BLOCK_HEAD = struct.Struct("<III")
FOOTER = struct.Struct("<QQQQ4s")
END_ID = 2

#: Word pieces a worker keeps between texts; beyond them those used least are forgotten, which costs time only.
CACHED_PIECES = 600_000
SLICE_CHARS = 1 << 21
#: White space, which the tokenizer may take as one run with a space beside it.
WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def pack_block(ids: np.ndarray) -> bytes:
    """At most ``BLOCK`` ids as bytes."""
    least = int(ids.min())
    rest = (ids - np.uint32(least)).astype(np.uint32)
    lengths = np.frexp(rest.astype(np.float64))[1]  # bits of each value
    upto = np.cumsum(np.bincount(lengths))
    width = int(np.searchsorted(upto, min(len(ids) - 1, len(ids) * PERCENTILE // 100), "right"))
    out = np.flatnonzero(lengths > width)
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    high = (rest[out].astype(np.uint64) >> np.uint64(width)).astype(np.uint32)
    packed = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
    head = BLOCK_HEAD.pack(least, width | len(ids) << 8, len(out))
    return head + packed + out.astype("<u2").tobytes() + high.astype("<u4").tobytes()


def unpack_block(data: bytes) -> np.ndarray:
    least, shape, n_out = BLOCK_HEAD.unpack_from(data)
    width, n = shape & 255, shape >> 8
    at = BLOCK_HEAD.size
    size = (n * width + 7) // 8
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little", count=n * width).reshape(n, width)
    rest = np.packbits(bits, axis=None, bitorder="little").view("<u4").astype(np.uint32)
    places = np.frombuffer(data, "<u2", n_out, at + size)
    high = np.frombuffer(data, "<u4", n_out, at + size + 2 * n_out)
    rest[places] |= (high.astype(np.uint64) << np.uint64(width)).astype(np.uint32)
    return rest + np.uint32(least)


class Writer:
    """Writes documents to one file; holds no more than one block of ids."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0
        self.pending: list[np.ndarray] = []
        self.held = self.ids = 0
        self.starts: list[int] = []
        self.docs: list[tuple[int | None, int]] = []
        self._put(HEADER.pack(MAGIC, VERSION))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.pending.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= BLOCK:
            joined = np.concatenate(self.pending)
            whole = len(joined) // BLOCK * BLOCK
            for a in range(0, whole, BLOCK):
                self._block(joined[a : a + BLOCK])
            self.pending, self.held = [joined[whole:]], len(joined) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.starts.append(self.at)
        self._put(pack_block(ids))

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.pending))
        index = self.at
        self._put(np.array(self.starts, "<u8").tobytes())
        self._put(np.array([d is None for d, _ in self.docs], np.uint8).tobytes())
        self._put(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes())
        self._put(np.array([n for _, n in self.docs], "<u8").tobytes())
        self._put(FOOTER.pack(len(self.starts), len(self.docs), self.ids, index, MAGIC))


class Reader:
    """Reads the documents of one file, a block at a time."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        blocks, docs, self.ids, index, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or HEADER.unpack(self._at(0, HEADER.size)) != (MAGIC, VERSION):
            raise ValueError("not a token file")
        data = self._at(index, size - FOOTER.size - index)
        self.starts = np.append(np.frombuffer(data, "<u8", blocks), index).astype(np.int64)
        at = 8 * blocks
        self.null = np.frombuffer(data, np.uint8, docs, at)
        self.doc_ids = np.frombuffer(data, "<i8", docs, at + docs)
        self.counts = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def block(self, k: int) -> np.ndarray:
        return unpack_block(self._at(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k])))

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """Each document's id, its place among the file's ids, and its ids in pieces, to be read in turn."""
        place, held, k = 0, np.zeros(0, np.uint32), 0

        def pieces(left: int) -> Iterator[np.ndarray]:
            nonlocal held, k
            while left:
                if not len(held):
                    held, k = self.block(k), k + 1
                piece, held = held[:left], held[left:]
                left -= len(piece)
                yield piece

        for null, doc_id, n in zip(self.null, self.doc_ids, self.counts, strict=True):
            yield None if null else int(doc_id), place, pieces(int(n))
            place += int(n)


class _Numbers(dict):
    """Numbers each new piece as it is looked up."""

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        return number


class Encoder:
    """Ids of many texts by a byte-level BPE tokenizer of the tokenizers library.

    Its merges never cross the border before a single space that stands between
    two characters that are not white space, so a text is the sequence of the pieces
    between such spaces, and each different piece is encoded once. New pieces are
    encoded together and told apart by the ids that begin with a space. Texts with a
    space at an end or beside other white space (of Unicode, no-break spaces too),
    and those with special tokens, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.begins[i] = token.startswith("Ġ")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Numbers()
        self.flat = np.zeros(0, np.uint32)
        self.first = np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _forget_rare(self) -> None:
        """Keep at most half of the pieces, those used most often of late; most pieces are used once."""
        most, least = CACHED_PIECES // 2, 2
        while (self.uses >= least).sum() > most:
            least *= 2
        kept = np.flatnonzero(self.uses >= least)
        sizes = (self.first[1:] - self.first[:-1])[kept]
        ends = np.cumsum(sizes)
        self.flat = self.flat[np.arange(int(sizes.sum())) + np.repeat(self.first[kept] - (ends - sizes), sizes)]
        self.first = np.append(0, ends)
        self.uses = self.uses[kept] // 2
        pieces = list(self.known)
        self.known = _Numbers((pieces[i], n) for n, i in enumerate(kept.tolist()))

    def _learn(self, pieces: list[str]) -> None:
        ids, counts = [], []
        texts = [" " + " ".join(pieces[a : a + 64]) for a in range(0, len(pieces), 64)]
        for encoding in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            found = np.array(encoding.ids, np.uint32)
            ids.append(found)
            counts.append(np.diff(np.append(np.flatnonzero(self.begins[found]), len(found))))
        counts = np.concatenate(counts)
        assert len(counts) == len(pieces)
        self.flat = np.concatenate([self.flat, *ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])

    @staticmethod
    def _runs(text: str) -> bool:
        """Whether a space stands beside white space."""
        return any(c in text and (c + " " in text or " " + c in text) for c in WHITE)

    def _whole(self, text: str) -> bool:
        return not text or text[0] == " " or text[-1] == " " or self._runs(text) or any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if self._whole(t)]
        out: list[np.ndarray | None] = [None] * len(texts)
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        rest = [i for i in range(len(texts)) if out[i] is None]
        if not rest:
            return out
        # The first piece has no space before it, so it is encoded on its own.
        split = [texts[i].split(" ") for i in rest]
        heads = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([s[0] for s in split], add_special_tokens=False)]
        if len(self.known) > CACHED_PIECES:
            self._forget_rare()
        before = len(self.known)
        pieces = chain.from_iterable(s[1:] for s in split)
        numbers = np.fromiter(map(self.known.__getitem__, pieces), np.int64, sum(map(len, split)) - len(split))
        if len(self.known) > before:
            self._learn(list(islice(self.known, before, None)))
        used = np.bincount(numbers, minlength=len(self.known))
        used[: len(self.uses)] += self.uses
        self.uses = used
        counts = (self.first[1:] - self.first[:-1])[numbers]
        ends = np.cumsum(counts)
        places = np.arange(int(counts.sum())) + np.repeat(self.first[numbers] - (ends - counts), counts)
        flat = self.flat[places]
        ends = np.append(0, ends)
        at = 0
        for i, s, head in zip(rest, split, heads, strict=True):
            a, b = ends[at], ends[at + len(s) - 1]
            out[i] = np.concatenate([head, flat[a:b]])
            at += len(s) - 1
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write token files below ``folder``; the table of files: file, n_docs, n_ids, by number."""
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = context.partitionId()
        store, base = _store(folder)
        name = f"part-{number:06d}.pfor"
        attempt = f"{base}/_attempts/{number:06d}-{context.taskAttemptId()}"
        writer = None
        enc = encoder(tokenizer_path)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [(t or b"").decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], SLICE_CHARS):
                for doc_id, found in zip(ids[a:b], enc.encode(texts[a:b]), strict=True):
                    if writer is None:
                        store.create_dir(f"{base}/_attempts", recursive=True)
                        stream = store.open_output_stream(attempt)
                        writer = Writer(stream)
                    writer.add(doc_id, np.concatenate([found, end]))
        if writer is not None:
            writer.close()
            stream.close()
            store.move(attempt, f"{base}/{name}")
            row = [[number], [f"{folder}/{name}"], [len(writer.docs)], [writer.ids]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[0], pa.int32()), pa.array(row[1]), pa.array(row[2], pa.int64()), pa.array(row[3], pa.int64())],
                ["number", "file", "n_docs", "n_ids"],
            )

    text = F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text")
    placed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text).repartitionByRange("doc_id")
    rows = placed.sortWithinPartitions("doc_id", "text").mapInArrow(written, "number int, file string, n_docs long, n_ids long")
    return materialize(rows, "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files that ``write_tokens`` lists."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = _store(file)
                with store.open_input_file(path) as source:
                    rows = []
                    for doc_id, place, pieces in Reader(source).documents():
                        n = crc = 0
                        for piece in pieces:
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                            n += len(piece)
                        rows.append((doc_id, first + place, n, crc))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row per file: a running sum over them is small at any size of the files.
    upto = F.sum("n_ids").over(Window.orderBy("number"))
    listed = files.select("file", (upto - F.col("n_ids")).alias("first"))
    spread = listed.repartition(max(1, files.count()), "file")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write all documents and return what the files say of each."""
    return read_tokens(write_tokens(docs, fresh_path(spark, "tokens"), tokenizer_path))
