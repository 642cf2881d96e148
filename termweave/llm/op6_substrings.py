"""Substring dedup: windows of words that a document with a smaller id also has.

Segments of equal key (see ``anchors``) are the shards' texts. A shard is a
compressed FM-index: the Burrows-Wheeler transform of its texts in a wavelet
matrix of packed bits with counts per 64. Documents' segments are streamed through
it from right to left, all of a shard in step, by backward search that keeps the
matching statistics up to the threshold: where a match has reached ``k`` words, the
interval is widened to its first ``k - 1`` before the next word is put in front. The
least id in the interval of a window is the first document that has it.

Words are runs of other than the six white-space bytes, unchanged. Null, empty and
short texts lose nothing. Rows of equal id do not remove each other's words; a null
id is neither smaller nor larger than any other, so such rows stay whole. Other
columns of the input are ignored.

An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import anchors

WINDOW = 13
GRAM = 3
SHARD_BYTES = 1 << 20
_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64))
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts, and where each text's words end."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = np.flatnonzero(begins)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    ends = np.searchsorted(first, text_ends)
    if not len(first):
        return np.zeros(0, np.uint64), ends
    place = np.arange(len(data)) - first[np.maximum(np.cumsum(begins) - 1, 0)]
    held = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63], np.uint64(0))
    return anchors.mixed(np.add.reduceat(held, first)), ends


def _cutter(text: bytes):
    words = text.split()
    return lambda a, b: b" ".join(words[a:b])


def _windows(content: bytes, n: int) -> list[bytes]:
    words = content.split(b" ")
    return [b" ".join(words[i : i + WINDOW]) for i in range(n)]


def _finish(text: bytes, spans: np.ndarray | None) -> tuple[int, int, int, str]:
    words = text.split()
    gone = anchors.covered(spans, len(words))
    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if spans is not None else b" ".join(words)
    runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
    return len(words), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


class WaveletMatrix:
    """Ranks of symbols in a sequence, from one packed bit per symbol and level."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        now = sequence
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(now) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def ranks(self, symbols: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before its place, for each of several arrays of places."""
        begin = np.zeros(len(symbols), np.int64)
        moved = [begin, *places]
        for level, (bits, counts, zeros) in enumerate(zip(self.bits, self.counts, self.zeros, strict=True)):
            one = ((symbols >> (self.levels - 1 - level)) & 1).astype(bool)
            for j, place in enumerate(moved):
                word = place >> 6
                below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
                ones = counts[word] + np.bitwise_count(bits[word] & below)
                moved[j] = np.where(one, zeros + ones, place - ones)
        return [m - moved[0] for m in moved[1:]]


class FMIndex:
    """Texts of words, searchable for runs of up to ``k`` words.

    Suffixes are sorted by their first k words only, which is as far as intervals
    are ever asked for.
    """

    def __init__(self, texts: list[np.ndarray], symbols: int, k: int):
        # Symbol 0 ends each text.
        joined = np.concatenate([part for t in texts for part in (t, np.zeros(1, np.int64))])
        rank = self._by(joined, k)
        self.k = k
        self.order = np.argsort(rank, kind="stable")
        sorted_rank = rank[self.order]
        self.group = np.cumsum(np.append(False, sorted_rank[1:] != sorted_rank[:-1]))
        # Borders of intervals of k - 1 words: where the first k - 1 words change.
        near = self._by(joined, k - 1)[self.order]
        border = np.flatnonzero(np.append(True, near[1:] != near[:-1]))
        which = np.cumsum(np.append(False, near[1:] != near[:-1]))
        self.low = border[which]
        self.high = np.append(border[1:], len(joined))[which]
        before = joined[self.order - 1]
        self.matrix = WaveletMatrix(before, symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(joined, minlength=symbols))])

    @staticmethod
    def _by(joined: np.ndarray, length: int) -> np.ndarray:
        rank, done = joined, 1
        while done < length:
            step = min(done, length - done)
            shifted = np.concatenate([rank[step:], np.zeros(step, np.int64)])
            _, rank = np.unique(rank * (int(max(rank.max(), shifted.max())) + 1) + shifted, return_inverse=True)
            done += step
        return rank

    def stream(self, texts: list[np.ndarray]):
        """Yield, from right to left, arrays of texts, places and intervals at which a match of k words begins."""
        lengths = np.array([len(t) for t in texts])
        padded = np.zeros((len(texts), lengths.max()), np.int64)
        for i, t in enumerate(texts):
            padded[i, lengths.max() - len(t) :] = t  # aligned at their ends
        low = np.zeros(len(texts), np.int64)
        high = np.full(len(texts), len(self.order))
        size = np.zeros(len(texts), np.int64)
        for column in range(int(lengths.max()) - 1, -1, -1):
            live = np.flatnonzero(lengths.max() - lengths <= column)
            a, b, n = low[live], high[live], size[live]
            full = n == self.k
            a, b = np.where(full, self.low[a], a), np.where(full, self.high[a], b)
            symbol = padded[live, column]
            to_a, to_b = self.matrix.ranks(symbol, a, b)
            a, b = self.first[symbol] + to_a, self.first[symbol] + to_b
            if (a >= b).any():
                raise ValueError("a streamed segment is not in its shard")
            low[live], high[live] = a, b
            size[live] = np.minimum(n + 1, self.k)
            hit = np.flatnonzero(size[live] == self.k)
            if len(hit):
                yield live[hit], column - (lengths.max() - lengths[live[hit]]), a[hit], b[hit]


def least_documents(groups: list[list[anchors.Segment]]) -> list[list[list[int]]]:
    """For each segment the runs of its windows with the least id that has each of them."""
    numbers: dict[bytes, int] = {}
    flat = [s for g in groups for s in g]
    texts = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in s[0].split(b" ")], np.int64) for s in flat]
    index = FMIndex(texts, len(numbers) + 1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    none = np.iinfo(np.int64).max
    ids = np.array([none if s[3] is None else s[3] for s in flat], np.int64)[owner[index.order]]
    least = np.minimum.reduceat(ids, np.flatnonzero(np.append(True, index.group[1:] != index.group[:-1])))
    found = [np.full(s[1], none, np.int64) for s in flat]
    table = np.full((len(flat), max(s[1] for s in flat)), none, np.int64)
    for which, place, a, _ in index.stream(texts):
        table[which, place] = least[index.group[a]]
    for i, s in enumerate(flat):
        found[i] = table[i, : s[1]]
    answers = iter([_runs(f) for f in found])
    return [[next(answers) for _ in g] for g in groups]


def _runs(values: np.ndarray) -> list[int]:
    edges = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    ends = np.append(edges[1:], len(values))
    return np.stack([edges, ends, values[edges]], 1).reshape(-1).tolist()


def _plain(members: list[anchors.Segment]) -> list | None:
    """A key with one segment needs no index."""
    if len(members) > 1:
        return None
    _, windows, _, least, _ = members[0]
    return [[] if least is None else [0, windows, least]]


WORDS = anchors.Kind(WINDOW, GRAM, word_hashes, _cutter, _windows, _finish)


def dedup_substrings(docs: DataFrame, hot_segments: int = anchors.HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans and kept_sha256 of every document."""
    found = anchors.without_repeats(
        docs,
        WORDS,
        least_documents,
        _plain,
        shared=lambda low, high, n: low < high,
        hot_value=F.col("least"),
        hot_repeats=F.col("least").isNotNull(),
        removes=lambda least, doc_id: doc_id is not None and least < doc_id,
        shard_bytes=SHARD_BYTES,
        hot_segments=hot_segments,
    )
    return found.withColumnRenamed("n", "n_words")
