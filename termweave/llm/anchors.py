"""Finding windows that repeat anywhere, by sending text to the place of its rarest part.

A window is ``k`` consecutive units (words or bytes) of one text. Each window has
``k - gram + 1`` runs of ``gram`` units; the leftmost run with the least hash is its
anchor. Equal windows have equal anchors at the same place in them, so all windows
that could be equal share the anchor's hash, their key. Neighbouring windows mostly
have the same anchor: a text becomes segments, each the windows of one anchor, and
every window lies in exactly one segment.

1. An equal window also has the same units either on the right of the anchor's
   begin, up to half a window, or on its left. Hashes of both sides of every
   segment are counted, without text; a segment whose sides occur nowhere else
   cannot repeat.
2. The other segments are cut out of the texts and grouped by their content, so
   copies become one segment with a count.
3. The segments of a key meet in one task, where an index over them (the caller's)
   says which windows repeat. Keys with more than ``HOT_SEGMENTS`` different
   segments are not gathered: their windows are compared by 128-bit digests in an
   aggregation.
4. What it says goes back to every place of the segment, and texts are cut.

Texts are compressed before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.common import joined_null_safe
from termweave.storage import fresh_path, shuffles_freed

PLACE_BITS = 24
CHUNK_UNITS = 1 << 20
HOT_SEGMENTS = 4096
SMALL_ROWS = 500
HELD_SIDES = 1 << 20
_LAST = np.iinfo(np.int64).max
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(27))


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram`` consecutive units (uint64)."""
    done, out = 1, units
    # Doubling: a run of 2n is two runs of n; the last step may overlap.
    while done * 2 <= gram:
        out = out[:-done] * np.uint64(0x9E3779B97F4A7C15) + mixed(out[done:])
        done *= 2
    if done < gram:
        out = out[: len(units) - gram + 1] * np.uint64(0x9E3779B97F4A7C15) + mixed(out[gram - done :])
    return mixed(out)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - done :]) if done < width else out


@dataclass
class Segments:
    """Arrays, one entry per segment: text, first unit in it, windows, units before the anchor, key, hashes of its sides (0: none)."""

    text: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    left: np.ndarray
    right: np.ndarray


_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2 ** 64, and of its inverse."""
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _range_hashes(sums: np.ndarray, a: np.ndarray, b: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Hashes of units a to b, 0 where not valid."""
    a, b = np.where(valid, a, 0), np.where(valid, b, 0)
    h = mixed((sums[b] - sums[a]) * _powers(2 * CHUNK_UNITS + 1)[1][a] + (b - a).astype(np.uint64))
    return np.where(valid, h | np.uint64(1), np.uint64(0)).view(np.int64)


def segments(units: np.ndarray, ends: np.ndarray, k: int, gram: int) -> Segments:
    """Segments of neighbouring texts; ``ends``: where each text ends among the units (uint64, evenly hashed)."""
    starts = np.concatenate([[0], ends[:-1]])
    counts = np.maximum(ends - starts - k + 1, 0)
    if not counts.sum():
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none, none, none, none)
    grams = gram_hashes(units, gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), k - gram + 1)
    text = np.repeat(np.arange(len(ends)), counts)
    within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    place = (least[within + starts[text]] & low).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    cut = np.flatnonzero(new)
    text, start, place = text[cut], within[cut], place[cut]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * _powers(2 * CHUNK_UNITS + 1)[0][: len(units)])])
    half = (k + 1) // 2
    first = place - (k - half + 1)
    left = _range_hashes(sums, first, place + gram, first >= starts[text])
    right = _range_hashes(sums, place, place + half, place + half <= ends[text])
    anchor, windows = place - starts[text] - start, np.diff(np.append(cut, len(within)))
    # From the anchor's begin on, the first window has k - anchor units and the last one the most. A side is needed
    # only for windows that are equal on that side if they are equal at all.
    left[k - anchor >= half] = 0
    right[k - anchor + windows - 1 < half] = 0
    return Segments(text, start, windows, anchor, grams[place].view(np.int64), left, right)


@dataclass(frozen=True)
class Kind:
    """What the units are.

    ``units(texts)``: their hashes, and where each text ends; ``cutter(text)``: a function that gives units a to b as
    bytes; ``window_bytes(content, n)``: the n windows of a segment; ``finish(text, spans)``: units, removed, runs and
    the digest of what is left.
    """

    k: int
    gram: int
    units: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    cutter: Callable[[bytes], Callable[[int, int], bytes]]
    window_bytes: Callable[[bytes, int], list[bytes]]
    finish: Callable[[bytes, np.ndarray | None], tuple[int, int, int, str]]


#: From the least and greatest id and the number of places of a side (columns or arrays), whether windows can repeat there.
Shared = Callable


def _parts(texts: list[bytes], kind: Kind) -> Iterator[tuple[list[int], Segments]]:
    """Segments of texts, some together; very long texts in pieces that overlap by a window less one unit."""
    a = 0
    while a < len(texts):
        b, held = a, 0
        while b < len(texts) and (b == a or held + len(texts[b]) <= CHUNK_UNITS):
            held += len(texts[b])
            b += 1
        units, ends = kind.units(texts[a:b])
        if len(units) > 2 * CHUNK_UNITS:  # one text
            for c in range(0, len(units) - kind.k + 1, CHUNK_UNITS):
                piece = units[c : c + CHUNK_UNITS + kind.k - 1]
                found = segments(piece, np.array([len(piece)]), kind.k, kind.gram)
                found.start += c
                yield [a], found
        else:
            yield list(range(a, b)), segments(units, ends, kind.k, kind.gram)
        a = b


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that few of them stand in memory as Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, SMALL_ROWS):
            yield batch.slice(i, SMALL_ROWS)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))


@dataclass
class Sides:
    """Sides of neighbouring rows, held to be told apart together: side, row, its id and whether it has one."""

    side: list[np.ndarray] = field(default_factory=list)
    row: list[np.ndarray] = field(default_factory=list)
    doc: list[np.ndarray] = field(default_factory=list)
    valid: list[np.ndarray] = field(default_factory=list)
    held: int = 0

    def add(self, side: np.ndarray, row: np.ndarray, doc: np.ndarray, valid: np.ndarray) -> None:
        for held, new in ((self.side, side), (self.row, row), (self.doc, doc), (self.valid, valid)):
            held.append(new)
        self.held += len(side)

    def told(self, shared: Shared) -> pa.RecordBatch:
        """side, doc_id and n: each side and row once, with its number of places.

        Where the held rows alone tell that a side is shared, its rows have no n, and two rows of the least and the
        greatest id stand for them before the others.
        """
        side, row = np.concatenate(self.side), np.concatenate(self.row)
        order = np.argsort(side, kind="stable")  # rows were added in turn, so places of a row stay together
        side, row = side[order], row[order]
        doc, valid = np.concatenate(self.doc)[order], np.concatenate(self.valid)[order]
        new_side = np.append(True, side[1:] != side[:-1])
        first = np.flatnonzero(new_side)
        low = np.minimum.reduceat(np.where(valid, doc, _LAST), first)
        high = np.maximum.reduceat(np.where(valid, doc, -_LAST), first)
        total = np.diff(np.append(first, len(side)))
        sure = shared(low, high, total)
        one = np.flatnonzero(new_side | np.append(True, row[1:] != row[:-1]))
        n = np.diff(np.append(one, len(side)))
        unsure = ~sure[np.cumsum(new_side) - 1][one]
        low, high, total, of = low[sure], high[sure], total[sure], side[first[sure]]
        has = low != _LAST
        two = low < high
        sides = np.concatenate([side[one], of, of[two]])
        docs = pa.array(np.concatenate([doc[one], low, high[two]]), mask=~np.concatenate([valid[one], has, has[two]]))
        zero = np.zeros(int(two.sum()), np.int64)
        counts = pa.array(np.concatenate([n, total, zero]), mask=np.append(~unsure, np.zeros(len(of) + len(zero), bool)))
        return pa.RecordBatch.from_arrays([pa.array(sides), docs, counts], ["side", "doc_id", "n"])


def shared_sides(docs: DataFrame, kind: Kind, shared: Shared) -> DataFrame:
    """doc_id and side of the sides that are shared, both of every segment; one shuffle by side.

    A side that very many rows have is told to be shared where it is made, so that few rows of it meet in a task.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = Sides(), 0
        for batch in _small(batches):
            doc, valid = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for which, s in _parts(batch.column(1).to_pylist(), kind):
                side, at = np.stack([s.left, s.right], 1).reshape(-1), np.repeat(np.array(which, np.int64)[s.text], 2)
                side, at = side[side != 0], at[side != 0]
                held.add(side, rows + at, doc[at], valid[at])
            rows += batch.num_rows
            if held.held >= HELD_SIDES:
                yield held.told(shared)
                held = Sides()
        if held.held:
            yield held.told(shared)

    rows = _rows(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    every = rows.mapInArrow(found, "side long, doc_id long, n long")
    # Rows of which it is known are dealt evenly.
    dealt = F.when(F.col("n").isNull(), F.xxhash64("side", "doc_id")).otherwise(F.col("side"))
    same = Window.partitionBy("dealt")
    met = every.withColumn("dealt", dealt).select(
        "side", "doc_id", "n", F.min("doc_id").over(same).alias("low"), F.max("doc_id").over(same).alias("high"), F.sum("n").over(same).alias("places")
    )
    is_shared = F.col("n").isNull() | shared(F.col("low"), F.col("high"), F.col("places"))
    return met.where(is_shared).select("doc_id", "side")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, a digest ``tid`` of the text, and the compressed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in _small(batches):
            texts = batch.column(1).to_pylist()
            tids = [hashlib.blake2b(t, digest_size=8).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tids, pa.binary()), pa.array([squeeze(t) for t in texts], pa.binary())],
                ["doc_id", "tid", "text"],
            )

    return _rows(docs).mapInArrow(run, f"doc_id {_id_type(docs)}, tid binary, text binary")


def cut(docs: DataFrame, shared: DataFrame, kind: Kind) -> DataFrame:
    """The segments of which a side is shared; ``shared``: doc_id and side."""
    per_doc = shared.groupBy("doc_id").agg(F.collect_set("side").alias("sides"))
    rows = joined_null_safe(packed(docs), per_doc, ["doc_id"], "inner")
    names = ["tid", "key", "sid", "start", "windows", "anchor", "content"]
    types = [pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in _small(batches):
            tids = batch.column(1).to_pylist()
            texts = [expand(t) for t in batch.column(2).to_pylist()]
            wanted = batch.column(3)
            out: list[tuple] = []
            owners: list[int] = []

            def flushed():
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)), *columns], ["doc_id", *names])

            for which, s in _parts(texts, kind):
                bounds = np.searchsorted(s.text, np.arange(len(which) + 1))
                for j, i in enumerate(which):
                    a, b = bounds[j], bounds[j + 1]
                    known = wanted[i].values.to_numpy()
                    keep = np.flatnonzero(np.isin(s.left[a:b], known) | np.isin(s.right[a:b], known)) + a
                    take = kind.cutter(texts[i]) if len(keep) else None
                    columns = (x[keep].tolist() for x in (s.key, s.start, s.windows, s.anchor))
                    for key, start, n, anchor in zip(*columns, strict=True):
                        content = take(start, start + n + kind.k - 1)
                        sid = hashlib.blake2b(content, digest_size=16).digest()
                        out.append((tids[i], key, sid, start, n, anchor, content))
                        owners.append(i)
                if len(out) > 20_000:
                    yield flushed()
                    out, owners = [], []
            if out:
                yield flushed()

    schema = f"doc_id {_id_type(docs)}, tid binary, key long, sid binary, start int, windows int, anchor int, content binary"
    return rows.select("doc_id", "tid", "text", "sides").mapInArrow(made, schema)


#: Of a segment: its content, windows, units before the anchor, least id and number of places. Judged to triples:
#: windows from, to, and a value.
Segment = tuple[bytes, int, int, int | None, int]
Index = Callable[[list[list[Segment]]], list[list[list[int]]]]


def judged(distinct: DataFrame, kind: Kind, index: Index, plain: Callable[[list[Segment]], list | None], shard_bytes: int) -> DataFrame:
    """sid and the judged runs of every segment of keys that are not hot.

    ``plain(segments of a key)`` answers where no index is needed, or returns None;
    the other keys are indexed together, up to ``shard_bytes`` at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answered(sids, runs):
            return pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(runs, pa.list_(pa.int64()))], ["sid", "runs"])

        def groups():
            last, members = None, []
            for batch in _small(batches):
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if row[0] != last and members:
                        yield members
                        members = []
                    last = row[0]
                    members.append(row[1:])
            if members:
                yield members

        waiting, held = [], 0
        sids, runs = [], []
        for members in groups():
            found = plain([m[1:] for m in members])
            if found is not None:
                sids += [m[0] for m in members]
                runs += found
            else:
                waiting.append(members)
                held += sum(len(m[1]) for m in members)
            if held >= shard_bytes:
                for group, answers in zip(waiting, index([[m[1:] for m in g] for g in waiting]), strict=True):
                    sids += [m[0] for m in group]
                    runs += answers
                waiting, held = [], 0
            if len(sids) > 20_000:
                yield answered(sids, runs)
                sids, runs = [], []
        if waiting:
            for group, answers in zip(waiting, index([[m[1:] for m in g] for g in waiting]), strict=True):
                sids += [m[0] for m in group]
                runs += answers
        if sids:
            yield answered(sids, runs)

    rows = distinct.select("key", "sid", "content", "windows", "anchor", "least", "places")
    return rows.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(run, "sid binary, runs array<long>")


def judged_by_digest(distinct: DataFrame, kind: Kind, value: Column, repeats: Column) -> DataFrame:
    """The same for hot keys: windows of equal content are aggregated by a 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            for sid, content, n, least, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digests = [hashlib.blake2b(w, digest_size=16).digest() for w in kind.window_bytes(content, n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array([sid] * n, pa.binary()), pa.array(range(n), pa.int64()), pa.array([least] * n, pa.int64()), pa.array([places] * n, pa.int64())],
                    ["digest", "sid", "at", "least", "places"],
                )

    rows = distinct.select("sid", "content", "windows", "least", "places")
    each = rows.mapInArrow(run, "digest binary, sid binary, at long, least long, places long")
    each = _stored(each, "hot-windows")
    same = each.groupBy("digest").agg(F.min("least").alias("least"), F.sum("places").alias("places"))
    back = each.select("digest", "sid", "at").join(same.where(repeats).select("digest", value.alias("value")), "digest")
    triples = F.array_sort(F.collect_list(F.struct("at", "value")))
    back = back.groupBy("sid").agg(triples.alias("t"))
    return back.select("sid", F.flatten(F.transform("t", lambda x: F.array(x["at"], x["at"] + 1, x["value"]))).alias("runs"))


def without_repeats(
    docs: DataFrame,
    kind: Kind,
    index: Index,
    plain: Callable[[list[Segment]], list | None],
    shared: Shared,
    hot_value: Column,
    hot_repeats: Column,
    removes: Callable[[int, object], bool],
    shard_bytes: int,
    hot_segments: int = HOT_SEGMENTS,
) -> DataFrame:
    """doc_id, n, n_removed, n_spans and kept_sha256 of every document.

    ``shared`` says of which sides windows can repeat. ``removes(value, doc_id)``: whether a judged run with that value
    is removed from a document.
    """
    segs = _stored(cut(docs, shared_sides(docs, kind, shared), kind), "repeat-places")
    distinct = segs.groupBy("key", "sid", "content", "windows", "anchor").agg(
        F.min("doc_id").cast("long").alias("least"), F.count("*").alias("places")
    )
    distinct = _stored(distinct, "repeat-segments")
    hot = distinct.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_segments).select("key")
    hot = _stored(hot, "repeat-hot")
    usual = judged(distinct.join(hot, "key", "left_anti"), kind, index, plain, shard_bytes)
    large = judged_by_digest(distinct.join(hot, "key", "left_semi"), kind, hot_value, hot_repeats)
    verdicts = _stored(usual.unionAll(large).where(F.size("runs") > 0), "repeat-verdicts")
    places = segs.select("doc_id", "tid", "sid", "start").join(verdicts, "sid")
    per_doc = places.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "runs")).alias("found"))
    rows = joined_null_safe(packed(docs), per_doc, ["doc_id", "tid"], "left").select("doc_id", "text", "found")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in _small(batches):
            rows = []
            for doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = [
                    (f["start"] + a, f["start"] + b - 1 + kind.k)
                    for f in found or ()
                    for a, b, value in zip(f["runs"][::3], f["runs"][1::3], f["runs"][2::3], strict=True)
                    if removes(value, doc_id)
                ]
                rows.append(kind.finish(expand(text), np.array(spans, np.int64).reshape(-1, 2) if spans else None))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                ["doc_id", "n", "n_removed", "n_spans", "kept_sha256"],
            )

    schema = f"doc_id {_id_type(docs)}, n long, n_removed long, n_spans long, kept_sha256 string"
    return rows.mapInArrow(finished, schema)


def covered(spans: np.ndarray | None, n: int) -> np.ndarray:
    """Which of ``n`` units lie in a span."""
    if spans is None:
        return np.zeros(n, bool)
    change = np.bincount(spans[:, 0], minlength=n + 1) - np.bincount(spans[:, 1], minlength=n + 1)
    return np.cumsum(change)[:n] > 0
