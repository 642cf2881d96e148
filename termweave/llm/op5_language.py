"""Language ID in two levels: the family, then one-versus-one linear SVMs within it.

A text becomes the square roots of the shares of its hashed character 2- and
3-grams, scaled to length one. At each level every pair of classes has a linear
support vector machine; the class with most won pairs is taken, ties by the sum of
margins, then by name. Level one has the families of the learned languages, level
two the languages of the chosen family. The score is the product, over both
levels, of the winner's least pairwise probability: a logistic curve of the margin.

The model is fitted on at most ``max_docs`` texts, of each language the first by a
hash of their ids, up to ``max_chars`` characters long. Every text is then read
whole on the executors.

``und`` with score 0: a null text, a text without a letter, and every text if no
language was learned. With one learned language all other texts get it, with score
1. Null languages are not learned from. Repeated rows get equal results. Other
columns of the input are ignored.

An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import crc_of_id
from termweave.llm.subwords import code_points, grams, slices

BITS = 12
SLICE_DOCS = 256
SLICE_CHARS = 1 << 20
UNKNOWN = "und"

#: Families of languages by their two-letter codes. Others stand alone.
FAMILIES = {
    "germanic": "af da de en is lb nl no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "celtic": "br cy ga gd",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "turkic": "az kk ky tr uz",
    "semitic": "am ar he mt",
    "austronesian": "id jv ms tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(language: str) -> str:
    return FAMILY_OF.get(language.lower().split("-")[0].split("_")[0], language)


def features(texts: list[str]) -> np.ndarray:
    """A row of length one per text, or of zeros if it has no letter."""
    points, starts = code_points(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    doc = np.concatenate([doc, np.full(len(points) - len(doc), max(0, len(texts) - 1))])
    total = np.zeros(len(texts) << BITS)
    for at, h in grams(points, 2, 3):
        # An n-gram that begins with the space before a text belongs to that text.
        own = doc[at + (points[at] == 32)]
        keys = (own << BITS) + (h >> np.uint32(32 - BITS))
        total += np.bincount(keys, minlength=len(total))
    x = np.sqrt(total.reshape(len(texts), 1 << BITS)).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _svm(x: np.ndarray, y: np.ndarray, steps: int = 200, strength: float = 20.0) -> np.ndarray:
    """Weights, the last of them the bias, of a linear SVM with squared hinge loss; y is 1 or -1.

    Classes weigh alike. Accelerated gradient steps on all rows.
    """
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()).astype(np.float32)
    rate = 1 / (1 + 4 * strength)
    w = np.zeros(x.shape[1], np.float32)
    ahead = w
    for i in range(steps):
        gap = np.maximum(0, 1 - y * (x @ ahead))
        step = ahead - rate * (ahead - 2 * strength * (x.T @ (share * y * gap)))
        ahead, w = step + i / (i + 3) * (step - w), step
    return w


@dataclass(frozen=True)
class OneVersusOne:
    """``weights`` has a column per pair of ``classes``, positive for the first of the pair."""

    classes: tuple[str, ...]
    pairs: tuple[tuple[int, int], ...]
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, names: np.ndarray) -> OneVersusOne:
        classes = tuple(sorted(set(names)))
        pairs = tuple((a, b) for a in range(len(classes)) for b in range(a + 1, len(classes)))
        columns = []
        for a, b in pairs:
            use = (names == classes[a]) | (names == classes[b])
            columns.append(_svm(x[use], np.where(names[use] == classes[a], 1, -1).astype(np.float32)))
        return OneVersusOne(classes, pairs, np.stack(columns, 1) if pairs else np.zeros((x.shape[1] + 1, 0), np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winning class of each row and its least pairwise probability."""
        if not self.pairs:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margins = x @ self.weights[:-1] + self.weights[-1]
        votes = np.zeros((len(x), len(self.classes)))
        least = np.full((len(x), len(self.classes)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k]
            votes[:, a] += (m >= 0) + 1e-6 * np.tanh(m)
            votes[:, b] += (m < 0) - 1e-6 * np.tanh(m)
            least[:, a] = np.minimum(least[:, a], m)
            least[:, b] = np.minimum(least[:, b], -m)
        best = votes.argmax(1)
        return best, 1 / (1 + np.exp(-np.clip(4 * least[np.arange(len(x)), best], -40, 40)))


@dataclass(frozen=True)
class Model:
    family: OneVersusOne | None
    within: dict[str, OneVersusOne] = field(default_factory=dict)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for a, b in slices([len(t) for t in texts], SLICE_CHARS):
            for c in range(a, b, SLICE_DOCS):
                n, s = self._predict(texts[c : min(b, c + SLICE_DOCS)])
                names += n
                scores.append(s)
        return names, np.concatenate(scores) if scores else np.zeros(0)

    def _predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if self.family is None:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        x = features(texts)
        families, score = self.family.predict(x)
        names = np.empty(len(texts), object)
        for k, family in enumerate(self.family.classes):
            rows = np.flatnonzero(families == k)
            if len(rows):
                level = self.within[family]
                best, s = level.predict(x[rows])
                names[rows] = [level.classes[i] for i in best]
                score[rows] *= s
        return list(names), score


def fit(texts: list[str], languages: list[str]) -> Model:
    if not texts:
        return Model(None)
    x = np.concatenate([features(texts[a : a + SLICE_DOCS]) for a in range(0, len(texts), SLICE_DOCS)])
    names = np.array(languages, object)
    families = np.array([family_of(n) for n in languages], object)
    within = {f: OneVersusOne.fit(x[families == f], names[families == f]) for f in set(families)}
    return Model(OneVersusOne.fit(x, families), within)


def train(docs: DataFrame, max_docs: int = 4000, max_chars: int = 20_000) -> Model:
    """Fit on a bounded sample of the documents that are not held out, languages as evenly as their sizes allow."""
    usable = docs.where(
        F.col("lang").isNotNull()
        & (F.col("lang") != UNKNOWN)
        & (crc_of_id(docs["doc_id"]) % 3 != 1)
        & F.col("text").rlike(r"\p{L}")
        & (F.length("text") <= max_chars)
    ).select("doc_id", "lang", "text")
    counts = dict(usable.groupBy("lang").count().collect())
    if not counts:
        return Model(None)
    each = max(1, max_docs // len(counts))
    # A hash of the id thins each language to about its share; the limit makes the bound exact.
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))).otherwise(rate)
    place = F.xxhash64(F.lit("language"), F.col("doc_id"))
    drawn = usable.where(F.pmod(place, F.lit(1 << 20)) < rate * (1 << 20))
    rows = sorted(drawn.orderBy(place, "doc_id").limit(max_docs).collect(), key=lambda r: (r["lang"], r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def _predict(model: Model, texts: pa.Array, letters: pa.Array) -> tuple[list[str], np.ndarray]:
    """Languages and scores of a batch, a slice of whose texts at a time stands in memory as Python objects."""
    plain = texts.cast(pa.binary())  # decoded here, as a text may hold bytes that are no UTF-8
    names, scores = [], []
    for at in range(0, len(plain), SLICE_DOCS):
        n, s = model.predict([(t or b"").decode("utf-8", "replace") for t in plain.slice(at, SLICE_DOCS).to_pylist()])
        names += n
        scores.append(s)
    known = np.asarray(letters.to_numpy(zero_copy_only=False), bool)
    found = np.concatenate(scores) if scores else np.zeros(0)
    return [n if ok else UNKNOWN for n, ok in zip(names, known, strict=True)], np.where(known, found, 0.0)


def _has_letter(docs: DataFrame):
    return F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _predict(shared.value, batch.column(2), batch.column(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        "doc_id",
        (crc_of_id(docs["doc_id"]) % 3 == 1).alias("held_out"),
        docs["text"].cast("binary").alias("text"),
        _has_letter(docs).alias("letters"),
    )
    return rows.mapInArrow(identified, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.25) -> DataFrame:
    """The documents that are in a learned language, with the columns of ``docs``.

    Rejected are ``und`` and texts whose score is below ``least``, the score of two
    even choices: a text in two languages stays. As a winner has at least that much, only ``und``
    is rejected unless ``least`` is raised. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            names, scores = _predict(shared.value, columns[text], batch.column(1))
            keep = pa.array([name != UNKNOWN and s >= least for name, s in zip(names, scores, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, docs_names).filter(keep)

    docs_names, schema = docs.columns, docs.schema
    # A row travels as one value, so that its columns may have any names, and its text once.
    return docs.select(F.struct(*docs_names).alias("doc"), _has_letter(docs).alias("letters")).mapInArrow(chosen, schema)


def language(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))
