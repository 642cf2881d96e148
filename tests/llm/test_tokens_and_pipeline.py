"""Token files, the registered text queries and the pipeline."""

from __future__ import annotations

import io
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import public_tokenizers  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from termweave.llm import common, op10_tokens, queries  # noqa: E402
from tools import compare  # noqa: E402

SF_DIR = Path("/root/testdata/sf0.001")
PATH = public_tokenizers.path("byte_bpe_50k.json")
needs_data = pytest.mark.skipif(not SF_DIR.exists(), reason="no test data")


@pytest.mark.parametrize("n", [1, 2, 100, 4095, 4096])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    usual = rng.integers(0, 3000, n)
    kinds = {
        "usual": usual,
        "outliers": np.where(rng.random(n) < 0.03, rng.integers(0, 2**32, n), usual),
        "equal": np.full(n, 17),
        "wide": rng.integers(0, 2**32, n),
    }
    for name, ids in kinds.items():
        ids = ids.astype(np.uint32)
        packed = op10_tokens.pack_block(ids)
        assert op10_tokens.unpack_block(packed).tolist() == ids.tolist(), name
        if name == "outliers" and n > 4000:
            assert len(packed) < 4 * n * 0.6  # the outliers do not widen the block


class Memory(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_files_round_trip():
    rng = np.random.default_rng(0)
    docs = [(d, rng.integers(0, 50_000, n).astype(np.uint32)) for d, n in zip([None, -5, 0, 3, 3, 9], [1, 5000, 4096, 1, 9000, 2])]
    file = Memory()
    writer = op10_tokens.Writer(file)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    reader = op10_tokens.Reader(file)
    found = [(d, place, np.concatenate(list(pieces)).tolist()) for d, place, pieces in reader.documents()]
    starts = np.cumsum([0, *(len(i) for _, i in docs)]).tolist()
    assert found == [(d, s, ids.tolist()) for (d, ids), s in zip(docs, starts, strict=False)]
    assert len(reader.block(1)) == op10_tokens.BLOCK


def test_encoder_equals_the_library():
    picks = random.Random(1)
    texts = ["", " ", "a", " a", "a ", "a  b", "\n", "a \nb", "x<|endoftext|> y", "don't we'll", "é 漢字 ñ", "a　b c d"]
    texts += ["".join(picks.choice(" \n\tab1'é.,X") for _ in range(picks.randrange(50))) for _ in range(500)]
    encoder = op10_tokens.Encoder(PATH)
    expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == expected
    assert [x.tolist() for x in encoder.encode(texts)] == expected  # pieces are known by now


def test_encoder_equals_the_library_beside_any_white_space():
    picks = random.Random(2)
    texts = ["a \u00a0\u00a0 b", "a \u00a0 b", "x\u00a0 \u00a0y", "c \u3000\u3000d", "n\n \n m", "b\u00a0\u00a0", "\u00a0\u00a0b c"]
    spaces = " \u00a0\u2003\u2028\u3000\u0085\x1c\n\t\u200b"
    texts += ["".join(picks.choice(spaces + "  \u00a0\u00a0ab1'.é") for _ in range(picks.randrange(40))) for _ in range(2000)]
    # Every character of the first plane beside a space.
    texts += [f"a {chr(c) * 2}b {chr(c)} c{chr(c)} d" for c in range(1 << 16) if not 0xD800 <= c < 0xE000]
    encoder = op10_tokens.Encoder(PATH)
    expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == expected


def test_encoder_forgets_rare_pieces(monkeypatch):
    monkeypatch.setattr(op10_tokens, "CACHED_PIECES", 60)
    picks = random.Random(3)
    words = ["".join(picks.choice("abcdefé1.") for _ in range(picks.randrange(1, 9))) for _ in range(2000)]
    encoder, held = op10_tokens.Encoder(PATH), []
    for _ in range(40):
        texts = [" ".join(["of", "the", *picks.choices(words, k=picks.randrange(1, 12)), "of"]) for _ in range(5)]
        expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.encode(texts)] == expected
        assert len(encoder.known) == len(encoder.first) - 1 == len(encoder.uses)
        held.append(len(encoder.known))
    assert any(b < a for a, b in zip(held, held[1:], strict=False))
    assert "of" in encoder.known


def test_token_files_of_odd_rows(spark):
    common.send_code(spark)
    rows = [(5, "five words are in here"), (1, None), (3, ""), (2, "long " * 20_000), (None, "no id"), (5, "a second five")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS file")
    found = sorted(op10_tokens.token_files(spark, df, PATH).collect(), key=lambda r: r["start"])
    encoder, start = op10_tokens.Encoder(PATH), 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for row, (doc, text) in zip(found, ordered, strict=True):
        ids = np.append(encoder.encode([text or ""])[0], 2).astype("<u4")
        assert tuple(row) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert op10_tokens.token_files(spark, df.where("false"), PATH).collect() == []


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    db = compare.database(str(SF_DIR))
    result, _ = compare.compare(spark, db, str(SF_DIR), name, queries.QUERIES[name], queries.SQL[name])
    assert result.startswith("ok"), result


@needs_data
def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@needs_data
def test_pipeline_stages_by_hand(spark):
    """The last stage's rows follow from the rows that the operators keep one by one."""
    rows = corpus_pipeline.run(spark, str(SF_DIR)).collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(SF_DIR))
        assert kept.columns == docs.columns
    texts = sorted(kept.select("doc_id", "text").collect())
    encoder, start, expected = op10_tokens.Encoder(PATH), 0, []
    for doc, text in texts:
        ids = np.append(encoder.encode([text])[0], 2).astype("<u4")
        expected.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in rows) == sorted(expected)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name, ddl in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
