"""Pipeline stages with clashing column names, nulls, repeats and empty tables; time of long texts."""

import time

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline as pipeline
from seqloom.llm import bpe

RNG = np.random.default_rng(8)
CLASHES = "kept n_bytes n_removed n_spans quality_score Key code spans body label _id _code size taken target passes copies copy node keys row chunk ids".split()


def words(n):
    return " ".join(RNG.choice(["river", "stone", "the", "a", "walks", "under", "bright", "sky", "and", "of"], n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stages")
    labels = [(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name,stage", pipeline.STAGES[:4])
def test_stages_leave_columns_of_any_name_alone(spark, folder, name, stage):
    passage = words(60)
    texts = [None, "", words(80), passage + " " + words(30), words(25) + " " + passage, words(120)]
    rows = [(i, t, "en", "s", -1, *(f"{c}{i}" for c in CLASHES)) for i, t in enumerate(texts)]
    rows += [rows[2], (None, words(40), None, None, None, *([None] * len(CLASHES)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES))
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = out.collect()
    assert got and all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in got for c in CLASHES)
    assert stage(spark, docs.where("false"), folder).count() == 0


def test_nothing_goes_without_usable_labels(spark, tmp_path):
    spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "")], "doc_id long, text string")
    assert pipeline.quality_filter(spark, docs, str(tmp_path)).count() == 3


def test_prefixes_are_compared_when_hashes_agree(monkeypatch):
    """With hashes that are all alike, only places whose bytes are alike reach the least length."""
    from seqloom.llm import suffix

    text = np.frombuffer((b"abcdefgh" * 3 + b"xyzw" + b"abcdefgh" * 3 + b"0123456789" * 4), np.uint8).astype(np.int64) + 1
    s = np.r_[text, 0]
    sa = suffix.suffix_array(s, 257)
    want = suffix.permuted_lcp(s, sa, 16) >= 16
    assert 0 < want.sum() < len(s)
    monkeypatch.setattr(suffix, "MIXERS", (0, 0, 0))
    got = suffix.permuted_lcp(s, sa, 16) >= 16
    assert got.tolist() == want.tolist()
    s = np.r_[RNG.integers(1, 3, 600), RNG.integers(1, 3, 50).repeat(2), np.tile(RNG.integers(1, 3, 40), 6), 0]
    at = np.unique(RNG.integers(0, len(s) - 9, 500))
    for other in (np.minimum(at + 40, len(s) - 9), np.maximum(at - 1, 0), RNG.integers(0, len(s) - 9, len(at))):
        assert suffix._alike(s, at, other, 8).tolist() == [s[a : a + 8].tolist() == s[b : b + 8].tolist() for a, b in zip(at, other)]


def test_splitting_a_long_text_is_linear(spark):
    """Twice as many characters take about twice as long: each chunk is cut where it is, not counted from the start."""
    import pyarrow as pa

    took = []
    for n in (8_000_000, 16_000_000):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array(["word é " * (n // 7)])], ["row", "doc_id", "text"])
        began = time.perf_counter()
        parts = list(bpe._chunks(bpe.CHUNK, bpe.OVERLAP)([batch]))
        took.append(time.perf_counter() - began)
        assert sum(p.num_rows for p in parts) == -(-7 * (n // 7) // bpe.CHUNK)
    assert took[1] < 4 * took[0] + 0.2
    text = words(300_000)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    whole = bpe.vocabulary(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).encode([text])[0]
    assert [bytes(r.ids) for r in bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()] == [whole]
