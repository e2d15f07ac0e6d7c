"""The pipeline's near-duplicates come from the SimHash operator, whatever else proposes pairs."""

import pyarrow as pa

from seqloom.llm import simhash


def test_fingerprints_propose_pairs(spark, monkeypatch):
    real = simhash._least_keys

    def no_shared_keys(shingle, seed):
        keys = real(shingle, seed)

        def run(batches):
            for b in keys(batches):
                own = [[n] if k else [] for n, k in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
                yield b.set_column(3, "keys", pa.array(own, pa.list_(pa.int64())))

        return run

    monkeypatch.setattr(simhash, "_least_keys", no_shared_keys)
    words = [f"w{i * i % 1009}x{i}" for i in range(2_000)]
    near = " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(words)), (2, near), (3, "quite another text of some words"), (4, ""), (5, None), (None, near), (1, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = {(r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()}
    assert len(kept) == 4 and {k for k, _ in kept} == {1, 3, 4, None} and (None, near) in kept
