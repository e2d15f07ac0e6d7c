"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def integer_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v array<long>): every component x as floor(scale * x). Null vectors and vectors holding null or
    non-finite components are left out, rows that repeat both id and vector count once. Sums and products are 64-bit:
    beyond components of about 2^22 (in millions of dimensions; fewer dimensions allow larger ones) scores wrap."""
    x = F.col("embedding")
    whole = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x)
        .where(F.coalesce(whole, F.lit(False)) & F.col("vec_id").isNotNull())
        .select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))
        .dropDuplicates(["vec_id", "v"])
    )


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    lengths = vectors.map(len).to_numpy()
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = np.concatenate([*vectors, np.zeros(0, np.int64)])
    return out


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of sparse query rows against sparse rows: for each term, the weighted postings are scattered into the
    dense score array of the queries that hold the term."""
    scores = np.zeros((len(queries), len(rows)), np.int64)
    for term in range(rows.shape[1]):
        asking, posting = np.flatnonzero(queries[:, term]), np.flatnonzero(rows[:, term])
        if not len(asking) or not len(posting):
            continue
        weights, postings = queries[asking, term], rows[posting, term]
        dense = len(posting) == len(rows)
        for q, w in zip(asking, weights):
            if dense:
                scores[q] += w * postings
            else:
                scores[q, posting] += w * postings
    return scores


def _best(k: int):
    def best(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(rows):
            rows = rows.sort_values("vec_id", kind="stable")
            width = int(max(queries.v.map(len).max(), rows.v.map(len).max()))
            q_ids, ids, r = queries.vec_id.to_numpy(), rows.vec_id.to_numpy(), _matrix(rows.v, width)
            q = _matrix(queries.v, width)
            for lo in range(0, len(q), 64):
                scores = accumulate(q[lo : lo + 64], r)
                for row, own in zip(scores, q_ids[lo : lo + 64]):
                    others = np.flatnonzero(ids != own)
                    s = row[others]
                    if len(s) > k:
                        # partition selection; all ties of the k-th score stay, the smallest ids of them win
                        kth = np.partition(s, len(s) - k)[len(s) - k]
                        keep = np.flatnonzero(s >= kth)
                        keep = keep[np.argsort(-s[keep], kind="stable")[:k]]
                    else:
                        keep = np.arange(len(s))
                    out["query_id"].append(np.full(len(keep), own))
                    out["vec_id"].append(ids[others[keep]])
                    out["score"].append(s[keep])
        return pd.DataFrame({c: np.concatenate([*x, np.zeros(0, np.int64)]) for c, x in out.items()})

    return best


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, query_block: int = 2048, row_block: int = 4096) -> DataFrame:
    """The k rows of highest inner product for each query row, ties to the smaller vec_id; a query's own id is no
    candidate. Both inputs have (vec_id, v array<long>); missing dimensions count as zero.

    Rows are hashed into blocks of about row_block and queries into blocks of about query_block. Every pair of blocks
    is one bounded group, scored exhaustively in one task; k survivors per query and block are merged afterwards. A
    query id that stands on several different vectors is answered over all of them (best score per candidate).
    Returns query_id, rank, vec_id, score; a query without candidates and empty inputs give no rows.
    """
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n_rows // row_block)), max(1, -(-n_queries // query_block))
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", block(query_blocks, 1)).withColumn("rb", every(row_blocks))
    right = rows.withColumn("rb", block(row_blocks, 2)).withColumn("qb", every(query_blocks))
    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(_best(k), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)  # k a query stay before the exchange
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir):
    from .common import read

    rows = cut(integer_vectors(read(spark, sf_dir, "embeddings")))
    return top_k(rows.where("vec_id % 50 = 0"), rows, 5)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT vec_id, unnest(v) AS w, generate_subscripts(v, 1) AS i FROM v),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(sum(q.w * r.w) AS BIGINT) AS score
  FROM t q JOIN t r ON q.i = r.i AND q.vec_id <> r.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
