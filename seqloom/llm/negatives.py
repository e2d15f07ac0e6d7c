"""Hard negatives by the threshold algorithm: sorted lists per dimension, read from the end that an anchor's sign names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Anchors and rows of a pair of blocks, and how far the sorted lists are read before the first look at the threshold;
#: every further look comes at four times the depth.
ANCHOR_BLOCK, ROW_BLOCK, FIRST_DEPTH = 2048, 4096, 16
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def labelled_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, v array<long>): every component x as floor(scale * x). Rows with a null id, label or vector, or
    with a null or non-finite component are left out. Repeated rows count once; of an id that stands on different rows
    the least (label, v) is taken. Scores are 64-bit integers and wrap beyond that."""
    x = F.col("embedding")
    whole = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.coalesce(whole, F.lit(False)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), v.alias("v")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


class Lists:
    """The rows of a block and, for every dimension, their places in the order of its values."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.order = rows, np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, self.order, axis=0)

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[np.ndarray]:
        """For each window (least and most score, both included) the places of its k best allowed rows or more: ties of
        the k-th score are all among them. Scores of all rows seen stand in self.scores.

        Sorted access reads every list of a dimension where the anchor isn't 0 from its best end, random access scores
        each row that turns up. No row unseen scores above the sum of the last products read. So reading stops once that
        is strictly below the k-th score of each window, or below the window's least score where fewer than k are in it.
        """
        n, up, down = len(self.rows), np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        self.scores, scored, lo, depth = np.zeros(n, np.int64), np.zeros(n, bool), 0, FIRST_DEPTH
        while True:
            hi = min(depth, n) if len(up) + len(down) else n
            seen = np.zeros(n, bool)
            if len(up) + len(down):
                seen[self.order[n - hi : n - lo, up]] = True
                seen[self.order[lo:hi, down]] = True
            else:
                seen[:] = True
            new = np.flatnonzero(seen & ~scored)
            self.scores[new] = self.rows[new] @ anchor
            scored[new] = True
            found = [np.flatnonzero(scored & allowed & (self.scores >= least) & (self.scores <= most)) for least, most in windows]
            kth = [int(np.partition(self.scores[f], len(f) - k)[len(f) - k]) if len(f) >= k else least for f, (least, _) in zip(found, windows)]
            if hi == n:
                break
            unseen = int(self.values[n - hi, up] @ anchor[up]) + int(self.values[hi - 1, down] @ anchor[down])
            if unseen < min(kth):
                break
            lo, depth = hi, 4 * depth
        return [f[self.scores[f] >= at] for f, at in zip(found, kth)]


def _best(k: int, same_label: bool):
    """Per anchor and window the k best rows of a block. `windows` of an anchor: ids and scores of its positives, or null
    for one window that holds every score."""
    names = ["anchor_id", "positive_id", "positive_score", "vec_id", "score"]

    def run(key, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {c: [np.zeros(0, np.int64)] for c in names}
        if len(anchors) and len(rows):
            rows = rows.sort_values("vec_id", kind="stable")
            width = int(max(anchors.v.map(len).max(), rows.v.map(len).max()))
            lists, ids, labels = Lists(_matrix(rows.v, width)), rows.vec_id.to_numpy(), rows.label.to_numpy()
            for own, label, v, windows in zip(anchors.vec_id, anchors.label, _matrix(anchors.v, width), anchors.windows):
                allowed = (labels == label) & (ids != own) if same_label else labels != label
                positives = [(0, 0)] if same_label else [(w["positive_id"], w["positive_score"]) for w in windows]
                limits = [(LEAST, MOST)] if same_label else [(-(-80 * s // 100), s) for _, s in positives]
                for (positive, score), found in zip(positives, lists.search(v, allowed, limits, k)):
                    # ids ascend, so a stable sort leaves ties to the smaller one
                    found = found[np.argsort(-lists.scores[found], kind="stable")[:k]]
                    for c, x in zip(names, (own, positive, score)):
                        out[c].append(np.full(len(found), x, np.int64))
                    out["vec_id"].append(ids[found])
                    out["score"].append(lists.scores[found])
        return pd.DataFrame({c: np.concatenate(x) for c, x in out.items()})

    return run


def _searched(anchors: DataFrame, rows: DataFrame, keys: list[str], k: int, same_label: bool) -> DataFrame:
    """Every pair of an anchor block and a row block with equal keys is one bounded group, searched in one task."""
    found = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"
    anchors = anchors.select([F.col(c).alias(c) for c in anchors.columns])  # both sides come from one table
    return anchors.groupBy(keys).cogroup(rows.groupBy(keys)).applyInPandas(_best(k, same_label), found)


def _block(blocks, seed: int):
    return F.pmod(F.xxhash64("vec_id", F.lit(seed)), blocks).cast("int")


def _every(blocks):
    return F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))


def positives(anchors: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the k rows of an anchor's label with the highest inner products, ties to
    the smaller id; an anchor's own id is none of them. A label has as many blocks as its number of rows asks for."""
    blocks = lambda df, size: F.ceil(F.count("*") / size).alias(df)
    sizes = rows.groupBy("label").agg(blocks("rows", ROW_BLOCK)).join(anchors.groupBy("label").agg(blocks("anchors", ANCHOR_BLOCK)), "label")
    left = anchors.join(sizes, "label").withColumn("qb", _block(F.col("anchors"), 1)).withColumn("rb", _every(F.col("rows")))
    right = rows.join(sizes, "label").withColumn("rb", _block(F.col("rows"), 2)).withColumn("qb", _every(F.col("anchors")))
    left, right = (x.drop("rows", "anchors") for x in (left.withColumn("windows", F.lit(None).cast("string")), right))
    found = _searched(left, right, ["label", "qb", "rb"], k, True)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))


def hard_negatives(anchors: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """For each anchor and each of its k positives, the k best rows of other labels that score between 80 % and 100 % of
    the positive, both included, in integers; ties to the smaller id. Both inputs have (vec_id, label, v array<long>),
    ids stand once, missing dimensions count as zero.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors without a positive,
    positives without such a negative (all those with a score below 0) and empty inputs give no rows. Rows are hashed into blocks
    of about ROW_BLOCK and anchors into blocks of about ANCHOR_BLOCK; every pair of blocks is one bounded task, whose
    survivors (k per window) are merged. Nothing is collected but two counts.
    """
    found = cut(positives(anchors, rows, k))
    windows = found.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("windows"))
    asking = anchors.join(windows, anchors.vec_id == windows.anchor_id).drop("anchor_id")
    row_blocks, anchor_blocks = (F.lit(max(1, -(-df.count() // size))) for df, size in ((rows, ROW_BLOCK), (windows, ANCHOR_BLOCK)))
    left = asking.withColumn("qb", _block(anchor_blocks, 1)).withColumn("rb", _every(row_blocks))
    right = rows.withColumn("rb", _block(row_blocks, 2)).withColumn("qb", _every(anchor_blocks))
    negatives = _searched(left, right, ["qb", "rb"], k, False)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    ranked = negatives.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir):
    from .common import read

    vectors = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = cut(labelled_vectors(vectors.withColumn("label", moved)))
    return hard_negatives(rows.where("vec_id % 100 = 0"), rows)


ORACLE = """
WITH r AS (
  SELECT vec_id, min({'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END,
    'v': list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))}) AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY 1),
t AS (SELECT vec_id, r.label AS label, unnest(r.v) AS w, generate_subscripts(r.v, 1) AS i FROM r),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(sum(a.w * b.w) AS BIGINT) AS score
  FROM t a JOIN t b ON a.i = b.i AND a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0 GROUP BY 1, 2, 3),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM n WHERE rank <= 5
"""
