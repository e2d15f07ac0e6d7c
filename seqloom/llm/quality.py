"""Quality classifier: a generalised additive model with pairwise interactions, scored by bin additions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_crc

FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper_share", "digit_share", "punct_share", "symbol_share",
    "space_share", "high_byte_share", "distinct_words", "lines_per_word", "repeated_lines", "shouted_words", "marked_words", "bang_share",
)
_CLASS = np.full(256, 6)  # 0 lower, 1 upper, 2 digit, 3 sentence marks, 4 other ASCII marks, 5 white space, 6 the rest
for _k, _c in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"-()?", b"!#$%&*+/<=>@[\\]^_`{|}~", b" \t\n\v\f\r")):
    _CLASS[list(_c)] = _k


def features(text: bytes | None) -> list[float]:
    """Numbers about one whole text; null counts as empty."""
    text = text or b""
    words, n = text.split(), max(1, len(text))
    w = max(1, len(words))
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = np.bincount(_CLASS, by_byte, 7) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    tails = sum(not x[-1:].isalnum() and x[-1] < 128 and x[-1:] not in b".,;:?" for x in words)
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / w, float(max(map(len, words), default=0)), share[1], share[2], share[3], share[4],
        share[5], share[6], len(set(words)) / w, len(lines) / w, 1 - len(set(lines)) / max(1, len(lines)), sum(map(bytes.isupper, words)) / w, tails / w, by_byte[33] / n,
    ]


def _matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))


def _steps(gain: np.ndarray, weight: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """A shallow regression tree over the bins of one feature: the value of every bin."""
    out, parts = np.zeros(len(gain)), [(0, len(gain))]
    g, h = np.r_[0, np.cumsum(gain)], np.r_[0, np.cumsum(weight)]
    score = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + smooth)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                c = np.arange(a + 1, b)
                s = score(a, c) + score(c, b) - score(a, b)
                best = max(best, (s.max(), (a, b), int(c[s.argmax()])), key=lambda x: x[0])
        if best[1] is None:
            break
        (a, b), c = best[1:]
        parts.remove((a, b))
        parts += [(a, c), (c, b)]
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + smooth)
    return out


def _quadrants(gain: np.ndarray, weight: np.ndarray, smooth: float):
    """The best tree of depth two over a pair: one cut of each feature. Returns its table and its gain."""
    full = lambda x: np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0)))
    g, h = full(gain), full(weight)
    best = np.full((gain.shape[0] + 1, gain.shape[1] + 1), 0.0)
    sides = []
    for x in (g, h):
        a = x
        b, c = x[:, -1:] - x, x[-1:, :] - x
        sides.append((a, b, c, x[-1, -1] - a - b - c))
    for gs, hs in zip(*sides):
        best += gs**2 / (hs + smooth)
    i, j = np.unravel_index(best[1:-1, 1:-1].argmax(), best[1:-1, 1:-1].shape) if min(gain.shape) > 1 else (0, 0)
    table = np.zeros(gain.shape)
    i, j = i + 1, j + 1
    for rows, cols in ((slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))):
        if gain[rows, cols].size:
            table[rows, cols] = gain[rows, cols].sum() / (weight[rows, cols].sum() + smooth)
    return table, best[i, j] if min(gain.shape) > 1 else 0.0


class Additive:
    """Lookup tables per feature and for the chosen pairs; a score adds the entries of a row's bins."""

    def __init__(self, edges, base, tables, pairs):
        self.edges, self.base, self.tables, self.pairs = edges, base, tables, pairs

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, z = self.bins(x), np.full(len(x), self.base)
        for b, t in zip(bins, self.tables):
            z += t[b]
        for (f, g), t in self.pairs.items():
            z += t[bins[f], bins[g]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, leaves: int = 3, n_bins: int = 32, n_pairs: int = 6, smooth: float = 2.0) -> Additive:
    """Cyclic boosting: round after round, each feature in turn gets a small tree on the current residuals; then the
    pairs of largest gain get trees of depth two. Without rows the score is 0.5; with one class it tends to that class."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, n_bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    prior = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive(edges, float(np.log(prior / (1 - prior))), [np.zeros(len(e) + 1) for e in edges], {})
    if not len(y):
        return model
    bins, z = model.bins(x), np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f, b in enumerate(bins):
            r, h = slopes()
            n = len(model.tables[f])
            step = rate * _steps(np.bincount(b, r, n), np.bincount(b, h, n), leaves, smooth)
            model.tables[f] += step
            z += step[b]
    r, h = slopes()
    grid = lambda f, g, v: np.bincount(bins[f] * len(model.tables[g]) + bins[g], v, len(model.tables[f]) * len(model.tables[g])).reshape(len(model.tables[f]), -1)
    gains = sorted(((_quadrants(grid(f, g, r), grid(f, g, h), smooth)[1], f, g) for f in range(len(bins)) for g in range(f)), reverse=True)
    model.pairs = {(f, g): np.zeros((len(model.tables[f]), len(model.tables[g]))) for _, f, g in gains[:n_pairs]}
    for _ in range(rounds // 4):
        for (f, g), table in model.pairs.items():
            r, h = slopes()
            step = rate * _quadrants(grid(f, g, r), grid(f, g, h), smooth)[0]
            table += step
            z += step[bins[f], bins[g]]
    return model


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, usable=None) -> Additive:
    """Fit on the labelled documents, on about most_rows of them (picked by a hash of doc_id) where there are more.
    `usable`: a condition on doc_id that training rows meet. Rows without a label don't count; repeated ones do."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("quality is not null and doc_id is not null")
    known = known.where(usable) if usable is not None else known
    share = min(1.0, most_rows / max(1, known.count()))
    pick = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where(pick)

    def run(batches):
        for b in batches:
            x = _matrix(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(x), pa.list_(pa.float64())), b.column("quality")], ["doc_id", "x", "quality"])

    rows = texts.join(known.where(pick), "doc_id").select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, x array<double>, quality double").toPandas()
    rows = rows.sort_values(["doc_id", "quality"], kind="stable")
    x = np.stack(rows.x.to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, (rows.quality.to_numpy(float) > 0.5).astype(float))


def score(docs: DataFrame, model: Additive, out: str = "quality_score") -> DataFrame:
    """docs plus `out` (0 to 1); null and empty texts get a score too. A column of that name is replaced; other columns
    and repeated rows stay. A model that saw no usable label gives 0.5 to all; an empty table gives no rows."""
    from pyspark.sql import types as T

    kept = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed number of bins
    at = kept.columns.index("text")

    def run(batches):
        for b in batches:
            x = _matrix(None if t is None else t.encode() for t in (v.as_py() for v in b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(x), pa.float64())], [*b.schema.names, out])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())]))


def query(spark, sf_dir):
    from .common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(doc_crc() % 3 == 1, F.lit(False))
    model = train(docs, read(spark, sf_dir, "labels"), usable=~held)
    s = score(docs, model).select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
