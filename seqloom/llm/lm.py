"""Language-model scoring by context-tree weighting over bytes, beside a smoothed word model."""

from __future__ import annotations

from collections import Counter
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_crc, drop_cut, shuffle_partitions

#: Bytes of context, at least two: the tree has a level for every length up to this.
DEPTH = 5
#: Text bytes of a block of documents, of a slice of blocks, and for each hash bucket of grams and words.
BLOCK_BYTES, SLICE_BYTES, BUCKET_BYTES = 6 << 20, 4 << 30, 64 << 20
#: Nearest bytes of a context that choose its bucket; the levels from there on are built bucket by bucket, the shorter
#: ones are sums over all buckets.
NEAR = 3
#: Distinct grams of which a task builds the tree at a time (more where a context of NEAR bytes alone has more).
PIECE = 1 << 17
#: A byte that UTF-8 never holds: stands before a text and ends it.
EDGE = 0xFF
_U = np.uint64
_LOG_HALF = float(np.log(0.5))


def _table(most: int = 1 << 12) -> np.ndarray:
    return np.array([lgamma(n + 0.5) for n in range(most)])


_HALVES = _table()


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1/2) for counts."""
    x = np.maximum(n.astype(float), len(_HALVES) - 1) + 0.5
    series = (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < len(_HALVES), _HALVES[np.minimum(n, len(_HALVES) - 1)], series)


def _lgamma_whole(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1) for counts."""
    x = n.astype(float) + 1
    big = np.maximum(x, 16.0)
    series = (big - 0.5) * np.log(big) - big + 0.9189385332046727 + 1 / (12 * big) - 1 / (360 * big**3)
    small = np.array([lgamma(i + 1) for i in range(17)])
    return np.where(x < 16, small[np.minimum(n, 16).astype(np.int64)], series)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return _lgamma_half(n0) + _lgamma_half(n1) - _lgamma_whole(n0 + n1) - 2 * _HALVES[0]


def grams(text: np.ndarray, depth: int) -> np.ndarray:
    """Every byte with the `depth` bytes before it, nearest byte first, the byte itself last."""
    n, x = len(text) - depth, text.astype(_U)
    out = np.zeros(n, _U)
    for j in range(1, depth + 1):
        out = (out << _U(8)) | x[depth - j : depth - j + n]
    return (out << _U(8)) | x[depth:]


class Tree:
    """The levels `least` to `depth` of the context tree over some contexts, from sorted distinct grams and their counts.

    A byte is eight binary decisions; each decision after the same higher bits has a tree of its own, whose nodes are the
    contexts. Level d holds the distinct (context of d bytes, byte) as `rows`, their counts, the row of the next shorter
    context in `up`, and for every bit the node of each row with its counts and weighted log probability."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, depth: int, least: int):
        self.depth, self.least, self.rows, self.up, self.nodes, self.first = depth, least, {depth: gram}, {}, {}, {}
        counts = {depth: count}
        for d in range(depth - 1, least - 1, -1):
            longer = self.rows[d + 1]
            shorter = ((longer >> _U(16)) << _U(8)) | (longer & _U(255))
            self.rows[d], self.up[d + 1] = np.unique(shorter, return_inverse=True)
            counts[d] = np.bincount(self.up[d + 1], counts[d + 1], len(self.rows[d])).astype(np.int64)
        for d in range(depth, least - 1, -1):
            for k in range(8):
                key = self.rows[d] >> _U(8 - k)
                new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
                node = np.cumsum(new) - 1
                bit = (self.rows[d] >> _U(7 - k)) & _U(1)
                total = np.bincount(node, counts[d]).astype(np.int64)
                ones = np.bincount(node, counts[d] * bit.astype(np.int64)).astype(np.int64)
                kt = log_kt(total - ones, ones)
                if d == depth:
                    weighted, own = kt, np.ones(len(kt))
                else:
                    child = np.flatnonzero(self.first[d + 1, k])
                    parent = node[self.up[d + 1][child]]
                    below = np.bincount(parent, self.nodes[d + 1, k][3], len(kt))
                    weighted = _LOG_HALF + np.logaddexp(kt, below)
                    own = np.exp(_LOG_HALF + kt - weighted)
                self.nodes[d, k] = (node, total, ones, weighted, own)
                self.first[d, k] = new

    def summary(self) -> pd.DataFrame:
        """Sums over the farthest byte of the shortest contexts: what the level below `least` needs. `near`: the nearest
        least - 1 context bytes; `place`: the higher bits of the byte after a leading one."""
        out = []
        for k in range(8):
            at = np.flatnonzero(self.first[self.least, k])
            _, total, ones, weighted, _ = self.nodes[self.least, k]
            place = (1 << k) | ((self.rows[self.least][at] & _U(255)) >> _U(8 - k)).astype(np.int64)
            near = (self.rows[self.least][at] >> _U(16)).astype(np.int64)
            out.append(pd.DataFrame({"near": near, "place": place, "total": total, "ones": ones, "weighted": weighted}))
        return pd.concat(out).groupby(["near", "place"], as_index=False).sum()

    def log10(self, middle: list["Level"], top: "Top") -> np.ndarray:
        """Log10 probability of the byte of every gram after its context: at each bit, the estimates of all contexts
        that were seen in training, mixed from the longest to none."""
        gram = self.rows[self.depth]
        out, at = np.zeros(len(gram)), {self.depth: np.arange(len(gram))}
        for d in range(self.depth - 1, self.least - 1, -1):
            at[d] = self.up[d + 1][at[d + 1]]
        near, byte = (gram >> _U(8 * self.depth)).astype(np.int64), (gram & _U(255)).astype(np.int64)
        for k in range(8):
            one = (byte >> (7 - k)) & 1 == 1
            p, seen = np.full(len(gram), 0.5), np.zeros(len(gram), bool)
            place = (1 << k) | (byte >> (8 - k))
            levels = [(x[2][x[0]][at[d]], x[1][x[0]][at[d]], x[4][x[0]][at[d]]) for d in range(self.depth, self.least - 1, -1) for x in (self.nodes[d, k],)]
            levels += [level.of((gram >> _U(8 * (self.depth + 1 - level.bytes))).astype(np.int64), place) for level in middle]
            levels += [tuple(x[near, place] for x in top.level1), tuple(x[place] for x in top.level0)]
            for n1, n, w in levels:
                kt = (np.where(one, n1, n - n1) + 0.5) / (n + 1.0)
                p = np.where(n == 0, p, np.where(seen, w * kt + (1 - w) * p, kt))
                seen |= n > 0
            out += np.log10(p)
        return out


class Level:
    """Nodes of one level of the tree as sorted arrays, from summaries of the level above."""

    def __init__(self, rows: pd.DataFrame, context_bytes: int):
        self.bytes = context_bytes
        rows = rows.assign(key=rows["near"].to_numpy(np.int64) * 256 + rows["place"].to_numpy(np.int64)).sort_values("key", kind="stable")
        kt = log_kt((rows["total"] - rows["ones"]).to_numpy(np.int64), rows["ones"].to_numpy(np.int64))
        self.near, self.place = rows["near"].to_numpy(), rows["place"].to_numpy()
        self.weighted = _LOG_HALF + np.logaddexp(kt, rows["weighted"].to_numpy(float))
        self.key, self.total, self.ones = (np.r_[rows[c].to_numpy(np.int64), 0] for c in ("key", "total", "ones"))
        self.key[-1], self.own = np.iinfo(np.int64).max, np.r_[np.exp(_LOG_HALF + kt - self.weighted), 0.0]

    def of(self, near: np.ndarray, place: np.ndarray):
        """ones, total and own weight of nodes; zeros where there is none."""
        key = near * 256 + place
        at = np.searchsorted(self.key, key)
        at = np.where(self.key[at] == key, at, len(self.key) - 1)
        return self.ones[at], self.total[at], self.own[at]

    def summary(self) -> pd.DataFrame:
        return pd.DataFrame({"near": self.near >> 8, "place": self.place, "total": self.total[:-1], "ones": self.ones[:-1], "weighted": self.weighted})


class Top:
    """Levels 1 and 0 of the tree as tables of fixed size: 256 contexts by 256 places, and 256 places."""

    def __init__(self, rows):
        total, ones, below = (np.zeros((256, 256)) for _ in range(3))
        for r in rows:
            total[r["near"], r["place"]], ones[r["near"], r["place"]], below[r["near"], r["place"]] = r["total"], r["ones"], r["weighted"]
        total, ones = total.astype(np.int64), ones.astype(np.int64)
        kt = log_kt(total - ones, ones)
        weighted = np.where(total > 0, _LOG_HALF + np.logaddexp(kt, below), 0.0)
        self.level1 = (ones, total, np.exp(_LOG_HALF + kt - weighted))
        kt0 = log_kt((total - ones).sum(0), ones.sum(0))
        weighted0 = _LOG_HALF + np.logaddexp(kt0, weighted.sum(0))
        self.level0 = (ones.sum(0), total.sum(0), np.exp(_LOG_HALF + kt0 - weighted0))


def _block_grams(texts: list[bytes], depth: int):
    """Place of every byte's gram among the block's sorted distinct grams, those grams, and where each text begins."""
    sizes = np.array([len(t) + 1 for t in texts])
    edge = bytes([EDGE]) * depth
    joined = np.frombuffer(b"".join(edge + t + b"\xff" for t in texts), np.uint8)
    all_grams = grams(joined, depth)
    begin = np.cumsum(sizes + depth) - (sizes + depth)
    keep = np.ones(len(all_grams), bool)
    for j in range(depth):  # grams whose byte belongs to the edge before a text
        cut_at = begin[1:] + j - depth
        keep[cut_at] = False
    all_grams = all_grams[keep]
    inverse, distinct = pd.factorize(all_grams)
    del all_grams, keep, joined
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return rank[inverse.astype(np.int32)], distinct[order], np.cumsum(sizes) - sizes


def _bucket_of(gram: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """Grams with the same NEAR nearest context bytes share a bucket."""
    return ((gram >> _U(8 * (depth + 1 - min(NEAR, depth)))) * _U(0x9E3779B97F4A7C15) >> _U(40)).astype(np.int64) % buckets


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), EDGE]] = True
_BASE = 0x9E3779B97F4A7C15


def _block_words(texts: list[bytes], buckets: int):
    """Place of every word among the block's distinct words, those words and their buckets in an order that depends on
    the words alone, and the number of words of each text. A word is told by a 64-bit polynomial of its bytes, which
    differences of running sums give for all words at once."""
    data = b"\xff".join([*texts, b""])
    x = np.frombuffer(data, np.uint8)
    blank = _SPACE[x]
    edge = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    powers = lambda base: np.cumprod(np.r_[_U(1), np.full(len(x), _U(base))])
    sums = np.r_[_U(0), np.cumsum((x.astype(_U) + _U(1)) * powers(_BASE)[:-1])]
    code = (sums[ends] - sums[starts]) * powers(pow(_BASE, -1, 1 << 64))[starts]
    code = (code ^ (code >> _U(29))) * _U(0xBF58476D1CE4E5B9) ^ (ends - starts).astype(_U)
    places, distinct = pd.factorize(code)
    first = np.zeros(len(distinct), np.int64)
    first[places[::-1]] = np.arange(len(places))[::-1]
    names = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    bucket = ((distinct >> _U(20)) % _U(buckets)).astype(np.int64)
    order = np.lexsort((distinct, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    last = np.cumsum([len(t) + 1 for t in texts])
    return rank[places], [names[i] for i in order], bucket[order], np.diff(np.r_[0, np.searchsorted(starts, last)])


def _texts(frame: pd.DataFrame) -> list[bytes]:
    return [bytes(t).lower() for t in frame["text"]]


def _count_block(depth: int, buckets: int):
    def run(key, frame):
        rows = []
        texts, learn = _texts(frame), frame["learn"].to_numpy(bool)
        places, distinct, begin = _block_grams(texts, depth)
        weight = np.repeat(learn, np.diff(np.r_[begin, len(places)]))
        count = np.bincount(places[weight], minlength=len(distinct))
        bucket = _bucket_of(distinct, depth, buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            i = order[cuts[b] : cuts[b + 1]]
            if len(i):
                rows.append((b, key[0], "gram", distinct[i].tobytes(), count[i].astype(np.int32).tobytes()))
        places, names, bucket, sizes = _block_words(texts, buckets)
        count = np.bincount(places[np.repeat(learn, sizes)], minlength=len(names))
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in range(buckets):
            if cuts[b] < cuts[b + 1]:
                rows.append((b, key[0], "word", b"\n".join(names[cuts[b] : cuts[b + 1]]), count[cuts[b] : cuts[b + 1]].astype(np.int32).tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "block", "kind", "keys", "counts"])

    return run


def _lists(frame: pd.DataFrame):
    """The grams of a frame's rows, each row's as an array, and the words likewise."""
    grams_of, words_of = frame[frame["kind"] == "gram"], frame[frame["kind"] == "word"]
    return grams_of, [np.frombuffer(k, _U) for k in grams_of["keys"]], words_of, [k.split(b"\n") for k in words_of["keys"]]


def _sums(own: list[np.ndarray], counts, kind) -> tuple[np.ndarray, np.ndarray]:
    gram, inverse = np.unique(np.concatenate([*own, np.zeros(0, _U)]), return_inverse=True)
    return gram, np.bincount(inverse, np.concatenate([*(np.frombuffer(c, kind) for c in counts), np.zeros(0, kind)]), len(gram)).astype(np.int64)


def _word_sums(lists: list[list[bytes]], counts, kind) -> dict[bytes, int]:
    total: Counter = Counter()
    for ws, c in zip(lists, counts):
        for w, n in zip(ws, np.frombuffer(c, kind).tolist()):
            total[w] += n
    return total


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """The distinct grams and words of a bucket in a slice, sorted, with their counts over the slice's blocks."""
    g, own, w, lists = _lists(frame)
    gram, count = _sums(own, g["counts"], np.int32)
    words = sorted(_word_sums(lists, w["counts"], np.int32).items())
    rows = [("gram", gram.tobytes(), count.tobytes())] if len(gram) else []
    rows += [("word", b"\n".join(x for x, _ in words), np.array([n for _, n in words], np.int64).tobytes())] if words else []
    return pd.DataFrame([(frame["bucket"].iloc[0], frame["slice"].iloc[0], *r) for r in rows], columns=["bucket", "slice", "kind", "keys", "counts"])


def _pieces(gram: np.ndarray, depth: int, least: int):
    """Stretches of sorted grams that hold whole contexts of `least` bytes."""
    context, a = gram >> _U(8 * (depth + 1 - least)), 0
    while a < len(gram):
        b = len(gram) if a + PIECE >= len(gram) else int(np.searchsorted(context, context[a + PIECE - 1], side="right"))
        yield slice(a, b)
        a = b


def _summaries(depth: int, least: int):
    """What the shorter contexts need of a bucket's grams; rows with place 0 name the contexts of its grams, trained or
    not, and one with near = -1 tells how many training words it holds."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        g, own, w, lists = _lists(frame)
        gram, count = _sums(own, g["counts"], np.int64)
        near = np.unique(gram >> _U(8 * (depth + 2 - least))).astype(np.int64)
        gram, count = gram[count > 0], count[count > 0]
        out = [Tree(gram[p], count[p], depth, least).summary() for p in _pieces(gram, depth, least)]
        words = [n for n in _word_sums(lists, w["counts"], np.int64).values() if n]
        out.append(pd.DataFrame({"near": [-1, *near], "place": 0, "total": [sum(words), *[0] * len(near)], "ones": [len(words), *[0] * len(near)], "weighted": 0.0}))
        return pd.concat(out).groupby(["near", "place"], as_index=False).sum().assign(bucket=frame["bucket"].iloc[0])

    return run


def _values(depth: int, least: int, top):
    """For each slice the values of a bucket's grams (log10 probabilities) or words (training counts), in their order."""

    def run(key, frame: pd.DataFrame, middle: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["bucket", "slice", "kind", "values"])
        g, own, w, lists = _lists(frame)
        gram, count = _sums(own, g["counts"], np.int64)
        levels = []
        if least > 2:
            nodes = {c: np.concatenate([*middle[c], np.zeros(0)]) for c in ("place", "total", "ones", "weighted")}
            levels = [Level(pd.DataFrame({"near": np.repeat(middle["near"].to_numpy(), middle["place"].map(len)), **nodes}), least - 1)]
        score = np.concatenate([*(Tree(gram[p], count[p], depth, least).log10(levels, top.value) for p in _pieces(gram, depth, least)), np.zeros(0)])
        out = [(s, "gram", score[np.searchsorted(gram, x)].astype(np.float32).tobytes()) for s, x in zip(g["slice"], own)]
        total = _word_sums(lists, w["counts"], np.int64)
        out += [(s, "word", np.array([total[x] for x in ws], float).tobytes()) for s, ws in zip(w["slice"], lists)]
        return pd.DataFrame([(key[0], *r) for r in out], columns=["bucket", "slice", "kind", "values"])

    return run


def _replies(key, frame: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    """For each block of a slice the values of its grams or words, in the block's order."""
    g, own, w, lists = _lists(frame)
    of, out = dict(zip(values["kind"], values["values"])), []
    if own:
        gram, score = np.unique(np.concatenate(own)), np.frombuffer(of["gram"], np.float32)
        out += [(b, "gram", score[np.searchsorted(gram, x)].tobytes()) for b, x in zip(g["block"], own)]
    if lists:
        total = dict(zip(sorted({x for ws in lists for x in ws}), np.frombuffer(of["word"]).tolist()))
        out += [(b, "word", np.array([total[x] for x in ws], float).tobytes()) for b, ws in zip(w["block"], lists)]
    return pd.DataFrame([(b, key[0], k, v) for b, k, v in out], columns=["block", "bucket", "kind", "values"])


def _score_block(depth: int, buckets: int, n_docs: int, tokens: int, distinct: int):
    """tokens and distinct: of the training words; every training document adds one end to the tokens."""

    def run(key, frame, values):
        if not len(frame):
            return pd.DataFrame(columns=["doc_id", "learn", "n_tokens", "n_known", "base_score", "score", "n_bytes"])
        texts = _texts(frame)
        of = {(k, b): np.frombuffer(v, np.float32 if k == "gram" else np.float64) for k, b, v in zip(values["kind"], values["bucket"], values["values"])}
        places, gram, begin = _block_grams(texts, depth)
        lp, bucket = np.empty(len(gram)), _bucket_of(gram, depth, buckets)
        lp[np.argsort(bucket, kind="stable")] = np.concatenate([of["gram", b] for b in range(buckets) if ("gram", b) in of])
        score = np.add.reduceat(lp[places], begin)
        places, names, bucket, sizes = _block_words(texts, buckets)
        count = np.concatenate([np.zeros(0), *(of["word", b] for b in range(buckets) if ("word", b) in of)])
        n, v = tokens + n_docs, distinct + (n_docs > 0)
        value, at = np.log10((count + 1) / (n + v + 1)), np.r_[0, np.cumsum(sizes)]
        sums = lambda x: np.diff(np.r_[0, np.cumsum(x[places])][at])
        return pd.DataFrame({
            "doc_id": frame["doc_id"].to_numpy(), "learn": frame["learn"].to_numpy(), "n_tokens": sizes + 1, "n_known": sums((count > 0).astype(np.int64)) + (n_docs > 0),
            "base_score": sums(value) + np.log10((n_docs + 1) / (n + v + 1)), "score": score, "n_bytes": [len(t) for t in texts],
        })

    return run


def score(docs: DataFrame, learn=None, depth: int = DEPTH) -> DataFrame:
    """Per document: doc_id, learn (whether the models learnt from it), n_tokens, n_known, train_tokens, base_score and
    score, both log10 probabilities of the text with A-Z lower-cased and an end, and bits_per_byte, the model's code length
    of text and end by their bytes.

    base_score adds log10((c + 1) / (N + V + 1)) over the words and the end. score is that of the context tree: counts of
    all bytes after all contexts of up to `depth` bytes in all training texts; a bit's estimates are mixed over the
    lengths by the weights that the training data give them. Contexts never seen in training take no part.

    Documents are hashed into blocks. A block sends its distinct words and grams with training counts to hash buckets,
    gets back the count or log probability of each, and adds them up over its documents: no table of words or grams is
    ever in one place. A bucket first merges the lists of each slice of blocks, so what meets in a task is a bucket's
    lists of one slice, or its distinct keys. The number of buckets and slices follows the size of the text; grams share
    a bucket by their three nearest context bytes, and the levels of shorter contexts are sums over the buckets. Within
    a block, words are told apart by 64-bit hashes of their bytes and by their length.

    Null texts count as empty and are a single end; nulls in doc_id stay; repeated rows are documents of their own;
    without training texts every bit has probability 1/2; an empty table gives no rows."""
    spark = docs.sparkSession
    learn, least = F.lit(True) if learn is None else learn, min(NEAR, depth)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(True)).alias("learn"), text.alias("text"))
    size, n_docs = rows.agg(F.sum(F.octet_length("text")), F.sum(F.col("learn").cast("long"))).first()
    size, n_docs = size or 0, n_docs or 0
    buckets, slices = max(shuffle_partitions(spark), -(-size // BUCKET_BYTES)), max(1, -(-size // SLICE_BYTES))
    blocks = max(buckets, -(-size // BLOCK_BYTES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    counted = rows.groupBy("block").applyInPandas(_count_block(depth, buckets), "bucket int, block int, kind string, keys binary, counts binary")
    counted = cut(counted.withColumn("slice", (F.col("block") % slices).cast("int")))
    merged = cut(counted.groupBy("bucket", "slice").applyInPandas(_merge, "bucket int, slice int, kind string, keys binary, counts binary"))
    node = "near long, place long, total long, ones long, weighted double"
    sums = cut(merged.groupBy("bucket").applyInPandas(_summaries(depth, least), f"bucket int, {node}"))
    sum_up = lambda nodes: nodes.groupBy("near", "place").agg(*(F.sum(c).alias(c) for c in ("total", "ones", "weighted")))
    level = sum_up(sums.where("place > 0"))
    # a context of the level has 255 nodes at most; every bucket gets those of its own contexts
    middle = level.groupBy("near").agg(*(F.collect_list(c).alias(c) for c in ("place", "total", "ones", "weighted")))
    middle = sums.where("place = 0 and near >= 0").select("bucket", "near").join(middle, "near")
    if least > 2:
        below = level.mapInPandas(lambda frames: (Level(f, least - 1).summary() for f in frames), node)
        level = sum_up(below)
    top = Top(level.collect())  # 256 x 255 rows at most
    words = sums.where("near < 0").agg(F.sum("total"), F.sum("ones")).first()
    shared = spark.sparkContext.broadcast(top)  # tables of fixed size
    values = merged.groupBy("bucket").cogroup(middle.groupBy("bucket")).applyInPandas(_values(depth, least, shared), "bucket int, slice int, kind string, values binary")
    replies = counted.groupBy("bucket", "slice").cogroup(values.groupBy("bucket", "slice"))
    replies = cut(replies.applyInPandas(_replies, "block int, bucket int, kind string, values binary"))
    for done in (counted, merged, sums):
        drop_cut(done)
    out = rows.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(
        _score_block(depth, buckets, n_docs, words[0] or 0, words[1] or 0), "doc_id long, learn boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    )
    bits = -F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)
    tokens = F.lit((words[0] or 0) + n_docs).cast("long").alias("train_tokens")
    return out.select("doc_id", "learn", "n_tokens", "n_known", tokens, "base_score", "score", bits.alias("bits_per_byte"))


def query(spark, sf_dir):
    from .common import read

    held = F.coalesce(doc_crc() % 7 == 2, F.lit(False))
    out = score(read(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
