"""Language identification: a bidirectional gated recurrent network over bytes, trained by backpropagation through time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_crc

#: Bytes of a training window and windows that a picked document gives.
TRAIN_BYTES, TRAIN_WINDOWS = 64, 4
#: A text is labelled in stretches of LABEL_BYTES; the states of both directions start CONTEXT bytes outside a stretch,
#: further than they remember, so that a position's label doesn't depend on where the text is cut.
LABEL_BYTES, CONTEXT = 256, 16
#: Stretches that are labelled at a time.
AT_ONCE = 512
HIDDEN = 10
#: The model learns from about so many documents a language, and from about so many in all, but from every language.
DOCS_PER_LANGUAGE, DOCS_IN_ALL, FEWEST_DOCS = 1_000, 100_000, 20
_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Two recurrent layers, one in each direction, and a softmax over their states at every byte.

    Per direction: W (256, 3H) holds what each byte adds to the update gate, the reset gate and the candidate; U (H, 3H)
    and b what the state adds. V, c turn both states into language scores."""

    def __init__(self, languages: int, hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p[f"U{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
            self.p[f"b{d}"] = np.zeros(3 * hidden, np.float32)
        self.p["V"] = rng.normal(0, 0.3, (2 * hidden, languages)).astype(np.float32)
        self.p["c"] = np.zeros(languages, np.float32)

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (T, B, H) for bytes x (T, B), in reading order of the direction; 0 where the mask has no text."""
        h, table, u = self.h, self.p[f"W{d}"] + self.p[f"b{d}"], self.p[f"U{d}"]
        out, s = np.empty((*x.shape, h), np.float32), np.zeros((x.shape[1], h), np.float32)
        for t in range(len(x)):
            a, g = table[x[t]], s @ u
            gates = a[:, : 2 * h] + g[:, : 2 * h]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:, :h], gates[:, h:]
            n = np.tanh(a[:, 2 * h :] + r * g[:, 2 * h :])
            if keep is not None:
                keep.append((s, z, r, n, g[:, 2 * h :]))
            s = (n + z * (s - n)) * mask[t][:, None]
            out[t] = s
        return out

    def states(self, x: np.ndarray, mask: np.ndarray, kept: dict | None = None) -> np.ndarray:
        f = self._direction(x, mask, "f", None if kept is None else kept.setdefault("f", []))
        b = self._direction(x[::-1], mask[::-1], "b", None if kept is None else kept.setdefault("b", []))[::-1]
        return np.concatenate([f, b], axis=2)

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(T, languages, B): the label probabilities at every position. Both directions go along at once, with texts in
        the last axis, so that every slice of the gates is one piece of memory."""
        h, (length, b) = self.h, x.shape
        sign = np.repeat(np.float32([-1, -2]), (2 * h, h))  # every gate is 1 / (1 + exp(.)), as tanh(v) is 2 / (1 + exp(-2 v)) - 1
        tables = [np.ascontiguousarray(((self.p[f"W{d}"] + self.p[f"b{d}"]) * sign).T) for d in "fb"]
        u = np.stack([(self.p[f"U{d}"] * sign).T for d in "fb"])
        a, g, r, s = (np.zeros((2, k, b), np.float32) for k in (3 * h, 3 * h, h, h))
        gates, n, at, out = a[:, : 2 * h], a[:, 2 * h :], x.astype(np.intp), np.empty((length, 2, h, b), np.float32)
        whole = mask.all(axis=1)
        for t in range(length):
            for i, place in enumerate((t, length - 1 - t)):
                np.take(tables[i], at[place], axis=1, out=a[i], mode="clip")
            np.matmul(u, s, out=g)
            gates += g[:, : 2 * h]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            np.multiply(gates[:, h:], g[:, 2 * h :], out=r)
            n += r
            np.exp(n, out=n)
            n += 1
            np.divide(2, n, out=n)
            n -= 1
            s -= n
            s *= gates[:, :h]
            s += n
            for i, place in enumerate((t, length - 1 - t)):
                if not whole[place]:
                    s[i] *= mask[place]
                out[place, i] = s[i]
        z = np.ascontiguousarray(self.p["V"].T) @ out.reshape(length, 2 * h, b) + self.p["c"][:, None]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over the positions in the mask, and its gradient by backpropagation through time."""
        kept: dict = {}
        s = self.states(x, mask, kept)
        z = s @ self.p["V"] + self.p["c"]
        z -= z.max(axis=2, keepdims=True)
        e = np.exp(z)
        p = e / e.sum(axis=2, keepdims=True)
        total = max(1.0, mask.sum())
        columns = np.arange(len(y))
        loss = float(-(np.log(p[:, columns, y] + 1e-9) * mask).sum() / total)
        p[:, columns, y] -= 1
        p *= (mask / total)[:, :, None]
        grad = {"V": np.einsum("tbh,tbl->hl", s, p), "c": p.sum((0, 1))}
        ds = p @ self.p["V"].T
        for d, part, xs, there in (("f", ds[:, :, : self.h], x, mask), ("b", ds[::-1, :, self.h :], x[::-1], mask[::-1])):
            gw, gu, carry = np.zeros_like(self.p[f"W{d}"]), np.zeros_like(self.p[f"U{d}"]), np.zeros((len(y), self.h), np.float32)
            gb, u = np.zeros(3 * self.h, np.float32), self.p[f"U{d}"]
            for t in range(len(xs) - 1, -1, -1):
                before, zt, r, n, gn = kept[d][t]
                dh = (part[t] + carry) * there[t][:, None]
                dn = dh * (1 - zt) * (1 - n * n)
                da = np.concatenate([dh * (before - n) * zt * (1 - zt), dn * gn * r * (1 - r), dn], axis=1)
                dg = da.copy()
                dg[:, 2 * self.h :] *= r
                gu += before.T @ dg
                gb += da.sum(0)
                np.add.at(gw, xs[t], da)
                carry = dh * zt + dg @ u.T
            grad |= {f"W{d}": gw, f"U{d}": gu, f"b{d}": gb}
        return loss, grad


def fit(windows: list[bytes], labels: np.ndarray, languages: int, steps: int | None = None, batch: int = 128, rate: float = 0.01, seed: int = 1) -> Network:
    """Adam on seeded batches with as many windows of each language as of any other. Beyond eight languages, steps and
    states grow with their number."""
    steps = steps or 400 + 25 * max(0, languages - 8)
    net, rng = Network(languages, HIDDEN + 3 * max(0, (languages // 8).bit_length() - 1), seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    by_language = [np.flatnonzero(labels == i) for i in range(languages)]
    x, mask = padded(windows, TRAIN_BYTES)
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(by_language[i]) for i in rng.integers(0, languages, batch)])
        _, grad = net.gradients(x[:, pick], mask[:, pick], labels[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.p[k] -= rate * min(1.0, 3 * (1 - step / (steps + 1))) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return net


def padded(windows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (width, B) and which of them are text."""
    x = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in windows), np.uint8).reshape(len(windows), width).T
    sizes = np.array([len(w) for w in windows])
    return x, (np.arange(width)[:, None] < sizes).astype(np.float32)


def train(docs: DataFrame, usable=None, seed: int = 1, per_language: int = DOCS_PER_LANGUAGE, in_all: int = DOCS_IN_ALL, **how) -> tuple[list[str], Network | None]:
    """Learn from texts that hold a letter and have a language; every such language is learnt. About per_language
    documents of each are picked by a hash of doc_id and text (fewer, FEWEST_DOCS at least, where that would be more than
    in_all documents), with TRAIN_WINDOWS windows of each. Without any such text there is no network."""
    rows = docs.select(F.col("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.where(usable) if usable is not None else rows
    counts = cut(rows.groupBy("lang").agg(F.count("*").alias("n")))
    per_language = max(FEWEST_DOCS, min(per_language, in_all // max(1, counts.count())))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    picked = rows.join(counts, "lang").where(draw < F.lit(per_language) / F.col("n")).select("doc_id", "text", "lang")

    def cut_out(batches):
        for b in batches:
            found = []
            for doc, text, lang in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
                if _LETTER.search(text):
                    data = text.encode()
                    at = np.linspace(0, max(0, len(data) - TRAIN_BYTES), TRAIN_WINDOWS).astype(int)
                    found += [(doc if doc is not None else -1, i, data[a : a + TRAIN_BYTES], lang) for i, a in enumerate(sorted(set(at.tolist())))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else ((),) * 4, (pa.int64(), pa.int32(), pa.binary(), pa.string()))], ["doc", "i", "window", "lang"])

    windows = sorted(tuple(r) for r in picked.mapInArrow(cut_out, "doc long, i int, window binary, lang string").collect())
    languages = sorted({w[3] for w in windows})
    if not languages:
        return [], None
    number = {lang: i for i, lang in enumerate(languages)}
    return languages, fit([bytes(w[2]) for w in windows], np.array([number[w[3]] for w in windows]), len(languages), seed=seed, **how)


def pooled(net: Network, texts: list[bytes], languages: int) -> np.ndarray:
    """Mean of the label probabilities over all positions of each whole text."""
    out, sizes = np.zeros((len(texts), languages)), np.array([max(1, len(t)) for t in texts])
    stretches = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t), LABEL_BYTES)]
    size = lambda p: min(LABEL_BYTES, len(texts[p[0]]) - p[1])
    stretches.sort(key=lambda p: (size(p), p))  # short ones together
    step = max(8, AT_ONCE * 8 // max(8, languages))
    for k in range(0, len(stretches), step):
        some = stretches[k : k + step]
        windows = [texts[i][max(0, at - CONTEXT) : at + LABEL_BYTES + CONTEXT] for i, at in some]
        x, mask = padded(windows, max(map(len, windows)))
        before = np.array([min(CONTEXT, at) for _, at in some])
        place = np.arange(len(x))[:, None]
        own = (place >= before) & (place < before + np.array([size(p) for p in some]))
        np.add.at(out, [i for i, _ in some], np.einsum("tlb,tb->bl", net.probabilities(x, mask), own.astype(np.float32)))
    return out / sizes[:, None]


def identify(docs: DataFrame, languages: list[str], net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score): the language of the highest pooled probability over every byte of the text, ties to
    the first in code point order. `und` with score 0 where text is null or has no letter, or nothing was learnt.
    Repeated rows give repeated rows, an empty table none; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, net))  # a fixed number of weights and languages

    def run(batches):
        names, own = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if own is not None and t is not None and _LETTER.search(t)]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if known:
                p = pooled(own, [texts[i].encode() for i in known], len(names))
                for i, best, s in zip(known, p.argmax(1), p.max(1)):
                    pred[i], score[i] = names[best], min(1.0, float(s))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def query(spark, sf_dir):
    from .common import read

    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(doc_crc() % 4 == 2, F.lit(False))
    languages, net = train(docs, ~held)
    return identify(docs, languages, net).select("doc_id", held.alias("held_out"), "lang_pred", "score")
