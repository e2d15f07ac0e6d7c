"""Byte-level BPE encoding and decoding with overlapping chunks."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Code points of a chunk and of the stretch that it shares with the next one; documents up to a chunk aren't split.
CHUNK, OVERLAP = 1 << 16, 1 << 11
#: Boundaries nearer than this to a chunk's end may depend on text beyond it (the longest alternative of the pattern and its look-ahead).
MARGIN = 8
#: Characters of the stretches that a Python worker remembers (the memory starts anew when full), and characters of the
#: texts that it encodes at a time.
REMEMBERED, TOGETHER = 1 << 21, 1 << 20
#: Stretches of a text whose pre-tokens don't depend on what is around them, for patterns like that of GPT-2: a space
#: between two visible characters always begins a pre-token. Other white space stays inside a stretch.
STRETCH = r"(?: ?\S+|\s+\S*)(?:(?! \S)\s+\S*)*"
NO_RANK = (1 << 31) - 1
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _merge_long(piece: bytes, ranks: dict) -> list[int]:
    """The ids of one piece of many bytes, with a heap over a linked list."""
    n = len(piece)
    size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, length = heapq.heappop(heap)
        j = after[i] if size[i] else n
        if j >= n or size[i] + size[j] != length:
            continue
        size[i], size[j], after[i] = length, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n:
                both = size[a] + size[after[a]]
                if (r := ranks.get(piece[a : a + both])) is not None:
                    heapq.heappush(heap, (r, a, both))
    return [ranks[piece[i : i + size[i]]] for i in range(n) if size[i]]


class Merges:
    """Merges many short pieces at once: in a round, every piece merges its pair of lowest rank, leftmost first."""

    def __init__(self, ranks: dict):
        found = [(ranks[w[:i]], ranks[w[i:]], r) for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks]
        a, b, rank = np.array(found, np.int64).reshape(-1, 3).T
        self.size = max(ranks.values()) + 1
        order = np.argsort(a * self.size + b)
        self.keys, self.ranks = np.r_[(a * self.size + b)[order], np.iinfo(np.int64).max], np.r_[rank[order], NO_RANK].astype(np.int32)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        every = np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)
        self.of_two = self.rank(*every)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(NO_RANK))

    def __call__(self, pieces: list[bytes], at_once: int = 4_000) -> list[bytes]:
        out, order = [b""] * len(pieces), sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        for i in range(0, len(order), at_once):
            self._some(pieces, order[i : i + at_once], out)
        return out

    def _some(self, pieces: list[bytes], some: list[int], out: list[bytes]):
        whose = np.array(some)
        n = np.array([len(pieces[i]) for i in some])
        x = np.frombuffer(b"".join([pieces[i] for i in some]), np.uint8)
        ids, pair = self.of_byte[x], np.full(len(x), NO_RANK, np.int32)
        pair[:-1] = self.of_two[x[:-1].astype(np.int32) * 256 + x[1:]]
        pair[np.cumsum(n) - 1] = NO_RANK
        while len(whose):
            low = np.minimum.reduceat(pair, np.cumsum(n) - n)
            going = low < NO_RANK
            if not going.all():
                stay = np.repeat(going, n)
                raw, ends = ids[~stay].astype("<u4").tobytes(), 4 * np.cumsum(n[~going])
                for i, a, b in zip(whose[~going].tolist(), [0, *ends.tolist()], ends.tolist()):
                    out[i] = raw[a:b]
                whose, n, low, ids, pair = whose[going], n[going], low[going], ids[stay], pair[stay]
                if not len(whose):
                    break
            at = np.flatnonzero(pair == np.repeat(low, n))
            if len(at) > len(n):
                owner = np.searchsorted(np.cumsum(n), at, side="right")
                at = at[np.r_[True, owner[1:] != owner[:-1]]]
            ids[at] = low
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            n -= 1
            ids, pair, at = ids[stay], pair[stay], at - np.arange(len(at))
            last = np.cumsum(n) - 1
            pair[last] = NO_RANK
            left = np.concatenate([at[at > last - n + 1] - 1, at[at < last]])
            pair[left] = self.rank(ids[left], ids[left + 1])


class Vocabulary:
    """Ids of texts as little-endian 32-bit integers, and bytes of ids. A piece that isn't a word of the vocabulary is
    merged by rank. `stretch`: see STRETCH; None where the pattern has no such places."""

    def __init__(self, path: str, pattern: str, stretch: str | None = STRETCH):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = [b""] * (max(self.ranks.values()) + 1)
        for word, i in self.ranks.items():
            self.words[i] = word
        self.pieces = regex.compile(pattern).findall
        self.stretches = re.compile(stretch).findall if stretch else None
        self.merges, self.known, self.chars = Merges(self.ranks), {}, 0

    def _split(self, new: set[str]) -> dict[str, list[str]]:
        """The pieces of stretches. Those that start and end visibly after their space are matched in one run."""
        joined = [s for s in new if s[0] == " " and not s[1:2].isspace() and not s[-1].isspace()] if self.stretches else []
        pieces = self.pieces("".join(joined))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        cuts = (np.searchsorted(ends, np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))) + 1).tolist()
        out = {s: pieces[a:b] for s, a, b in zip(joined, [0, *cuts], cuts)}
        return out | {s: self.pieces(s) for s in new.difference(joined)}

    def _merged(self, pieces: set[str]) -> dict[str, bytes]:
        data = {p: p.encode() for p in pieces}
        out = {p: self.ranks[d].to_bytes(4, "little") for p, d in data.items() if d in self.ranks}
        rest = [p for p in data if p not in out]
        out |= {p: np.array(_merge_long(data[p], self.ranks), "<u4").tobytes() for p in rest if len(data[p]) >= 400}
        short = [p for p in rest if len(data[p]) < 400]
        return out | dict(zip(short, self.merges([data[p] for p in short])))

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = list(map(self.stretches or self.pieces, texts))
        every = set(chain.from_iterable(parts))
        if self.chars > REMEMBERED:
            self.known, self.chars = {}, 0
        new = every.difference(self.known)
        pieces = self._split(new)
        merged = self._merged(set(chain.from_iterable(pieces.values())).difference(self.known))
        self.known |= merged
        self.known.update((s, b"".join(map(self.known.__getitem__, p))) for s, p in pieces.items())
        self.chars += sum(map(len, merged)) + sum(map(len, new))
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str, stretch: str | None = STRETCH) -> Vocabulary:
    return Vocabulary(path, pattern, stretch)


def _whole(how: tuple, digests: bool):
    """Whole texts, some at a time: their ids, or the digests of those."""

    def run(batches):
        own = vocabulary(*how)
        for batch in batches:
            texts = batch.column("text")
            size = np.cumsum([0, *pa.compute.utf8_length(texts).to_pylist()]) // TOGETHER
            cuts = [0, *(np.flatnonzero(size[1:-1] != size[2:]) + 1).tolist(), batch.num_rows]
            for part in (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a):
                ids = own.encode(part.column("text").to_pylist())
                yield _digest_batch(part.column("doc_id"), ids, own) if digests else pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _digest_batch(doc_id, ids: list[bytes], own: Vocabulary) -> pa.RecordBatch:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return pa.RecordBatch.from_arrays(
        [doc_id, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(own.decode(x)) for x in ids], pa.string())],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _chunks(chunk: int, overlap: int):
    """Overlapping chunks of long texts, some at a time; every text is walked through once."""

    def run(batches):
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c) for c in ("row", "doc_id", "text"))):
                whole = text.as_py()
                starts = range(0, len(whole), chunk)
                for few in (starts[i : i + 16] for i in range(0, len(starts), 16)):
                    size = len(few)
                    columns = [[row.as_py()] * size, [doc_id.as_py()] * size, [len(whole)] * size, [a // chunk for a in few], list(few), [whole[a : a + chunk + overlap] for a in few]]
                    kinds = [pa.int64(), doc_id.type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["row", "doc_id", "n", "chunk", "at", "text"])

    return run


def _bounds(pattern: str, chunk: int, overlap: int):
    """The boundaries that a chunk's own pre-tokenisation finds in the stretches it shares with its neighbours."""

    def run(frames):
        spans = regex.compile(pattern).finditer
        for f in frames:
            left, right = [], []
            for at, text in zip(f["at"], f["text"]):
                ends = [m.end() for m in spans(text)]
                left.append([at + e for e in ends if e < overlap and e <= len(text) - MARGIN])
                right.append([at + e for e in ends if chunk <= e <= len(text) - MARGIN])
            yield f.assign(left=left, right=right)

    return run


def _between(how: tuple):
    def run(frames):
        own = vocabulary(*how)
        for f in frames:
            ids = [own.encode([t[int(a - at) : int(b - at)]])[0] for t, at, a, b in zip(f["text"], f["at"], f["begin"], f["end"])]
            yield pd.DataFrame({"row": f.row, "doc_id": f.doc_id, "chunk": f.chunk, "ids": ids})

    return run


def _joined(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values("chunk")
    return pd.DataFrame({"doc_id": f.doc_id.iloc[:1], "ids": [b"".join(f.ids)]})


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP, stretch: str | None = STRETCH) -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit): every match of the pattern in the whole text is merged by rank.

    Texts up to `chunk` code points are encoded where they are read. Longer ones become overlapping chunks that are
    pre-tokenised in parallel; two neighbours are stitched at the first boundary that both find in their shared
    stretch. Matching only looks ahead, so from a common boundary on both go on alike. Where a stretch has no common
    boundary (a run of one class longer than it) the document is pre-tokenised in one piece instead. Long documents
    and the boundaries of their chunks are written tables, so the numbers that tell documents apart stay the same when a
    lost executor's work is done again. Within a piece of text, pre-tokenising restarts at the stretches that `stretch`
    matches (see STRETCH; None for patterns that it doesn't fit), and a stretch seen before isn't matched again.
    Null and empty texts give no ids; null ids stay; repeated rows give repeated rows; other columns are ignored.
    """
    how = (path, pattern, stretch)
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = lambda d: d.mapInArrow(_whole(how, digests), f"doc_id {kind}, {DIGESTS if digests else 'ids binary'}")
    short = whole(rows.where(F.length("text") <= chunk))

    long = cut(rows.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()))
    chunks = long.select("row", "doc_id", "text").mapInArrow(_chunks(chunk, overlap), f"row long, doc_id {kind}, n long, chunk long, at long, text string")
    seen = chunks.mapInPandas(_bounds(pattern, chunk, overlap), f"{_ddl(chunks)}, left array<bigint>, right array<bigint>")
    by = Window.partitionBy("row").orderBy("chunk")
    meet = F.array_min(F.array_intersect("right", F.lead("left").over(by)))
    seen = seen.withColumn("end", F.when(F.lead("chunk").over(by).isNull(), F.col("n")).otherwise(meet))
    seen = seen.withColumn("begin", F.when(F.col("chunk") == 0, F.lit(0).cast("long")).otherwise(F.lag("end").over(by)))
    seen = seen.withColumn("apart", F.max(F.col("end").isNull()).over(Window.partitionBy("row")))
    seen = cut(seen.select("row", "doc_id", "chunk", "at", "begin", "end", "apart", "text"))
    ids = seen.where(~F.col("apart")).drop("apart")
    ids = ids.mapInPandas(_between(how), f"row long, doc_id {kind}, chunk long, ids binary")
    stitched = ids.groupBy("row").applyInPandas(_joined, f"doc_id {kind}, ids binary")
    stitched = stitched.mapInArrow(_digests(how), f"doc_id {kind}, {DIGESTS}") if digests else stitched
    rest = long.join(seen.where("apart").select("row").distinct(), "row", "left_semi").select("doc_id", "text")
    return short.unionByName(stitched).unionByName(whole(rest))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary): the raw bytes of the ids, one after another."""

    def run(batches):
        own = vocabulary(path, pattern)
        for b in batches:
            data = [own.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def _digests(how: tuple):
    def run(batches):
        own = vocabulary(*how)
        for b in batches:
            yield _digest_batch(b.column("doc_id"), b.column("ids").to_pylist(), own)

    return run


def digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, and the SHA-256 of its ids and of the bytes that they decode to."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    return encode(docs, path, pattern, digests=True)


def query(spark, sf_dir):
    from .common import read

    return digest(read(spark, sf_dir, "documents"))
