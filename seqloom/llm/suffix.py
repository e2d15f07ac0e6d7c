"""Removal of repeated byte strings with suffix arrays built by induced sorting."""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, unused

#: Bytes whose hash selects the places where a repeat is looked for.
GRAM = 24
#: Text bytes of a group of candidate hashes, and of one suffix array.
GROUP_BYTES, ARRAY_BYTES = 8 << 20, 1 << 20
#: Minimizers that a task packs, and documents whose contexts it gathers, at a time.
MINIMIZERS, DOCUMENTS = 300_000, 1_500
#: A reduced string with more names than this is sorted by doubling: passes over its buckets would be mostly empty.
WIDE = 2_000
_U = np.uint64
#: Odd factors of the prefix hashes.
MIXERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


# ---- suffix arrays -------------------------------------------------------------------------------------------------


def _types(s: np.ndarray) -> np.ndarray:
    """True for S-type suffixes (smaller than the next one). The last symbol is a sentinel."""
    step = np.r_[np.sign(np.diff(s.astype(np.int64))), 1]
    known = np.where(step != 0, np.arange(len(s)), len(s))
    ahead = np.minimum.accumulate(known[::-1])[::-1]
    return step[ahead] > 0


def _induce(s: np.ndarray, k: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the order of the leftmost-smaller suffixes, bucket by bucket: one pass upwards
    places the L-type suffixes, one downwards the S-type ones. Each step handles a whole stretch of a bucket."""
    size = np.bincount(s, minlength=k)
    start = np.r_[0, np.cumsum(size)]
    sa = np.full(len(s), -1, np.int64)
    sa[0] = len(s) - 1
    head, tail = start[:-1].copy(), start[1:].copy()
    lms_end = np.cumsum(np.bincount(s[lms], minlength=k))

    def push(found: np.ndarray, up: bool):
        c = s[found]
        order = np.argsort(c, kind="stable")
        n = np.bincount(c, minlength=k)
        first = np.cumsum(n) - n
        c, found = c[order], found[order]
        rank = np.arange(len(c)) - first[c]
        if up:
            sa[head[c] + rank] = found
            np.add(head, n, out=head)
        else:
            sa[tail[c] - 1 - rank] = found
            np.subtract(tail, n, out=tail)

    for up in (True, False):
        wanted = ~small if up else small
        for c in np.flatnonzero(size) if up else np.flatnonzero(size)[::-1]:
            at = start[c] if up else start[c + 1]
            if c == 0:  # the sentinel stands alone; its predecessor follows from `lms` upwards and is none downwards
                at = head[c] if up else tail[c]
            while True:  # what the bucket's own suffixes put into it comes after what is there
                now = head[c] if up else tail[c]
                stretch = sa[at:now] if up else sa[now:at][::-1]
                if not len(stretch):
                    break
                at = now
                before = stretch[stretch > 0] - 1
                before = before[wanted[before]]
                if len(before):
                    push(before, up)
            rest = lms[lms_end[c - 1] if c else 0 : lms_end[c]] if up else sa[start[c] : head[c]][::-1]
            before = rest[rest > 0] - 1
            before = before[wanted[before]]
            if len(before):
                push(before, up)
    return sa


def _by_doubling(names: np.ndarray, depth: int | None) -> np.ndarray:
    n, step, rank = len(names), 1, names.astype(np.int64)
    while True:
        key = rank * (n + 2) + np.r_[rank[step:] + 1, np.zeros(min(step, n), np.int64)][:n]
        order = np.argsort(key)
        new = np.r_[0, np.cumsum(key[order[1:]] != key[order[:-1]])]
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step > n or depth is not None and step >= depth:
            return order


def suffix_array(s: np.ndarray, k: int, depth: int | None = None) -> np.ndarray:
    """Suffix array of s (symbols below k; the last one, 0, occurs nowhere else) by induced sorting. With a depth,
    suffixes that agree in so many symbols may stand in any order."""
    s = s.astype(np.uint16 if k <= 1 << 16 else np.int64)  # narrow symbols sort by radix
    small = _types(s)
    is_lms = small & ~np.r_[True, small[:-1]]
    lms = np.flatnonzero(is_lms)
    if len(s) == 1:
        return np.zeros(1, np.int64)
    rough = _induce(s, k, small, lms[np.argsort(s[lms], kind="stable")])
    order = rough[is_lms[rough]]  # sorted by their leftmost-smaller substrings
    after = np.full(len(s), len(s) - 1)
    after[lms[:-1]] = lms[1:]
    length = after[order] - order
    same = np.r_[False, length[1:] == length[:-1]]
    active, place = np.flatnonzero(same), 0
    while len(active):
        a, b = order[active] + place, order[active - 1] + place
        differs = s[a] != s[b]
        same[active[differs]] = False
        active = active[~differs]
        place += 1
        active = active[place <= length[active]]
    names = np.empty(len(s), np.int64)
    names[order] = np.cumsum(~same) - 1
    reduced = names[lms]
    wide = int(reduced.max()) + 1
    if wide == len(reduced):
        ranked = np.argsort(reduced)
    elif wide <= WIDE:
        ranked = suffix_array(reduced, wide, depth)
    else:
        ranked = _by_doubling(reduced, depth)
    return _induce(s, k, small, lms[ranked])


def _alike(s: np.ndarray, at: np.ndarray, other: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings of `length` symbols at two places are the same. at ascends. Where both places moved on by one
    since the pair before, only the last symbol is new; a run with a difference in it is compared whole."""
    strings = np.lib.stride_tricks.sliding_window_view(s.astype(np.min_scalar_type(int(s.max()))), length)

    def whole(some: np.ndarray) -> np.ndarray:
        parts = [some[lo : lo + (1 << 13)] for lo in range(0, len(some), 1 << 13)]
        return np.concatenate([np.zeros(0, bool), *((strings[at[p]] == strings[other[p]]).all(axis=1) for p in parts)])

    if not len(at):
        return np.zeros(0, bool)
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(other) != 1)]
    same = s[at + length - 1] == s[other + length - 1]
    same[new] = whole(np.flatnonzero(new))
    broken = ~np.logical_and.reduceat(same, np.flatnonzero(new))
    again = np.flatnonzero(broken[np.cumsum(new) - 1])
    same[again] = whole(again)
    return same


def permuted_lcp(s: np.ndarray, sa: np.ndarray, least: int = 1) -> np.ndarray:
    """For every place of the text, the common prefix (127 at most) with the suffix just before it in sorted order.
    Common prefixes below `least`, rounded down to a power of two, may be given as 0; those that reach a `least` above 1
    do so by comparison, not by hashes alone."""
    first, second, third = map(_U, MIXERS)
    n, levels, h = len(s), [], s.astype(_U) * first + _U(1)
    for j in range(7):
        levels.append(h)
        m = 1 << j
        if n > m:
            h = h.copy()
            h[:-m] = (h[:-m] ^ (h[:-m] >> _U(29))) * second + h[m:]
            h[-m:] = np.arange(1, m + 1, dtype=_U) * third + _U(j)  # beyond the end nothing is alike
    left = np.full(n, n)
    left[sa[1:]] = sa[:-1]
    out, at, top = np.zeros(n, np.int64), np.arange(n), least.bit_length() - 1
    for j in [top, *range(6, -1, -1)] if top else range(6, -1, -1):
        m = 1 << j
        a, b = at + out[at], left[at] + out[at]
        fits = (a + m <= n) & (b + m <= n)
        alike = fits & (levels[j][np.minimum(a, n - 1)] == levels[j][np.minimum(b, n - 1)])
        if j == top and len(at) == n and top:
            at = np.flatnonzero(alike)  # only these can reach it; their prefix is measured anew
            continue
        out[at] += np.where(alike, m, 0)
    if top:  # hashes only propose: what reaches `least` is compared symbol by symbol
        sure = np.flatnonzero(out >= least)
        out[sure[~_alike(s, sure, left[sure], least)]] = 0
    return out


# ---- candidates ----------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def minimizers(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the grams that have the least hash in some string of `length` bytes of the text. What is chosen
    for a string depends on its bytes alone, so equal strings share a chosen gram."""
    window, hashes, places, stride = length - GRAM + 1, [], [], 1 << 19
    for at in range(0, max(1, len(text) - length + 1), stride):
        b = np.frombuffer(text[at : at + stride + length - 1], np.uint8)
        n = len(b) - GRAM + 1
        if n < window:
            continue
        w = b.astype(_U)
        for m in (1, 2, 4):
            w = w[:-m] | (w[m:] << _U(8 * m))
        h = _mix(w[:n] * _U(0x9E3779B97F4A7C15) + _U(1))
        for m in (8, 16):
            h = _mix((h ^ w[m : m + n]) * _U(0x9E3779B97F4A7C15))
        low = _U((1 << 20) - 1)
        key, span = (h & ~low) | (low - np.arange(n, dtype=_U)), 1
        while 2 * span <= window:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if window > span:
            key = np.minimum(key[: span - window], key[window - span :])
        key = key[np.r_[True, key[1:] != key[:-1]]]
        place = (low - (key & low)).astype(np.int64)
        hashes.append(h[place])
        places.append(place + at)
    return np.concatenate([*hashes, np.zeros(0, _U)]), np.concatenate([*places, np.zeros(0, np.int64)])


def _place(code: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """64 bits of a place: the same for the same place of equal texts."""
    return _mix(code.view(_U) ^ _mix(pos.astype(_U) + _U(1)))


def _packed_minimizers(length: int, groups: int):
    names = ["bucket", "h", "doc", "code", "pos"]

    def packed(parts):
        h, doc, code, pos = (np.concatenate(x) for x in zip(*parts))
        bucket, q = (h >> _U(33)) % _U(groups), _place(code, pos)
        order = np.lexsort((doc, q, h, bucket))
        order = order[np.r_[True, (np.diff(h[order]) != 0) | (np.diff(q[order]) != 0)]]  # of equal texts, the first speaks for all
        bucket, h, doc, code, pos = (x[order] for x in (bucket, h, doc, code, pos))
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = [*cuts[1:], len(bucket)]
        raw = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), raw(h), raw(doc), raw(code), raw(pos)], names)

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for doc, code, text in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), (t.as_py() for t in batch.column(2))):
                h, pos = minimizers(text, length)
                if not len(h):
                    continue
                parts.append((h, np.full(len(h), doc), np.full(len(h), code), pos.astype(np.uint32)))
                size += len(h)
                if size > MINIMIZERS:
                    yield packed(parts)
                    parts, size = [], 0
        if parts:
            yield packed(parts)
        pa.default_memory_pool().release_unused()

    return run


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """The places of a bucket's hashes that stand at more than one place of different texts."""
    kinds = {"h": np.uint64, "doc": np.int64, "code": np.int64, "pos": np.uint32}
    h, doc, code, pos = (np.frombuffer(b"".join(frame[c]), t) for c, t in kinds.items())
    q = _place(code, pos)
    order = np.lexsort((doc, q, h))
    order = order[np.r_[True, (np.diff(h[order]) != 0) | (np.diff(q[order]) != 0)]]
    same = np.diff(h[order]) == 0
    keep = order[np.r_[same, False] | np.r_[False, same]]
    return pd.DataFrame({"doc_key": doc[keep], "code": code[keep], "pos": pos[keep].astype(np.int32)})


def _contexts(length: int, groups: int):
    """Around every shared place, the bytes of all strings that hold its gram; equal contexts of a batch as one."""
    reach = length - GRAM

    def run(batches):
        for batch in (b.slice(i, DOCUMENTS) for b in batches for i in range(0, b.num_rows, DOCUMENTS)):
            found: dict[int, dict] = defaultdict(dict)
            for doc, code, text, places in zip(*(batch.column(c).to_pylist() for c in range(4))):
                for p in places:
                    base = max(0, p - reach)
                    shard = zlib.crc32(text[p : p + GRAM]) % groups
                    found[shard].setdefault((text[base : p + length], p - base), []).append((doc, code, base))
            rows = defaultdict(list)
            for shard, of in found.items():
                at = np.array([x for v in of.values() for x in v], np.int64)
                rows["shard"].append(shard)
                rows["context"].append([c for c, _ in of])
                rows["left"].append(np.array([x for _, x in of], np.int32).tobytes())
                rows["count"].append(np.array([len(v) for v in of.values()], np.int32).tobytes())
                rows["at"].append(at.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["shard"], pa.int32()), pa.array(rows["context"], pa.list_(pa.binary())), *(pa.array(rows[c], pa.binary()) for c in ("left", "count", "at"))],
                ["shard", "context", "left", "count", "at"],
            )

    return run


def _repeats(length: int):
    """Stretches (doc, code, from, to) of a shard that strings of `length` bytes starting earlier cover."""

    def earlier(contexts: list[bytes], first: np.ndarray) -> np.ndarray:
        """Which strings of the contexts stand earlier too: rows (context, place). first: doc, code, base of a context's
        first occurrence."""
        sizes = np.array([len(c) for c in contexts])
        text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 2
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        text[begin + sizes] = 1
        text = np.r_[text, 0]
        sa = suffix_array(text, 258, depth=2 * length)
        lcp = permuted_lcp(text, sa, length)
        of = np.repeat(np.arange(len(contexts)), sizes + 1)
        group = np.cumsum(lcp[sa] < length)  # suffixes that share `length` symbols stand together
        many = np.bincount(group, minlength=group[-1] + 1)[group] > 1
        sa, group = sa[many], group[many]
        o = sa - begin[of[sa]]
        valid = o + length <= sizes[of[sa]]
        own, o, group = of[sa][valid], o[valid], group[valid]
        doc, code, base = first[own].T
        order = np.lexsort((base + o, code, doc, group))
        own, o, group, doc, code, start = own[order], o[order], group[order], doc[order], code[order], (base + o)[order]
        lead = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        of_lead = np.repeat(lead, np.diff(np.r_[lead, len(group)]))
        later = (doc != doc[of_lead]) | (code != code[of_lead]) | (start != start[of_lead])
        return np.stack([own[later], o[later]], axis=1)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        classes: dict[tuple[bytes, int], int] = {}
        number = [classes.setdefault((c, x), len(classes)) for cs, left in zip(frame.context, frame.left) for c, x in zip(cs, np.frombuffer(left, np.int32).tolist())]
        at = np.frombuffer(b"".join(frame["at"]), np.int64).reshape(-1, 3)
        of = np.repeat(np.array(number), np.frombuffer(b"".join(frame["count"]), np.int32))
        order = np.lexsort((at[:, 2], at[:, 1], at[:, 0], of))
        at, of = at[order], of[order]
        is_first = np.r_[True, of[1:] != of[:-1]]
        first, keys = at[is_first], list(classes)
        sizes = np.array([len(c) for c, _ in keys])
        # a later occurrence of a whole context goes in one stretch (a repeated row is the first occurrence again)
        again = (at != at[np.flatnonzero(is_first)[np.cumsum(is_first) - 1]]).any(axis=1) & (sizes[of] >= length)
        out = [np.c_[at[again], at[again, 2] + sizes[of[again]]]]

        def search(part: list[int], parts: list[tuple[int, int]] | None = None):
            """Contexts `part`, or stretches (from, to) of them, go into one array."""
            lows = np.zeros(len(part), np.int64) if parts is None else np.array([a for a, _ in parts])
            who = first[part].copy()
            who[:, 2] += lows
            texts = [keys[i][0] for i in part] if parts is None else [keys[i][0][a:b] for i, (a, b) in zip(part, parts)]
            hit = earlier(texts, who)
            if len(hit):
                hit = hit[np.lexsort((hit[:, 1], hit[:, 0]))]
                new = np.r_[True, (np.diff(hit[:, 0]) != 0) | (np.diff(hit[:, 1]) != 1)]
                a, b = hit[new], hit[np.r_[new[1:], True]]
                who = who[a[:, 0]]
                out.append(np.c_[who[:, :2], who[:, 2] + a[:, 1], who[:, 2] + b[:, 1] + length])

        def split(part: list[int], least: int, most: int):
            """Contexts of one gram, for strings with `least` to `most` bytes before it. All of those hold the same bytes
            around the gram, which deal the contexts into smaller parts; a context alone in its part has no repeat."""
            dealt = defaultdict(list)
            for i in part:
                c, x = keys[i]
                held = c[x - least : x + length - most] if x >= least and len(c) - x >= length - most else None
                if held is not None:
                    dealt[held].append(i)
            for some in dealt.values():
                spans = [(max(0, keys[i][1] - most), min(len(keys[i][0]), keys[i][1] - least + length)) for i in some]
                if len(some) == 1:
                    continue
                if least == most:  # one and the same string
                    who = first[some] + np.array([[0, 0, a] for a, _ in spans])
                    who = who[np.lexsort(who.T[::-1])]
                    who = who[(who != who[0]).any(axis=1)]
                    out.append(np.c_[who, who[:, 2] + length])
                elif sum(b - a for a, b in spans) <= ARRAY_BYTES:
                    search(some, spans)
                else:
                    middle = (least + most) // 2
                    split(some, least, middle)
                    split(some, middle + 1, most)

        part, size = [], 0
        by_gram = sorted(range(len(keys)), key=lambda i: keys[i][0][keys[i][1] : keys[i][1] + GRAM])
        for _, same in groupby(by_gram, key=lambda i: keys[i][0][keys[i][1] : keys[i][1] + GRAM]):
            same = list(same)
            own = int(sizes[same].sum())
            if own > ARRAY_BYTES:
                split(same, 0, length - GRAM)
                continue
            if part and size + own > ARRAY_BYTES:
                search(part)
                part, size = [], 0
            part, size = part + same, size + own
        if part:
            search(part)
        return pd.DataFrame(np.concatenate(out), columns=["doc_key", "code", "start", "stop"])

    return run


def _kept(length: int):
    """The last two columns are the text and its spans; the ones before stay."""

    def run(batches):
        for batch in (b.slice(i, DOCUMENTS) for b in batches for i in range(0, b.num_rows, DOCUMENTS)):
            out = []
            for text, spans in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                merged: list[list[int]] = []
                for s in sorted((x["start"], x["stop"]) for x in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                ends = [0, *(x for m in merged for x in m), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])) if merged else text
                out.append((len(text), len(text) - len(kept), len(merged), kept))
            n, removed, spans, kept = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                [*batch.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_key, code, spans): per text that loses bytes, the stretches [start, stop) covered by strings of `length`
    bytes that also start earlier. docs: (doc_key long, code long: a hash of the text, text binary)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_BYTES))
    # equal texts: the first speaks for all, the others go whole
    ids = cut(docs.select("doc_key", "code", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("n")))
    several = ids.groupBy("sha").agg(F.min("doc_key").alias("first"), F.count("*").alias("c")).where("c > 1")
    copies = ids.where(F.col("n") >= length).join(several, "sha").where("doc_key > first").select("doc_key", "code", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("stop"))

    packed = docs.select("doc_key", "code", "text").mapInArrow(_packed_minimizers(length, groups), "bucket int, h binary, doc binary, code binary, pos binary")
    shared = packed.groupBy("bucket").applyInPandas(_shared, "doc_key long, code long, pos int")
    places = cut(shared.groupBy("doc_key", "code").agg(F.collect_set("pos").alias("places")))
    contexts = docs.join(places, ["doc_key", "code"]).select("doc_key", "code", "text", "places")
    contexts = cut(contexts.mapInArrow(_contexts(length, groups), "shard int, context array<binary>, left binary, count binary, at binary"))
    found = contexts.groupBy("shard").applyInPandas(_repeats(length), "doc_key long, code long, start long, stop long")
    spans = cut(found.union(copies).groupBy("doc_key", "code").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    drop_cut(contexts)
    return spans


#: The columns that deduplicate() adds.
NEW = ("n_bytes", "n_removed", "n_spans", "kept")


def deduplicate(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs plus n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary, the remaining bytes): every byte
    that a string of `length` bytes starting earlier (smaller doc_id, or same document and earlier start) covers goes.

    Texts are judged as UTF-8 on the input. Null and empty texts lose nothing; null ids come after all others; rows
    that repeat both id and text are one document and get equal results; rows that share an id only are ordered by a
    hash of their text. Columns of docs with the names of the new ones are replaced.

    Equal strings share a gram of least hash. Places whose gram stands elsewhere too are found by hash bucket; the
    bytes around them go to the shard of the gram, equal contexts once, and each shard sorts their suffixes."""
    names = [c for c in docs.columns if c.lower() not in (*NEW, "text")]
    key, code, spans, body = (unused(c, [*names, *NEW]) for c in ("key", "code", "spans", "body"))
    keyed = docs.select(*names, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias(body))
    keyed = keyed.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn(code, F.xxhash64(body))
    found = repeated_spans(keyed.select(F.col(key).alias("doc_key"), F.col(code).alias("code"), F.col(body).alias("text")), length)
    found = found.withColumnsRenamed({"spans": spans, "doc_key": key, "code": code})
    rows = keyed.join(found, [key, code], "left").select(*names, body, spans)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(_kept(length), f"{kinds}, n_bytes long, n_removed long, n_spans long, kept binary")


def deduplicated_documents(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs with what deduplicate() keeps of their texts (and n_chars, if there, to match). Where a cut falls inside a
    character, its remaining bytes go; documents that lose all their bytes go, empty ones stay. Other columns stay as
    they are, also those with a name of NEW. Nulls, repeats and shared ids: see deduplicate()."""
    away = {c: unused(c, [*docs.columns, *NEW]) for c in docs.columns if c.lower() in NEW}

    @F.pandas_udf("string")
    def whole_characters(kept: pd.Series) -> pd.Series:
        return kept.map(lambda b: b.decode("utf-8", "ignore"))

    out = deduplicate(docs.withColumnsRenamed(away), length).where("n_removed = 0 or n_removed < n_bytes").withColumn("text", whole_characters("kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select([F.col(away.get(c, c)).alias(c) for c in docs.columns])


def query(spark, sf_dir):
    from .common import read

    out = deduplicate(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
