"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, cut, shuffle_partitions

BYTES = 8


#: Shingle hashes that are unpacked to bits at a time.
AT_ONCE = 1 << 16


def _fingerprints(shingle: int, seed: int, words: int = 1):
    """words: 64-bit words of a fingerprint. The first takes a shingle's hash, the others mix it with their number."""
    digest = xxhash.xxh64_intdigest

    def pieces(words: list[bytes]):
        """The shingle hashes of one text, some thousands at a time."""
        if len(words) <= shingle:
            yield [digest(b" ".join(words), seed)] if words else []
            return
        for i in range(0, len(words) - shingle + 1, AT_ONCE):
            part = words[i : i + AT_ONCE + shingle - 1]
            at = [0, *np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1).tolist()]
            line = b" ".join(part)
            yield [digest(line[a : b - 1], seed) for a, b in zip(at, at[shingle:])]

    def expanded(hashes: list[int]) -> np.ndarray:
        h = np.array(hashes, np.uint64)[:, None]
        if words > 1:
            h = h + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h[:, 1:] = (h[:, 1:] ^ (h[:, 1:] >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h[:, 1:] = (h[:, 1:] ^ (h[:, 1:] >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h[:, 1:] ^= h[:, 1:] >> np.uint64(31)
        return np.ascontiguousarray(h.astype(">u8")).view(np.uint8)

    def run(batches):
        for batch in (b.slice(i, 2_000) for b in batches for i in range(0, b.num_rows, 2_000)):
            counts, total = np.zeros((batch.num_rows, 64 * words), np.int32), np.zeros(batch.num_rows, np.int64)
            hashes, starts, rows = [], [], []

            def flush():
                bits = np.unpackbits(expanded(hashes), axis=1)
                np.add.at(counts, rows, np.add.reduceat(bits, starts, axis=0, dtype=np.int32))
                hashes.clear(), starts.clear(), rows.clear()

            for i, text in enumerate(batch.column(1)):
                for some in pieces((text.as_py() or b"").lower().split()):
                    if some:
                        starts.append(len(hashes))
                        rows.append(i)
                        hashes.extend(some)
                        total[i] += len(some)
                    if len(hashes) * words >= AT_ONCE:
                        flush()
            if hashes:
                flush()
            packed = np.packbits(2 * counts.astype(np.int64) > total[:, None], axis=1)
            fp = pa.array([r.tobytes() for r in packed], pa.binary()) if words > 1 else pa.array(packed.view(">u8").ravel().astype(np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp, pa.array(total)], ["doc_id", "fp", "n_shingles"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, fp long, n_shingles) over the word shingles of every whole text, A-Z lower-cased. Texts with fewer words
    than a shingle count as one shingle; null texts and texts without words have fingerprint zero."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _fingerprints(shingle, seed), "doc_id long, fp long, n_shingles long"
    )


def covering(size: int, least: int) -> list[tuple[int, ...]]:
    """Sets of `size` byte positions such that any `least` positions hold one of them, chosen greedily."""
    goals, chosen = {frozenset(c) for c in combinations(range(BYTES), least)}, []
    while goals:
        best = max(combinations(range(BYTES), size), key=lambda c: sum(g.issuperset(c) for g in goals))
        chosen.append(best)
        goals = {g for g in goals if not g.issuperset(best)}
    return chosen


def _linked(rest: np.ndarray, one: np.uint64, most: int) -> np.ndarray:
    """Which of `rest` link to `one`: count filter on shared positional bytes, then verification bit by bit."""
    x = rest ^ one
    tally = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    near = np.flatnonzero(tally >= BYTES - most)
    return near[np.bitwise_count(x[near]) <= most]


def _connected(rest: np.ndarray, most: int) -> list[np.ndarray]:
    """The connected groups (two members at least) among some distinct fingerprints."""
    groups = []
    while len(rest):
        group, todo, rest = [rest[0]], [rest[0]], rest[1:]
        while todo and len(rest):
            near = _linked(rest, todo.pop(), most)
            if len(near):
                group += list(rest[near])
                todo += list(rest[near])
                rest = np.delete(rest, near)
        if len(group) > 1:
            groups.append(np.array(group, np.uint64))
    return groups


def _posting_stars(fps: np.ndarray, most: int, shared: int, leaf: int = 512) -> list[np.ndarray]:
    """Connected groups that hold every link among the distinct fingerprints of one posting list, whose members share
    `shared` positional bytes. A list above `leaf` becomes a list for each further byte at each other position: a link
    shares BYTES - most bytes, so it stands in one of them."""
    if len(fps) <= leaf or shared >= BYTES - most:
        return _connected(fps, most)
    groups, octets = [], fps.view(np.uint8).reshape(-1, BYTES)
    agree = (octets == octets[0]).all(axis=0)
    if agree.sum() >= BYTES - most:  # the list can't be told apart by what its links must share
        return _connected(fps, most)
    for p in np.flatnonzero(~agree):
        order = np.argsort(octets[:, p], kind="stable")
        cuts = np.flatnonzero(np.diff(octets[order, p])) + 1
        for part in np.split(fps[order], cuts):
            if len(part) > 1:
                groups += _posting_stars(part, most, int(agree.sum()) + 1, leaf)
    return groups


def _edges(most: int, shared: int):
    def edges_of(key: np.ndarray, fp: np.ndarray):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        many = ends - starts > 1
        for a, b in zip(starts[many], ends[many]):
            for group in _posting_stars(fp[a:b].astype(np.int64).view(np.uint64), most, shared):
                signed = group.view(np.int64)
                low = signed.min()
                yield from ((low, x) for x in signed if x != low)

    def run(frames):
        """The rows come sorted by key; a posting list may go on in the next frames."""
        rest: list[tuple] = []
        for frame in frames:
            key, fp = frame["key"].to_numpy(), frame["fp"].to_numpy()
            if not len(key):
                continue
            last = np.searchsorted(key, key[-1])
            if last or rest and rest[0][0][0] != key[0]:
                key_of, fp_of = (np.concatenate(x) for x in zip(*rest, (key[:last], fp[:last])))
                yield pd.DataFrame(list(edges_of(key_of, fp_of)), columns=["src", "dst"], dtype="int64")
                rest = []
            rest.append((key[last:], fp[last:]))
        if rest:
            yield pd.DataFrame(list(edges_of(*(np.concatenate(x) for x in zip(*rest)))), columns=["src", "dst"], dtype="int64")

    return run


def links(distinct: DataFrame, most: int = 3) -> DataFrame:
    """Links (src, dst) between distinct fingerprints that connect every pair at `most` or fewer differing bits.

    Two such fingerprints share at least 8 - most of their 8 positional bytes. Postings are kept for sets of four
    positional bytes (with more differing bits, of fewer) chosen so that any 8 - most positions hold one of the sets:
    single-byte postings would hold a 256th of all documents each; a list that is still long is split by a further byte
    as long as its links must share one. In a posting list, the shared positional bytes of a
    pair are tallied, pairs below the guaranteed minimum go, the others are verified. A list gives a star per connected
    group, not its pairs, so thousands of near copies cost as many rows as there are copies.
    """
    size = min(4, BYTES - most)
    sets = covering(size, BYTES - most)
    byte = lambda i: F.shiftrightunsigned(F.col("fp"), 8 * i).bitwiseAND(F.lit(255).cast("long"))
    packed = lambda c: sum((F.shiftleft(byte(p), 8 * j) for j, p in enumerate(c)), F.lit(0).cast("long"))
    keys = F.array(*(packed(c) + F.lit(i << 40).cast("long") for i, c in enumerate(sets)))
    postings = distinct.select("fp", F.explode(keys).alias("key"))
    n = shuffle_partitions(distinct.sparkSession)
    return postings.repartition(n, "key").sortWithinPartitions("key", "fp").mapInPandas(_edges(most, size), "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, most: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, n_shingles, component_id): documents whose fingerprints differ in `most` or fewer bits link, a
    component's id is its smallest doc_id. Every row of docs comes back once, repeated rows too; equal texts share
    their fingerprint and so their component. A row without an id belongs to a component like any other, but a component
    of such rows alone has no id; an empty table gives no rows. Other columns are ignored."""
    prints = cut(fingerprints(docs, shingle, seed))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = connected_components(links(first.select("fp"), most))
    member = first.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = member.groupBy("component").agg(F.min("first").alias("component_id"))
    of = member.join(least, "component").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_shingles", "component_id")


#: Min-hash keys of a text and least hashes in a key: a pair of similarity 0.8 shares no key with probability 1.3e-7.
BANDS, ROWS = 40, 5
#: Texts of a block; the blocks of a list are compared two by two, so that a task holds two at most.
BLOCK = 1_000


def _shingles(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    words = text.lower().split()
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    at = [0, *np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()]
    line = b" ".join(words)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a : b - 1], seed) for a, b in zip(at, at[shingle:])), np.uint64))


def _least_keys(shingle: int, seed: int):
    """Per text, the hash of its shingle set (node) and its min-hash keys; a set without shingles has no keys."""
    rng = np.random.default_rng(seed)
    salt, odd = (rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
    odd |= np.uint64(1)
    number = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def keys(h: np.ndarray) -> np.ndarray:
        least = np.full(BANDS * ROWS, ~np.uint64(0))
        for i in range(0, len(h), 1024):
            least = np.minimum(least, ((h[i : i + 1024] ^ salt) * odd).min(axis=1))
        key = number.copy()
        for column in least.reshape(BANDS, ROWS).T:
            key = (key ^ column) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
        return key.view(np.int64)

    def run(batches):
        for batch in (b.slice(i, 2_000) for b in batches for i in range(0, b.num_rows, 2_000)):
            node, found = [], []
            for text in batch.column(2):
                h = _shingles(text.as_py() or b"", shingle, seed)
                node.append(xxhash.xxh64_intdigest(h.tobytes(), seed))
                found.append(keys(h) if len(h) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), lists], ["doc_id", "code", "node", "keys"])

    return run


def _sets(shingle: int, seed: int):
    def run(batches):
        for b in batches:
            found = [_shingles(t.as_py() or b"", shingle, seed).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    return run


def _verified(similarity: float):
    """Which pairs (src, dst, shingles of both) are alike."""

    def alike(one: bytes, other: bytes) -> bool:
        a, b = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
        if min(len(a), len(b)) < similarity * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / (len(a) + len(b) - both) >= similarity

    def run(batches):
        for b in batches:
            keep = [alike(x.as_py(), y.as_py()) for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return run


def _cross_links(similarity: float):
    """Links between the components that meet in two blocks of a list (or in one): every pair of texts that are not
    linked yet is compared by its whole shingle sets."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        node, label, block = (frame[c].to_numpy().copy() for c in ("node", "label", "block"))
        sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
        sizes = np.array([len(s) for s in sets])
        starts = np.cumsum(sizes) - sizes
        words, at = np.unique(np.concatenate(sets), return_inverse=True)
        names, counts = np.unique(label, return_counts=True)
        apart, out = frame["p"].iloc[0] != frame["q"].iloc[0], []
        marked = np.zeros(len(words), bool)
        for i in np.flatnonzero(label != names[counts.argmax()]):
            wanted = (label != label[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]))
            if apart:
                wanted &= block != block[i]
            if not wanted.any():
                continue
            own = at[starts[i] : starts[i] + sizes[i]]
            marked[own] = True
            both = np.add.reduceat(marked[at], starts, dtype=np.int64)
            marked[own] = False
            for j in np.flatnonzero(wanted & (both / (sizes + sizes[i] - both) >= similarity)):
                if label[i] != label[j]:
                    out.append((node[i], node[j]))
                    label[label == label[j]] = label[i]
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    return run


def _members(docs: DataFrame, shingle: int, similarity: float, seed: int) -> DataFrame:
    """(doc_id, code: a hash of the text, first: the least (doc_id, code) of the component) of all rows with an id."""
    code = F.xxhash64("text")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), code.alias("code"), F.col("text").cast("binary").alias("text"))
    prints = cut(texts.mapInArrow(_least_keys(shingle, seed), "doc_id long, code long, node long, keys array<long>"))
    first = cut(prints.groupBy("node").agg(F.min(F.struct("doc_id", "code")).alias("first")))

    # groups of the SimHash operator; texts are known by their code, those without shingles aren't compared
    groups = near_duplicates(texts.select(F.col("code").alias("doc_id"), "text"), shingle, seed=seed)
    groups = groups.select(F.col("doc_id").alias("code"), F.col("component_id").alias("key")).distinct()
    grouped = prints.where(F.size("keys") > 0).select("code", "node").distinct().join(groups, "code").select("node", "key")

    # lists: the distinct sets that share a key or a group
    list_of = Window.partitionBy("key")
    postings = prints.select("node", "keys").distinct().select("node", F.explode("keys").alias("key")).union(grouped).distinct()
    lists = postings.select("key", "node", F.min("node").over(list_of).alias("low"), F.count("*").over(list_of).alias("n"))
    lists = cut(lists.where("n > 1"))
    some = first.join(lists.select("node").distinct(), "node").select("node", "first.doc_id", "first.code")
    sets = texts.join(some, ["doc_id", "code"]).select("node", "text").mapInArrow(_sets(shingle, seed), "node long, shingles binary")
    sets = cut(sets.distinct())

    # every text of a list against the list's first
    pairs = lists.where("node <> low").select(F.col("low").alias("src"), F.col("node").alias("dst")).distinct()
    side = lambda c, name: sets.select(F.col("node").alias(c), F.col("shingles").alias(name))
    pairs = pairs.join(side("src", "one"), "src").join(side("dst", "other"), "dst").select("src", "dst", "one", "other")
    links = cut(pairs.mapInArrow(_verified(similarity), "src long, dst long"))
    labels = connected_components(links)

    # lists that are still several components: all pairs across them, equal lists once
    long = lists.where("n > 2").join(labels, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("label"))
    long = cut(long)
    mixed = long.groupBy("key", "n").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.bit_xor(F.xxhash64("node")).alias("all")).where("a < b")
    mixed = mixed.groupBy("all", "n").agg(F.min("key").alias("key")).select("key")
    blocks = F.ceil(F.col("n") / BLOCK)
    rest = long.join(mixed, "key").select("key", "node", "label", F.pmod(F.xxhash64("node"), blocks).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    rest = rest.select("key", "node", "label", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    more = rest.join(sets, "node").groupBy("key", "p", "q").applyInPandas(_cross_links(similarity), "src long, dst long")

    component = connected_components(links.union(more))
    of = first.join(component, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    least = of.groupBy("component").agg(F.min("first").alias("least"))
    of = of.join(least, "component").select("node", F.col("least").alias("first"))
    return prints.select("doc_id", "code", "node").join(of, "node").select("doc_id", "code", "first")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """(doc_id, component_id): documents whose sets of word shingles have a Jaccard similarity of `similarity` or more
    link; a component's id is its smallest doc_id.

    Candidates are the groups of near_duplicates(), whose fingerprints link at three or fewer bits, and texts that share
    one of 40 keys, each made of five least hashes: fingerprints of texts alike by 0.8 mostly differ in more bits. Every text of such a list is compared with the list's
    first by the whole sets; where that leaves a list in several components, all pairs across them are compared. So no
    pair below the bound links, and one at 0.8 isn't met with probability 1.3e-7. Texts with fewer words than a shingle
    count as one. Null texts and texts without words link to one another; repeated rows come back as often as they stand;
    rows without an id have no component."""
    found = _members(docs, shingle, similarity, seed).select("doc_id", F.col("first.doc_id").alias("component_id"))
    none = docs.where("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("component_id"))
    return found.union(none)


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """One document of each component of similar_documents() stays: its smallest doc_id, of rows that share an id the one
    with the least hash of its text. Rows that repeat id and text are one document; rows without an id stay."""
    gone = _members(docs, shingle, similarity, seed).where("doc_id <> first.doc_id or code <> first.code")
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("code").alias("_code")).distinct()
    same = (docs["doc_id"].cast("long") == gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_code"])
    return docs.join(gone, same, "left_anti").select(docs.columns)


def query(spark, sf_dir):
    from .common import read

    return near_duplicates(read(spark, sf_dir, "documents"), shingle=3).select("doc_id", "fingerprint", "component_id")
