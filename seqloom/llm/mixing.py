"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Divisors that one pass over the sources tries; the range of the divisor shrinks by this factor a pass.
DIVISORS = 64
#: A source is split into shards of about so many tokens, MOST_SHARDS at most (the shards of one source meet in one task).
SHARD_TOKENS, MOST_SHARDS = 1 << 17, 1 << 16


def sainte_lague(weights, seats: int, caps) -> np.ndarray:
    """Seats by the highest quotients w / (2 s + 1), ties to the earlier party, no party above its cap."""
    w, caps = np.asarray(weights, float), np.asarray(caps, np.int64)
    seats = int(min(seats, caps[w > 0].sum()))
    if seats <= 0:
        return np.zeros(len(w), np.int64)
    given = lambda d: np.minimum(caps, np.floor(w / d + 0.5).astype(np.int64))
    high, low = 4 * w.max() + 1, w[w > 0].min() / (2.0 * caps.max() + 2)
    for _ in range(200):  # a divisor that gives no more than the seats
        mid = (low * high) ** 0.5
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
    out = given(high)
    heap = [(-w[i] / (2 * out[i] + 1), i) for i in range(len(w)) if w[i] > 0 and out[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-w[i] / (2 * out[i] + 1), i))
    return out


def capped_targets(sources: DataFrame, total: float, most: float) -> DataFrame:
    """sources plus `target`: shares of the total by weight; what exceeds most * tokens is shared again by weight until
    none is above. A pass over the sources settles all that the present share per weight fills; it takes as many passes
    as the fill level rises."""
    cap, level, over = F.col("tokens") * float(most), -1.0, F.lit(False)
    while True:
        free, full = sources.agg(F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, cap))).first()
        raised = (float(total) - (full or 0.0)) / free if free else float("inf")
        if raised <= level or not free:
            break
        level, over = raised, F.lit(raised) * F.col("weight") >= cap
    return sources.withColumn("target", F.when(over, cap).otherwise(F.lit(level) * F.col("weight")))


def apportion(sources: DataFrame, seats: int, block_tokens: int, most: int) -> DataFrame:
    """sources plus `quota`: `seats` blocks by the highest quotients target / (2 s + 1), ties to the earlier source, no
    source above `most` times its own blocks. Passes over the sources close in on the divisor; the seats that are left
    between its bounds are few and go by the quotients themselves. No table of the sources leaves the executors."""
    cap = F.ceil(F.col("tokens") / block_tokens) * most
    given = lambda d: F.floor(F.least(cap.cast("double"), F.col("target") / F.lit(d) + 0.5)).cast("long")
    top, least, room = sources.where("target > 0").agg(F.max("target"), F.min("target"), F.sum(cap)).first()
    seats = min(seats, room or 0)
    if seats <= 0:
        return sources.withColumn("quota", F.lit(0).cast("long"))
    low, high = least / (2.0 * (room + 1)), 4 * top + 1
    for _ in range(12):
        tried = np.geomspace(low, high, DIVISORS + 1)[1:-1].tolist()
        sums = sources.agg(*(F.sum(given(d)) for d in tried)).first()
        above = sum(x > seats for x in sums)
        low, high = [low, *tried, high][above], [low, *tried, high][above + 1]
        some = sums[above] if above < len(tried) else 0
        if seats - some <= DIVISORS:
            break
    left = seats - (sources.agg(F.sum(given(high))).first()[0] or 0)
    next_ones = F.sequence(given(high), F.least(given(low), given(high) + F.lit(left)) - 1)
    quotients = sources.where(given(low) > given(high)).select("src", "target", F.explode(next_ones).alias("s"))
    won = quotients.orderBy((F.col("target") / (2 * F.col("s") + 1)).desc(), "src", "s").limit(int(left)).groupBy("src").agg(F.count("*").alias("won"))
    return sources.join(won, "src", "left").withColumn("quota", given(high) + F.coalesce("won", F.lit(0))).drop("won")


def numbered_sources(sized: DataFrame, weights) -> DataFrame:
    """(src, source_name, tokens, weight) of the sources by code point, null last: ranges of names are numbered each for
    itself, after the counts of the ranges before."""
    spark = sized.sparkSession
    each = sized.groupBy("source").agg(F.sum("size").alias("tokens"))
    ranged = each.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranged = cut(ranged.select("source", "tokens", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    counts = sorted((r.part, r["count"]) for r in ranged.groupBy("part").count().collect())  # a row per range
    before, n = {}, 0
    for part, count in counts:
        before[part], n = n, n + count
    offsets = spark.createDataFrame(list(before.items()), "part int, before long")
    src = F.col("place") + F.col("before")
    weight = F.array(*map(F.lit, weights))[(src % len(weights)).cast("int")].cast("double")
    return ranged.join(F.broadcast(offsets), "part").select(src.alias("src"), F.col("source").alias("source_name"), "tokens", weight.alias("weight"))


def _shard_quotas(block_tokens: int, most: int):
    def quotas(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard")
        n = -(-shards.tokens.to_numpy() // block_tokens)
        q = sainte_lague(shards.tokens.to_numpy(), int(shards.quota.iloc[0]), n * most)
        return pd.DataFrame({"src": shards.src, "shard": shards.shard, "n": n, "q": q})

    return quotas


def mix(docs: DataFrame, weights=(1, 2, 3), most: int = 3, block_tokens: int = 16, seed: int = 7, keep: tuple = ()) -> DataFrame:
    """One row per document with what the mix takes of it.

    Sources (null last) weigh by the repeating `weights` and share all tokens; a target stops at `most` times its
    source. The target is apportioned in blocks of block_tokens tokens: first to the sources by the highest quotients,
    then to the shards of each source. A shard lays its documents out in seeded order; a quota of q of its n blocks
    takes q // n whole passes and a run of q % n blocks from a seeded start, so only the documents at both ends of a
    run are taken in part. Returns doc_id, size, source_size, target, taken, passes (whole copies), cut_from and cut_to
    (the run's words in the document, up to two stretches), and the columns named in `keep` under `kept`.

    Sources may be of any number: they are numbered, filled and apportioned in Spark. Shard and order of a document
    follow from a hash of its id and text, so null and repeated ids spread. Null texts and texts without words have size
    0 and are never taken; a null doc_id is an id like any other; repeated rows are documents of their own; an empty table gives no rows. Other columns are ignored.
    """
    sized = docs.select(
        F.col("doc_id"), F.xxhash64("doc_id", "text").alias("code"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *([F.struct(*keep).alias("kept")] if keep else []),
    )
    if not keep:
        sized = cut(sized)
    sources = cut(numbered_sources(sized, weights))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    table = capped_targets(sources, total, most) if total else sources.withColumn("target", F.lit(0.0))
    table = apportion(cut(table), round(total / block_tokens), block_tokens, most)
    shards = F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("tokens") / SHARD_TOKENS))).cast("int")
    table = cut(table.select("src", "source_name", F.col("tokens").alias("source_size"), "target", "quota", shards.alias("shards")))
    rows = sized.join(table, F.col("source").eqNullSafe(F.col("source_name"))).withColumn("shard", F.pmod(F.xxhash64("code", F.lit(seed)), F.col("shards")).cast("int"))
    per_shard = (
        rows.groupBy("src", "shard").agg(F.sum("size").alias("tokens"), F.first("quota").alias("quota"))
        .groupBy("src").applyInPandas(_shard_quotas(block_tokens, most), "src long, shard int, n long, q long")
    )
    laid = Window.partitionBy("src", "shard").orderBy(F.xxhash64("code", F.lit(seed + 1)), "code", "doc_id", "size")
    end = F.sum("size").over(laid.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", end).join(per_shard, ["src", "shard"])
    b = F.lit(block_tokens)
    start, run = F.pmod(F.xxhash64(F.lit(seed), "src", "shard"), F.greatest("n", F.lit(1))), F.col("q") % F.greatest("n", F.lit(1))
    begin = F.col("end") - F.col("size")
    clip = lambda x: F.least(F.greatest(x - begin, F.lit(0)), F.col("size"))  # noqa: E731  a token place of the shard, in the document
    first = (clip(F.least(start + run, F.col("n")) * b), clip(start * b))
    second = clip(F.greatest(start + run - F.col("n"), F.lit(0)) * b)
    passes = F.floor(F.col("q") / F.greatest("n", F.lit(1)))
    return rows.select(
        "doc_id", "size", "source_size", "target", (passes * F.col("size") + first[0] - first[1] + second).cast("long").alias("taken"),
        passes.cast("int").alias("passes"), F.array(F.lit(0).cast("long"), first[1].cast("long")).alias("cut_from"), F.array(second.cast("long"), first[0].cast("long")).alias("cut_to"),
        *(["kept"] if keep else []),
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents, with the columns of `docs`: a row for every whole copy that is taken and one for the words
    that a run takes of a document at its end (white space between those words stays)."""
    rows = mix(docs, keep=tuple(docs.columns), **how)
    part = F.col("taken") - F.col("passes") * F.col("size")
    whole = F.col("passes") + F.when((F.col("size") > 0) & (part == F.col("size")), 1).otherwise(0)
    words = F.regexp_extract_all(F.col("kept.text"), F.lit(r"([^\x20\x09-\x0D]++[\x20\x09-\x0D]*+)"), F.lit(1))
    piece = lambda i: F.array_join(F.slice(words, (F.col("cut_from")[i] + 1).cast("int"), (F.col("cut_to")[i] - F.col("cut_from")[i]).cast("int")), "")
    text = F.when(F.col("copy") > whole, F.concat(piece(0), piece(1))).otherwise(F.col("kept.text"))
    out = rows.withColumn("copies", whole + F.when((part > 0) & (part < F.col("size")), 1).otherwise(0)).where("copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    names = {c: F.col("kept").getField(c) for c in docs.columns} | {"text": text}
    if "n_chars" in names:
        names["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*(x.alias(c) for c, x in names.items()))


def query(spark, sf_dir):
    from .common import read

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
