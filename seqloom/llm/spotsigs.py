"""SpotSigs fingerprints from DataFrame functions alone: chains of content words that follow common-word anchors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

# Common words of English, French, German and Spanish that serve as anchors.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his i if in into is it its not of on or our she so some than that the "
    "their them then there these they this to was we were what when which who will with would you your "
    "au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas plus pour que qui "
    "sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei bis das dass dem den der die du durch ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht "
    "noch oder sich sie sind so um und von vor war wie wir zu zum zur "
    "al como con del el ella ellos entre era es esta este fue ha hay las lo los más me mi muy no nos o para pero por sin sobre su sus también "
    "tiene todo y ya"
).split()
#: Content words in a chain.
CHAIN = 3
#: Text bytes of a range of neighbouring ids, and the most ranges (their bounds stand in the plan).
RANGE_BYTES, MOST_RANGES = 24 << 20, 4_096
#: Tables and lists hold no common words: one content word in so many, by its hash, is an anchor for the chain that it begins.
RARER = 8
_GLUE = "\x01"


def with_signatures(rows: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """rows plus `out`: the sorted distinct 32-bit spot signatures of the whole text.

    Words are runs of letters and digits, lower-cased. A run of anchor words and the `chain` content words after it
    make a signature; so does a chain whose first word counts as an anchor by its hash. A text without an anchored whole
    chain (null and empty ones too) has one signature, of all its words, so it equals only itself."""
    keep = rows.columns
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    step = rows.select(*keep, words.alias("_words"))
    marked = F.array_join(F.transform("_words", lambda w: F.when(w.isin(sorted(set(ANCHORS))), F.concat(F.lit(_GLUE), w, F.lit(_GLUE))).otherwise(F.concat(w, F.lit(" ")))), "")
    # a token is a content word with the anchors before it glued on; what ends the text may be empty
    step = step.select(*keep, "_words", F.split(marked, " ").alias("_tokens"))
    step = step.select(*keep, "_words", "_tokens", F.transform("_tokens", lambda t: F.substring_index(t, _GLUE, -1)).alias("_content"))
    after = F.slice("_content", 2, F.size("_content"))
    for i in range(3, chain + 1):
        after = F.zip_with(after, F.slice("_content", i, F.size("_content")), lambda a, b: F.concat(a, F.lit(" "), b))
    step = step.select(*keep, "_words", "_tokens", after.alias("_after"))
    full = lambda b: b.isNotNull() & ~b.endswith(" ") & (b != "")
    chosen = lambda xs: F.array_sort(F.array_distinct(F.filter(xs, lambda s: s.isNotNull())))
    own = lambda a: F.pmod(F.hash(F.substring_index(a, _GLUE, -1)), F.lit(RARER)) == 0
    spots = F.zip_with("_tokens", "_after", lambda a, b: F.when(full(b) & (a.startswith(_GLUE) | own(a)), F.hash(a, b)))
    step = step.select(*keep, "_words", chosen(spots).alias(out))
    return step.select(*keep, F.when(F.size(out) > 0, F.col(out)).otherwise(F.array(F.hash(F.array_join("_words", " "), F.lit("whole text")))).alias(out))


def as_text(signatures: str) -> Column:
    """The signature set as hexadecimal digits, eight a signature."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: str, b: str, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets. With a bound, sets are partitioned by length so that only sets of the
    same or neighbouring partitions can reach it; other pairs, and those whose lengths rule the bound out, are pruned
    to 0 before any element is compared."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    exact = shared / (F.size(a) + F.size(b) - shared)
    if at_least <= 0:
        return exact
    part = lambda c: F.floor(F.log(F.size(c).cast("double")) / math.log(1 / at_least)) if at_least < 1 else F.size(c)
    reach = (F.abs(part(a) - part(b)) <= 1) & (F.least(F.size(a), F.size(b)) >= F.greatest(F.size(a), F.size(b)) * at_least - 1e-9)
    return F.when(reach & (exact >= at_least), exact).otherwise(0.0)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs plus next_<column> of the row after it in descending doc_id, after the last the first.

    Ids are cut into ranges of like size at their quantiles; a range is one window. The rows at the top of a range also
    visit the range above it (those of the highest the lowest) as end markers, so no window needs another's rows and
    each row is moved once. Equal ids order by text; null ids come last."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MOST_RANGES, max(2 * shuffle_partitions(docs.sparkSession), -(-size // RANGE_BYTES)))
    bounds = docs.agg(F.percentile_approx("doc_id", [(i + 1) / n for i in range(n)], 10_000).alias("b")).first().b
    bounds = sorted(set(bounds or []))
    root = max(1, math.isqrt(len(bounds)))
    coarse = bounds[root - 1 :: root]
    lists = [bounds[i : i + root] for i in range(0, len(bounds), root)] or [[]]
    fine = F.array(*(F.array(*map(F.lit, x)).cast("array<bigint>") for x in lists))
    below = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("doc_id")))
    rows = docs.withColumn("_c", F.least(below(F.array(*map(F.lit, coarse)).cast("array<bigint>")), F.lit(len(lists) - 1)))
    rows = rows.withColumn("_list", fine[F.col("_c")])
    rows = rows.withColumn("_range", F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("_c") * root + below(F.col("_list"))))
    above = F.when(F.col("_range") == len(bounds) - 1, 0).otherwise(F.col("_range") + 1)
    spot = lambda at, mark: F.struct(at.cast("int").alias("at"), F.lit(mark).alias("mark"))
    places = F.when(F.array_contains("_list", F.col("doc_id")), F.array(spot(F.col("_range"), False), spot(above, True))).otherwise(F.array(spot(F.col("_range"), False)))
    rows = rows.withColumn("_place", F.explode(places)).drop("_c", "_list", "_range")
    order = Window.partitionBy("_place.at").orderBy("_place.mark", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    after = F.lead(F.struct(*columns)).over(order)
    if not bounds:  # without any id there is one range, which ends where it starts
        after = F.coalesce(after, F.first(F.struct(*columns)).over(order))
    rows = rows.withColumn("_next", after).where("not _place.mark")
    return rows.select(*docs.columns, *(F.when(F.col("_next").isNull(), F.col(c)).otherwise(F.col("_next").getField(c)).alias(f"next_{c}") for c in columns))


def fingerprint_pairs(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Per document: its fingerprint, that of its edited text (the last third of its code points replaced by as many of
    the next document's first) and how alike they, and its and the next document's fingerprint, are. Null texts count
    as empty; every row comes back once; an empty table gives no rows; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_signatures(rows, "text", "spots", chain), ["text", "spots"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", "spots", "next_spots", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = with_signatures(rows, "edited", "edited_spots", chain)
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("spots").alias("fingerprint"), as_text("edited_spots").alias("edited_fingerprint"),
        likeness("spots", "edited_spots").alias("near_edited"), likeness("spots", "next_spots").alias("near_next"),
    )


def query(spark, sf_dir):
    from .common import read

    return fingerprint_pairs(read(spark, sf_dir, "documents"))
