"""How filters interact: what every filter removes in every order of all filters, per part of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: Salts that rows without an id are dealt to before the join on ids.
SALTS = 1024


def failures(text: Column) -> dict[str, Column]:
    """What fails filters A to D; the text isn't null. Words are maximal runs of [^\\x20\\x09-\\x0D], case-sensitive."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)) * 100 < n * 50,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 2,
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by source (null: empty string) and by the filters A to E that they fail,
    bit 0 for A to bit 4 for E; how many of them have a label quality = 1, and toxic = 1.

    Only ids, digests and bits leave a text's task. E needs the smallest id of a text: that is a partial aggregate by
    digest (SHA-256), joined back on digest and id together, so a text that a third of all rows hold is dealt out by
    its ids. Rows that repeat id, text and source are summed before the joins; rows without an id are salted.
    Null texts count as empty. A null id has no smaller one and is smaller than none, so it never fails E and has no
    labels. A document with several label rows is good, or toxic, if one of them says so.
    """
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(fails, F.lit(1 << i)).otherwise(0) for i, fails in enumerate(failures(text).values())), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), bits.alias("bits"))
    rows = cut(rows.groupBy("id", "sha", "part", "bits").count())
    first = rows.where("id IS NOT NULL").groupBy("sha").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    repeated = F.col("id").isNotNull() & F.col("is_first").isNull()
    rows = rows.join(first, ["sha", "id"], "left").withColumn("mask", F.col("bits") + F.when(repeated, 16).otherwise(0))

    said = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = said.where("good OR toxic").groupBy("id").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("good", "toxic")))
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("sha"), F.lit(SALTS)).cast("int")).otherwise(0)
    rows = rows.withColumn("salt", spread).join(said.withColumn("salt", F.lit(0)), ["id", "salt"], "left")
    n = F.col("count")
    return rows.groupBy("part", "mask").agg(F.sum(n).alias("n"), *(F.coalesce(F.sum(F.when(F.col(c), n)), F.lit(0).cast("long")).alias(c) for c in ("good", "toxic")))


#: Every recursion level extends each part's prefixes by the letters that they lack and reads that step's metrics from
#: the part's mask cells (2 ^ filters at most, one row per part). `applied` carries the bits of the prefix. A prefix of
#: length k stands for (filters - k)! full orders: shapley weighs its removals so, and the last join unfolds it.
_SQL = """
WITH RECURSIVE
orders(filter_order) AS (
  SELECT ''
  UNION ALL
  SELECT concat(o.filter_order, l) FROM orders o LATERAL VIEW explode(filter({letters}, l -> NOT contains(o.filter_order, l))) AS l),
steps AS (
  SELECT filter_order, step, left(filter_order, step) AS prefix
  FROM orders LATERAL VIEW explode(sequence(1, {k})) AS step WHERE length(filter_order) = {k}),
walk(part, prefix, applied, step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, 0, '', 0L, 0L, 0L, 0L, 0L, 0L FROM {cells}
  UNION ALL
  SELECT part, concat(prefix, added), applied | bit, step + 1, added,
    aggregate(cells, 0L, (s, c) -> s + if(c.mask & (applied | bit) = 0, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if(c.mask & applied = 0 AND c.mask & bit <> 0, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if(c.mask & applied <> 0 AND c.mask & bit <> 0, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if(c.mask = bit, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if(c.mask & applied = 0 AND c.mask & bit <> 0, c.good, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if(c.mask & applied = 0 AND c.mask & bit <> 0, c.toxic, 0L))
  FROM (
    SELECT w.part, w.prefix, w.applied, w.step, added, shiftleft(1, ascii(added) - 65) AS bit, c.cells
    FROM walk w JOIN {cells} c ON w.part = c.part
    LATERAL VIEW explode(filter({letters}, l -> NOT contains(w.prefix, l))) AS added)),
every AS (SELECT * FROM walk LIMIT ALL),
weighed AS (
  SELECT *, sum(removed * factorial({k} - step)) OVER (PARTITION BY part, letter) AS shapley FROM every WHERE step > 0)
SELECT /*+ BROADCAST(s) */ w.part, s.filter_order, w.step, w.kept, w.removed, w.redundant, w.unique_fails, w.good_lost, w.toxic_lost, w.shapley
FROM weighed w JOIN steps s ON w.prefix = s.prefix
"""


def audit(cells: DataFrame, filters: int = 5) -> DataFrame:
    """Every order of the filters (letters from A) on every part: one row per part, order and step with the documents
    kept after the step, removed in it, redundant (failing its filter, removed earlier), failing its filter only, good
    and toxic ones removed in it, and removed by its filter summed over all orders.

    cells: (part, mask, n, good, toxic), as cells() gives them; masks that stand more than once are summed. No cells give
    no rows. The orders are enumerated by a recursive common table expression over the parts; a part has one row there
    for every prefix of an order, so the row limit that Spark puts on recursions is lifted in the statement itself.
    """
    spark = cells.sparkSession
    by_mask = cells.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    by_part = cut(by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")))
    letters = "array(" + ", ".join(f"'{chr(65 + i)}'" for i in range(filters)) + ")"
    sql = _SQL.replace("{letters}", letters).replace("{k}", str(filters))
    return spark.sql(sql, cells=by_part)


def query(spark, sf_dir):
    from .common import read

    return audit(cells(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


ORACLE = r"""
WITH RECURSIVE
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS lo FROM t),
g AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
m AS (
  SELECT w.part, coalesce(g.good, false) AS good, coalesce(g.toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > lo THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN g ON w.doc_id = g.doc_id),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
o AS (
  SELECT '' AS s, 0 AS bits
  UNION ALL SELECT o.s || f.letter, o.bits | f.bit FROM o JOIN f ON o.bits & f.bit = 0),
p AS (
  SELECT o.s AS filter_order, CAST(k AS INTEGER) AS step, f.letter, f.bit,
    (SELECT sum(b.bit) FROM f b WHERE contains(left(o.s, CAST(k AS INTEGER) - 1), b.letter)) AS before
  FROM o, range(1, 6) r(k), f WHERE length(o.s) = 5 AND f.letter = substr(o.s, CAST(k AS INTEGER), 1)),
q AS (SELECT filter_order, step, letter, bit, CAST(coalesce(before, 0) AS INTEGER) AS before FROM p),
a AS (
  SELECT m.part, q.filter_order, q.step, q.letter,
    count(*) FILTER (WHERE mask & (before | bit) = 0) AS kept,
    count(*) FILTER (WHERE mask & before = 0 AND mask & bit <> 0) AS removed,
    count(*) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0) AS redundant,
    count(*) FILTER (WHERE mask = bit) AS unique_fails,
    count(*) FILTER (WHERE mask & before = 0 AND mask & bit <> 0 AND good) AS good_lost,
    count(*) FILTER (WHERE mask & before = 0 AND mask & bit <> 0 AND toxic) AS toxic_lost
  FROM m, q GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM a
"""
