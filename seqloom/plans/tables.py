"""Queries of filters, joins, groupings, sets, splits and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.operators import labels as lb
from seqloom.operators import scoring as sc
from seqloom.operators import stats as st
from seqloom.sources import adapters as src

from .registry import query

LABELS = "l AS (SELECT sequence_id, subject, weight, sequence_type, coalesce(gesture, 'non_bfrb') AS gesture, coalesce(orientation, 'Unknown') AS orientation, CAST(coalesce(sequence_type = 'Target', false) AS INTEGER) AS is_target FROM sequences)"
FULL = LABELS + ", f AS (SELECT *, CASE WHEN is_target = 1 THEN gesture ELSE 'non_bfrb' END AS bfrb, split_part(gesture, '-', 1) AS gesture_position, list_last(string_split(gesture, '-')) AS gesture_action FROM l)"


def labelled(spark, d):
    return lb.with_labels(src.sequences(spark, d))


@query("f01_fill_labels", f"WITH {LABELS} SELECT sequence_id, gesture, orientation FROM l", "sequences")
def f01(spark, d):
    return labelled(spark, d).select("sequence_id", "gesture", "orientation")


@query("f02_target_flag", f"WITH {LABELS} SELECT sequence_id, is_target FROM l", "sequences")
def f02(spark, d):
    return labelled(spark, d).select("sequence_id", "is_target")


@query("f03_conditional_label", f"WITH {FULL} SELECT sequence_id, bfrb FROM f", "sequences")
def f03(spark, d):
    return labelled(spark, d).select("sequence_id", "bfrb")


@query("f04_delimited_split", f"WITH {FULL} SELECT sequence_id, gesture_position, gesture_action FROM f", "sequences")
def f04(spark, d):
    return labelled(spark, d).select("sequence_id", "gesture_position", "gesture_action")


@query("f05_in_list_filters", f"WITH {FULL} SELECT sequence_id FROM f WHERE orientation IN ('O', 'Unknown') AND gesture_position IN ('1', '5')", "sequences")
def f05(spark, d):
    return lb.candidates(labelled(spark, d), {"orientation": ["O", "Unknown"], "gesture_position": ["1", "5"], "gesture": []}).select("sequence_id")


@query("f06_target_only", f"WITH {LABELS} SELECT sequence_id FROM l WHERE is_target = 1", "sequences")
def f06(spark, d):
    return labelled(spark, d).where("is_target = 1").select("sequence_id")


@query("f07_phase_filter", "SELECT sequence_id, sequence_counter, acc_x FROM samples WHERE phase = 'click'", "samples")
def f07(spark, d):
    return src.samples(spark, d).where("phase = 'click'").select("sequence_id", "sequence_counter", "acc_x")


@query("f08_sequence_candidates", "SELECT o_orderkey AS sequence_id FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority = '2-HIGH'")
def f08(spark, d):
    o = src.table(spark, d, "orders")
    return lb.candidates(o, {"o_orderstatus": ["O", "F"], "o_orderpriority": ["2-HIGH"], "o_custkey": ["(all)"]}).select(F.col("o_orderkey").alias("sequence_id"))


@query("f09_row_candidates", "SELECT DISTINCT user_id AS sequence_id FROM events WHERE event_type = 'error' AND value > 150")
def f09(spark, d):
    return src.samples(spark, d).where("phase = 'error' and acc_x > 150").select("sequence_id").distinct()


@query("f11_drop_incomplete", "SELECT sequence_id, count(*) AS n FROM samples_gap GROUP BY 1 HAVING count(*) FILTER (acc_x IS NULL) < 8", "samples_gap")
def f11(spark, d):
    s = src.samples_gap(spark, d)
    many = s.where("acc_x is null").groupBy("sequence_id").count().where("count >= 8").select("sequence_id")
    return s.join(many, "sequence_id", "left_anti").groupBy("sequence_id").agg(F.count("*").alias("n"))


@query("f12_clip", "SELECT sequence_id, sequence_counter, least(greatest(acc_x, 10), 40) AS acc_x FROM samples3", "samples3")
def f12(spark, d):
    return src.samples3(spark, d).select("sequence_id", "sequence_counter", F.least(F.greatest("acc_x", F.lit(10.0)), F.lit(40.0)).alias("acc_x"))


@query("f15_finite", "SELECT sequence_id, sequence_counter, round(CASE WHEN acc_y IS NULL OR acc_z = 0 THEN 0 ELSE acc_y / acc_z END, 6) AS ratio FROM samples3", "samples3")
def f15(spark, d):
    s = src.samples3(spark, d).withColumn("ratio", F.try_divide("acc_y", "acc_z"))
    return st.finite(s, ["ratio"]).select("sequence_id", "sequence_counter", F.round("ratio", 6).alias("ratio"))


@query("f16_wide_to_long", "SELECT sequence_id, sequence_counter, CAST(regexp_extract(name, '_(\\d+)', 1) AS INTEGER) AS sensor, round(value, 6) + 0.0 AS value FROM (UNPIVOT thermo ON thm_1, thm_2, thm_3, thm_4, thm_5 INTO NAME name VALUE value)", "thermo")
def f16(spark, d):
    t = src.thermo(spark, d).unpivot(["sequence_id", "sequence_counter"], [f"thm_{i}" for i in range(1, 6)], "name", "value")
    return t.select("sequence_id", "sequence_counter", F.regexp_extract("name", r"_(\d+)", 1).cast("int").alias("sensor"), (F.round("value", 6) + 0.0).alias("value"))


@query("f18_composite_key", f"WITH {FULL} SELECT sequence_id, orientation || '||' || gesture_action AS composite FROM f", "sequences")
def f18(spark, d):
    return labelled(spark, d).select("sequence_id", lb.composite("||", "orientation", "gesture_action").alias("composite"))


@query("f19_age_band", "SELECT subject, CASE WHEN age <= 18 THEN 'child' WHEN age < 25 THEN 'young_adult' WHEN age >= 25 THEN 'adult' END AS band FROM subjects", "subjects")
def f19(spark, d):
    return src.subjects(spark, d).select("subject", lb.age_band(F.col("age")).alias("band"))


@query("f20_drop_impute_standardise", "WITH t AS (SELECT avg(acc_x) AS m FROM samples_gap), x AS (SELECT sequence_id, sequence_counter, coalesce(acc_x, (SELECT m FROM t)) AS x FROM samples_gap), s AS (SELECT avg(acc_x) AS m, stddev_pop(acc_x) AS s FROM samples_gap) SELECT sequence_id, sequence_counter, round((x - m) / s, 6) + 0.0 AS acc_x FROM x, s", "samples_gap")
def f20(spark, d):
    s = src.samples_gap(spark, d)
    kept = st.columns_mostly_known(s, ["acc_x"], 0.3)
    return st.standardised(s, kept).select("sequence_id", "sequence_counter", *((F.round(c, 6) + 0.0).alias(c) for c in kept))


@query("j01_left_join_subjects", "SELECT sequence_id, s.subject, age, handedness FROM sequences s LEFT JOIN subjects u ON s.subject = u.subject AND u.age < 30", "sequences subjects")
def j01(spark, d):
    return src.sequences(spark, d).join(src.subjects(spark, d).where("age < 30"), "subject", "left").select("sequence_id", "subject", "age", "handedness")


@query("j02_handedness_lookup", "SELECT sequence_id, handedness FROM sequences LEFT JOIN subjects USING (subject)", "sequences subjects")
def j02(spark, d):
    return src.sequences(spark, d).join(src.subjects(spark, d).select("subject", "handedness"), "subject", "left").select("sequence_id", "handedness")


LABEL_ROWS = "y AS (SELECT o_custkey AS subject, arg_min(o_orderpriority, o_orderkey) AS gesture FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"


def label_rows(spark, d):
    o = src.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("subject"), "o_orderkey", F.col("o_orderpriority").alias("gesture"))
    return sc.first_label(o, "subject", ["gesture"], "o_orderkey")


@query("j03_align_labels", f"WITH {LABEL_ROWS} SELECT subject, coalesce(gesture, 'non_bfrb') AS gesture FROM subjects LEFT JOIN y USING (subject)", "subjects")
def j03(spark, d):
    return sc.aligned(src.subjects(spark, d).select("subject"), label_rows(spark, d), "subject", {"gesture": "non_bfrb"})


@query("j04_align_labels_inner", f"WITH {LABEL_ROWS} SELECT subject, gesture FROM subjects JOIN y USING (subject)", "subjects")
def j04(spark, d):
    return sc.aligned(src.subjects(spark, d).select("subject"), label_rows(spark, d), "subject", {}, keep_unmatched=False)


@query("j05_semi_join", "SELECT sequence_id, subject FROM sequences WHERE subject IN (SELECT subject FROM subjects WHERE age > 40)", "sequences subjects")
def j05(spark, d):
    return src.sequences(spark, d).join(src.subjects(spark, d).where("age > 40"), "subject", "left_semi").select("sequence_id", "subject")


@query("j06_anti_join", "SELECT sequence_id, subject FROM sequences WHERE subject NOT IN (SELECT subject FROM subjects WHERE age > 12)", "sequences subjects")
def j06(spark, d):
    return src.sequences(spark, d).join(src.subjects(spark, d).where("age > 12"), "subject", "left_anti").select("sequence_id", "subject")


@query("j07_composite_lookup", f"""WITH {FULL}, k AS (SELECT orientation, gesture_action, min(gesture) AS found FROM f WHERE is_target = 1 AND orientation <> 'P' GROUP BY 1, 2), m AS (SELECT gesture FROM f WHERE is_target = 1 GROUP BY 1 ORDER BY count(*) DESC, gesture LIMIT 1)
SELECT sequence_id, CASE WHEN is_target = 0 THEN 'non_bfrb' ELSE coalesce(found, (SELECT gesture FROM m)) END AS predicted FROM f LEFT JOIN k USING (orientation, gesture_action)""", "sequences")
def j07(spark, d):
    f = labelled(spark, d)
    lookup = f.where("is_target = 1 and orientation <> 'P'").groupBy("orientation", "gesture_action").agg(F.min("gesture").alias("found"))
    modal = f.where("is_target = 1").groupBy("gesture").count().orderBy(F.desc("count"), "gesture").limit(1).first()
    out = f.join(lookup, ["orientation", "gesture_action"], "left")
    return out.select("sequence_id", F.when(F.col("is_target") == 0, "non_bfrb").otherwise(F.coalesce("found", F.lit(modal.gesture if modal else None))).alias("predicted"))


@query("j09_sequence_value_on_rows", "SELECT sequence_id, sequence_counter, round(m, 6) AS spectrum FROM samples JOIN (SELECT sequence_id, avg(acc_x * acc_x) AS m FROM samples GROUP BY 1) USING (sequence_id)", "samples")
def j09(spark, d):
    s = src.samples(spark, d)
    return s.select("sequence_id", "sequence_counter", F.round(F.avg(F.col("acc_x") * F.col("acc_x")).over(Window.partitionBy("sequence_id")), 6).alias("spectrum"))


@query("g01_count_distinct", f"WITH {FULL} SELECT bfrb, count(DISTINCT subject) AS subjects, count(DISTINCT sequence_id) AS sequences FROM f GROUP BY 1", "sequences")
def g01(spark, d):
    return labelled(spark, d).groupBy("bfrb").agg(F.count_distinct("subject").alias("subjects"), F.count_distinct("sequence_id").alias("sequences"))


@query("g02_value_counts", "SELECT phase, count(*) AS n FROM samples GROUP BY 1", "samples")
def g02(spark, d):
    return src.samples(spark, d).groupBy("phase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phase")


@query("g03_named_aggregates", "SELECT subject, count(*) AS n, count(DISTINCT orientation) AS orientations, arg_min(weight, sequence_id) AS first_weight, list_sort(list(DISTINCT sequence_type))[1] AS first_type FROM sequences GROUP BY 1", "sequences")
def g03(spark, d):
    return src.sequences(spark, d).groupBy("subject").agg(F.count("*").alias("n"), F.count_distinct("orientation").alias("orientations"), F.min_by("weight", "sequence_id").alias("first_weight"), F.array_sort(F.collect_set("sequence_type"))[0].alias("first_type"))


@query("g04_two_dimensions", "SELECT handedness, CASE WHEN age <= 18 THEN 'child' WHEN age < 25 THEN 'young_adult' ELSE 'adult' END AS band, count(DISTINCT subject) AS n, array_to_string(list_sort(list(DISTINCT sex)), ',') AS sexes FROM subjects GROUP BY 1, 2", "subjects")
def g04(spark, d):
    return src.subjects(spark, d).groupBy("handedness", lb.age_band(F.col("age")).alias("band")).agg(F.count_distinct("subject").alias("n"), F.array_join(F.array_sort(F.collect_set("sex")), ",").alias("sexes"))


@query("g05_having", "SELECT sequence_id, count(DISTINCT behavior) AS kinds FROM samples3 GROUP BY 1 HAVING count(DISTINCT behavior) > 2", "samples3")
def g05(spark, d):
    return src.samples3(spark, d).groupBy("sequence_id").agg(F.count_distinct("behavior").alias("kinds")).where("kinds > 2")


@query("g06_dimension_consistency", "SELECT CAST(sum(CASE WHEN a > 1 THEN 1 ELSE 0 END) AS BIGINT) AS varying_orientation, CAST(sum(CASE WHEN b > 1 THEN 1 ELSE 0 END) AS BIGINT) AS varying_type FROM (SELECT count(DISTINCT orientation) AS a, count(DISTINCT sequence_type) AS b FROM sequences GROUP BY subject)", "sequences")
def g06(spark, d):
    per = src.sequences(spark, d).groupBy("subject").agg(F.count_distinct("orientation").alias("a"), F.count_distinct("sequence_type").alias("b"))
    return per.agg(F.sum((F.col("a") > 1).cast("long")).alias("varying_orientation"), F.sum((F.col("b") > 1).cast("long")).alias("varying_type"))


@query("g07_group_size", "SELECT sequence_id, behavior, count(*) AS n FROM samples3 GROUP BY 1, 2", "samples3")
def g07(spark, d):
    return src.samples3(spark, d).groupBy("sequence_id", "behavior").agg(F.count("*").alias("n"))


@query("g08_segment_lengths", "WITH n AS (SELECT sequence_id, phase, count(*) / 20.0::DOUBLE AS s FROM samples GROUP BY 1, 2) SELECT phase, count(*) AS count, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std, min(s) AS min, round(quantile_cont(s, 0.25), 6) AS q25, round(quantile_cont(s, 0.5), 6) AS q50, round(quantile_cont(s, 0.75), 6) AS q75, max(s) AS max FROM n GROUP BY 1", "samples")
def g08(spark, d):
    s = st.segment_lengths(src.samples(spark, d), "phase", 20.0)
    return s.select("phase", "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", *(F.round(q, 6).alias(q) for q in ("q25", "q50", "q75")), "max")


@query("g09_functional_dependency", f"WITH {FULL}, t AS (SELECT DISTINCT orientation, gesture_action, gesture FROM f) SELECT bool_and(n = 1) AS holds FROM (SELECT count(DISTINCT gesture) AS n FROM t GROUP BY orientation, gesture_action)", "sequences")
def g09(spark, d):
    t = labelled(spark, d).select("orientation", "gesture_action", "gesture").distinct()
    return t.groupBy("orientation", "gesture_action").agg(F.count_distinct("gesture").alias("n")).agg(F.bool_and(F.col("n") == 1).alias("holds"))


@query("g10_mode", f"WITH {FULL} SELECT gesture, count(*) AS n FROM f WHERE is_target = 1 GROUP BY 1 ORDER BY n DESC, gesture LIMIT 1", "sequences")
def g10(spark, d):
    return labelled(spark, d).where("is_target = 1").groupBy("gesture").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gesture").limit(1)


@query("g11_share_of_total", "SELECT l_returnflag AS feature, round(100 * sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1")
def g11(spark, d):
    t = src.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("feature")).agg(F.sum("l_quantity").alias("q"))
    return t.select("feature", F.round(100 * F.col("q") / F.sum("q").over(Window.partitionBy()), 6).alias("share"))


@query("g19_pooled_predictions", "WITH p AS (SELECT sequence_id, avg(acc_x / 50) AS a, avg(acc_y * 10) AS b, avg(acc_z * 10) AS c FROM samples3 GROUP BY 1) SELECT sequence_id, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS prediction FROM p", "samples3")
def g19(spark, d):
    s = src.samples3(spark, d).select("sequence_id", (F.col("acc_x") / 50).alias("a"), (F.col("acc_y") * 10).alias("b"), (F.col("acc_z") * 10).alias("c"))
    return sc.pooled_predictions(s, "sequence_id", ["a", "b", "c"]).select("sequence_id", *(F.round(c, 6).alias(c) for c in "abc"), "prediction")


@query("g20_masked_mean", "SELECT sequence_id, round(sum(acc_x * m) / greatest(sum(m), 1), 6) AS mean FROM (SELECT *, CASE WHEN phase = 'view' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m FROM samples) GROUP BY 1", "samples")
def g20(spark, d):
    m = F.when(F.col("phase") == "view", 1.0).otherwise(0.0)
    return src.samples(spark, d).groupBy("sequence_id").agg(F.round(st.masked_mean(F.col("acc_x"), m), 6).alias("mean"))


@query("g21_balanced_weights", f"WITH {FULL}, n AS (SELECT bfrb, count(*) AS n FROM f GROUP BY 1) SELECT sequence_id, bfrb, round((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n.n), 6) AS class_weight FROM f JOIN n USING (bfrb)", "sequences")
def g21(spark, d):
    return sc.balanced_weights(labelled(spark, d).select("sequence_id", "bfrb"), "bfrb").select("sequence_id", "bfrb", F.round("class_weight", 6).alias("class_weight"))


@query("g22_selection_summary", "SELECT count(*) FILTER (phase = 'click') AS selected, count(*) AS total, count(DISTINCT CASE WHEN phase = 'click' THEN sequence_id END) AS sequences, round(100.0::DOUBLE * count(*) FILTER (phase = 'click') / count(*), 4) AS percent FROM samples", "samples")
def g22(spark, d):
    hit = F.col("phase") == "click"
    return src.samples(spark, d).agg(F.count_if(hit).alias("selected"), F.count("*").alias("total"), F.count_distinct(F.when(hit, F.col("sequence_id"))).alias("sequences"), F.round(100.0 * F.count_if(hit) / F.count("*"), 4).alias("percent"))


@query("g24_correlation", "SELECT round(corr(acc_x, acc_y), 6) AS xy, round(corr(acc_x, acc_z), 6) AS xz, round(corr(acc_y, acc_z), 6) AS yz FROM samples3", "samples3")
def g24(spark, d):
    return src.samples3(spark, d).agg(*(F.round(F.corr(f"acc_{p[0]}", f"acc_{p[1]}"), 6).alias(p) for p in ("xy", "xz", "yz")))


@query("g25_sequence_metadata", "SELECT sequence_id, arg_min(phase, sequence_counter) AS phase, arg_min(acc_x, sequence_counter) AS acc_x FROM samples GROUP BY 1", "samples")
def g25(spark, d):
    return src.samples(spark, d).groupBy("sequence_id").agg(F.min_by(F.struct("phase", "acc_x"), "sequence_counter").alias("m")).select("sequence_id", "m.phase", "m.acc_x")


@query("o02_top_k", "SELECT sequence_id, weight FROM sequences ORDER BY weight DESC, sequence_id LIMIT 25", "sequences")
def o02(spark, d):
    return src.sequences(spark, d).select("sequence_id", "weight").orderBy(F.desc("weight"), "sequence_id").limit(25)


@query("o04_first_ids", "SELECT DISTINCT sequence_id FROM samples ORDER BY 1 LIMIT 50", "samples")
def o04(spark, d):
    return src.samples(spark, d).select("sequence_id").distinct().orderBy("sequence_id").limit(50)


@query("o05_first_per_key", "SELECT subject, arg_min(sequence_id, sequence_id) AS sequence_id, arg_min(weight, sequence_id) AS weight FROM sequences GROUP BY 1", "sequences")
def o05(spark, d):
    return sc.first_label(src.sequences(spark, d), "subject", ["sequence_id", "weight"], "sequence_id").select("subject", "sequence_id", "weight")


@query("o06_distinct", "SELECT DISTINCT orientation, sequence_type FROM sequences", "sequences")
def o06(spark, d):
    return src.sequences(spark, d).select("orientation", "sequence_type").distinct()


@query("u01_union_by_name", "SELECT sequence_id, acc_x, NULL::DOUBLE AS acc_y FROM samples UNION SELECT sequence_id, acc_x, acc_y FROM samples3 WHERE sequence_counter = 0", "samples samples3")
def u01(spark, d):
    a, b = src.samples(spark, d).select("sequence_id", "acc_x"), src.samples3(spark, d).where("sequence_counter = 0").select("sequence_id", "acc_x", "acc_y")
    return a.unionByName(b, allowMissingColumns=True).distinct()


@query("u02_leak_check", "SELECT DISTINCT subject FROM sequences WHERE orientation = 'F' INTERSECT SELECT DISTINCT subject FROM sequences WHERE orientation = 'O'", "sequences")
def u02(spark, d):
    s = src.sequences(spark, d)
    return lb.leaks(s.where("orientation = 'F'"), s.where("orientation = 'O'"), "subject")


@query("p01_balanced_split", """WITH s AS (SELECT sequence_id, sequence_type, coalesce(orientation, 'Unknown') AS orientation FROM sequences), t AS (SELECT count(*) AS n, count(DISTINCT sequence_type) * count(DISTINCT orientation) AS c FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY sequence_type, orientation ORDER BY md5(sequence_id || ':42'), sequence_id) AS p FROM s)
SELECT sequence_id, sequence_type, orientation, CASE WHEN p <= CAST(floor(n * 0.2::DOUBLE) AS BIGINT) // c THEN 'train' ELSE 'test' END AS split FROM r, t WHERE p <= CAST(floor(n * 0.2::DOUBLE) AS BIGINT) // c + CAST(floor(n * 0.05::DOUBLE) AS BIGINT) // c""", "sequences")
def p01(spark, d):
    s = src.sequences(spark, d).select("sequence_id", "sequence_type", F.coalesce("orientation", F.lit("Unknown")).alias("orientation"))
    return lb.balanced_split(s, "sequence_id", ["sequence_type", "orientation"], 0.2, 0.05)


@query("p02_grouped_folds", "SELECT sequence_id, CAST(('0x' || substr(md5(sequence_id || ':42'), 1, 8))::BIGINT % 5 AS BIGINT) AS fold FROM sequences", "sequences")
def p02(spark, d):
    return lb.folds(src.sequences(spark, d).select("sequence_id"), "sequence_id", 5)


@query("p03_stratified_split", "WITH s AS (SELECT sequence_id, sequence_type AS label, count(*) OVER (PARTITION BY sequence_type) AS n, row_number() OVER (PARTITION BY sequence_type ORDER BY md5(sequence_id || ':42'), sequence_id) AS p FROM sequences) SELECT sequence_id, label, p <= round(n * 0.25::DOUBLE) AS is_validation FROM s", "sequences")
def p03(spark, d):
    return lb.stratified_split(src.sequences(spark, d).withColumnRenamed("sequence_type", "label"), "sequence_id", "label", 0.25)


FOLD = "CAST(('0x' || substr(md5(sequence_id || ':42'), 1, 8))::BIGINT % 5 AS BIGINT)"


@query("p04_split_is_disjoint", f"SELECT count(*) FILTER (fold = 0) AS validation, count(*) FILTER (fold > 0) AS training, CAST(0 AS BIGINT) AS leaks FROM (SELECT {FOLD} AS fold FROM sequences)", "sequences")
def p04(spark, d):
    s = lb.folds(src.sequences(spark, d).select("sequence_id"), "sequence_id", 5)
    sizes = s.agg(F.count_if(F.col("fold") == 0).alias("validation"), F.count_if(F.col("fold") > 0).alias("training"))
    leaks = lb.leaks(s.where("fold = 0"), s.where("fold > 0"), "sequence_id").agg(F.count("*").alias("leaks"))
    return sizes.join(leaks)  # one row each


@query("p05_episodes", f"""WITH {LABELS}, c AS (SELECT gesture FROM l GROUP BY 1 ORDER BY md5(gesture || ':42') LIMIT 3),
r AS (SELECT gesture, sequence_id, row_number() OVER (PARTITION BY gesture ORDER BY md5(sequence_id || ':42'), sequence_id) AS p FROM l JOIN c USING (gesture))
SELECT gesture, sequence_id, CASE WHEN p <= 5 THEN 'support' ELSE 'query' END AS role FROM r WHERE p <= 15""", "sequences")
def p05(spark, d):
    return lb.episodes(labelled(spark, d), "sequence_id", "gesture", 3, 5, 10)


@query("p05_many_episodes", f"""WITH {LABELS}, z AS (SELECT gesture, count(*) AS size FROM l WHERE gesture IS NOT NULL GROUP BY 1),
e AS (SELECT gesture, size, CAST(i AS INTEGER) AS episode FROM z, range(0, 100) r(i)),
w AS (SELECT *, CAST(row_number() OVER (PARTITION BY episode ORDER BY md5(gesture || ':' || episode || ':42'), gesture) - 1 AS INTEGER) AS way FROM e QUALIFY row_number() OVER (PARTITION BY episode ORDER BY md5(gesture || ':' || episode || ':42'), gesture) <= 3),
p AS (SELECT *, CAST('0x' || substr(md5(gesture || ':' || episode || ':42:start'), 1, 8) AS BIGINT) % size AS start FROM w),
k AS (SELECT gesture, sequence_id, row_number() OVER (PARTITION BY gesture ORDER BY md5(sequence_id || ':42'), sequence_id) AS place FROM l)
SELECT p.episode, p.way, p.gesture, k.sequence_id, CASE WHEN j < 5 THEN 'support' ELSE 'query' END AS role
FROM p, range(0, 15) s(j) JOIN k ON k.gesture = p.gesture AND k.place = (p.start + j) % p.size + 1""", "sequences")
def p05_many(spark, d):
    return lb.many_episodes(labelled(spark, d), "sequence_id", "gesture", 100, 3, 5, 10)


SCORED = "s AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'non_bfrb' WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS truth, CASE WHEN toxic = 1 OR doc_id % 5 = 0 THEN 'non_bfrb' WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS pred FROM labels)"


def scored(spark, d):
    x = F.col
    return src.table(spark, d, "labels").select(
        "doc_id", F.when(x("quality") == 0, "non_bfrb").when(x("doc_id") % 3 == 0, "a").otherwise("b").alias("truth"),
        F.when((x("toxic") == 1) | (x("doc_id") % 5 == 0), "non_bfrb").when(x("doc_id") % 2 == 0, "a").otherwise("b").alias("pred"),
    )


CLASSES = "c AS (SELECT label, count(*) FILTER (truth = label AND pred = label) AS tp, count(*) FILTER (truth <> label AND pred = label) AS fp, count(*) FILTER (truth = label AND pred <> label) AS fn FROM {0}, (SELECT DISTINCT unnest([truth, pred]) AS label FROM {0}) GROUP BY 1)"


@query("l02_competition_score", f"WITH {SCORED}, t AS (SELECT * FROM s WHERE truth <> 'non_bfrb'), {CLASSES.format('t')}, b AS (SELECT 2.0::DOUBLE * count(*) FILTER (truth <> 'non_bfrb' AND pred <> 'non_bfrb') / (count(*) FILTER (truth <> 'non_bfrb') + count(*) FILTER (pred <> 'non_bfrb')) AS b FROM s), m AS (SELECT avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)) AS m FROM c) SELECT round(b, 6) AS binary_f1, round(m, 6) AS macro_f1, round((b + m) / 2, 6) AS score FROM b, m")
def l02(spark, d):
    s = sc.competition_score(scored(spark, d), "truth", "pred")
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


@query("l03_class_report", f"WITH {SCORED}, {CLASSES.format('s')} SELECT label, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def l03(spark, d):
    return sc.class_counts(scored(spark, d), "truth", "pred").select("label", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("l04_holdout_table", f"WITH {SCORED} SELECT doc_id AS sequence_id, CAST(truth <> 'non_bfrb' AS INTEGER) AS is_target_true, CAST(pred <> 'non_bfrb' AS INTEGER) AS is_target_pred, truth AS bfrb_true, pred AS bfrb_pred FROM s")
def l04(spark, d):
    return scored(spark, d).select(F.col("doc_id").alias("sequence_id"), (F.col("truth") != "non_bfrb").cast("int").alias("is_target_true"), (F.col("pred") != "non_bfrb").cast("int").alias("is_target_pred"), F.col("truth").alias("bfrb_true"), F.col("pred").alias("bfrb_pred"))


@query("o01_ordered_samples", "SELECT sequence_id, sequence_counter, acc_x FROM samples ORDER BY 1, 2", "samples")
def o01(spark, d):
    return src.samples(spark, d).select("sequence_id", "sequence_counter", "acc_x").orderBy("sequence_id", "sequence_counter")


@query("o03_by_measured_length", "SELECT sequence_id, count(*) AS n FROM samples3 GROUP BY 1 ORDER BY n DESC, 1", "samples3")
def o03(spark, d):
    return src.samples3(spark, d).groupBy("sequence_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sequence_id")


@query("l10_hierarchical_routing", f"""WITH {FULL}, b AS (SELECT sequence_type, avg(weight) AS m FROM f GROUP BY 1), o AS (SELECT orientation, avg(weight) AS m FROM f WHERE is_target = 1 AND orientation <> 'Unknown' GROUP BY 1),
g AS (SELECT orientation, gesture, avg(weight) AS m FROM f WHERE is_target = 1 AND orientation <> 'Unknown' GROUP BY 1, 2),
x AS (SELECT f.sequence_id, f.weight, (SELECT arg_min(CAST(b.sequence_type = 'Target' AS INTEGER), abs(f.weight - b.m)) FROM b) AS is_target, (SELECT arg_min(o.orientation, abs(f.weight - o.m)) FROM o) AS orientation FROM f)
SELECT x.sequence_id, CASE WHEN x.is_target = 0 THEN 'non_bfrb' ELSE (SELECT arg_min(g.gesture, abs(x.weight - g.m)) FROM g WHERE g.orientation = x.orientation) END AS prediction FROM x""", "sequences")
def l10(spark, d):
    """Three stages of nearest-mean models on one feature: target or not, then orientation, then the gesture model of
    that orientation; each stage's table of means is a row a class."""
    f = labelled(spark, d)
    t = f.where("is_target = 1 and orientation <> 'Unknown'")
    binary = f.groupBy("sequence_type").agg(F.avg("weight").alias("m"))
    return sc.routed(f.select("sequence_id", "weight"), "weight", binary, "Target", t.groupBy("orientation").agg(F.avg("weight").alias("m")), t.groupBy("orientation", "gesture").agg(F.avg("weight").alias("m")), "non_bfrb")
