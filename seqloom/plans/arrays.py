"""Queries of the depth-grid and temperature operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seqloom.functions import grids as gr
from seqloom.functions import numeric as nm
from seqloom.operators import windows as w
from seqloom.sources import adapters as src

from .registry import query

GRID = "grid"
VALID = "list_filter(grid, lambda p: p <> -1)"
NULLED = "list_transform(grid, lambda p: CASE WHEN p <> -1 THEN p END)"


def filled_sql(v: int) -> str:
    return f"list_transform(grid, lambda p: CASE WHEN p = -1 THEN {v}::DOUBLE ELSE p END)"


def r(c, n: int = 6):
    return F.round(F.coalesce(c, F.lit(0.0)), n) + 0.0


def mean_of(places, source: str = NULLED) -> str:
    return f"round(coalesce(list_avg(list_filter(list_transform({[p + 1 for p in places]}, lambda i: ({source})[i]), lambda p: p IS NOT NULL)), 0), 6) + 0.0"


@query("f13_sentinel_to_null", f"SELECT vec_id, CAST(len({VALID}) AS BIGINT) AS valid FROM grids", "grids")
def f13(spark, d):
    return src.grids(spark, d).select("vec_id", F.size(gr.known(gr.valid(GRID))).cast("long").alias("valid"))


@query("f14_range_invalidation", "SELECT vec_id, CAST(len(list_filter(grid, lambda p: p > 0 AND p < 150)) AS BIGINT) AS valid FROM grids", "grids")
def f14(spark, d):
    return src.grids(spark, d).select("vec_id", F.size(gr.known(gr.in_range(GRID, 0.0, 150.0))).cast("long").alias("valid"))


for _fill, _value in (("far_255", 255), ("far_500", 500), ("zero", 0)):

    @query(f"t01_impute_{_fill}", f"SELECT vec_id, round(list_sum({filled_sql(_value)}), 4) AS total FROM grids", "grids")
    def t01(spark, d, fill=_fill):
        return src.grids(spark, d).select("vec_id", F.round(gr.total(gr.imputed(GRID, fill)), 4).alias("total"))


@query("t02_raw_and_validity", "SELECT vec_id, unnest(range(1, 65)) AS pixel, unnest(grid) AS value, unnest(list_transform(grid, lambda p: CAST(p <> -1 AS INTEGER))) AS valid FROM grids", "grids")
def t02(spark, d):
    g = src.grids(spark, d).select("vec_id", F.posexplode(F.arrays_zip(F.col(GRID).alias("v"), gr.validity(GRID).alias("k"))).alias("i", "x"))
    return g.select("vec_id", (F.col("i") + 1).cast("long").alias("pixel"), F.col("x.v").alias("value"), F.col("x.k").alias("valid"))


@query("t03_sensor_stats", f"SELECT vec_id, round(list_avg({filled_sql(255)}), 6) AS imputed_mean, round(list_aggregate({filled_sql(255)}, 'stddev_pop'), 5) AS imputed_std, round(coalesce(list_avg({VALID}), 0), 6) AS valid_mean, round(coalesce(list_aggregate({VALID}, 'stddev_pop'), 0), 5) AS valid_std, round(coalesce(list_min({VALID}), 0), 6) AS valid_min, round(coalesce(list_max({VALID}), 0), 6) AS valid_max, round(len({VALID}) / 64.0::DOUBLE, 6) AS valid_fraction FROM grids", "grids")
def t03(spark, d):
    s = gr.sensor_stats(GRID)
    return src.grids(spark, d).select("vec_id", *(r(s[n], 5 if n.endswith("std") else 6).alias(n) for n in ("imputed_mean", "imputed_std", "valid_mean", "valid_std", "valid_min", "valid_max", "valid_fraction")))


@query("t04_pooled_stats", "WITH s AS (SELECT sequence_id, sequence_counter // 5 AS t, list_filter(flatten(list(grid ORDER BY sequence_counter)), lambda p: p <> -1) AS v FROM grids GROUP BY 1, 2) SELECT sequence_id, t, round(coalesce(list_avg(v), 0), 6) AS valid_mean, CAST(len(v) AS BIGINT) AS n FROM s", "grids")
def t04(spark, d):
    g = src.grids(spark, d).withColumn("t", F.floor(F.col("sequence_counter") / 5))  # five sensors of one time step
    both = g.groupBy("sequence_id", "t").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sequence_counter", "grid"))), lambda x: x["grid"])).alias("grid"))
    return both.select("sequence_id", "t", r(gr.sensor_stats(GRID)["valid_mean"]).alias("valid_mean"), F.size(gr.known(gr.valid(GRID))).cast("long").alias("n"))


@query("t05_pool_2x2", "SELECT vec_id, " + ", ".join(f"{mean_of(p, filled_sql(255))} AS pool_{i}" for i, p in enumerate(gr.squares(2)[:4])) + f", {mean_of(gr.squares(2)[5], 'list_transform(grid, lambda p: CAST(p <> -1 AS DOUBLE))')} AS fraction_5 FROM grids", "grids")
def t05(spark, d):
    g = src.grids(spark, d).select("vec_id", gr.pooled(gr.imputed(GRID), gr.squares(2)).alias("p"), gr.pooled(F.transform(gr.validity(GRID), lambda x: x.cast("double")), gr.squares(2)).alias("f"))
    return g.select("vec_id", *(r(F.col("p")[i]).alias(f"pool_{i}") for i in range(4)), r(F.col("f")[5]).alias("fraction_5"))


@query("t06_nine_regions", "SELECT vec_id, " + ", ".join(f"{mean_of(p)} AS region_{i}" for i, p in enumerate(gr.nine_regions())) + " FROM grids", "grids")
def t06(spark, d):
    g = src.grids(spark, d).select("vec_id", gr.pooled(gr.valid(GRID), gr.nine_regions()).alias("p"))
    return g.select("vec_id", *(r(F.col("p")[i]).alias(f"region_{i}") for i in range(9)))


@query("t08_spatial_zones", "SELECT vec_id, " + ", ".join(f"{mean_of(p)} AS {n}" for n, p in gr.halves().items()) + " FROM grids", "grids")
def t08(spark, d):
    g = src.grids(spark, d)
    return g.select("vec_id", *(r(gr.mean(gr.known(gr.pick(gr.valid(GRID), p)))).alias(n) for n, p in gr.halves().items()))


@query("t08_centre_of_mass", f"WITH n AS (SELECT vec_id, list_transform({NULLED}, lambda p: coalesce(4000 - p, 0)) AS v FROM grids) SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: v[i] * ((i - 1) // 8))) / list_sum(v), 6) AS centre_row, round(list_sum(list_transform(range(1, 65), lambda i: v[i] * ((i - 1) % 8))) / list_sum(v), 6) AS centre_column FROM n", "grids")
def t08c(spark, d):
    row, column = gr.centre_of_mass(gr.valid(GRID))
    return src.grids(spark, d).select("vec_id", F.round(row, 6).alias("centre_row"), F.round(column, 6).alias("centre_column"))


def _sobel_sql() -> str:
    at = lambda i, dr, dc: f"v[least(greatest({i} // 8 + {dr}, 0), 7) * 8 + least(greatest({i} % 8 + {dc}, 0), 7) + 1]"
    x = " + ".join(f"({k}) * {at('i', dr, dc)}" for dr, dc, k in ((-1, 1, 1), (0, 1, 2), (1, 1, 1), (-1, -1, -1), (0, -1, -2), (1, -1, -1)))
    y = " + ".join(f"({k}) * {at('i', dr, dc)}" for dr, dc, k in ((1, -1, 1), (1, 0, 2), (1, 1, 1), (-1, -1, -1), (-1, 0, -2), (-1, 1, -1)))
    return f"list_transform(range(0, 64), lambda i: sqrt(pow({x}, 2) + pow({y}, 2)))"


@query("t09_sobel", f"WITH f AS (SELECT vec_id, {filled_sql(255)} AS v FROM grids), s AS (SELECT vec_id, {_sobel_sql()} AS e FROM f) SELECT vec_id, round(list_avg(e), 5) AS edge_mean, round(list_max(e), 5) AS edge_max, round(len(list_filter(e, lambda x: x > 500)) / 64.0::DOUBLE, 6) AS edge_density FROM s", "grids")
def t09(spark, d):
    g = src.grids(spark, d).select("vec_id", gr.imputed(GRID).alias("v")).select("vec_id", gr.sobel(F.col("v")).alias("e"))
    return g.select("vec_id", r(gr.mean(F.col("e")), 5).alias("edge_mean"), r(F.array_max("e"), 5).alias("edge_max"), r(F.size(F.filter("e", lambda x: x > 500)) / 64.0).alias("edge_density"))


def _numpy(name: str, fields: list[str], make):
    """A query that hands each filled 8 x 8 grid to NumPy, in Arrow batches."""

    @query(name)
    def run(spark, d):
        def batches(frames):
            for f in frames:
                rows = [dict(zip(fields, map(float, make(np.asarray(g, float).reshape(8, 8))))) for g in f["v"]]
                yield pd.concat([f[["vec_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=fields)], axis=1)

        g = src.grids(spark, d).select("vec_id", gr.imputed(GRID).alias("v"))
        return g.mapInPandas(batches, "vec_id long, " + ", ".join(f"{f} double" for f in fields))

    return run


_WAVE = lambda u, v, f: "list_sum(list_transform(range(1, 65), lambda i: v[i] * " + f"{f}(2 * pi() * ({u} * ((i - 1) // 8) + {v} * ((i - 1) % 8)) / 8)))"
_LOW = " + ".join(f"pow({_WAVE(u, v, f)}, 2)" for u in (0, 7) for v in (0, 7) for f in ("cos", "sin"))


@query("t10_fft_energy", f"WITH f AS (SELECT vec_id, {filled_sql(255)} AS v FROM grids), e AS (SELECT vec_id, {_LOW} AS low, 64 * list_sum(list_transform(v, lambda p: p * p)) AS total FROM f) SELECT vec_id, round(low, 0) AS low, round(total - low, 0) AS high, round(low / total, 6) AS low_share FROM e", "grids")
def t10(spark, d):
    g = src.grids(spark, d).select("vec_id", gr.imputed(GRID).alias("v"))
    low, high = gr.fft_energy(F.col("v"))
    return g.select("vec_id", F.round(low, 0).alias("low"), F.round(high, 0).alias("high"), F.round(low / (low + high), 6).alias("low_share"))


t11 = _numpy("t11_singular_values", ["sv1", "sv2", "sv3", "ratio", "rank2_energy"], nm.singular_values)
t14 = _numpy("t14_largest_blob", ["area", "centre_row", "centre_column"], nm.near_blob)


def _haar_sql(signs) -> str:
    parts = [f"pow(({' + '.join(f'({s}) * v[{p + 1}]' for s, p in zip(signs, square))}) / 2, 2)" for square in gr.squares(2)]
    return " + ".join(parts)


@query("t12_haar", f"WITH f AS (SELECT vec_id, {filled_sql(255)} AS v FROM grids) SELECT vec_id, round({_haar_sql((1, 1, 1, 1))}, 2) AS approximation, round({_haar_sql((1, 1, -1, -1))}, 2) AS horizontal, round({_haar_sql((1, -1, 1, -1))}, 2) AS vertical, round({_haar_sql((1, -1, -1, 1))}, 2) AS diagonal FROM f", "grids")
def t12(spark, d):
    g = src.grids(spark, d).select("vec_id", gr.imputed(GRID).alias("v"))
    return g.select("vec_id", *(F.round(e, 2).alias(n) for n, e in gr.haar(F.col("v")).items()))


@query("t13_mean_frame_zones", "WITH e AS (SELECT sequence_id, unnest(range(0, 64)) AS i, unnest(grid) AS p FROM grids), m AS (SELECT sequence_id, i, avg(nullif(p, -1)) AS p FROM e GROUP BY 1, 2) SELECT sequence_id, round(avg(p) FILTER (i // 8 < 4), 6) AS top, round(avg(p) FILTER (i // 8 >= 4), 6) AS bottom, round(avg(p), 6) AS mean FROM m GROUP BY 1", "grids")
def t13(spark, d):
    e = src.grids(spark, d).select("sequence_id", F.posexplode(gr.valid(GRID)).alias("i", "p"))
    m = e.groupBy("sequence_id", "i").agg(F.avg("p").alias("p"))  # partial means: no grid is gathered
    top = F.col("i") < 32
    return m.groupBy("sequence_id").agg(F.round(F.avg(F.when(top, F.col("p"))), 6).alias("top"), F.round(F.avg(F.when(~top, F.col("p"))), 6).alias("bottom"), F.round(F.avg("p"), 6).alias("mean"))


PLACES = {"q1": (0, 0), "q2": (0, 4), "q3": (4, 0), "q4": (4, 4)}
QUADRANTS = {q: [(r0 + i) * 8 + c0 + j for i in range(4) for j in range(4)] for q, (r0, c0) in PLACES.items()}
AT = lambda places: f"list_avg(list_transform({[p + 1 for p in places]}, lambda i: v[i]))"
STEPS = "list_transform(range(1, 65), lambda i: sqrt(pow(CASE WHEN (i - 1) % 8 = 0 THEN 0 ELSE v[i] - v[i - 1] END, 2) + pow(CASE WHEN i <= 8 THEN 0 ELSE v[i] - v[i - 8] END, 2)))"


@query("t15_frame_spatial", f"""WITH k AS (SELECT vec_id, list_transform(grid, lambda p: CASE WHEN p > 0 AND p < 4000 THEN p END) AS k FROM grids),
f AS (SELECT vec_id, len(list_filter(k, lambda p: p IS NOT NULL)) / 64::DOUBLE AS valid_ratio, list_transform(k, lambda p: coalesce(p, list_median(k), 0::DOUBLE)) AS v FROM k),
g AS (SELECT *, {STEPS} AS g FROM f)
SELECT vec_id, round(list_avg(v), 4) AS spatial_mean, round(list_stddev_pop(v), 4) AS spatial_std, round(list_min(v), 4) AS spatial_min, round(list_max(v), 4) AS spatial_max, round(valid_ratio, 6) AS valid_ratio,
  {', '.join(f'round({AT(p)}, 4) AS {q}_mean' for q, p in QUADRANTS.items())}, round({AT(gr.halves()['center'])}, 4) AS center_mean, round({AT(gr.halves()['edge'])}, 4) AS edge_mean,
  round({AT(gr.halves()['center'])} / ({AT(gr.halves()['edge'])} + 1e-6::DOUBLE), 4) AS center_edge_ratio,
  round({AT(gr.halves()['left'])} - {AT(gr.halves()['right'])}, 3) + 0.0 AS lr_asymmetry, round({AT(gr.halves()['top'])} - {AT(gr.halves()['bottom'])}, 3) + 0.0 AS tb_asymmetry,
  round(CASE WHEN list_sum(v) > 0 THEN list_sum(list_transform(range(1, 65), lambda i: v[i] * ((i - 1) % 8))) / list_sum(v) ELSE 4 END, 4) AS com_x,
  round(CASE WHEN list_sum(v) > 0 THEN list_sum(list_transform(range(1, 65), lambda i: v[i] * ((i - 1) // 8))) / list_sum(v) ELSE 4 END, 4) AS com_y,
  round(list_avg(g), 4) AS gradient_mean, round(list_stddev_pop(g), 3) AS gradient_std FROM g""", "grids")
def t15(spark, d):
    g = gr.with_frame_spatial(src.grids(spark, d), "grid", "vec_id")
    exact = {"valid_ratio": 6, "lr_asymmetry": 3, "tb_asymmetry": 3, "gradient_std": 3}
    return g.select("vec_id", *(r(n, exact.get(n, 4)).alias(n) for n in g.columns if n != "vec_id"))


@query("t16_mean_frame", "WITH e AS (SELECT sequence_id, unnest(range(0, 64)) AS i, unnest(grid) AS p FROM grids) SELECT sequence_id, i, round(avg(nullif(p, -1)), 6) AS mean, round(count(nullif(p, -1)) / CAST(count(*) AS DOUBLE), 6) AS valid_ratio FROM e GROUP BY 1, 2", "grids")
def t16(spark, d):
    e = src.grids(spark, d).select("sequence_id", F.posexplode(gr.valid(GRID)).alias("i", "p"))
    return e.groupBy("sequence_id", F.col("i").cast("long").alias("i")).agg(F.round(F.avg("p"), 6).alias("mean"), F.round(F.count("p") / F.count("*"), 6).alias("valid_ratio"))


@query("t17_mean_per_sensor", f"SELECT vec_id, round(coalesce(list_avg({VALID}), 0), 6) AS mean FROM grids", "grids")
def t17(spark, d):
    return src.grids(spark, d).select("vec_id", r(gr.mean(gr.known(gr.valid(GRID)))).alias("mean"))


@query("t18_centred_grid", f"SELECT vec_id, round(list_sum(list_transform({VALID}, lambda p: abs(p - list_avg({VALID})))), 4) AS deviation, round(coalesce(list_min({VALID}), -999), 6) AS least FROM grids", "grids")
def t18(spark, d):
    g = src.grids(spark, d).select("vec_id", gr.known(gr.valid(GRID)).alias("v")).select("vec_id", "v", gr.mean(F.col("v")).alias("m"))
    return g.select("vec_id", F.round(gr.total(F.transform("v", lambda p: F.abs(p - F.col("m")))), 4).alias("deviation"), F.round(F.coalesce(F.array_min("v"), F.lit(-999.0)), 6).alias("least"))


@query("t18_difference", """WITH b AS (SELECT *, lag(grid) OVER (PARTITION BY sequence_id ORDER BY sequence_counter) AS before FROM grids),
d AS (SELECT sequence_id, sequence_counter, list_transform(range(1, 65), lambda i: CASE WHEN grid[i] <> -1 AND before[i] <> -1 THEN grid[i] - before[i] ELSE 0 END) AS d FROM b)
SELECT sequence_id, sequence_counter, round(list_sum(d), 4) + 0.0 AS change, round(list_max(d), 6) + 0.0 AS most, round(d[10], 6) + 0.0 AS pixel_9 FROM d""", "grids")
def t18_difference(spark, d):
    g = src.grids(spark, d)
    g = g.withColumn("d", gr.difference(GRID, F.lag("grid").over(w.ordered())))
    return g.select("sequence_id", "sequence_counter", r(gr.total(F.col("d")), 4).alias("change"), r(F.array_max("d")).alias("most"), r(F.col("d")[9]).alias("pixel_9"))


@query("s27_pooled_diff", f"WITH m AS (SELECT sequence_id, sequence_counter, coalesce(list_avg({VALID}), 0) AS m FROM grids) SELECT sequence_id, sequence_counter, round(coalesce(m - lag(m) OVER (PARTITION BY sequence_id ORDER BY sequence_counter), 0), 6) + 0.0 AS diff FROM m", "grids")
def s27(spark, d):
    g = src.grids(spark, d).select("sequence_id", "sequence_counter", F.coalesce(gr.mean(gr.known(gr.valid(GRID))), F.lit(0.0)).alias("m"))
    return g.select("sequence_id", "sequence_counter", r(w.step(F.col("m"))).alias("diff"))


@query("s28_motion_intensity", f"WITH n AS (SELECT sequence_id, sequence_counter, {NULLED} AS v FROM grids), l AS (SELECT *, lag(v) OVER (PARTITION BY sequence_id ORDER BY sequence_counter) AS b FROM n) SELECT sequence_id, sequence_counter, round(coalesce(list_avg(list_filter(list_transform(range(1, 65), lambda i: abs(v[i] - b[i])), lambda x: x IS NOT NULL)), 0), 6) AS intensity FROM l", "grids")
def s28(spark, d):
    g = src.grids(spark, d).select("sequence_id", "sequence_counter", gr.valid(GRID).alias("v")).withColumn("b", F.lag("v").over(w.ordered()))
    moved = F.filter(F.zip_with("v", "b", lambda a, b: F.abs(a - b)), lambda x: x.isNotNull())
    return g.select("sequence_id", "sequence_counter", r(gr.mean(moved)).alias("intensity"))


CHANNELS = [f"thm_{i}" for i in range(1, 6)]


@query("h01_row_centring", "SELECT sequence_id, sequence_counter, round(thm_1 - (thm_1 + thm_2 + thm_3 + thm_4 + thm_5) / 5, 6) + 0.0 AS thm_1 FROM thermo", "thermo")
def h01(spark, d):
    mean = sum((F.col(c) for c in CHANNELS[1:]), F.col(CHANNELS[0])) / 5
    return src.thermo(spark, d).select("sequence_id", "sequence_counter", r(F.col("thm_1") - mean).alias("thm_1"))


@query("h02_average", "SELECT sequence_id, sequence_counter, round((thm_1 + thm_2 + thm_3 + thm_4 + thm_5) / 5, 6) + 0.0 AS mean FROM thermo", "thermo")
def h02(spark, d):
    return src.thermo(spark, d).select("sequence_id", "sequence_counter", r(sum((F.col(c) for c in CHANNELS[1:]), F.col(CHANNELS[0])) / 5).alias("mean"))


@query("g23_thermopile_spatial", "SELECT sequence_id, sequence_counter, CAST(list_position([thm_1, thm_2, thm_3, thm_4, thm_5], greatest(thm_1, thm_2, thm_3, thm_4, thm_5)) AS BIGINT) AS hottest, CAST(list_position([thm_1, thm_2, thm_3, thm_4, thm_5], least(thm_1, thm_2, thm_3, thm_4, thm_5)) AS BIGINT) AS coolest, round(greatest(thm_1, thm_2, thm_3, thm_4, thm_5) - least(thm_1, thm_2, thm_3, thm_4, thm_5), 6) AS spread, round(thm_1 - thm_2, 6) + 0.0 AS first_step FROM thermo", "thermo")
def g23(spark, d):
    xs = F.array(*CHANNELS)
    return src.thermo(spark, d).select("sequence_id", "sequence_counter", F.array_position(xs, F.array_max(xs)).alias("hottest"), F.array_position(xs, F.array_min(xs)).alias("coolest"), F.round(F.array_max(xs) - F.array_min(xs), 6).alias("spread"), r(F.col("thm_1") - F.col("thm_2")).alias("first_step"))
