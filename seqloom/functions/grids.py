"""Depth grids of 8 x 8 pixels as arrays in row-major order: null or -1 is a pixel without return."""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE, NO_RETURN = 8, -1.0
FILLS = {"far_255": 255.0, "far_500": 500.0, "zero": 0.0}


def valid(grid: Column) -> Column:
    """The grid with null for pixels without return."""
    return F.transform(grid, lambda p: F.when(p != NO_RETURN, p))


def in_range(grid: Column, low: float = 0.0, high: float = 4000.0) -> Column:
    return F.transform(grid, lambda p: F.when((p > low) & (p < high), p))


def imputed(grid: Column, fill: str = "far_255") -> Column:
    if fill not in FILLS:
        raise ValueError(f"unknown fill mode {fill!r}")
    return F.transform(valid(grid), lambda p: F.coalesce(p, F.lit(FILLS[fill])))


def validity(grid: Column) -> Column:
    return F.transform(valid(grid), lambda p: p.isNotNull().cast("int"))


def known(grid: Column) -> Column:
    return F.filter(grid, lambda p: p.isNotNull())


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, p: a + p)


def mean(values: Column) -> Column:
    """Mean of an array without nulls; null for an empty one."""
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def deviation(values: Column) -> Column:
    """Population standard deviation from running sums."""
    sums = F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, p: F.struct((a["s"] + p).alias("s"), (a["q"] + p * p).alias("q")))
    n = F.size(values)
    return F.when(n > 0, F.sqrt(F.greatest(sums["q"] / n - (sums["s"] / n) * (sums["s"] / n), F.lit(0.0))))


def sensor_stats(grid: Column, fill: str = "far_255") -> dict[str, Column]:
    """Mean, deviation, least and greatest of all pixels (filled) and of the valid ones, and the valid fraction."""
    every, some = imputed(grid, fill), known(valid(grid))
    out = {}
    for kind, x in (("imputed", every), ("valid", some)):
        for name, v in (("mean", mean(x)), ("std", deviation(x)), ("min", F.array_min(x)), ("max", F.array_max(x))):
            out[f"{kind}_{name}"] = F.coalesce(v, F.lit(0.0))
    return out | {"valid_fraction": F.coalesce(F.size(some) / F.size(grid), F.lit(0.0))}


def pick(grid: Column, places: list[int]) -> Column:
    return F.array(*(F.element_at(grid, p + 1) for p in places))


def pooled(grid: Column, places: list[list[int]]) -> Column:
    """Means over groups of pixels; null where a group has none."""
    return F.array(*(mean(known(pick(grid, p))) for p in places))


def squares(size: int = 2) -> list[list[int]]:
    """Pixel groups of size x size squares, row by row."""
    n = SIDE // size
    return [[(r * size + i) * SIDE + c * size + j for i in range(size) for j in range(size)] for r in range(n) for c in range(n)]


def nine_regions() -> list[list[int]]:
    """Rows and columns split 3 / 2 / 3."""
    parts = [range(0, 3), range(3, 5), range(5, 8)]
    return [[r * SIDE + c for r in rows for c in cols] for rows in parts for cols in parts]


def halves() -> dict[str, list[int]]:
    cells = range(SIDE * SIDE)
    return {
        "top": [i for i in cells if i // SIDE < 4], "bottom": [i for i in cells if i // SIDE >= 4], "left": [i for i in cells if i % SIDE < 4],
        "right": [i for i in cells if i % SIDE >= 4], "center": [i for i in cells if 2 <= i // SIDE < 6 and 2 <= i % SIDE < 6],
        "edge": [i for i in cells if not (2 <= i // SIDE < 6 and 2 <= i % SIDE < 6)],
    }


def centre_of_mass(grid: Column, far: float = 4000.0) -> tuple[Column, Column]:
    """Row and column of the centre of nearness (far - depth) over valid pixels; the middle for an empty grid."""
    near = F.transform(grid, lambda p: F.coalesce(F.lit(far) - p, F.lit(0.0)))
    weigh = lambda f: F.aggregate(F.transform(near, lambda p, i: p * f(i)), F.lit(0.0), lambda a, p: a + p)
    mass = total(near)
    middle = F.lit((SIDE - 1) / 2)
    return tuple(F.when(mass > 0, weigh(f) / mass).otherwise(middle) for f in (lambda i: F.floor(i / SIDE), lambda i: i % SIDE))


def haar(grid: Column) -> dict[str, Column]:
    """Energies of one level of the two-dimensional Haar transform."""
    blocks = [tuple(F.element_at(grid, p + 1) for p in s) for s in squares(2)]
    signs = {"approximation": (1, 1, 1, 1), "horizontal": (1, 1, -1, -1), "vertical": (1, -1, 1, -1), "diagonal": (1, -1, -1, 1)}
    energy = lambda s: F.aggregate(F.array(*(sum((x * k for x, k in zip(b[1:], s[1:])), b[0] * s[0]) / 2 for b in blocks)), F.lit(0.0), lambda a, v: a + v * v)
    return {n: energy(s) for n, s in signs.items()}


def sobel(grid: Column) -> Column:
    """Gradient sizes by the Sobel masks; pixels beyond the border repeat the nearest one."""
    at = lambda r, c: F.element_at(grid, min(max(r, 0), SIDE - 1) * SIDE + min(max(c, 0), SIDE - 1) + 1)
    def one(r: int, c: int) -> Column:
        side = lambda k: at(r - 1, c + k) + 2 * at(r, c + k) + at(r + 1, c + k)
        level = lambda k: at(r + k, c - 1) + 2 * at(r + k, c) + at(r + k, c + 1)
        x, y = side(1) - side(-1), level(1) - level(-1)
        return F.sqrt(x * x + y * y)
    return F.array(*(one(r, c) for r in range(SIDE) for c in range(SIDE)))


def fft_energy(grid: Column) -> tuple[Column, Column]:
    """Power of the two-dimensional Fourier transform in the four middle bins of the shifted spectrum, and elsewhere (the
    sum of all bins is 64 times that of the squares)."""
    def wave(u: int, v: int, f) -> Column:
        weights = F.array(*(F.lit(f(2 * pi * (u * (i // SIDE) + v * (i % SIDE)) / SIDE)) for i in range(SIDE * SIDE)))
        return total(F.zip_with(grid, weights, lambda a, b: a * b))
    parts = [wave(u, v, f) for u in (0, SIDE - 1) for v in (0, SIDE - 1) for f in (cos, sin)]
    low = sum((p * p for p in parts[1:]), parts[0] * parts[0])
    return low, total(F.transform(grid, lambda p: p * p)) * (SIDE * SIDE) - low


def difference(grid: Column, before: Column) -> Column:
    """Change of every pixel since the frame before; 0 where either has no return, and in a first frame."""
    changed = F.zip_with(grid, before, lambda a, b: F.when((a != NO_RETURN) & (b != NO_RETURN), a - b).otherwise(0.0))
    return F.coalesce(changed, F.transform(grid, lambda _: F.lit(0.0)))


def with_frame_spatial(df: DataFrame, grid: str, *keep: str) -> DataFrame:
    """keep and numbers about each grid, in which pixels out of range become the median of the others (0 without any):
    levels, quadrants, centre against edge, asymmetries, centre of mass and gradients."""
    df = df.select(*keep, in_range(F.col(grid)).alias("_k"))
    known_ones = F.array_sort(known(F.col("_k")))
    df = df.select(*keep, "_k", known_ones.alias("_s"))
    n = F.size("_s")
    middle = F.when(n > 0, (F.get("_s", F.floor((n - 1) / 2).cast("int")) + F.get("_s", F.floor(n / 2).cast("int"))) / 2).otherwise(0.0)
    df = df.select(*keep, (n / (SIDE * SIDE)).alias("valid_ratio"), middle.alias("_m"), "_k")
    v = F.col("_v")
    df = df.select(*keep, "valid_ratio", F.transform("_k", lambda p: F.coalesce(p, F.col("_m"))).alias("_v"))
    change = lambda i, by, edge: 0.0 if edge else F.get(v, F.lit(i)) - F.get(v, F.lit(i - by))
    steps = []
    for i in range(SIDE * SIDE):
        x, y = change(i, 1, i % SIDE == 0), change(i, SIDE, i < SIDE)
        steps.append(F.sqrt(F.lit(x * x + y * y)) if not isinstance(x, Column) and not isinstance(y, Column) else F.sqrt(x * x + y * y))
    df = df.select(*keep, "valid_ratio", "_v", F.array(*steps).alias("_g"))
    part = {k: mean(pick(v, p)) for k, p in halves().items()}
    quarter = lambda r, c: mean(pick(v, [(r + i) * SIDE + c + j for i in range(4) for j in range(4)]))
    weighed = lambda f: total(F.transform(v, lambda p, i: p * f(i)))
    mass = total(v)
    return df.select(
        *keep, mean(v).alias("spatial_mean"), deviation(v).alias("spatial_std"), F.array_min(v).alias("spatial_min"), F.array_max(v).alias("spatial_max"), "valid_ratio",
        quarter(0, 0).alias("q1_mean"), quarter(0, 4).alias("q2_mean"), quarter(4, 0).alias("q3_mean"), quarter(4, 4).alias("q4_mean"),
        part["center"].alias("center_mean"), part["edge"].alias("edge_mean"), (part["center"] / (part["edge"] + 1e-6)).alias("center_edge_ratio"),
        (part["left"] - part["right"]).alias("lr_asymmetry"), (part["top"] - part["bottom"]).alias("tb_asymmetry"),
        F.when(mass > 0, weighed(lambda i: i % SIDE) / mass).otherwise(4.0).alias("com_x"), F.when(mass > 0, weighed(lambda i: F.floor(i / SIDE)) / mass).otherwise(4.0).alias("com_y"),
        mean(F.col("_g")).alias("gradient_mean"), deviation(F.col("_g")).alias("gradient_std"),
    )
