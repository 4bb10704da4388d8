"""K, L and centred L functions, hard-core radius, quadrat test.

K is the estimate from the literature, A/n² times the ordered pairs within d, on
``d_max/steps`` spaced distances; the edge correction is optional.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from craquelure.operators import neighbours as N

STEPS = 100


def k_function(points: DataFrame, keys, d_max: float, area: Column, steps: int = STEPS, weight=False, size=("w_mm", "h_mm")) -> DataFrame:
    """``(keys, step, d, k, l, lc)``; ``area`` is an aggregate giving the observed area."""
    keys = list(keys)
    counts = N.pair_counts(points, keys, d_max, steps, weight, size=size)
    totals = points.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_n"), area.alias("_area"))
    # one row per key carries the counts of its steps, at most ``steps + 1``
    curves = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step", "pairs"))).alias("_c"))
    d = totals.join(curves, keys, "left").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    up_to = F.filter("_c", lambda p: p["step"] <= F.col("step"))
    d = d.withColumn("_pairs", F.coalesce(F.aggregate(up_to, F.lit(0.0), lambda total, p: total + p["pairs"]), F.lit(0.0)))
    d = d.withColumn("d", F.col("step") * (d_max / steps))
    d = d.withColumn("k", F.col("_area") * F.col("_pairs") / (F.col("_n") * F.col("_n")))
    d = d.withColumn("l", F.sqrt(F.col("k") / math.pi)).withColumn("lc", F.col("l") - F.col("d"))
    return d.select(*keys, "step", "d", "k", "l", "lc", F.col("_n").alias("n"))


def hann(length: int) -> list[float]:
    if length == 1:
        return [1.0]
    return [0.5 - 0.5 * math.cos(2 * math.pi * k / (length - 1)) for k in range(length)]


def smooth(y: np.ndarray, length: int) -> np.ndarray:
    """Hann-weighted average, zero padded, same length."""
    if length < 3:
        return y
    w = np.array(hann(length))
    return np.convolve(y, w)[(length - 1) // 2 :][: len(y)] / w.sum()


def minima(y: np.ndarray, order: int) -> np.ndarray:
    """Positions strictly below all others within ``order``; the ends never are."""
    strict = np.ones(len(y), bool)
    strict[[0, -1]] = False
    for k in range(1, order + 1):
        strict[k:] &= y[k:] < y[:-k]
        strict[:-k] &= y[:-k] < y[k:]
    return np.flatnonzero(strict)


def first_minimum_index(y: np.ndarray) -> int:
    """The lower of the first two minima of the smoothed curve, else the last position."""
    s = smooth(y, len(y) // 3)
    m = minima(s, len(y) // 5)
    if len(m) == 0:
        return len(y) - 1
    return int(m[1] if len(m) > 1 and s[m[0]] > s[m[1]] else m[0])


def first_maximum_index(y: np.ndarray) -> int:
    s = smooth(y, 20)
    m = minima(-s, 3)
    return int(m[0] if len(m) else s.argmax())


def _read_curve(lc: DataFrame, keys, index, out: str) -> DataFrame:
    """Distance at the position ``index(curve)``; a curve has ``STEPS`` values at most."""
    position = F.pandas_udf(lambda ys: pd.Series([index(np.asarray(y)) for y in ys], dtype="int32"), "int")
    curve = F.array_sort(F.collect_list(F.struct("step", "d", "lc")))
    d = lc.groupBy(*keys).agg(curve.alias("_c"))
    d = d.withColumn("_i", position(F.transform("_c", lambda p: p["lc"])))
    return d.select(*keys, F.get("_c", F.col("_i"))["d"].alias(out))


def hard_core_radius(lc: DataFrame, keys) -> DataFrame:
    """Distance of the first local minimum of the smoothed centred L function.

    Of the first two minima the lower one counts; without any, the largest distance.
    """
    return _read_curve(lc, keys, first_minimum_index, "rhc")


def first_maximum(lc: DataFrame, keys) -> DataFrame:
    return _read_curve(lc, keys, first_maximum_index, "r_max")


def acceptance(lc: DataFrame, keys, diagonal: Column) -> DataFrame:
    """Distance of the smallest centred L value over the region diagonal."""
    return lc.groupBy(*keys).agg((F.min_by("d", F.struct("lc", "step")) / diagonal).alias("acceptance"))


def region_radius(points: DataFrame, keys, d_max: float = 7.5, least: int = 50) -> DataFrame:
    """Hard-core radius per region of at least ``least`` points; the area is the sum of areas."""
    keys = list(keys)
    lc = k_function(points, keys, d_max, F.sum("area"))
    return hard_core_radius(lc.filter(F.col("n") >= least), keys)


def pane_radius(splinters: DataFrame) -> DataFrame:
    """Hard-core radius of a pane and its ratio to the pane diagonal."""
    lc = k_function(splinters, ["specimen_id"], 7.5, F.sum("area"))
    size = splinters.groupBy("specimen_id").agg(F.max("w_mm").alias("_w"), F.max("h_mm").alias("_h"))
    d = hard_core_radius(lc, ["specimen_id"]).join(size, "specimen_id")
    diagonal = F.sqrt(F.col("_w") * F.col("_w") + F.col("_h") * F.col("_h"))
    return d.select("specimen_id", "rhc", (F.col("rhc") / diagonal).alias("acceptance"))


def chi2_quantile(p: float, dof: int) -> float:
    """Quantile by bisection of the regularised lower incomplete gamma series."""

    def cdf(x: float) -> float:
        a, half = dof / 2, x / 2
        if half <= 0:
            return 0.0
        term = math.exp(-half + a * math.log(half) - math.lgamma(a + 1))
        total, k = 0.0, 0
        # the terms grow until k passes half - a, then fall geometrically
        while k <= half - a or term > 1e-17 * total:
            total += term
            k += 1
            term *= half / (a + k)
        return total

    low, high = 0.0, dof + 40 * math.sqrt(2 * dof) + 40
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def quadrat_test(points: DataFrame, keys, size=(500.0, 500.0), d: float = 100.0, x="x_mm", y="y_mm") -> DataFrame:
    """Pearson X² of the quadrat counts, empty quadrats included, and the 0.95 critical value.

    Empty quadrats contribute the expected count each, so they need no rows of their own.
    """
    keys = list(keys)
    nx, ny = math.ceil(size[0] / d), math.ceil(size[1] / d)
    cells = points.groupBy(*keys, F.floor(F.col(x) / d).alias("_i"), F.floor(F.col(y) / d).alias("_j")).agg(
        F.count(F.lit(1)).alias("_o")
    )
    totals = cells.groupBy(*keys).agg(
        F.sum("_o").alias("n"),
        F.count(F.lit(1)).alias("_filled"),
        F.sum((F.col("_o") * F.col("_o")).cast("double")).alias("_oo"),
    )
    e = F.col("n") * (d * d / (size[0] * size[1]))
    filled = (F.col("_oo") - 2 * e * F.col("n") + F.col("_filled") * e * e) / e
    dof = (nx - 1) * (ny - 1)
    d2 = totals.withColumn("x2", filled + (nx * ny - F.col("_filled")) * e)
    critical = chi2_quantile(0.95, dof)
    return d2.select(*keys, "n", "x2", F.lit(dof).alias("dof"), F.lit(critical).alias("critical"))


def delta_hcp(intensity: Column) -> Column:
    return F.sqrt(F.lit(2 / math.sqrt(3)) / intensity)
