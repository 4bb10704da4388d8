"""Histograms, cumulative shares, kernel densities, modes, moving averages."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from craquelure.operators.ordered import stretches


def weighted_median(counts: DataFrame, keys, value: str, count: str) -> DataFrame:
    """Exact median per key from value counts (midpoint of the two middle values)."""
    keys = list(keys)
    ranked = cumulative(counts, keys, value, {"_cum": F.col(count)})
    totals = counts.groupBy(*keys).agg(F.sum(count).alias("_n"))
    d = ranked.join(totals, keys)
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    return d.groupBy(*keys).agg(
        (
            (
                F.min(F.when(F.col("_cum") >= low, F.col(value)))
                + F.min(F.when(F.col("_cum") >= high, F.col(value)))
            )
            / 2
        ).alias("median")
    )


def cumulative(df: DataFrame, keys, order: str, sums: dict, rows: int = 65536) -> DataFrame:
    """Running sums along a numeric column with distinct values per key.

    A stretch (see :func:`ordered.stretches`) is ordered in one task, the stretches before it
    enter as totals.
    """
    keys = list(keys)
    d = stretches(df, keys, order, rows)
    for name, expr in sums.items():
        d = d.withColumn(f"_v_{name}", expr)
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    starts = d.groupBy(*keys, "_cell").agg(*[F.sum(f"_v_{s}").alias(f"_t_{s}") for s in sums])
    starts = starts.select(
        *keys, "_cell", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums]
    )
    for name in sums:
        d = d.withColumn(name, F.sum(f"_v_{name}").over(inside))
    d = d.join(starts, keys + ["_cell"])
    for name in sums:
        d = d.withColumn(name, F.col(name) + F.col(f"_b_{name}"))
    return d.drop("_cell", *[f"_{p}_{s}" for s in sums for p in ("v", "b")])


def limits(df: DataFrame, keys, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def bin_index(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Half-open bins, the last one closed; outside the range there is no bin."""
    width = (hi - lo) / bins
    index = F.when(value == hi, F.lit(bins - 1)).otherwise(F.floor((value - lo) / F.nullif(width, F.lit(0.0))).cast("int"))
    return F.when((value >= lo) & (value <= hi), index)


def edge(k: Column, lo: Column, hi: Column, bins: int) -> Column:
    return lo + k * ((hi - lo) / bins)


def histogram(df: DataFrame, keys, value: str, edges: DataFrame, bins: int, split: str | None = None, labels=()) -> DataFrame:
    """Counts and density per key and bin, empty bins included.

    ``edges`` has one ``lo``/``hi`` per key. With ``split`` the rows are counted per
    label in the same pass (columns ``n_<label>``, ``density_<label>``).
    """
    keys = list(keys)
    d = df.join(edges, keys) if keys else df.withColumn("_k", F.lit(1)).join(edges.withColumn("_k", F.lit(1)), "_k")
    d = d.withColumn("bin", bin_index(F.col(value), F.col("lo"), F.col("hi"), bins)).filter("bin is not null")
    if split is None:
        counts = [F.count(F.lit(1)).alias("n")]
        names = [""]
    else:
        counts = [F.count_if(F.col(split) == label).alias(f"n_{label}") for label in labels]
        names = [f"_{label}" for label in labels]
    counted = d.groupBy(*keys, "bin").agg(*counts)
    every = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = every.join(counted, [*keys, "bin"], "left")
    # the bins of one key are few: a window over them is bounded
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    width = (F.col("hi") - F.col("lo")) / bins
    for s in names:
        out = out.withColumn(f"n{s}", F.coalesce(F.col(f"n{s}"), F.lit(0)))
    for s in names:
        out = out.withColumn(f"density{s}", F.try_divide(F.col(f"n{s}"), F.sum(f"n{s}").over(over) * width))
    return out.withColumn("edge", edge(F.col("bin"), F.col("lo"), F.col("hi"), bins))


def cdf(hist: DataFrame, keys, count: str = "n") -> DataFrame:
    """Cumulative share over the (bounded) bins of a histogram."""
    over = Window.partitionBy(*keys)
    up_to = over.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("cdf", F.try_divide(F.sum(count).over(up_to), F.sum(count).over(over)))


def share_curve(df: DataFrame, keys, value: str) -> DataFrame:
    """Cumulative sum of the sorted values over their total, one row per distinct value.

    ``n`` tells how many equal values end at ``share``; the single steps in between are
    ``share - k * value / total``.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    d = cumulative(counts, keys, value, {"cum": F.col(value) * F.col("n")})
    totals = counts.groupBy(*keys).agg(F.sum(F.col(value) * F.col("n")).alias("total"))
    return d.join(totals, list(keys)).withColumn("share", F.try_divide("cum", "total"))


def size_distribution(df: DataFrame, keys, value: str, steps: int = 50) -> DataFrame:
    """For equal thresholds: how many values do not exceed it (missing where none does)."""
    lim = limits(df, keys, value)
    d = df.join(lim, list(keys))
    step = (F.col("hi") - F.col("lo")) / (steps - 1)
    k = F.ceil((F.col(value) - F.col("lo")) / F.nullif(step, F.lit(0.0))).cast("int")
    k = F.coalesce(k, F.lit(0))
    at = lambda i: F.col("lo") + i * step
    first = F.when((k > 0) & (at(k - 1) >= F.col(value)), k - 1).when(at(k) < F.col(value), k + 1).otherwise(k)
    counted = d.withColumn("step", F.least(first, F.lit(steps - 1))).groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("c"))
    every = lim.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    w = Window.partitionBy(*keys)
    d = every.join(counted, [*keys, "step"], "left").withColumn(
        "index", F.sum(F.coalesce("c", F.lit(0))).over(w.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    )
    total = F.sum(F.coalesce("c", F.lit(0))).over(w)
    return d.withColumn("threshold", at(F.col("step"))).withColumn(
        "index", F.when(F.col("index") < total, F.col("index"))
    )


def kde(df: DataFrame, keys, value: str, points: int = 1000) -> DataFrame:
    """Gaussian kernel density on equal points between minimum and maximum.

    Equal values are merged first, and every task adds up its values per point before the
    shuffle, so the cost is (distinct values x points) and the shuffle (keys x points).
    """
    keys = list(keys)
    d = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    stats = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(value).alias("_lo"),
        F.max(value).alias("_hi"),
        F.stddev_samp(value).alias("_s"),
    )
    counts = d.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")).join(stats, keys)
    counts = counts.withColumn("_bw", F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    kinds = ", ".join(f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in keys)
    step = np.arange(points)

    def add_up(batches):
        """Each batch adds its values up per key and point, so rows that leave are keys x points."""
        for batch in batches:
            for key, part in batch.groupby(keys, dropna=False, sort=False):
                n, lo, hi, width = part[["_n", "_lo", "_hi", "_bw"]].iloc[0].astype(float)
                x = lo + step * ((hi - lo) / (points - 1))
                density = np.full(points, np.nan)
                # one value only, or one kind of value, has no bandwidth: its density is missing
                if width > 0:
                    density[:] = 0.0
                    values, many = part[value].to_numpy(float), part["_c"].to_numpy(float)
                    for at in range(0, len(values), 1024):
                        z = (x[None, :] - values[at : at + 1024, None]) / width
                        density += many[at : at + 1024] @ np.exp(-0.5 * z * z)
                    density /= n * width * math.sqrt(2 * math.pi)
                out = pd.DataFrame({"k": step, "x": x, "density": density})
                yield out.assign(**dict(zip(keys, key)))[[*keys, "k", "x", "density"]]

    parts = counts.mapInPandas(add_up, f"{kinds}, k int, x double, density double")
    density = F.sum(F.when(~F.isnan("density"), F.col("density")))
    return parts.groupBy(*keys, "k", "x").agg(density.alias("density"))


def mode(df: DataFrame, keys, value: str, points: int = 1000) -> DataFrame:
    """Most probable value: where the density is largest, and its share of all points.

    Without a density (equal values) both are missing.
    """
    d = kde(df, keys, value, points)
    return d.groupBy(*keys).agg(
        F.max_by("x", F.when(F.col("density").isNotNull(), F.struct("density", -F.col("k")))).alias("mode"),
        F.try_divide(F.max("density"), F.sum("density")).alias("probability"),
    )


def moving_average(df: DataFrame, keys, x: str, ys, edges) -> DataFrame:
    """Mean and deviation per bin of ``x``; half-open bins, the last one open-ended.

    All edges appear in the result; bins without rows have missing values.
    """
    keys = list(keys)
    edges = [float(e) for e in edges]
    table = F.array(*[F.lit(e) for e in edges])
    d = df.filter(F.col(x).isNotNull() & ~F.isnan(x))
    d = d.withColumn("bin", F.size(F.filter(table, lambda e: e <= F.col(x))) - 1).filter("bin >= 0")
    aggs = [F.count(F.lit(1)).alias("n")]
    for y in ys:
        aggs += [F.avg(y).alias(y), F.stddev_pop(y).alias(f"{y}_std")]
    binned = d.groupBy(*keys, "bin").agg(*aggs)
    every = d.select(*keys).distinct().select(*keys, F.posexplode(table).alias("bin", "edge"))
    return every.join(binned, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
