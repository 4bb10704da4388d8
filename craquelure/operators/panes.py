"""Pane-level aggregates: N50 counts, crack surface, detection rate, tiles, resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craquelure.functions import mechanics as M
from craquelure.operators import cells, kernels
from craquelure.operators.exclusions import contour_share, in_box
from craquelure.operators.ordered import key_stats

# Norm region 50 x 50 mm around (400, 400), 25 mm edge strip.
NORM_CENTRES = ((400.0, 400.0),)
NORM_SIZE = 50.0
NORM_EDGE = 25.0
# Fixed value: the detectable area of a pane, 490 mm square without the impact disc.
DETECTABLE_AREA = 490.0**2 - math.pi * 20.0**2


def window_grid(splinters: DataFrame, props, kw: float = 50.0, n_points=25, size=(500.0, 500.0), keys=("specimen_id",)) -> DataFrame:
    """Overlapping square windows: one row per non-empty window and property aggregates."""
    if set(props) <= {"count", "intensity"}:
        return _counted_windows(splinters, list(props), kw, n_points, size, list(keys))
    placed = cells.windows(splinters, kw, n_points, size[0], size[1], size)
    return kernels.aggregate(placed, [*keys, "i", "j"], props, F.lit(float(kw) ** 2))


def _counted_windows(splinters: DataFrame, props, kw: float, n_points, size, keys) -> DataFrame:
    """Windows of properties that counts and summed areas give.

    Splinters that lie in the same windows are added up before they are copied to each of them. What is
    left of a key are at most the places its windows tell apart, so a key's windows are made in one task.
    """
    spark = splinters.sparkSession
    ranges = cells.window_ranges(splinters.select(*keys, "x_mm", "y_mm", "area"), kw, n_points, size[0], size[1], size)
    d = ranges.groupBy(*keys, "_is", "_js").agg(F.count(F.lit(1)).alias("_n"), F.sum("area").alias("_area"))
    d = d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    for index in ("i", "j"):
        d = d.withColumn(index, F.explode(F.sequence(f"_{index}s.first", f"_{index}s.last")))
    d = d.groupBy(*keys, "i", "j").agg(F.sum("_n").alias("n"), F.sum("_area").alias("_area"))
    named = {"count": F.col("n").cast("double"), "intensity": F.try_divide("n", "_area")}
    out = [c for p in props for c in (named[p].alias(p), F.lit(0.0).alias(f"{p}_std"))]
    return d.select(*keys, "i", "j", "n", *out)


def filled_grid(values: DataFrame, panes: DataFrame, props, n_points=25, kw: float = 50.0, size=(500.0, 500.0)) -> DataFrame:
    """All windows of all panes, gaps interpolated along the flattened grid (row = ``j``).

    ``values`` has a row for a window at most. Panes meet their values by the pane alone, where the gaps are filled too.
    """
    nx, ny = cells.grid_points(n_points, size, kw)
    n = int(panes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = [c for c in values.columns if c not in ("specimen_id", "i", "j")]
    # a pane that is listed twice has its grid twice; panes are spread before they grow
    listed = panes.groupBy("specimen_id").agg(F.count(F.lit(1)).alias("_panes"))
    grid = cells.full_grid(listed.repartition(n, "specimen_id"), nx, ny)
    known = values.filter(F.col("specimen_id").isNotNull()).repartition(n, "specimen_id")
    d = grid.unionByName(known, allowMissingColumns=True).groupBy("specimen_id", "i", "j").agg(
        F.max("_panes").alias("_panes"), *[F.first(c, ignorenulls=True).alias(c) for c in others]
    )
    d = d.filter("_panes is not null").withColumn("_pane", F.explode(F.sequence(F.lit(1), F.col("_panes").cast("int"))))
    d = d.select("specimen_id", "_pane", "i", "j", *others, (F.col("j") * (nx - 1) + F.col("i")).alias("_flat"))
    return kernels.fill_gaps(d, ["specimen_id", "_pane"], "_flat", props).drop("_flat", "_pane")


def pane_intensity(splinters: DataFrame, panes: DataFrame, kw: float = 50.0, n_points: int = 25) -> DataFrame:
    """Mean fracture intensity of a pane over the filled window grid (1/mm²)."""
    values = window_grid(splinters, ["intensity"], kw, n_points).select("specimen_id", "i", "j", "intensity")
    filled = filled_grid(values, panes, ["intensity"], n_points, kw)
    return filled.groupBy("specimen_id").agg(F.avg("intensity").alias("intensity"))


def norm_score(centre=(400.0, 400.0), size: float = NORM_SIZE, px_per_mm: float = 8.0, score: str = "coded") -> Column:
    """Contribution of one splinter to the norm count.

    As coded a full hit adds 1 and, being also above one half, another 0.5;
    ``score="doc"`` gives 1 for a full hit and 0.5 from one half on.
    """
    half = size // 2
    x1, x2, y1, y2 = (int(v * px_per_mm) for v in (centre[0] - half, centre[0] + half, centre[1] - half, centre[1] + half))
    share = contour_share(x1, y1, x2, y2)
    inner = in_box(NORM_EDGE, NORM_EDGE, F.col("w_mm") - NORM_EDGE, F.col("h_mm") - NORM_EDGE)
    if score == "doc":
        value = F.when(share == 1, 1.0).when(share >= 0.5, 0.5).otherwise(0.0)
    else:
        value = F.when(share == 1, 1.0).otherwise(0.0) + F.when(share > 0.5, 0.5).otherwise(0.0)
    return F.when(inner, value).otherwise(0.0)


def norm_count(contours: DataFrame, centres=NORM_CENTRES, **options) -> DataFrame:
    """N50 by counting: the norm score summed per pane, averaged over the centres."""
    total: Column = F.lit(0.0)
    for centre in centres:
        total = total + norm_score(centre, **options)
    return contours.groupBy("specimen_id").agg((F.sum(total) / len(centres)).alias("n50"))


def crack_surface_simple(splinters: DataFrame) -> DataFrame:
    t, area, circ = F.col("measured_thickness"), F.col("area"), F.col("circ")
    return splinters.groupBy("specimen_id").agg(
        F.sum(circ * t).alias("crack_surface"),
        F.avg(kernels.clean(area * t)).alias("mean_volume"),
        F.avg(kernels.clean("area")).alias("mean_area"),
        F.avg(kernels.clean("circ")).alias("mean_circ"),
        M.mass_per_mm(F.avg(kernels.clean("area"))).alias("mass_per_mm"),
    )


def edge_surface(length: Column, thickness: Column, width: Column) -> Column:
    """Half crack surface along contour edges of a length (mm), given the crack width there."""
    return ((thickness + width) + F.sqrt(thickness * thickness + width * width)) / 2 * length / 2


def detection_rate(splinters: DataFrame) -> DataFrame:
    """Share of the pane area that was detected, and the deviation from the expected area."""
    total = F.sum("area")
    deviation = F.abs(1 - total / DETECTABLE_AREA) * 100
    return splinters.groupBy("specimen_id").agg(
        total.alias("area"),
        (total / F.max(F.col("w_mm") * F.col("h_mm")) * 100).alias("rate"),
        deviation.alias("deviation"),
        (deviation > 5).alias("flagged"),
    )


def resample(df: DataFrame, keys, nx: int = 50, ny: int = 30, x="x", y="y", z="z") -> DataFrame:
    """Scattered values to a grid of cell means; cells are half-open, so the maximum drops."""
    d = key_stats(df, list(keys), _x0=F.min(x), _x1=F.max(x), _y0=F.min(y), _y1=F.max(y))
    d = d.withColumn("ix", cells.bucket(F.col(x), F.col("_x0"), F.col("_x1"), nx))
    d = d.withColumn("iy", cells.bucket(F.col(y), F.col("_y0"), F.col("_y1"), ny))
    d = d.filter((F.col("ix") < nx) & (F.col("iy") < ny))
    cx = F.col("_x0") + (F.col("ix") + 0.5) * ((F.col("_x1") - F.col("_x0")) / nx)
    cy = F.col("_y0") + (F.col("iy") + 0.5) * ((F.col("_y1") - F.col("_y0")) / ny)
    return d.groupBy(*keys, "ix", "iy").agg(
        F.first(cx).alias("cx"), F.first(cy).alias("cy"), F.avg(kernels.clean(z)).alias("value")
    )


def image_axis(x: Column, size: int, kw: int, n: int) -> Column:
    """Boxes ``[int(c - kw//2), int(c + kw//2))`` around all ``n`` centres of an image axis."""
    half = kw // 2
    step = (size - 2 * half) / (n - 1)
    boxes = F.sequence(
        F.greatest(F.floor((x - 2 * half) / step).cast("int"), F.lit(0)),
        F.least(F.floor((x + 1) / step).cast("int") + 1, F.lit(n - 1)),
    )

    def inside(i):
        c = F.lit(float(half)) + i * step
        return (F.floor(c - half) <= x) & (x < F.floor(c + half))

    return F.filter(boxes, inside)


def image_windows(pixels: DataFrame, size, kw: int, n: int, value: Column, keys=()) -> DataFrame:
    """Aggregate of the pixels per box; ``value`` is any aggregate column."""
    d = pixels.withColumn("i", F.explode(image_axis(F.col("x"), size[0], kw, n)))
    d = d.withColumn("j", F.explode(image_axis(F.col("y"), size[1], kw, n)))
    return d.groupBy(*keys, "i", "j").agg(value.alias("value"))


def brightness(pixels: DataFrame, target: float, keys=()) -> DataFrame:
    """Scale the gray values so that the image mean meets ``target``, saturated at 255."""
    keys = list(keys)
    d = pixels.withColumn("_k", F.lit(1))
    mean = d.groupBy("_k", *keys).agg(F.avg("gray").alias("_mean"))
    scaled = F.rint(F.col("gray") * (F.lit(target) / F.col("_mean")))
    return d.join(mean, ["_k", *keys]).withColumn("brightened", F.least(F.lit(255.0), scaled)).drop("_k", "_mean")


def sigmoid_contrast(gray: Column) -> Column:
    return F.floor(255.0 * (1.0 / (1.0 + F.exp(-10.0 * (gray / 255.0 - 0.5)))))
