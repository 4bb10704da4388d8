"""Property grids over radius and strain energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from craquelure.functions import names
from craquelure.operators import cells, kernels
from craquelure.operators.brackets import bracket, weight


def energy_band(u: Column, value: float, share: float = 0.05) -> Column:
    return (u > value * (1 - share)) & (u < value * (1 + share))


def layer_input(
    catalog: DataFrame,
    break_pos: str,
    break_mode: str = "punch",
    exclude: str | None = None,
    thicknesses=None,
    excluded_names=(),
    base: Column | None = None,
) -> DataFrame:
    """Specimens that may enter a layer."""
    keep = (
        (F.col("break_pos") == break_pos)
        & (F.col("break_mode") == break_mode)
        & F.col("boundary").isin("A", "B", "Z")
        & F.col("has_scalp")
        & F.col("has_splinters")
        & F.col("u_d").isNotNull()
        & ~F.isnan("u_d")
    )
    if exclude is not None:
        keep = keep & ~names.prefix_match(F.col("name"), exclude)
    if thicknesses is not None:
        keep = keep & F.col("thickness").isin(list(thicknesses))
    if excluded_names:
        keep = keep & ~F.col("name").isin(list(excluded_names))
    if base is not None:
        keep = keep & base
    return catalog.filter(keep)


LAYER_KEYS = ["boundary", "thickness", "break_pos"]


def create(
    splinters: DataFrame,
    specimens: DataFrame,
    props=("area",),
    dr: float = 25.0,
    r_min: float = 20.0,
    normalise: bool = False,
    fill: bool = True,
) -> DataFrame:
    """Property over radius and energy for all specimens in one job.

    ``splinters`` carry their specimen (``measured``); ``specimens`` are the selected
    catalog rows with ``u``. One aggregation computes every property; bands without
    splinters are interpolated along the radius. ``r`` is the lower edge of the band.
    """
    info = specimens.select("specimen_id", "u", *LAYER_KEYS, "w_mm", "h_mm", "ip_x", "ip_y")
    chosen = splinters.join(specimens.select("specimen_id"), "specimen_id", "left_semi")
    values = kernels.aggregate(cells.polar(chosen, dr, 360.0, r_min), ["specimen_id", "rb"], props)
    bands = info.withColumn("rb", F.explode(F.sequence(F.lit(0), cells.n_bands(dr, r_min) - 1)))
    d = bands.join(values, ["specimen_id", "rb"], "left")
    columns = [c for p in props for c in (p, f"{p}_std")]
    if fill:
        d = kernels.fill_gaps(d, ["specimen_id"], "rb", columns)
    if normalise:
        over = Window.partitionBy("specimen_id")
        for p in props:
            d = d.withColumn(p, F.try_divide(F.col(p), F.max(p).over(over)))
    d = d.withColumn("r", F.lit(r_min) + F.col("rb") * dr).withColumn("n", F.coalesce("n", F.lit(0)))
    return d.select("specimen_id", *LAYER_KEYS, "u", "rb", "r", "n", *columns)


def long(layer: DataFrame, props=("area",)) -> DataFrame:
    """One row per property and grid point: ``prop, value, std``; the stored form."""
    parts = F.array(
        *[
            F.struct(F.lit(p).alias("prop"), F.col(p).cast("double").alias("value"), F.col(f"{p}_std").cast("double").alias("std"))
            for p in props
        ]
    )
    keep = [c for c in layer.columns if c not in {x for p in props for x in (p, f"{p}_std")}]
    return layer.select(*keep, F.explode(parts).alias("_p")).select(*keep, "_p.*")


def lookup(layer: DataFrame, queries: DataFrame, ident, keys=None) -> DataFrame:
    """Bilinear value and deviation at ``(r_q, u_q)``, clamped to the grid.

    ``layer`` is in long form, restricted to one property or with ``prop`` among the
    keys. The four corners of a query become rows of one equi-join.
    """
    keys = list(keys or LAYER_KEYS)
    ident = list(ident)
    # specimens with the same energy share one grid row
    grid = layer.groupBy(*keys, "u", "r").agg(F.avg("value").alias("value"), F.avg("std").alias("std"))
    d = bracket(queries, grid, keys, "u_q", "u", "uc")
    d = bracket(d, grid, keys, "r_q", "r", "rc")
    wu, wr = weight("uc"), weight("rc")
    corners = F.array(
        *[
            F.struct(F.col(u).alias("u"), F.col(r).alias("r"), w.alias("w"))
            for u, r, w in (
                ("uc_lo", "rc_lo", (1 - wu) * (1 - wr)),
                ("uc_lo", "rc_hi", (1 - wu) * wr),
                ("uc_hi", "rc_lo", wu * (1 - wr)),
                ("uc_hi", "rc_hi", wu * wr),
            )
        ]
    )
    d = d.select(*keys, *ident, "r_q", "u_q", F.explode(corners).alias("_c")).select(*keys, *ident, "r_q", "u_q", "_c.*")
    d = d.filter("w > 0").join(grid, keys + ["u", "r"])
    return d.groupBy(*keys, *ident, "r_q", "u_q").agg(
        F.sum(F.col("w") * F.col("value")).alias("value"), F.sum(F.col("w") * F.col("std")).alias("std")
    )


def boundary_means(splinters: DataFrame, specimens: DataFrame, prop: str = "area", dr: float = 25.0) -> DataFrame:
    """Mean over specimens per boundary and band (each specimen weighs the same)."""
    layer = create(splinters, specimens, [prop], dr)
    return layer.groupBy("boundary", "rb", "r").agg(
        F.avg(kernels.clean(prop)).alias(prop), F.count(F.lit(1)).alias("specimens")
    )
