"""Aggregates per cell, looked up by property name."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NORM_AREA = 2500.0


def clean(col) -> Column:
    """NaN counts as missing."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(c), c)


def property_kernel(col: str) -> tuple[Column, Column]:
    return F.avg(clean(col)), F.stddev_pop(clean(col))


def count_kernel() -> tuple[Column, Column]:
    return F.count(F.lit(1)).cast("double"), F.lit(0.0)


def nfifty_kernel(window_size: Column) -> tuple[Column, Column]:
    return F.floor(F.count(F.lit(1)) * (NORM_AREA / window_size)).cast("double"), F.lit(0.0)


def intensity_kernel() -> tuple[Column, Column]:
    return F.try_divide(F.count(F.lit(1)), F.sum("area")), F.lit(0.0)


def kernel(prop: str, window_size: Column | None = None) -> tuple[Column, Column]:
    """Value and deviation aggregates for a property; unknown names are plain columns."""
    named: dict[str, Callable] = {
        "count": count_kernel,
        "intensity": intensity_kernel,
        "nfifty": lambda: nfifty_kernel(window_size),
    }
    return named.get(prop, lambda: property_kernel(prop))()


def aggregate(cells: DataFrame, keys, props, window_size: Column | None = None) -> DataFrame:
    """All requested properties in one aggregation: ``<prop>`` and ``<prop>_std``."""
    out = []
    for prop in props:
        value, std = kernel(prop, window_size)
        out += [value.alias(prop), std.alias(f"{prop}_std")]
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *out)


def fill_gaps(grid: DataFrame, keys, flat: str, values) -> DataFrame:
    """Linear interpolation of missing values along the flattened grid, ends held.

    A grid has a fixed number of cells per key, so ordering one key's grid is bounded. The next
    known cell is the last one in descending order: a frame that ends at the grid's last cell
    would be gone through once more for every cell.
    """
    values = list(values)
    before = Window.rowsBetween(Window.unboundedPreceding, 0).partitionBy(*keys)

    def latest(order: Column, out: str) -> list[Column]:
        known = [F.when(clean(v).isNotNull(), F.struct(F.col(flat).alias("p"), F.col(v).alias("v"))) for v in values]
        return [F.last(k, ignorenulls=True).over(before.orderBy(order)).alias(f"{out}{n}") for n, k in enumerate(known)]

    d = grid.select("*", *latest(F.asc(flat), "_a")).select("*", *latest(F.desc(flat), "_b"))
    filled = {}
    for n, v in enumerate(values):
        a, b = F.col(f"_a{n}"), F.col(f"_b{n}")
        share = F.try_divide(F.col(flat) - a["p"], b["p"] - a["p"])
        between = a["v"] + (b["v"] - a["v"]) * share
        filled[v] = F.when(b.isNull(), a["v"]).when(a.isNull(), b["v"]).when(a["p"] == b["p"], a["v"]).otherwise(between)
    return d.withColumns(filled).drop(*[f"_{s}{n}" for s in "ab" for n in range(len(values))])


def skipped_cells(grid: DataFrame, keys, value: str, skip: Column, fill: str = "mean", normalise: bool = False) -> DataFrame:
    """Blank the cells of ``skip``, fill them with the grid mean or zero, scale by the maximum."""
    over = Window.partitionBy(*keys)
    d = grid.withColumn(value, F.when(~skip, F.col(value)))
    filler = F.avg(value).over(over) if fill == "mean" else F.lit(0.0)
    d = d.withColumn(value, F.coalesce(F.col(value), filler))
    if normalise:
        d = d.withColumn(value, F.try_divide(F.col(value), F.max(value).over(over)))
    return d


def custom(
    cells: DataFrame,
    keys,
    columns,
    state: Callable[[pd.DataFrame], tuple],
    n_state: int,
    finish: Callable[..., tuple[Column, Column]],
) -> DataFrame:
    """User-defined window calculator.

    ``state`` turns a batch of splinters into ``n_state`` additive contributions per row
    (arrays as long as the batch). They are added up per cell, within the batch and then
    by Spark, and ``finish`` turns the totals into (value, deviation). A cell therefore
    never has to fit into one task.
    """
    keys = list(keys)
    names = [f"s{k}" for k in range(n_state)]
    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{n} double" for n in names])

    def batches(frames):
        for pdf in frames:
            part = pdf[keys].assign(**dict(zip(names, state(pdf))))
            yield part.groupby(keys, as_index=False, sort=False).sum()

    states = cells.select(*keys, *[c for c in columns if c not in keys]).mapInPandas(batches, schema)
    totals = states.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    value, std = finish(*[F.col(n) for n in names])
    return totals.select(*keys, value.alias("value"), std.alias("std"))


def map_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a function to batches of rows in parallel, in no particular order."""

    def batches(frames):
        for pdf in frames:
            yield fn(pdf)

    return df.mapInPandas(batches, schema)
