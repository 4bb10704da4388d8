"""Bracket (as-of style) lookups: the table rows around a value.

Axis and values are put in one order, stretch by stretch, and every value takes the last axis
row before it and the first one from it on; what a stretch has none of comes from the stretches
beside it. No inequality join is planned, and an axis may crowd anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from craquelure.operators.ordered import stretches
from craquelure.session import checkpointed

STRETCH_ROWS = 65536


def bracket(df: DataFrame, axis: DataFrame, keys, position: str, value: str, out: str, rows: int = STRETCH_ROWS) -> DataFrame:
    """Add ``<out>_lo``, ``<out>_hi`` with ``lo < position <= hi``; positions are clamped.

    Rows whose key has no axis are dropped. ``<out>`` is the clamped position; at the low end it
    is ``lo`` itself, and an axis of one value is both ends.
    """
    keys = list(keys)
    marks = checkpointed(axis.select(*keys, F.col(value).cast("double").alias(out)).distinct())
    span = marks.groupBy(*keys).agg(F.min(out).alias("_a"), F.max(out).alias("_b"))
    second = marks.join(span, keys).filter(F.col(out) > F.col("_a")).groupBy(*keys).agg(F.min(out).alias("_second"))
    span = span.join(second, keys, "left")
    clamped = F.greatest(F.col("_a"), F.least(F.col("_b"), F.col(position).cast("double")))
    asked = df.join(span, keys).withColumn(out, clamped).withColumn("_axis", F.lit(False))
    both = asked.unionByName(marks.withColumn("_axis", F.lit(True)), allowMissingColumns=True)
    # read several times, and lookups follow one another
    both = checkpointed(stretches(checkpointed(both), keys, out, rows))
    mark = F.when(F.col("_axis"), F.col(out))

    # a value stands before an equal axis row
    cell = [*keys, "_cell"]
    up = Window.partitionBy(*cell).orderBy(out, "_axis").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*cell).orderBy(F.desc(out), F.desc("_axis")).rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(*cell).agg(F.min(mark).alias("_first"), F.max(mark).alias("_last"))
    back = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    on = Window.partitionBy(*keys).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *cell,
        F.last("_last", ignorenulls=True).over(back).alias("_before"),
        F.last("_first", ignorenulls=True).over(on).alias("_after"),
    )
    d = both.withColumn("_up", F.last(mark, ignorenulls=True).over(up))
    d = d.withColumn("_down", F.last(mark, ignorenulls=True).over(down)).filter(~F.col("_axis")).join(ends, cell)
    low_end = F.col(out) == F.col("_a")
    lo = F.when(low_end, F.col("_a")).otherwise(F.coalesce("_up", "_before"))
    hi = F.when(low_end, F.coalesce("_second", "_a")).otherwise(F.coalesce("_down", "_after"))
    d = d.withColumn(f"{out}_lo", lo).withColumn(f"{out}_hi", hi)
    return d.drop("_a", "_b", "_second", "_axis", "_cell", "_up", "_down", "_before", "_after")


def weight(out: str):
    """Share of the upper row in a linear interpolation."""
    lo, hi = F.col(f"{out}_lo"), F.col(f"{out}_hi")
    return F.coalesce(F.try_divide(F.col(out) - lo, hi - lo), F.lit(0.0))


def nearest_sample(df: DataFrame, targets: DataFrame, keys, time: str = "t", seq: str = "seq") -> DataFrame:
    """Row closest to a target time per key, ties to the smallest number.

    ``targets`` holds a few rows ``(keys, t0)``; the minimum combines map-side.
    """
    keys = list(keys)
    d = df.join(targets, keys)
    best = F.min(F.struct(F.abs(F.col(time) - F.col("t0")).alias("gap"), F.col(seq), F.col(time)))
    return d.groupBy(*keys, "t0").agg(best.alias("_b")).select(*keys, "t0", f"_b.{seq}", f"_b.{time}", "_b.gap")
