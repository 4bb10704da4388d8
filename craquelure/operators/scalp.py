"""Residual stress per location and specimen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craquelure.functions.mechanics import principal_stress

DIRECTIONS = ("x", "y", "xy")


def locations(df: DataFrame, keys=("specimen_id", "location"), order: str = "ord", manual: DataFrame | None = None) -> DataFrame:
    """Surface stress per direction (the last measurement wins), validity, principal stresses.

    ``df`` has ``orientation`` (any case) and ``stress0``. ``manual`` may supply stresses
    ``(keys, orientation, stress0)`` for directions that were not measured.
    """
    keys = list(keys)
    d = df.select(*keys, F.lower("orientation").alias("_o"), F.col("stress0").alias("_v"), F.struct(F.lit(1).alias("m"), F.col(order).alias("o")).alias("_at"))
    if manual is not None:
        entered = manual.select(*keys, F.lower("orientation").alias("_o"), F.col("stress0").alias("_v"))
        d = d.unionByName(entered.withColumn("_at", F.struct(F.lit(0).alias("m"), F.lit(None).cast(df.schema[order].dataType).alias("o"))))
    last = [F.max_by("_v", F.when(F.col("_o") == o, F.col("_at"))).alias(f"s_{o}") for o in DIRECTIONS]
    valid = [F.bool_or(F.col("_o") == o) for o in DIRECTIONS]
    d = d.groupBy(*keys).agg(*last, (valid[0] & valid[1] & valid[2]).alias("valid"))
    s1, s2 = principal_stress(F.col("s_x"), F.col("s_y"), F.col("s_xy"))
    return d.withColumn("sig_1", F.when(F.col("valid"), s1)).withColumn("sig_2", F.when(F.col("valid"), s2))


def specimen_stress(locs: DataFrame, key: str = "specimen_id") -> DataFrame:
    """Mean and deviation of both principal stresses over the valid locations; n over all."""
    long = locs.select(key, "location", "valid", F.explode(F.array("sig_1", "sig_2")).alias("s"))
    ok = F.when(F.col("valid"), F.col("s"))
    return long.groupBy(key).agg(
        F.avg(ok).alias("sig_h"),
        F.stddev_pop(ok).alias("deviation"),
        (F.count(F.lit(1)) / 2).cast("bigint").alias("n_points"),
        (F.count(ok) == 0).alias("invalid"),
    )


def retardation_stress(fits: DataFrame, keys, c: float, beta: float) -> DataFrame:
    """Principal stresses from the quadratic retardation fits of the three directions.

    ``fits`` has ``orientation`` and ``coef`` (constant first); as coded, the surface value
    is the leading coefficient of the derivative.
    """
    import math

    keys = list(keys)
    lead = 2 * F.get("coef", F.lit(2)) / (c * math.cos(beta) ** 2)
    value = lambda o: F.max(F.when(F.lower("orientation") == o, lead)).alias(f"s_{o}")
    d = fits.groupBy(*keys).agg(*[value(o) for o in DIRECTIONS])
    s1, s2 = principal_stress(F.col("s_x"), F.col("s_y"), F.col("s_xy"), retardation=True)
    return d.withColumn("sig_1", s1).withColumn("sig_2", s2)
