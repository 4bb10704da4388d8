"""Splinter properties by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craquelure.functions import geometry as G

NEEDS_HULL = {"roughness", "asp", "asp0", "l1", "l2", "l1_weighted", "impact_dependency"}
NAMES = (
    "area",
    "orientation",
    "impact_dependency",
    "roundness",
    "roughness",
    "asp",
    "asp0",
    "l1",
    "l2",
    "circumfence",
    "l1_weighted",
    "angle",
    "angle0",
)


def with_properties(df: DataFrame, props, px_per_mm: float = 8.0) -> DataFrame:
    """Add the named properties to rows with ``contour, area, circ, x_mm, y_mm, ip_x, ip_y``.

    The edge sums and (only where a property needs it) the hull are computed once per row.
    """
    unknown = set(props) - set(NAMES)
    if unknown:
        raise ValueError(f"unknown properties: {sorted(unknown)}")
    d = df.withColumn("_m", G.measures("contour"))
    if set(props) & NEEDS_HULL:
        d = d.withColumn("_h", G.hull_columns("contour"))
    shape = G.Shape(F.col("_m"))
    to_x, to_y = F.col("ip_x") - F.col("x_mm"), F.col("ip_y") - F.col("y_mm")
    major_x, major_y = shape.axis
    scale = shape.perimeter / F.col("circ")
    columns: dict[str, Column] = {
        "area": F.col("area"),
        "orientation": G.alignment(to_x, to_y, major_x, major_y),
        "roundness": G.roundness(shape.area_px, shape.perimeter),
        "circumfence": shape.open_length / px_per_mm,
        "angle": G.angle_deg(-to_x, -to_y),
        "angle0": G.angle_deg(major_x, major_y),
    }
    if set(props) & NEEDS_HULL:
        la, lb, ux, uy = (F.col(f"_h.{c}") for c in ("la", "lb", "ux", "uy"))
        long, short = F.greatest(la, lb), F.least(la, lb)
        first = G.alignment(to_x, to_y, ux, uy) > G.alignment(to_x, to_y, -uy, ux)
        aspect = F.abs(F.try_divide(long, short))
        columns |= {
            "roughness": F.col("_h.hull") / shape.perimeter,
            "asp": F.abs(F.when(first, F.try_divide(la, lb)).otherwise(F.try_divide(lb, la))),
            "asp0": aspect,
            "l1": long / scale,
            "l2": short / scale,
            "l1_weighted": long / scale * columns["orientation"],
            "impact_dependency": columns["orientation"] * (aspect - 1),
        }
    out = d
    for name in props:
        if name != "area":
            out = out.withColumn(name, columns[name])
    return out.drop("_m", "_h")
