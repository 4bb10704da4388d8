"""Which splinters count: edge, impact, sensor and position exclusions, boxes, areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sensor positions (mm) by break position; only corner sensors are known.
SENSOR_POSITIONS = {"corner": {1: (450.0, 50.0), 3: (250.0, 250.0), 4: (450.0, 450.0), 5: (50.0, 450.0)}}
ALL_SENSORS = (1, 3, 4, 5)


def distance(x0, y0, x="x_mm", y="y_mm") -> Column:
    dx = F.col(x) - (F.col(x0) if isinstance(x0, str) else F.lit(x0))
    dy = F.col(y) - (F.col(y0) if isinstance(y0, str) else F.lit(y0))
    return F.sqrt(dx * dx + dy * dy)


def away_from_edge(delta: float = 10.0) -> Column:
    x, y = F.col("x_mm"), F.col("y_mm")
    return (x > delta) & (x < F.col("w_mm") - delta) & (y > delta) & (y < F.col("h_mm") - delta)


def away_from_impact(radius: float = 20.0) -> Column:
    return distance("ip_x", "ip_y") > radius


def away_from_sensors(sensors=ALL_SENSORS, radius: float = 10.0) -> Column:
    """The sensor table is a handful of fixed points, so it is part of the expression."""
    keep = F.lit(True)
    for break_pos, positions in SENSOR_POSITIONS.items():
        near = F.lit(False)
        for s in sensors:
            if s in positions:
                near = near | (distance(*positions[s]) <= radius)
        keep = keep & ~((F.col("break_pos") == break_pos) & near)
    return keep


def away_from_positions(positions: str = "excluded_positions", radius="excluded_positions_radius") -> Column:
    """``positions`` is an array of ``[x, y]`` pairs on the row."""
    r = F.col(radius) if isinstance(radius, str) else F.lit(radius)

    def near(p):
        dx, dy = F.col("x_mm") - p[0], F.col("y_mm") - p[1]
        return F.sqrt(dx * dx + dy * dy) <= r

    return ~F.exists(positions, near)


def in_box(x1, y1, x2, y2, x="x_mm", y="y_mm") -> Column:
    return F.col(x).between(x1, x2) & F.col(y).between(y1, y2)


def contour_share(x1, y1, x2, y2, contour="contour") -> Column:
    """Share of the contour points inside a closed box."""
    inside = F.filter(contour, lambda p: p["px"].between(x1, x2) & p["py"].between(y1, y2))
    return F.size(inside) / F.size(contour)


def area_filter(df: DataFrame, key: str, low: float = 10.0, high: float = 25000.0, ties: str = "splinter_key") -> DataFrame:
    """Drop the largest contour of each pane (the pane outline), then keep ``low..high``.

    The largest is found by an aggregate that combines map-side, not by ranking a pane.
    """
    largest = df.groupBy(key).agg(F.max_by(ties, F.struct("area", ties)).alias("_outline"))
    kept = df.filter(F.col("area").between(low, high)).join(largest, key)
    return kept.filter(F.col(ties) != F.col("_outline")).drop("_outline")


def measured(splinter: DataFrame, specimen: DataFrame, edge: float = 10.0, impact: float = 20.0) -> DataFrame:
    """Splinters with their specimen, after the default exclusions."""
    return splinter.join(specimen, "specimen_id").filter(away_from_edge(edge) & away_from_impact(impact))


def finite(col: str) -> Column:
    c = F.col(col)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
