"""Fixed literature values and the expressions that read them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from craquelure.functions.mechanics import E_MPA

# Relative remaining strain energy of fragments over A/h², for fragments
# with 3, 4, 5 and infinitely many edges (published table, doi 10.1007/s40940-016-0036-z).
REMAINING_ENERGY = [
    (0.05, 0.003, 0.002, 0.001, 0.001),
    (0.25, 0.052, 0.032, 0.028, 0.026),
    (0.45, 0.121, 0.083, 0.074, 0.069),
    (0.65, 0.186, 0.141, 0.129, 0.121),
    (0.85, 0.241, 0.198, 0.184, 0.173),
    (1.05, 0.287, 0.250, 0.235, 0.223),
    (1.25, 0.326, 0.295, 0.281, 0.269),
    (1.45, 0.358, 0.335, 0.323, 0.310),
    (1.65, 0.386, 0.370, 0.359, 0.346),
    (1.85, 0.411, 0.401, 0.391, 0.379),
    (2.05, 0.432, 0.427, 0.419, 0.407),
    (2.25, 0.452, 0.451, 0.444, 0.433),
    (2.45, 0.469, 0.472, 0.466, 0.456),
    (2.65, 0.485, 0.490, 0.486, 0.476),
    (2.85, 0.499, 0.507, 0.504, 0.495),
    (3.05, 0.512, 0.522, 0.520, 0.512),
    (3.25, 0.524, 0.536, 0.535, 0.527),
    (3.45, 0.535, 0.549, 0.548, 0.541),
    (3.65, 0.546, 0.560, 0.560, 0.554),
    (3.85, 0.556, 0.571, 0.572, 0.566),
    (4.05, 0.565, 0.581, 0.582, 0.577),
    (5.65, 0.621, 0.642, 0.645, 0.643),
    (7.25, 0.660, 0.681, 0.686, 0.686),
    (8.85, 0.688, 0.710, 0.715, 0.717),
    (10.45, 0.711, 0.732, 0.738, 0.740),
    (12.05, 0.729, 0.750, 0.755, 0.759),
    (13.65, 0.744, 0.764, 0.770, 0.774),
    (15.25, 0.756, 0.776, 0.782, 0.786),
    (16.85, 0.767, 0.787, 0.793, 0.797),
    (18.45, 0.777, 0.796, 0.802, 0.806),
]
# Column of the table above by number of edges, -1 for infinitely many.
EDGE_COLUMN = {3: 1, 4: 2, 5: 3, -1: 4}


def remaining_energy(area: Column, thickness: Column, edges: int = -1) -> Column:
    """Power-law interpolation between the table rows around A/h²; missing outside."""
    d = area / (thickness * thickness)
    x = [row[0] for row in REMAINING_ENERGY]
    y = [row[EDGE_COLUMN[edges]] for row in REMAINING_ENERGY]
    slope = [math.log10(b / a) / math.log10(q / p) for a, b, p, q in zip(y, y[1:], x, x[1:])]
    value = F.lit(None).cast("double")
    # from the last interval down, so that the first matching upper bound wins
    for x0, x1, y0, b in reversed(list(zip(x, x[1:], y, slope))):
        value = F.when(d <= x1, y0 * F.pow(d / x0, F.lit(b))).otherwise(value)
    return F.when((d > x[0]) & (d < x[-1]), value)


def density_from_energy(u: Column, thickness: Column) -> Column:
    """Energy per area to energy density."""
    return u / (thickness * 1e-3)


def literature_density(u: Column, thickness: Column) -> Column:
    """As the literature reader does it: the 4 mm series is divided by 8 mm."""
    metres = F.when(thickness == 12, 12e-3).otherwise(8e-3)
    return u / metres


def mid_stress(u_d: Column, nue: float = 0.25) -> Column:
    return F.sqrt(u_d * 5 / 4e6 * E_MPA / (1 - nue))


def energy_from_mid_stress_squared(sigma_m2: Column, nue: float = 0.23) -> Column:
    return 1e6 * sigma_m2 / (5 * E_MPA) * 4 * (1 - nue)


# Published fragment counts in 50 mm squares and strain energies (J/m2), (thickness mm, N50, U).
COUNTS_AND_ENERGIES = [
    (4, 2.988570242547909, 54.43219732397485),
    (4, 3.9591401203877608, 48.318625631898925),
    (4, 2.988570242547909, 48.7634778502579),
    (4, 44.105516438678706, 74.67398000372832),
    (4, 46.84521242514626, 68.13469310951773),
    (4, 50.7646754467195, 69.07779295927216),
    (8, 3.9730034550451268, 55.42247692969174),
    (8, 4.966326207445054, 55.93840463842206),
    (8, 5.961154754531081, 58.86306511656379),
    (8, 41.797025335806204, 90.14746879833663),
    (8, 42.22315298185902, 93.11894435695726),
    (8, 42.22315298185902, 95.30120811199536),
    (8, 94.09537598368814, 143.9371346002303),
    (8, 94.09537598368814, 147.31033426450102),
    (12, 9.700277108603037, 75.59529817644722),
    (12, 10.955887828441798, 78.08709948681407),
    (12, 11.64338599416454, 76.65332564600337),
    (12, 20.135608460451905, 94.42223177617967),
    (12, 19.93239437459763, 97.08378411945606),
    (12, 19.93239437459763, 97.98753683983995),
    (12, 29.306256905915465, 102.15967264931217),
    (12, 29.90686739636164, 104.07053385456253),
    (12, 30.21177289865603, 106.01713705517209),
    (12, 63.99814718591155, 154.29574130434008),
    (12, 63.3522603232277, 157.91169728548246),
]

# Published counts of heat-treated panes, (thickness mm, surface stress MPa, N50).
COUNTS_AND_STRESSES = [
    (6, 111.64, 97.5),
    (6, 111.2, 98),
    (6, 110.48, 97),
    (6, 110.13, 94),
    (6, 109.94, 99.5),
    (6, 120.55, 135.5),
    (6, 119.57, 146),
    (6, 119.22, 144),
    (6, 122.05, 151),
    (6, 119.68, 147),
    (6, 120.49, 141.5),
    (6, 121.02, 151),
    (6, 118.8, 141.5),
    (6, 118.64, 142),
    (6, 118.87, 143),
    (6, 119.21, 147),
    (6, 123.48, 160.5),
    (6, 120.75, 144),
    (6, 119.5, 139.5),
    (6, 120.6, 143.5),
    (6, 106.87, 91),
    (6, 103.95, 97),
    (6, 103.08, 95),
    (6, 104.46, 102.5),
    (6, 104.46, 94.5),
    (6, 116.02, 148),
    (6, 113.55, 149),
    (6, 117.26, 158.5),
    (6, 114.67, 146),
    (8, 112.6, 99.5),
    (8, 111.18, 101),
    (8, 112.06, 103.5),
    (8, 112.26, 96.5),
    (8, 111.66, 99),
    (8, 151.63, 201.5),
    (8, 152.44, 199.5),
    (8, 155.84, 222),
    (8, 157.18, 217.5),
    (8, 153.91, 196),
    (8, 112.39, 102.5),
    (8, 113.68, 104.5),
    (8, 112.56, 101),
    (8, 113.39, 100),
    (8, 111.94, 95.5),
    (8, 166.36, 218.5),
    (8, 162.53, 220),
    (8, 163.61, 214),
    (8, 159.83, 217),
    (8, 161.11, 204.5),
    (8, 103.09, 79.5),
    (8, 100.76, 77.5),
    (8, 101.07, 77),
    (8, 101.83, 81.5),
    (8, 101.05, 81),
    (8, 131.21, 190.5),
    (8, 135.42, 197.5),
    (8, 138.82, 193.5),
    (8, 135.21, 188.5),
    (8, 137.2, 197),
    (10, 93.23, 58.5),
    (10, 96.27, 60.5),
    (10, 94.24, 61.5),
    (10, 94.38, 63),
    (10, 96.01, 62),
    (10, 125.13, 152),
    (10, 127.17, 150.5),
    (10, 128.02, 148),
    (10, 127.76, 146),
    (10, 132.21, 154.5),
    (12, 107.78, 76.5),
    (12, 107.39, 78),
    (12, 106.68, 71),
    (12, 107.96, 73.5),
    (12, 107.06, 74.5),
    (12, 145.8, 149),
    (12, 146.15, 151),
    (12, 147.45, 156),
    (12, 148.36, 169),
    (12, 145.47, 161.5),
]


def literature_energies(spark: SparkSession) -> DataFrame:
    """``thickness, n50, u`` and what the literature reader makes of it: ``u_d`` (by the thickness) and ``sig_m``."""
    d = spark.createDataFrame([(t, float(n), float(u)) for t, n, u in COUNTS_AND_ENERGIES], "thickness int, n50 double, u double")
    u_d = density_from_energy(F.col("u"), F.col("thickness"))
    return d.withColumn("u_d", u_d).withColumn("sig_m", mid_stress(u_d))


def literature_stresses(spark: SparkSession) -> DataFrame:
    """``thickness, s, n50``."""
    rows = [(t, float(s), float(n)) for t, s, n in COUNTS_AND_STRESSES]
    return spark.createDataFrame(rows, "thickness int, s double, n50 double")


def interpolated_energies(table: DataFrame) -> DataFrame:
    """A table of squared mid stresses ``thickness, n50, sig_m2`` as energies ``u`` (J/m2) and densities ``u_d`` (J/m3)."""
    u = energy_from_mid_stress_squared(F.col("sig_m2"))
    return table.select("thickness", "n50", u.alias("u"), density_from_energy(u, F.col("thickness")).alias("u_d"))
