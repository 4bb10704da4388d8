"""Strain energy, wave runtimes and fracture-intensity formulas as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Material and test constants.
NUE = 0.23
E_MPA = 70e3
DROP_MASS_KG = 2.41
GRAVITY = 9.81
DENSITY = 2500.0
WAVE_SPEED = {"p": 5500e3, "s": 3500e3, "c": 1500e3}  # mm/s
SHEAR_SPEED, DILATATION_SPEED, SHEAR_MODULUS, K1 = 3300.0, 5500.0, 26e3, 0.75


def energy_density(sigma: Column) -> Column:
    return F.lit(1e6 / 5 * (1 - NUE) / E_MPA) * sigma * sigma


def energy(sigma: Column, thickness: Column) -> Column:
    return energy_density(sigma) * thickness * 1e-3


def bending_energy(sigma: Column, thickness: Column, w: Column, h: Column) -> Column:
    half = sigma / 2
    return 1e6 * 6 * half * half * (w * 1e-3) * (h * 1e-3) * (thickness * 1e-3) / E_MPA


def stress_from_density(ud: Column) -> Column:
    return F.sqrt(ud * 5 * E_MPA / ((1 - NUE) * 1e6))


def stress_from_energy(u: Column, thickness: Column) -> Column:
    """No mm conversion of the thickness, hence not the inverse of :func:`energy`."""
    return F.sqrt(u * 5 * E_MPA / ((1 - NUE) * 1e6 * thickness))


def tensile_density(sigma: Column) -> Column:
    return F.lit(1e6 * (128 / 125) * (1 - NUE) / E_MPA) * sigma * sigma


def total_energy(u: Column, w: Column, h: Column) -> Column:
    return u * w * h * 1e-6


def fall_energy(height_m: Column) -> Column:
    return F.lit(DROP_MASS_KG * GRAVITY) * height_m


def alternative_total_energy(sigma: Column, thickness: Column, w: Column, h: Column) -> Column:
    """The older total-energy formula: a tenth of the bending energy."""
    return bending_energy(sigma, thickness, w, h) / 10


def runtimes(break_pos: Column) -> dict[str, Column]:
    """Seconds until the primary, shear and crack front reach their sensor."""
    center = break_pos == "center"

    def pick(at_center: float, at_corner: float, speed: str) -> Column:
        return F.when(center, at_center / WAVE_SPEED[speed]).otherwise(at_corner / WAVE_SPEED[speed])

    return {
        "t_p": pick(250.0, 450.0, "p"),
        "t_s": pick(200.0, 400.0, "s"),
        "t_c": pick(math.hypot(250.0, 250.0), math.hypot(450.0, 450.0), "c"),
    }


def release_rate(v: Column) -> Column:
    """Energy release rate (kJ/m²) of a crack running at ``v`` m/s."""
    a_s = F.sqrt(1 - v * v / SHEAR_SPEED**2)
    a_d = F.sqrt(1 - v * v / DILATATION_SPEED**2)
    d = 4 * a_s * a_d - (1 + a_s * a_s) * (1 + a_s * a_s)
    return 1e3 * (v * v * a_d) / (2 * SHEAR_SPEED**2 * SHEAR_MODULUS * d) * K1**2


def n50_analytic(sigma_surface: Column) -> Column:
    return F.pow(sigma_surface / 2 / 14.96, F.lit(4.0))


def n50_regression(t: Column, sigma: Column) -> Column:
    """Published regression in thickness and surface stress (fixed coefficients)."""
    return (
        1281
        + t * 18.98
        + sigma * (-37.29)
        + sigma * sigma * sigma * (-0.0009638)
        + sigma * sigma * 0.3504
        + sigma * t * (-0.2149)
    )


def mass_per_mm(area: Column) -> Column:
    return area * DENSITY * 1e-6


def floor_to_10(x: Column) -> Column:
    return F.floor(x / 10) * 10


def principal_stress(sx: Column, sy: Column, sxy: Column, retardation: bool = False) -> tuple[Column, Column]:
    """Principal stresses of a plane state from the x, y and diagonal readings."""
    shear = sxy - ((sy - sx) if retardation else (sx + sy)) / 2
    mean, half = (sx + sy) / 2, (sx - sy) / 2
    phi = F.lit(0.5) * F.atan(F.try_divide(2 * shear, sx - sy))

    def at(angle: Column) -> Column:
        return mean + half * F.cos(2 * angle) + shear * F.sin(2 * angle)

    return at(phi), at(phi + math.pi / 2)
