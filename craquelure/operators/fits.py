"""Curve fits from sums: the data is aggregated once, only small systems are solved."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craquelure.operators.ordered import key_stats
from craquelure.session import checkpointed


def _solve(m: int):
    """Arrow function: upper triangle of the normal matrix and right side -> coefficients."""
    upper = [(i, j) for i in range(m) for j in range(i, m)]

    def solve(sums: pd.Series) -> pd.Series:
        out = []
        for s in sums:
            s = np.asarray(s, float)
            a = np.zeros((m, m))
            for v, (i, j) in zip(s, upper):
                a[i, j] = a[j, i] = v
            rhs = s[len(upper) :]
            scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
            scaled = a / np.outer(scale, scale)
            if not np.isfinite(s).all() or np.linalg.matrix_rank(scaled) < m:
                out.append(None)
                continue
            out.append((np.linalg.solve(scaled, rhs / scale) / scale).tolist())
        return pd.Series(out, dtype=object)

    return F.pandas_udf(solve, "array<double>")


def linear(df: DataFrame, keys, terms: list[Column], y: Column) -> DataFrame:
    """Least squares ``y = sum coef[k] * terms[k]`` per key, missing where singular."""
    keys = list(keys)
    m = len(terms)
    d = df.select(*keys, *[t.cast("double").alias(f"_t{i}") for i, t in enumerate(terms)], y.cast("double").alias("_y"))
    t = [F.col(f"_t{i}") for i in range(m)]
    products = [F.sum(t[i] * t[j]) for i in range(m) for j in range(i, m)] + [F.sum(c * F.col("_y")) for c in t]
    sums = d.groupBy(*keys).agg(F.array(*products).alias("_s"), F.count("_y").alias("n"))
    return sums.select(*keys, "n", _solve(m)("_s").alias("coef"))


def polynomial(df: DataFrame, keys, x: str, y: str, degree: int) -> DataFrame:
    """Polynomial per key, ``coef[k]`` of ``x**k``; fitted on centred, scaled abscissae."""
    keys = list(keys)
    d = key_stats(df.select(*keys, x, y), keys, _mu=F.avg(x), _sd=F.greatest(F.stddev_pop(x), F.lit(1e-300)))
    z = (F.col(x) - F.col("_mu")) / F.col("_sd")
    terms = [F.pow(z, F.lit(float(k))) if k else F.lit(1.0) for k in range(degree + 1)]
    fit = linear(d, [*keys, "_mu", "_sd"], terms, F.col(y))

    def back(coef: pd.Series, mu: pd.Series, sd: pd.Series) -> pd.Series:
        out = []
        for c, m, s in zip(coef, mu, sd):
            if c is None:
                out.append(None)
                continue
            poly = np.zeros(1)
            for a in reversed(c):
                poly = np.polynomial.polynomial.polyadd(np.polynomial.polynomial.polymul(poly, [-m / s, 1 / s]), [a])
            out.append(np.pad(poly, (0, degree + 1))[: degree + 1].tolist())
        return pd.Series(out, dtype=object)

    return fit.select(*keys, "n", F.pandas_udf(back, "array<double>")("coef", "_mu", "_sd").alias("coef"))


def evaluate(coef: str, x: Column) -> Column:
    """Polynomial value by Horner's rule."""
    return F.aggregate(F.reverse(coef), F.lit(0.0), lambda acc, c: acc * x + c)


def logarithmic(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """``a ln x + b``."""
    return df.groupBy(*keys).agg(
        F.regr_slope(F.col(y), F.log(x)).alias("a"), F.regr_intercept(F.col(y), F.log(x)).alias("b")
    )


def inverse_proportional(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """``y = x / a``."""
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col(x) * F.col(x)), F.sum(F.col(x) * F.col(y))).alias("a")
    )


def n50_terms(t: Column, s: Column, long: bool = False) -> list[Column]:
    """Terms of the two-variable N50 model: 1, t, s, s², s³, st and with ``long`` also t², t³."""
    terms = [F.lit(1.0), t, s, s * s, s * s * s, s * t]
    return terms + [t * t, t * t * t] if long else terms


def predict(coef: str, terms: list[Column]) -> Column:
    total: Column = F.lit(0.0)
    for k, term in enumerate(terms):
        total = total + F.get(coef, F.lit(k)) * term
    return total


def lines(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Slope, intercept, R² and inverse slope per key."""
    slope = F.regr_slope(y, x)
    return df.groupBy(*keys).agg(
        slope.alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.try_divide(F.lit(1.0), slope).alias("inverse_slope"),
    )


# Models with a nonlinear parameter, written for numpy arrays (``m = numpy``) and for
# columns (``m = pyspark.sql.functions``) alike.
MODELS: dict[str, Callable] = {
    "exponential": lambda x, p, m: p[0] * m.exp(p[1] * x),
    "logarithmic": lambda x, p, m: p[0] * m.log(p[1] * x + p[2]) + p[3],
    "hyperbolic": lambda x, p, m: p[0] + p[1] / (p[2] + x),
    "fourth_power": lambda x, p, m: (p[0] * x / 14.96) * (p[0] * x / 14.96) * (p[0] * x / 14.96) * (p[0] * x / 14.96) + p[1] * x,
}


def nonlinear(
    df: DataFrame,
    model: str | Callable,
    x: str,
    y: str,
    start,
    bounds=None,
    steps: int = 60,
    tolerance: float = 1e-9,
) -> list[float] | None:
    """Damped Gauss-Newton over the whole table.

    Every step is one distributed pass: tasks reduce their batches to ``JᵀJ``, ``Jᵀr`` and
    the squared residual, and only the sum of these few numbers reaches the driver.
    Returns the parameters, or None on failure.
    """
    f = MODELS[model] if isinstance(model, str) else model
    m = len(start)
    d = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter("_x is not null and _y is not null")
    # every step reads the points again: keep the two columns, not what led to them
    d = checkpointed(d)
    names = [f"s{i}" for i in range(2 + m + m * m)]

    def sums(p):
        def batches(frames):
            total = np.zeros(len(names))
            with np.errstate(all="ignore"):
                for pdf in frames:
                    u, v = pdf["_x"].to_numpy(), pdf["_y"].to_numpy()
                    r = v - f(u, p, np)
                    jac = []
                    for k in range(m):
                        h = np.zeros(m)
                        h[k] = 1e-6 * max(abs(p[k]), 1e-3)
                        jac.append((f(u, p + h, np) - f(u, p - h, np)) / (2 * h[k]) + 0 * u)
                    jac = np.array(jac)
                    total += np.concatenate([[r @ r], jac @ r, (jac @ jac.T).ravel(), [len(u)]])
            yield pd.DataFrame([total], columns=names)

        parts = d.mapInPandas(batches, ", ".join(f"{n} double" for n in names))
        row = parts.agg(*[F.sum(n) for n in names]).first()
        usable = all(v is not None and math.isfinite(v) for v in row) and row[-1] >= m
        return np.array(row, float)[:-1] if usable else None

    def clip(p):
        return p if bounds is None else np.clip(p, *np.asarray(bounds, float).T)

    p = clip(np.asarray(start, float))
    s = sums(p)
    if s is None:
        return None
    damping = 1e-3
    for _ in range(steps):
        a = s[m + 1 :].reshape(m, m)
        step = np.linalg.lstsq(a + damping * np.diag(np.diag(a) + 1e-300), s[1 : m + 1], rcond=None)[0]
        trial = clip(p + step)
        t = sums(trial)
        if t is not None and t[0] <= s[0]:
            small = np.abs(trial - p).max() <= tolerance * (np.abs(p).max() + tolerance)
            flat = s[0] - t[0] <= 1e-10 * s[0]
            p, s, damping = trial, t, max(damping / 10, 1e-12)
            if small or flat:
                break
        else:
            damping *= 10
            if damping > 1e6:
                break
    return [float(v) for v in p]


def fitted_curve(df: DataFrame, model: str | Callable, x: str, y: str, start, bounds=None, points: int = 100) -> DataFrame:
    """Parameters, R² and an evenly spaced curve of a nonlinear fit; empty if it fails."""
    spark = df.sparkSession
    f = MODELS[model] if isinstance(model, str) else model
    p = nonlinear(df, model, x, y, start, bounds)
    if p is None:
        return spark.createDataFrame([], "k int, x double, y double, r2 double, params array<double>")
    lit = [F.lit(v) for v in p]
    fit = f(F.col(x).cast("double"), lit, F)
    res = F.col(y) - fit
    quality = df.agg(
        F.min(x).cast("double").alias("lo"),
        F.max(x).cast("double").alias("hi"),
        (1 - F.try_divide(F.sum(res * res), F.var_pop(y) * F.count(y))).alias("r2"),
    )
    d = quality.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    d = d.withColumn("x", F.col("lo") + F.col("k") * ((F.col("hi") - F.col("lo")) / (points - 1)))
    return d.select("k", "x", f(F.col("x"), lit, F).alias("y"), "r2", F.array(*lit).alias("params"))


def nonlinear_groups(
    df: DataFrame, keys, models: dict[str, list], x: str, y: str, bounds: dict | None = None, steps: int = 80, tolerance: float = 1e-14
) -> DataFrame:
    """Damped Gauss-Newton for every key and model at once: ``(keys, model, n, params, sse, r2)``.

    ``models`` maps names of :data:`MODELS` to start values. The fits are rows of a table of
    states. A step joins the points with the states still open, adds up the normal equations of
    all of them in one aggregation of column expressions, and updates each state; a state that
    no longer improves is closed. A fit that fails has no parameters.
    """
    keys, bounds = list(keys), bounds or {}
    spark = df.sparkSession
    most = max(len(v) for v in models.values())
    upper = [(i, j) for i in range(most) for j in range(i, most)]
    place = [*keys, "model"]
    d = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    d = checkpointed(d)
    spread = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.var_pop("_y") * F.count("_y")).alias("_all"))
    clipped = {m: _clip(v, bounds.get(m)).tolist() for m, v in models.items()}
    given = F.explode(F.map_from_entries(F.array(*[
        F.struct(F.lit(m).alias("key"), F.array(*[F.lit(float(a)) for a in v]).alias("value")) for m, v in clipped.items()
    ]))).alias("model", "trial")
    nothing = F.array().cast("array<double>")
    states = spread.select(*keys, "n", given).select(
        *place, "n", "trial", nothing.alias("params"), nothing.alias("sums"), F.lit(1e-3).alias("damping"), F.lit(True).alias("open")
    )
    states = checkpointed(states)
    schema = states.schema

    def value(name: str, shift: int | None = None, h: Column | None = None) -> Column:
        p = [F.get("trial", F.lit(k)) + (h if k == shift else 0.0) for k in range(len(models[name]))]
        return MODELS[name](F.col("_x"), p, F)

    def slope(k: int) -> Column:
        h = F.greatest(F.abs(F.get("trial", F.lit(k))), F.lit(1e-3)) * 1e-6
        out = F.lit(0.0)
        for name, start in models.items():
            if k < len(start):
                out = F.when(F.col("model") == name, (value(name, k, h) - value(name, k, -h)) / (2 * h)).otherwise(out)
        return out

    def sums(states: DataFrame) -> DataFrame:
        rows = d.join(states.select(*place, "trial"), keys)
        fit = F.lit(None).cast("double")
        for name in models:
            fit = F.when(F.col("model") == name, value(name)).otherwise(fit)
        rows = rows.select(*place, (F.col("_y") - fit).alias("_r"), *[slope(k).alias(f"_j{k}") for k in range(most)])
        r, j = F.col("_r"), [F.col(f"_j{k}") for k in range(most)]
        parts = [F.sum(r * r), *[F.sum(v * r) for v in j], *[F.sum(j[a] * j[b]) for a, b in upper]]
        parts.append(F.count(r + sum(j, F.lit(0.0))).cast("double"))
        return rows.groupBy(*place).agg(F.array(*parts).alias("found"))

    def step(frames):
        for pdf in frames:
            rows = [_advanced(r, len(models[r["model"]]), upper, most, bounds.get(r["model"]), tolerance) for r in pdf.to_dict("records")]
            yield pd.DataFrame(rows, columns=schema.names)

    for _ in range(steps):
        live = states.filter("open")
        if live.isEmpty():
            break
        moved = live.join(sums(live), place, "left").mapInPandas(step, schema)
        states = checkpointed(states.filter("not open").unionByName(moved))
    out = states.join(spread.select(*keys, "_all"), keys)
    sse = F.get("sums", F.lit(0))
    params = F.when(F.size("params") > 0, F.col("params"))
    return out.select(*place, "n", params.alias("params"), sse.alias("sse"), (1 - F.try_divide(sse, F.col("_all"))).alias("r2"))


def _clip(p, bounds) -> np.ndarray:
    p = np.asarray(p, float)
    return p if bounds is None else np.clip(p, *np.asarray(bounds, float).T)


def _advanced(row: dict, m: int, upper, most: int, bounds, tolerance: float) -> dict:
    """A state after the sums of its trial parameters are known."""
    found = row.pop("found")
    found = None if found is None else np.asarray(found, float)
    usable = found is not None and np.isfinite(found).all() and found[-1] == row["n"] >= m
    params, known = np.asarray(row["params"], float), np.asarray(row["sums"], float)
    if not len(params) and not usable:
        return row | {"open": False}
    if usable and (not len(params) or found[0] <= known[0]):
        flat = len(params) and known[0] - found[0] <= tolerance * known[0]
        params, known = np.asarray(row["trial"], float), found
        row |= {"params": params.tolist(), "sums": known.tolist(), "damping": max(row["damping"] / 10, 1e-12)}
        if flat or known[0] == 0:
            return row | {"open": False}
    else:
        row["damping"] *= 10
        if row["damping"] > 1e8:
            return row | {"open": False}
    a = np.zeros((most, most))
    for v, (i, j) in zip(known[1 + most :], upper):
        a[i, j] = a[j, i] = v
    a, right = a[:m, :m], known[1 : 1 + m]
    move = np.linalg.lstsq(a + row["damping"] * np.diag(np.diag(a) + 1e-300), right, rcond=None)[0]
    return row | {"trial": _clip(params + move, bounds).tolist()}


def curves(fits: DataFrame, spans: DataFrame, keys, points: int = 100) -> DataFrame:
    """``(keys, model, k, x, y)``: each fit over an even axis from ``lo`` to ``hi`` of its key."""
    d = fits.filter("params is not null").join(spans, list(keys))
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    d = d.withColumn("x", F.col("lo") + F.col("k") * ((F.col("hi") - F.col("lo")) / (points - 1)))
    y = F.lit(None).cast("double")
    p = [F.get("params", F.lit(k)) for k in range(4)]
    for name, f in MODELS.items():
        y = F.when(F.col("model") == name, f(F.col("x"), p, F)).otherwise(y)
    return d.select(*keys, "model", "k", "x", y.alias("y"))
