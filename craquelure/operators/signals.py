"""Sensor channels: slicing, zeroing, filters, integration, peaks, spectra.

A channel is rows ``(keys, seq, t, value)`` with a dense 0-based ``seq``. Recordings are
processed in chunks of ``seq`` with the neighbour rows a filter needs, so a single long
recording spreads over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craquelure.functions.mechanics import DROP_MASS_KG, GRAVITY
from craquelure.operators.ordered import CHUNK_ROWS, chunk_of, framed, in_runs, key_stats, neighbour, python_groups, rolling, running_sum
from craquelure.session import checkpointed

KEYS = ("specimen_id", "channel")
# Stop bands of the drop weight (Hz), Fourier factors, time units.
EIGEN_BANDS = ((2000.0, 2200.0), (7100.0, 7300.0), (7700.0, 7900.0), (9200.0, 9800.0))
TIME_UNITS = {"ns": 1e9, "us": 1e6, "ms": 1e3, "s": 1.0}


# ---- selection and zeroing ---------------------------------------------------------------


def channels_like(channels: DataFrame, pattern: str, first: bool = False, keys=("specimen_id",), ordinal="ordinal") -> DataFrame:
    """Channel names whose start matches; with ``first`` the earliest one per recording."""
    d = channels.filter(F.col("channel").rlike(f"^(?:{pattern})"))
    if not first:
        return d
    return d.groupBy(*keys).agg(F.min_by("channel", F.struct(ordinal, "channel")).alias("channel"))


def acceptable(df: DataFrame, required: str = "Fall_g1", drop: str = "Fall_g", least_hz: float = 20000.0, key="specimen_id") -> DataFrame:
    """Recordings with the required channel whose drop channels are all sampled fast enough."""
    rates = df.groupBy(key, "channel").agg(
        F.try_divide((F.count(F.lit(1)) - 1).cast("double"), F.max("t") - F.min("t")).alias("hz")
    )
    ok = rates.groupBy(key).agg(
        F.bool_or(F.col("channel").startswith(required)).alias("_has"),
        F.coalesce(F.bool_or(F.col("channel").contains(drop) & (F.col("hz") < least_hz)), F.lit(False)).alias("_slow"),
    )
    return ok.filter("_has and not _slow").select(key)


def until(df: DataFrame, seconds: float, keys=KEYS) -> DataFrame:
    return key_stats(df, keys, _t0=F.min("t")).filter(F.col("t") < F.col("_t0") + seconds).drop("_t0")


def after(df: DataFrame, seconds: float) -> DataFrame:
    return df.filter(F.col("t") > seconds)


def between(df: DataFrame, start: float, end: float) -> DataFrame:
    return df.filter((F.col("t") > start) & (F.col("t") < end))


def renumber(df: DataFrame, keys=KEYS) -> DataFrame:
    """Dense numbers again after a contiguous slice."""
    return key_stats(df, keys, _s0=F.min("seq")).withColumn("seq", F.col("seq") - F.col("_s0")).drop("_s0")


def zeroed(df: DataFrame, seconds: float = 0.2, keys=KEYS) -> DataFrame:
    """Time starts at zero; values lose their mean over the first ``seconds``."""
    d = key_stats(df, keys, _t0=F.min("t")).withColumn("t", F.col("t") - F.col("_t0")).drop("_t0")
    d = key_stats(d, keys, _base=F.avg(F.when(F.col("t") < seconds, F.col("value"))))
    return d.withColumn("value", F.col("value") - F.col("_base")).drop("_base")


def trigger_time(df: DataFrame, back: float = 0.5, keys=KEYS) -> DataFrame:
    return key_stats(df, keys, _t0=F.min("t")).withColumn("t", F.col("t") - F.col("_t0") - back).drop("_t0")


def scaled_time(t: Column, unit: str) -> Column:
    return t * TIME_UNITS[unit]


def aligned(df: DataFrame, keys=KEYS) -> DataFrame:
    """Milliseconds relative to the largest sample (the first one of equals)."""
    d = key_stats(df, keys, _tp=F.max_by("t", F.struct("value", -F.col("seq"))))
    return d.withColumn("ms", (F.col("t") - F.col("_tp")) * 1e3).drop("_tp")


def extremes(df: DataFrame, keys=KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.max("value").alias("maximum"),
        F.min("value").alias("minimum"),
        F.max_by("t", F.struct("value", -F.col("seq"))).alias("t_maximum"),
    )


def impact_index(df: DataFrame, head: int = 10000, factor: float = 1.5, keys=KEYS) -> DataFrame:
    """Two rows before the signal first exceeds ``factor`` times its early maximum."""
    size = F.abs("value")
    d = key_stats(df, keys, _m=F.max(F.when(F.col("seq") < head, size)))
    hit = F.when(F.pow(size / (F.col("_m") * factor), F.lit(10.0)) >= 1, F.col("seq"))
    return d.groupBy(*keys).agg((F.min(hit) - 2).alias("impact"))


def around(df: DataFrame, centre: DataFrame, before: int, after_: int, keys=KEYS) -> DataFrame:
    """Largest sample within an index window around a per-key position ``centre``."""
    d = df.join(centre, list(keys))
    inside = (F.col("seq") >= F.col("centre") - before) & (F.col("seq") < F.col("centre") + after_)
    return d.filter(inside).groupBy(*keys).agg(
        F.max("value").alias("peak"), F.min_by("seq", F.struct(-F.col("value"), "seq")).alias("at")
    )


# ---- moving windows ----------------------------------------------------------------------


def moving_mean(df: DataFrame, length: int = 11, keys=KEYS) -> DataFrame:
    """Moving average, the end values repeated beyond the ends (odd lengths)."""
    h = length // 2
    d = key_stats(df, keys, _n=F.count(F.lit(1)), _a=F.min_by("value", "seq"), _b=F.max_by("value", "seq"))
    d = rolling(d, keys, {"_sum": framed(F.sum("value"), h, h)}, h, h)
    left = F.greatest(F.lit(0), h - F.col("seq"))
    right = F.greatest(F.lit(0), h - (F.col("_n") - 1 - F.col("seq")))
    smooth = (F.col("_sum") + left * F.col("_a") + right * F.col("_b")) / length
    return d.withColumn("smooth", smooth).drop("_n", "_a", "_b", "_sum")


def weighted(df: DataFrame, weights: list[float], shift: int, keys=KEYS, out: str = "smooth") -> DataFrame:
    """``sum_k w[k] * x[seq + shift - k]`` with zeros beyond the ends."""
    after_, before = shift, len(weights) - 1 - shift

    def build(w):
        total: Column = F.lit(0.0)
        for k, weight in enumerate(weights):
            o = shift - k
            x = F.col("value") if o == 0 else (F.lead("value", o) if o > 0 else F.lag("value", -o)).over(w)
            total = total + F.coalesce(x, F.lit(0.0)) * weight
        return total

    return rolling(df, keys, {out: build}, before, after_)


def hann_smooth(df: DataFrame, length: int = 11, keys=KEYS) -> DataFrame:
    from craquelure.operators.pointstats import hann

    w = hann(length)
    return weighted(df, [v / sum(w) for v in w], (length - 1) // 2, keys)


def wiener(df: DataFrame, size: int = 17, keys=KEYS) -> DataFrame:
    """Local mean and variance filter, zeros beyond the ends, noise = mean local variance."""
    h = size // 2
    d = rolling(
        df,
        keys,
        {
            "_m": lambda w: framed(F.sum("value"), h, h)(w) / size,
            "_q": lambda w: framed(F.sum(F.col("value") * F.col("value")), h, h)(w) / size,
        },
        h,
        h,
    )
    d = d.withColumn("_v", F.col("_q") - F.col("_m") * F.col("_m"))
    d = key_stats(d, keys, _noise=F.avg("_v"))
    kept = (F.col("value") - F.col("_m")) * (1 - F.try_divide(F.col("_noise"), F.col("_v"))) + F.col("_m")
    return d.withColumn("smooth", F.when(F.col("_v") < F.col("_noise"), F.col("_m")).otherwise(kept)).drop("_m", "_q", "_v", "_noise")


def without_nan(values: np.ndarray | pa.ChunkedArray) -> pa.Array:
    """Numbers with the undefined ones missing."""
    return pa.array(np.asarray(values, float), from_pandas=True)


def by_chunk(df: DataFrame, keys, fn: Callable, before, after_, stats: dict | None = None, chunk_rows: int = CHUNK_ROWS, out="smooth") -> DataFrame:
    """Run ``fn(values, first, n, info) -> values`` on chunks with their neighbour rows.

    ``first`` is the number of the first row handed over, ``n`` the length of the series.
    ``before``/``after_`` may be columns; the result of the extra rows is dropped.
    """
    keys = list(keys)
    stats = dict(stats or {})
    d = key_stats(df, keys, _n=F.count(F.lit(1)), **stats)
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    first = F.greatest(F.lit(0), F.floor((F.col("seq") - lit(after_)) / chunk_rows))
    last = F.least(F.floor((F.col("seq") + lit(before)) / chunk_rows), F.floor((F.col("_n") - 1) / chunk_rows))
    d = d.withColumn("_chunk", F.explode(F.sequence(first, last)))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["seq bigint", "t double", "value double", f"{out} double"])
    info = list(stats)

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        number = {c: table.column(c).to_numpy() for c in ("_chunk", "seq", "_n")}
        x = table.column("value").cast(pa.float64()).to_numpy().astype(float)
        own = number["seq"] // chunk_rows == number["_chunk"]
        y = np.empty(len(x))
        more = {c: table.column(c) for c in info}
        for start, end in zip(starts, [*starts[1:], len(x)]):
            given = {c: v[int(start)].as_py() for c, v in more.items()}
            y[start:end] = fn(x[start:end], int(number["seq"][start]), int(number["_n"][start]), given)
        made = {c: table.column(c) for c in [*keys, "seq"]} | {"t": without_nan(table.column("t"))}
        return pa.table(made | {"value": without_nan(x), out_name: without_nan(y)}).filter(pa.array(own))

    out_name = out
    cols = [*keys, "_chunk", "seq", F.col("t").cast("double").alias("t"), "value", "_n", *info]
    return in_runs(d.select(*cols), [*keys, "_chunk"], ["seq"], run, schema)


@lru_cache(1024)
def savgol_weights(window: int, order: int, at: float) -> np.ndarray:
    """Weights that read the least-squares polynomial of a window at position ``at``."""
    x = np.arange(window) - at
    basis = np.vander(x, order + 1, increasing=True)
    return np.linalg.pinv(basis)[0]


def savgol(df: DataFrame, window: int, order: int, keys=KEYS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Polynomial smoothing; at the ends the polynomial of the outermost window is read.

    An even window reads between its two middle samples. Too short series are missing.
    """
    centre = (window - 1) / 2
    h = window // 2

    def fit(x, first, n, info):
        if n < window:
            return np.full(len(x), np.nan)
        y = np.full(len(x), np.nan)
        if len(x) >= window:
            inner = np.convolve(x, savgol_weights(window, order, centre)[::-1], mode="valid")
            lead = (window - 1) // 2
            y[lead : lead + len(inner)] = inner
        if first == 0:
            for i in range(h):
                y[i] = savgol_weights(window, order, i) @ x[:window]
        if first + len(x) == n:
            for i in range(1, h + 1):
                y[-i] = savgol_weights(window, order, window - i) @ x[-window:]
        return y

    d = by_chunk(df, keys, fit, window, window, chunk_rows=chunk_rows)
    return d.withColumn("smooth", F.when(~F.isnan("smooth"), F.col("smooth")))


def drop_index(df: DataFrame, window: int = 203, order: int = 5, keys=KEYS) -> DataFrame:
    """First row whose smoothed magnitude is within 0.01 of 1 g: the start of the fall."""
    d = savgol(df, window, order, keys)
    hit = F.when(F.abs(F.abs("smooth") - 1) < 0.01, F.col("seq"))
    return d.groupBy(*keys).agg(F.min(hit).alias("drop"))


# ---- zero-phase Butterworth --------------------------------------------------------------


def butter_sections(kind: str, edges, fs: float, order: int = 4) -> np.ndarray:
    """Second-order sections of a digital Butterworth filter (bilinear transform)."""
    edges = np.atleast_1d(np.asarray(edges, float))
    warped = 2 * fs * np.tan(np.pi * edges / fs)
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if kind == "lowpass":
        s_poles, s_zeros = warped[0] * poles, np.array([])
        gain_at = 1.0
    elif kind == "highpass":
        s_poles, s_zeros = warped[0] / poles, np.zeros(order)
        gain_at = -1.0
    else:
        centre, width = np.sqrt(warped[0] * warped[1]), warped[1] - warped[0]
        if kind == "bandpass":
            half = poles * width / 2
            s_zeros = np.zeros(order)
            gain_at = np.exp(2j * np.arctan(centre / (2 * fs)))
        else:
            half = width / 2 / poles
            s_zeros = np.concatenate([1j * centre * np.ones(order), -1j * centre * np.ones(order)])
            gain_at = 1.0
        root = np.sqrt(half * half - centre * centre + 0j)
        s_poles = np.concatenate([half + root, half - root])
    z_poles = (2 * fs + s_poles) / (2 * fs - s_poles)
    z_zeros = (2 * fs + s_zeros) / (2 * fs - s_zeros)
    z_zeros = np.concatenate([z_zeros, -np.ones(len(z_poles) - len(z_zeros))])
    # conjugate pairs share a section; zeros are paired in the same way
    up = sorted((p for p in z_poles if p.imag > 1e-14), key=abs)
    real_poles = sorted((p.real for p in z_poles if abs(p.imag) <= 1e-14), key=abs)
    up_zeros = [z for z in z_zeros if z.imag > 1e-14]
    real_zeros = sorted(z.real for z in z_zeros if abs(z.imag) <= 1e-14)
    sections = []

    def zero_pair():
        if up_zeros:
            z = up_zeros.pop()
            return [1.0, -2 * z.real, abs(z) ** 2]
        a, b = real_zeros.pop(0), real_zeros.pop(-1)
        return [1.0, -(a + b), a * b]

    for p in up:
        sections.append([*zero_pair(), 1.0, -2 * p.real, abs(p) ** 2])
    for a, b in zip(real_poles[::2], real_poles[1::2]):
        sections.append([*zero_pair(), 1.0, -(a + b), a * b])
    sos = np.array(sections)
    z = np.array([1.0, 1 / gain_at, 1 / gain_at**2])
    response = np.prod([(s[:3] @ z) / (s[3:] @ z) for s in sos])
    sos[0, :3] /= abs(response)
    return sos


def _modes(section) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
    """A section's state equations by its poles, and its state after a constant input of one.

    Powers of this matrix keep their precision where poles lie close to one (edges far below the
    sampling rate); the differences that vanish there are taken in extended precision.
    """
    b0, b1, b2, _, a1, a2 = (np.longdouble(v) for v in section)
    c1, c0 = b1 - a1 * b0, b2 - a2 * b0
    inside = a1 * a1 / 4 - a2
    root = np.sqrt(abs(inside))
    if root < 1e-9:
        # a double pole has no such form
        a, b, c = np.array([[-a1, 1], [-a2, 0]]), np.array([c1, c0]), np.array([1, 0])
        rest = c0 - a2 * (c1 + c0) / (1 + a1 + a2)
        steady = np.array([(c1 + c0) / (1 + a1 + a2), rest])
    elif inside < 0:
        # w' = p w + x with one of the conjugate poles, y = b0 x + 2 Re(r w)
        p = -a1 / 2 + 1j * root
        r = (c1 * p + c0) / (2j * root)
        a, b, c = np.array([[p.real, -p.imag], [p.imag, p.real]]), np.array([1, 0]), np.array([2 * r.real, -2 * r.imag])
        steady = np.array([(1 / (1 - p)).real, (1 / (1 - p)).imag])
    else:
        p, q = -a1 / 2 + root, -a1 / 2 - root
        a, b = np.diag([p, q]), np.array([1, 1])
        c = np.array([(c1 * p + c0) / (p - q), (c1 * q + c0) / (q - p)])
        steady = np.array([1 / (1 - p), 1 / (1 - q)])
    return *(v.astype(float) for v in (a, b, c)), float(b0), steady.astype(float)


def cascade(sos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """State equations of the sections one after another: ``s' = A s + B x``, ``y = C s + D x``."""
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
    for section in sos:
        a2, b2, c2, d2, _ = _modes(section)
        a = np.block([[a, np.zeros((len(a), 2))], [np.outer(b2, c), a2]])
        b, c, d = np.concatenate([b, b2 * d]), np.concatenate([d2 * c, c2]), d2 * d
    return a, b, c, d


def steady_state(sos: np.ndarray) -> np.ndarray:
    """State after a constant input of one."""
    out, x = [], np.longdouble(1)
    for section in sos:
        out.append(_modes(section)[4] * float(x))
        b0, b1, b2, _, a1, a2 = (np.longdouble(v) for v in section)
        x *= (b0 + b1 + b2) / (1 + a1 + a2)
    return np.concatenate(out)


def recursion(x: np.ndarray, state: np.ndarray, system) -> tuple[np.ndarray, np.ndarray]:
    """Output and last state. Stretches run side by side from state zero; then their first states follow one another."""
    a, b, c, d = system
    m = max(1, math.isqrt(len(x)))
    stretches = len(x) // m
    rows = x[: m * stretches].reshape(stretches, m).T
    y, s = np.empty_like(rows), np.zeros((len(a), stretches))
    reading, power = np.empty((m, len(a))), np.eye(len(a))
    for i in range(m):
        y[i] = c @ s + d * rows[i]
        s = a @ s + b[:, None] * rows[i]
        reading[i] = c @ power
        power = a @ power
    starts = np.empty_like(s)
    for j in range(stretches):
        starts[:, j] = state
        state = power @ state + s[:, j]
    out = np.empty(len(x))
    out[: m * stretches] = (y + reading @ starts).T.ravel()
    for i in range(m * stretches, len(x)):
        out[i] = c @ state + d * x[i]
        state = a @ state + b * x[i]
    return out, state


def echo(system, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(A^length, what state a forward pass that starts in a state leaves after the backward pass over its output).

    The second is the sum of ``A^k B C A^k``; both by doubling the length.
    """
    a, b, c, _ = system
    power, total = np.eye(len(a)), np.zeros_like(a)
    step, part = a, np.outer(b, c)  # of 1, 2, 4 ... samples
    while length:
        if length & 1:
            total = total + power @ part @ power
            power = power @ step
        step, part, length = step @ step, part + step @ part @ step, length >> 1
    return power, total


@dataclass
class Pass:
    """One zero-phase filter over a chunk; real ends are extended by odd reflection."""

    sos: np.ndarray

    def __post_init__(self):
        self.system, self.steady = cascade(self.sos), steady_state(self.sos)
        taps = 2 * len(self.sos) + 1 - min((self.sos[:, 2] == 0).sum(), (self.sos[:, 5] == 0).sum())
        self.pad = 3 * int(taps)

    def run(self, x: np.ndarray, ends: tuple[bool, bool], forward=0.0, backward=0.0):
        """(filtered, last state forward, last state backward) from the states with which either pass comes in."""
        left = 2 * x[0] - x[self.pad : 0 : -1] if ends[0] else x[:0]
        right = 2 * x[-1] - x[-2 : -self.pad - 2 : -1] if ends[1] else x[:0]
        whole = np.concatenate([left, x, right])
        y, out = recursion(whole, self.steady * whole[0] if ends[0] else self.steady * 0 + forward, self.system)
        z, back = recursion(y[::-1], self.steady * y[-1] if ends[1] else self.steady * 0 + backward, self.system)
        return z[::-1][len(left) : len(left) + len(x)], out, back

    def states(self, lengths: list[int], out: np.ndarray, back: np.ndarray) -> tuple[list, list]:
        """States with which the passes enter each chunk, from what the chunks leave when entered with none."""
        last = len(lengths) - 1
        forward, backward = [self.steady * 0], [self.steady * 0] * len(lengths)
        known = {}
        for n in {*lengths[:1], *lengths[1:-1], *lengths[-1:]}:
            known[n] = echo(self.system, n)
        for i in range(last):
            forward.append(known[lengths[i]][0] @ forward[i] + out[i])
        for i in range(last, 0, -1):
            power, back_of = known[lengths[i]]
            if i == last:
                # the backward pass starts from the last output, which the incoming state changes too
                before = echo(self.system, lengths[i] - 1)[0]
                back_of = back_of + np.outer(power @ self.steady, self.system[2] @ before)
            left = back[i] + back_of @ forward[i]
            backward[i - 1] = left if i == last else left + power @ backward[i]
        return forward, backward


@lru_cache(256)
def _designed(kind: str, edges: tuple, order: int, n: int, t0: float, t1: float) -> Pass | bool | None:
    """The filter of a series of ``n`` samples; None leaves the data, False cannot be applied."""
    fs = 1.0 / (t1 - t0) if n > 1 and t1 > t0 else 0.0
    if n > 1 and kind == "lowpass" and edges[0] > fs / 2:
        return None
    if fs == 0 or max(edges) >= fs / 2:
        return False
    found = Pass(butter_sections(kind, edges, fs, order))
    return found if n > 3 * (2 * len(found.sos) + 1) else False


def butterworth(df: DataFrame, kind: str, edges, keys=KEYS, order: int = 4) -> DataFrame:
    """Zero-phase low-, high-, band-pass or band-stop filter of every series."""
    return filter_chain(df, [(kind, edges)], keys, order)


def filter_chain(df: DataFrame, stages, keys=KEYS, order: int = 4, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Zero-phase Butterworth filters ``(kind, edges)`` one after the other.

    A filter is a linear recurrence, so a chunk maps the state it is entered with to the one it
    leaves: a power of the state matrix and an offset, for the forward and the backward pass.
    Long series are read twice: once for the offsets, and, when the states of all chunks have
    been added up along the series, once more with them. Rows are not copied, however slowly the
    response dies out. A low-pass above half the sampling rate leaves the data unchanged; a band
    above it, or a series shorter than the end extension, gives missing values.
    """
    keys = list(keys)
    stages = [(kind, tuple(np.atleast_1d(np.asarray(edges, float)))) for kind, edges in stages]
    chunk_rows = max(chunk_rows, 64)

    def of(stage, pdf: pd.DataFrame):
        return _designed(*stage, order, int(pdf["_n"].iloc[0]), float(pdf["_t0"].iloc[0]), float(pdf["_t1"].iloc[0]))

    heads = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.min(F.when(F.col("seq") == 0, F.col("t"))), F.lit(math.nan)).alias("_t0"),
        F.coalesce(F.min(F.when(F.col("seq") == 1, F.col("t"))), F.lit(math.nan)).alias("_t1"),
    )
    d = df.select(*keys, "seq", "t", "value").join(heads, keys)
    # the last chunk is as long as two, so an end extension lies within it
    chunk = F.least(F.floor(F.col("seq") / chunk_rows), F.greatest(F.lit(0), F.floor(F.col("_n") / chunk_rows) - 1))
    d = d.withColumn("_chunk", chunk)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    head = "".join(f"`{k}` {types[k]}, " for k in keys)
    rows = head + "seq bigint, t double, value double, smooth double"

    def result(key, pdf: pd.DataFrame, y: np.ndarray, **more) -> pd.DataFrame:
        out = {k: v for k, v in zip(keys, key)} | {c: pdf[c].to_numpy() for c in ("seq", "t", "value")}
        return pd.DataFrame(out | {"smooth": y} | more)

    def filtered(x: np.ndarray, found, *given) -> np.ndarray:
        if found is None:
            return x
        return np.full(len(x), np.nan) if found is False else found.run(x, *given)[0]

    def short(table: pa.Table, starts: np.ndarray) -> pa.Table:
        x = table.column("value").cast(pa.float64()).to_numpy().astype(float)
        n, t0, t1 = (table.column(c).to_numpy() for c in ("_n", "_t0", "_t1"))
        y = np.empty(len(x))
        for start, end in zip(starts, [*starts[1:], len(x)]):
            part = x[start:end]
            for stage in stages:
                part = filtered(part, _designed(*stage, order, int(n[start]), float(t0[start]), float(t1[start])), (True, True))
            y[start:end] = part
        made = {c: table.column(c) for c in [*keys, "seq"]} | {c: without_nan(table.column(c)) for c in ("t", "value")}
        return pa.table(made | {"smooth": without_nan(y)})

    def long(d: DataFrame, stage) -> DataFrame:
        """One filter over the column ``smooth`` of series of several chunks."""

        def ends(key, pdf: pd.DataFrame) -> tuple[bool, bool]:
            return key[-1] == 0, pdf["seq"].iloc[-1] == pdf["_n"].iloc[0] - 1

        def offsets(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("seq")
            found = of(stage, pdf)
            out = {k: [v] for k, v in zip(keys, key)} | {"_chunk": [key[-1]]}
            out |= {c: pdf[c].iloc[:1].to_numpy() for c in ("_n", "_t0", "_t1")}
            if not found:
                return pd.DataFrame(out | {"length": [0], "forward": [[]], "backward": [[]]})
            at = ends(key, pdf)
            _, a, b = found.run(pdf["smooth"].to_numpy(dtype=float), at)
            length = len(pdf) + found.pad * (int(at[0]) + int(at[1]))
            return pd.DataFrame(out | {"length": [length], "forward": [a.tolist()], "backward": [b.tolist()]})

        def added_up(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_chunk")
            found = of(stage, pdf)
            a, b = pdf["forward"].tolist(), pdf["backward"].tolist()
            if found:
                a, b = found.states(pdf["length"].tolist(), [np.array(v) for v in a], [np.array(v) for v in b])
            out = {k: v for k, v in zip(keys, key)} | {"_chunk": pdf["_chunk"].to_numpy()}
            return pd.DataFrame(out | {"forward": [list(v) for v in a], "backward": [list(v) for v in b]})

        def applied(key, pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("seq")
            a, b = (np.array(states[c].iloc[0]) for c in ("forward", "backward"))
            y = filtered(pdf["smooth"].to_numpy(dtype=float), of(stage, pdf), ends(key, pdf), a, b)
            more = {c: pdf[c].to_numpy() for c in ("_n", "_t0", "_t1", "_chunk")}
            return result(key, pdf, y, **more)

        stated = "forward array<double>, backward array<double>"
        groups = python_groups(d, *keys, "_chunk")
        left = groups.applyInPandas(
            offsets, f"{head}_chunk bigint, _n bigint, _t0 double, _t1 double, length bigint, {stated}"
        )
        states = left.groupBy(*keys).applyInPandas(added_up, f"{head}_chunk bigint, {stated}")
        both = groups.cogroup(states.groupBy(*keys, "_chunk"))
        return both.applyInPandas(applied, f"{rows}, _n bigint, _t0 double, _t1 double, _chunk bigint")

    is_long = F.col("_n") >= 2 * chunk_rows
    parts = d.filter(is_long).withColumn("smooth", F.col("value"))
    for stage in stages:
        parts = long(parts, stage)
    whole = d.filter(~is_long).select(*keys, "seq", *[F.col(c).cast("double").alias(c) for c in ("t", "value", "_t0", "_t1")], "_n")
    whole = in_runs(whole, keys, ["seq"], short, rows)
    d = whole.unionByName(parts.drop("_n", "_t0", "_t1", "_chunk"))
    return d.withColumn("smooth", F.when(~F.isnan("smooth"), F.col("smooth")))


def drop_bands(df: DataFrame, keys=KEYS, bands=EIGEN_BANDS) -> DataFrame:
    """All eigenfrequency bands of the drop weight removed."""
    return filter_chain(df, [("bandstop", band) for band in bands], keys)


# ---- integration -------------------------------------------------------------------------


def integrated(df: DataFrame, column: str, out: str, keys=KEYS) -> DataFrame:
    """Cumulative trapezoid along ``t``, zero at the first row."""
    d = rolling(df, keys, {"_dt": lambda w: F.col("t") - F.lag("t").over(w), "_p": neighbour(column, -1)}, 1, 0)
    part = F.coalesce((F.col(column) + F.col("_p")) / 2 * F.col("_dt"), F.lit(0.0))
    return running_sum(d, keys, {out: part}).drop("_dt", "_p")


def motion(df: DataFrame, tail: int = 60000, keys=KEYS) -> DataFrame:
    """Acceleration, velocity and distance from g; the offset is the mean of the last rows."""
    d = key_stats(df, keys, _n=F.count(F.lit(1)))
    d = key_stats(d, keys, _off=F.avg(F.when(F.col("seq") >= F.col("_n") - tail, F.col("value"))))
    d = d.withColumn("a", (F.col("value") - F.col("_off")) * GRAVITY).drop("_n", "_off")
    return integrated(integrated(d, "a", "v", keys), "v", "s", keys)


def load_curve(df: DataFrame, fall_height: float = 0.07, trigger: float = 0.5, span: float = 0.5, keys=KEYS) -> DataFrame:
    """Fall, impact and following ``span`` seconds as (t, a, v, s, e_kin, force)."""
    start = trigger - math.sqrt(2 * fall_height / GRAVITY)
    d = renumber(between(df, start, start + span), keys)
    d = key_stats(d, keys, _t0=F.min("t")).withColumn("t", F.col("t") - F.col("_t0")).drop("_t0")
    d = d.withColumn("a", F.col("value") * GRAVITY)
    d = integrated(integrated(d, "a", "v", keys), "v", "s", keys)
    v = F.col("v")
    return (
        d.withColumn("s", F.col("s") + fall_height)
        .withColumn("e_kin", 0.5 * GRAVITY * v * v)
        .withColumn("force", DROP_MASS_KG * F.col("a"))
    )


# ---- peaks -------------------------------------------------------------------------------


def runs(df: DataFrame, keys=KEYS) -> DataFrame:
    """Stretches of equal values: ``(keys, seq = run number, first, last, value)``."""
    d = rolling(df, keys, {"_p": neighbour("value", -1)}, 1, 0)
    new = F.when(F.col("_p").isNull() | (F.col("_p") != F.col("value")), 1.0).otherwise(0.0)
    d = running_sum(d, keys, {"_run": new})
    return d.groupBy(*keys, (F.col("_run") - 1).cast("bigint").alias("seq")).agg(
        F.min("seq").alias("first"), F.max("seq").alias("last"), F.min("value").alias("value"), F.min("t").alias("t")
    )


def local_maxima(df: DataFrame, height: float, keys=KEYS) -> DataFrame:
    """Samples (or middles of plateaus) above both neighbours and at least ``height``."""
    d = rolling(runs(df, keys), keys, {"_l": neighbour("value", -1), "_r": neighbour("value", 1)}, 1, 1)
    top = (F.col("_l") < F.col("value")) & (F.col("_r") < F.col("value")) & (F.col("value") >= height)
    return d.filter(top).select(*keys, F.floor((F.col("first") + F.col("last")) / 2).alias("seq"), "value")


def _spaced(pos: np.ndarray, value: np.ndarray, kept: np.ndarray, seen: tuple[float, float], distance: int) -> np.ndarray:
    """Which of the sorted candidates stay: 1 kept, 0 removed, -1 not known from the candidates given.

    Higher candidates go first, later ones among equals. All candidates within ``seen`` are
    given; one whose surroundings reach beyond, or which a higher unknown one competes
    with, stays unknown unless something removes it. ``kept`` ones were decided before.
    """
    near = np.searchsorted(pos, pos - distance, side="right"), np.searchsorted(pos, pos + distance, side="left")
    gone, doubtful = np.zeros(len(pos), bool), (pos - distance < seen[0]) | (pos + distance > seen[1])
    out = np.zeros(len(pos), np.int8)
    for i in np.lexsort((pos, value, kept))[::-1].tolist():
        if kept[i] or not (gone[i] or doubtful[i]):
            out[i] = 1
            gone[near[0][i] : near[1][i]] = True
        elif not gone[i]:
            out[i] = -1
            doubtful[near[0][i] : near[1][i]] = True
    return out


def peaks(df: DataFrame, height: float, distance: int, keys=KEYS, tile_rows: int = CHUNK_ROWS) -> DataFrame:
    """Local maxima thinned to a minimum distance, higher peaks first, later ones among equals.

    A recording is cut into tiles, and a tile sees the candidates of a margin on either side.
    What it can decide from them is final: a candidate that tops all undecided ones within
    ``distance`` stays and removes them. Only what hangs on candidates beyond the margin goes to
    the next round, with the peaks that have been kept near its borders; noise leaves next to
    nothing. Heights that rise from tile to tile without a break take a round for each tile.
    """
    keys = list(keys)
    margin = 8 * distance
    tile_rows = max(tile_rows, 2 * margin)
    c = local_maxima(df, height, keys).withColumn("kept", F.lit(False))
    types = {f.name: f.dataType.simpleString() for f in c.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["seq bigint", "value double", "state tinyint"])

    def decide(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        pos, kept = pdf["seq"].to_numpy(), pdf["kept"].to_numpy()
        start = int(key[-1]) * tile_rows
        low, high = start - margin, start + tile_rows + margin
        state = _spaced(pos, pdf["value"].to_numpy(), kept, (low if start else -math.inf, high), distance)
        own = (pos >= start) & (pos < start + tile_rows) & ~kept & (state != 0)
        out = {k: v for k, v in zip(keys, key)}
        return pd.DataFrame(out | {"seq": pos[own], "value": pdf["value"].to_numpy()[own], "state": state[own]})

    def tiled(d: DataFrame) -> DataFrame:
        first = F.greatest(F.lit(0), F.floor((F.col("seq") - margin) / tile_rows))
        d = d.withColumn("_tile", F.explode(F.sequence(first, F.floor((F.col("seq") + margin) / tile_rows))))
        return checkpointed(python_groups(d, *keys, "_tile").applyInPandas(decide, schema))

    found = None
    while True:
        c = tiled(c)
        kept = c.filter("state = 1").drop("state")
        found = kept if found is None else found.unionByName(kept)
        if c.filter("state = -1").isEmpty():
            return found.select(*keys, "seq", "value")
        # what later tiles must know of this round's peaks: those a neighbour's candidate may be near to
        place = F.col("seq") % tile_rows
        border = found.filter((place < distance) | (place >= tile_rows - distance)).withColumn("kept", F.lit(True))
        c = c.filter("state = -1").drop("state").withColumn("kept", F.lit(False)).unionByName(border)


def broken_immediately(
    drop: DataFrame, reaction: DataFrame, runtime: float, cutoff: float = 3500.0, key="specimen_id",
    drop_peak=(20.0, 10), reaction_peak=(500.0, 100),
) -> DataFrame:
    """Does the edge sensor answer within 1.5 crack runtimes of the impact?

    Without a peak the first sample of the channel stands for it.
    """

    def first_time(df: DataFrame, height: float, distance: int, out: str) -> DataFrame:
        d = trigger_time(df, keys=[key])
        found = peaks(d, height, distance, [key]).groupBy(key).agg(F.min("seq").alias("_p"))
        starts = d.select(key).distinct().join(found, key, "left").withColumn("seq", F.coalesce("_p", F.lit(0)).cast("bigint"))
        return starts.join(d.select(key, "seq", "t"), [key, "seq"]).select(key, F.col("t").alias(out))

    filtered = butterworth(drop, "lowpass", cutoff, [key]).drop("value").withColumnRenamed("smooth", "value")
    # the peak search reads it several times
    filtered = checkpointed(filtered)
    impact = first_time(filtered, *drop_peak, "t_impact")
    fracture = first_time(reaction, *reaction_peak, "t_fracture")
    d = impact.join(fracture, key)
    return d.withColumn("broken_immediately", F.col("t_fracture") - F.col("t_impact") < 1.5 * runtime)


# ---- spectra -----------------------------------------------------------------------------


def fourier_bins(df: DataFrame, bins, keys=KEYS) -> DataFrame:
    """Magnitude at chosen frequency numbers: two sums per bin, combined map-side."""
    keys = list(keys)
    d = key_stats(df, keys, _n=F.count(F.lit(1)), _t0=F.min(F.when(F.col("seq") == 0, F.col("t"))), _t1=F.min(F.when(F.col("seq") == 1, F.col("t"))))
    d = d.withColumn("k", F.explode(F.array(*[F.lit(int(b)) for b in bins]))).filter(F.col("k") < F.col("_n"))
    phase = 2 * math.pi * F.col("k") * F.col("seq") / F.col("_n")
    freq = F.least(F.col("k"), F.col("_n") - F.col("k")) / (F.col("_n") * F.nullif(F.col("_t1") - F.col("_t0"), F.lit(0.0)))
    sums = d.withColumn("freq", freq).groupBy(*keys, "k", "freq").agg(
        F.sum(F.col("value") * F.cos(phase)).alias("_c"), F.sum(F.col("value") * F.sin(phase)).alias("_s")
    )
    return sums.withColumn("magnitude", F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s"))).drop("_c", "_s")


def _factor(n: int, direct: int) -> int:
    """1 for series one task can take, else the largest divisor not above the square root; 0 if that leaves too long a rest."""
    if n <= direct:
        return 1
    p = next(k for k in range(math.isqrt(n), 0, -1) if n % k == 0)
    return p if n // p <= direct else 0


def _chirp(seq: np.ndarray, n: int) -> np.ndarray:
    """``exp(i pi seq^2 / n)``, the square reduced in whole numbers."""
    return np.exp(1j * np.pi * (seq * seq % (2 * n)) / n)


def spectrum(df: DataFrame, keys=KEYS, direct: int = CHUNK_ROWS) -> DataFrame:
    """Full discrete Fourier transform, ``(keys, k, freq, magnitude)``.

    A series longer than ``direct`` with ``n = p*q`` is done as ``p`` transforms of length
    ``q``, a phase factor, and ``q`` transforms of length ``p`` with a shuffle in between. Where
    ``n`` has no such factors (it may be prime) the transform is written as a convolution with a
    chirp, which has any length from ``2n - 1`` on: a power of two, done in the same two steps
    there and back. No task holds a series longer than ``direct`` whole.
    """
    keys = list(keys)
    heads = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.when(F.col("seq") == 0, F.col("t"))).alias("_t0"),
        F.min(F.when(F.col("seq") == 1, F.col("t"))).alias("_t1"),
    )
    factor = F.pandas_udf(lambda s: pd.Series([_factor(int(v), direct) for v in s], dtype="int64"), "bigint")
    heads = heads.withColumn("_p", factor("_n"))
    d = df.select(*keys, "seq", "value").join(heads, keys)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    head = ", ".join(f"{k} {types[k]}" for k in keys)

    def whole(key, pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.abs(np.fft.fft(pdf.sort_values("seq")["value"].to_numpy(dtype=float)))
        return pd.DataFrame(dict(zip(keys, key)) | {"k": np.arange(len(y)), "magnitude": y})

    def stage_one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        n, p, j = int(pdf["_n"].iloc[0]), int(pdf["_p"].iloc[0]), int(key[-1])
        y = np.fft.fft(pdf["value"].to_numpy(dtype=float))
        y = y * np.exp(-2j * np.pi * j * np.arange(len(y)) / n)
        out = dict(zip(keys, key))
        return pd.DataFrame(out | {"_j": j, "_m": np.arange(len(y)), "_n": n, "_p": p, "re": y.real, "im": y.imag})

    def stage_two(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_j")
        n, p, m = int(pdf["_n"].iloc[0]), int(pdf["_p"].iloc[0]), int(key[-1])
        y = np.fft.fft(pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy())
        return pd.DataFrame(dict(zip(keys, key)) | {"k": m + (n // p) * np.arange(len(y)), "magnitude": np.abs(y)})

    result = f"{head}, k bigint, magnitude double"
    short = python_groups(d.filter("_p = 1").select(*keys, "seq", "value"), *keys).applyInPandas(whole, result)
    one = d.filter("_p > 1").withColumn("_j", F.col("seq") % F.col("_p")).select(*keys, "_j", "seq", "value", "_n", "_p")
    one = python_groups(one, *keys, "_j").applyInPandas(
        stage_one, f"{head}, _j bigint, _m bigint, _n bigint, _p bigint, re double, im double"
    )
    two = python_groups(one, *keys, "_m").applyInPandas(stage_two, result)
    odd = _chirped(d.filter("_p = 0"), heads.filter("_p = 0"), keys, head, result)
    freq = F.least(F.col("k"), F.col("_n") - F.col("k")) / (F.col("_n") * F.nullif(F.col("_t1") - F.col("_t0"), F.lit(0.0)))
    every = short.unionByName(two).unionByName(odd).join(heads, keys)
    return every.select(*keys, "k", freq.alias("freq"), "magnitude")


def _chirped(d: DataFrame, heads: DataFrame, keys: list[str], head: str, result: str) -> DataFrame:
    """Magnitudes by a circular convolution of length ``2^a * 2^b`` with a chirp.

    Rows of the series (``_side`` 0) and of the chirp (1) go through the first step each, meet
    under their frequency, and their product goes back.
    """

    def lengths(n: int) -> tuple[int, int]:
        bits = (2 * n - 2).bit_length()
        return 1 << bits // 2, 1 << bits - bits // 2

    def first_step(x: np.ndarray, out: dict, j: int, side: int, n: int, p: int, q: int) -> pd.DataFrame:
        y = np.fft.fft(x) * np.exp(-2j * np.pi * j * np.arange(q) / (p * q))
        return pd.DataFrame(out | {"_side": side, "_j": j, "_m": np.arange(q), "_n": n, "re": y.real, "im": y.imag})

    def series(key, pdf: pd.DataFrame) -> pd.DataFrame:
        n, j = int(pdf["_n"].iloc[0]), int(key[-1])
        p, q = lengths(n)
        seq, x = pdf["seq"].to_numpy(), np.zeros(q, complex)
        x[(seq - j) // p] = pdf["value"].to_numpy(dtype=float) * _chirp(seq, n).conj()
        return first_step(x, dict(zip(keys, key)), j, 0, n, p, q)

    def chirp(key, pdf: pd.DataFrame) -> pd.DataFrame:
        n, j = int(pdf["_n"].iloc[0]), int(key[-1])
        p, q = lengths(n)
        at = j + p * np.arange(q)
        at = np.minimum(at, p * q - at)
        return first_step(np.where(at < n, _chirp(np.minimum(at, n), n), 0), dict(zip(keys, key)), j, 1, n, p, q)

    def product(key, pdf: pd.DataFrame) -> pd.DataFrame:
        n, m = int(pdf["_n"].iloc[0]), int(key[-1])
        p, q = lengths(n)
        y = np.ones(p, complex)
        for side in (0, 1):
            rows = pdf[pdf["_side"] == side].sort_values("_j")
            x = np.zeros(p, complex)
            x[rows["_j"].to_numpy()] = rows["re"].to_numpy() + 1j * rows["im"].to_numpy()
            y = y * np.fft.fft(x)
        y = np.fft.ifft(y) * np.exp(2j * np.pi * m * np.arange(p) / (p * q))
        out = dict(zip(keys, key))
        return pd.DataFrame(out | {"_m": m, "_s": np.arange(p), "_n": n, "re": y.real, "im": y.imag})

    def back(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_m")
        n, s = int(pdf["_n"].iloc[0]), int(key[-1])
        p, q = lengths(n)
        y = np.abs(np.fft.ifft(pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()))
        k = s + p * np.arange(q)
        return pd.DataFrame(dict(zip(keys, key)) | {"k": k[k < n], "magnitude": y[k < n]})

    parts = F.pandas_udf(lambda v: pd.Series([lengths(int(n))[0] for n in v], dtype="int64"), "bigint")
    heads = heads.select(*keys, "_n", parts("_n").alias("_parts"))
    rows = d.select(*keys, "seq", "value").join(heads, keys).withColumn("_j", F.col("seq") % F.col("_parts"))
    step = f"{head}, _side int, _j bigint, _m bigint, _n bigint, re double, im double"
    a = python_groups(rows.drop("_parts"), *keys, "_j").applyInPandas(series, step)
    every = heads.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
    b = python_groups(every.drop("_parts"), *keys, "_j").applyInPandas(chirp, step)
    met = python_groups(a.unionByName(b), *keys, "_m").applyInPandas(
        product, f"{head}, _m bigint, _s bigint, _n bigint, re double, im double"
    )
    return python_groups(met, *keys, "_s").applyInPandas(back, result)


def spectrogram(df: DataFrame, frame: int = 1024, overlap: int = 512, keys=KEYS) -> DataFrame:
    """Power density per frame (tapered cosine window of share 0.25, mean removed)."""
    keys = list(keys)
    hop = frame - overlap
    d = key_stats(df, keys, _n=F.count(F.lit(1)), _t0=F.min(F.when(F.col("seq") == 0, F.col("t"))), _t1=F.min(F.when(F.col("seq") == 1, F.col("t"))))
    first = F.greatest(F.lit(0), F.ceil((F.col("seq") - frame + 1) / hop))
    last = F.least(F.floor(F.col("seq") / hop), F.floor((F.col("_n") - frame) / hop))
    d = d.filter(F.col("_n") >= frame).filter(first <= last).withColumn("frame", F.explode(F.sequence(first, last)))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["frame bigint", "time double", "freq double", "power double"])

    def taper() -> np.ndarray:
        # periodic: one sample longer, the last one dropped
        m = frame + 1
        w = np.ones(m)
        width = int(np.floor(0.25 * (m - 1) / 2))
        i = np.arange(width + 1)
        w[: width + 1] = 0.5 * (1 + np.cos(np.pi * (-1 + 2.0 * i / 0.25 / (m - 1))))
        j = np.arange(m - width - 1, m)
        w[m - width - 1 :] = 0.5 * (1 + np.cos(np.pi * (-2.0 / 0.25 + 1 + 2.0 * j / 0.25 / (m - 1))))
        return w[:-1]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        x = pdf["value"].to_numpy(dtype=float)
        fs = 1.0 / (pdf["_t1"].iloc[0] - pdf["_t0"].iloc[0])
        w = taper()
        power = np.abs(np.fft.rfft((x - x.mean()) * w)) ** 2 / (fs * (w * w).sum())
        power[1 : (-1 if frame % 2 == 0 else None)] *= 2
        out = {k: v for k, v in zip(keys, key)}
        return pd.DataFrame(
            out | {"frame": int(key[-1]), "time": (key[-1] * hop + frame / 2) / fs, "freq": np.fft.rfftfreq(frame, 1 / fs), "power": power}
        )

    cols = [*keys, "frame", "seq", "value", "_t0", "_t1"]
    return python_groups(d.select(*cols), *keys, "frame").applyInPandas(run, schema)


# ---- crack tracks and frames -------------------------------------------------------------


def track(tips: DataFrame, dt: float = 1.0, ends=(3, 4), key: str = "crack_id", turning: str = "stored", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Kinematics of crack tips ``(key, frame, x_mm, y_mm[, pixel])``.

    The number of tip pixels is the status, the first one in image order (row, then column)
    is the tip; a track stops after a closing status. Angles:
    ``plain`` is the absolute change of heading, ``stored`` compares the heading with the
    previously stored difference, as the original does.
    """
    keys = [key]
    first = F.min(F.struct("pixel", "x_mm", "y_mm")) if "pixel" in tips.columns else F.min(F.struct("y_mm", "x_mm"))
    d = tips.groupBy(key, "frame").agg(F.count(F.lit(1)).alias("status"), first.alias("_p"))
    d = d.select(key, "frame", "status", F.col("_p.x_mm").alias("x_mm"), F.col("_p.y_mm").alias("y_mm"))
    d = key_stats(d, keys, _end=F.min(F.when(F.col("status").isin(list(ends)), F.col("frame"))))
    d = d.filter(F.col("_end").isNull() | (F.col("frame") <= F.col("_end"))).drop("_end")
    d = running_sum(d.withColumn("seq", F.col("frame").cast("bigint")), keys, {"_i": F.lit(1.0)})
    d = d.withColumn("seq", F.col("_i").cast("bigint") - 1).withColumn("t", F.col("frame") * dt).drop("_i")
    d = rolling(d, keys, {"_px": neighbour("x_mm", -1), "_py": neighbour("y_mm", -1), "_pt": neighbour("t", -1)}, 1, 0)
    dx, dy = F.col("x_mm") - F.col("_px"), F.col("y_mm") - F.col("_py")
    d = d.withColumn("step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    d = d.withColumn("heading", F.coalesce(F.atan2(dy, dx) * (180 / math.pi), F.lit(0.0)))
    d = running_sum(d, keys, {"distance": F.col("step")})
    gap = F.col("t") - F.col("_pt")
    d = d.withColumn("velocity", F.try_divide(F.col("step") * 1e-3, gap) / 1e-6).withColumn("t_velocity", F.col("_pt") + gap / 2)
    d = d.drop("_px", "_py", "_pt")
    if turning == "plain":
        d = rolling(d, keys, {"_h": neighbour("heading", -1)}, 1, 0)
        return d.withColumn("angle", F.when(F.col("seq") > 0, F.abs(F.col("_h") - F.col("heading"))).otherwise(0.0)).drop("_h")
    return _stored_angles(d, key, chunk_rows)


def _stored_angles(d: DataFrame, key: str, chunk_rows: int) -> DataFrame:
    """``stored = |previous stored - heading|``: a fold, done chunk by chunk.

    The recurrence is sequential, so chunks of a long track follow each other with the
    last value carried over; tracks up to ``chunk_rows`` frames need one round.
    """
    rounds = (d.agg(F.max("seq")).first()[0] or 0) // chunk_rows + 1
    d = d.withColumn("_chunk", chunk_of("seq", chunk_rows))
    if rounds > 1:
        d = checkpointed(d)
    done, state = None, None
    for c in range(rounds):
        part = d.filter(F.col("_chunk") == c)
        rows = part.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "heading"))).alias("_h"))
        rows = rows.withColumn("_s", F.lit(0.0)) if state is None else rows.join(state, key)
        start = F.struct(F.col("_s").alias("s"), F.array().cast("array<double>").alias("a"))

        def fold(acc, h):
            value = F.when(h["seq"] == 0, F.lit(0.0)).otherwise(F.abs(acc["s"] - h["heading"]))
            return F.struct(value.alias("s"), F.concat(acc["a"], F.array(value)).alias("a"))

        rows = rows.withColumn("_f", F.aggregate("_h", start, fold))
        if rounds > 1:
            rows = checkpointed(rows)
        angles = rows.select(key, F.explode(F.arrays_zip(F.col("_h.seq").alias("seq"), F.col("_f.a").alias("angle"))).alias("_z"))
        angles = angles.select(key, "_z.seq", "_z.angle")
        done = angles if done is None else done.unionByName(angles)
        state = rows.select(key, F.col("_f.s").alias("_s"))
    return d.join(done, [key, "seq"]).drop("_chunk")


def mean_velocity(tracks: DataFrame, key: str = "crack_id") -> DataFrame:
    return tracks.groupBy(key).agg(
        F.regr_slope("distance", "t").alias("velocity"), F.regr_intercept("distance", "t").alias("intercept")
    )


def frame_difference(pixels: DataFrame, threshold: int = 10, frame="frame", place=("x", "y")) -> DataFrame:
    """Pixels that change by more than ``threshold`` to the next frame.

    Frames meet in an equi-join on (pixel, frame number), which has no hot key.
    """
    place = list(place)
    following = pixels.select(*place, (F.col(frame) - 1).alias(frame), F.col("gray").alias("_next"))
    d = pixels.join(following, [*place, frame])
    return d.withColumn("change", F.abs(F.col("_next") - F.col("gray"))).filter(F.col("change") > threshold).drop("_next")
