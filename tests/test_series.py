"""Series operators against plain numpy, with chunks of a few rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from craquelure.operators import ordered as O, signals as S

K = ["k"]


@pytest.fixture(scope="module")
def wave(spark):
    rng = np.random.default_rng(3)
    n = 400
    t = np.arange(n) * 1e-4
    x = np.sin(2 * np.pi * 300 * t) + 0.3 * rng.normal(size=n)
    frames = [pd.DataFrame({"k": "a", "seq": np.arange(n), "t": t, "value": x}), pd.DataFrame({"k": "b", "seq": np.arange(37), "t": t[:37], "value": x[:37] ** 2})]
    pdf = pd.concat(frames)
    return spark.createDataFrame(pdf).select("k", F.col("seq").cast("bigint").alias("seq"), "t", "value"), pdf


def collected(df, column, key="a"):
    rows = df.filter(F.col("k") == key).orderBy("seq").select(column).collect()
    return np.array([np.nan if r[0] is None else r[0] for r in rows])


def test_sequence_number_over_many_stretches(spark):
    rng = np.random.default_rng(1)
    t = np.concatenate([rng.normal(size=500), np.full(20, 0.25)])
    d = spark.createDataFrame(pd.DataFrame({"k": 1, "t": t, "id": np.arange(len(t))}))
    got = O.sequence_number(d, K, "t", ["id"], chunk_rows=16).toPandas().sort_values(["t", "id"])
    assert got["seq"].tolist() == list(range(len(t)))


def test_stretches_of_a_burst_are_equally_full(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.random(18000) * 0.01, rng.random(2000)])
    d = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x}))
    n = [r["count"] for r in O.stretches(d, K, "x", 500).groupBy("_cell").count().collect()]
    assert len(n) == 40 and max(n) < 2 * np.median(n)
    few = O.stretches(d.filter("x < 0.0002"), K, "x", 500)
    assert {r["_cell"] for r in few.collect()} == {0}


def test_rolling_and_running_sums_cross_chunks(wave):
    df, pdf = wave
    x = pdf[pdf.k == "a"]["value"].to_numpy()
    d = O.rolling(df, K, {"m": O.framed(F.sum("value"), 5, 3), "p": O.neighbour("value", -1)}, 5, 3, chunk_rows=7)
    want = [x[max(0, i - 5) : i + 4].sum() for i in range(len(x))]
    np.testing.assert_allclose(collected(d, "m"), want)
    np.testing.assert_allclose(collected(d, "p")[1:], x[:-1])
    assert d.count() == len(pdf)
    r = O.running_sum(df, K, {"c": F.col("value")}, chunk_rows=9)
    np.testing.assert_allclose(collected(r, "c"), np.cumsum(x))


def test_savgol_equals_local_polynomials(wave):
    df, pdf = wave
    x = pdf[pdf.k == "a"]["value"].to_numpy()
    got = collected(S.savgol(df, 9, 3, K, chunk_rows=32), "smooth")
    for i in range(len(x)):
        a = min(max(i - 4, 0), len(x) - 9)
        want = np.polyval(np.polyfit(np.arange(9), x[a : a + 9], 3), i - a)
        assert got[i] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("kind,edges", [("lowpass", 800.0), ("highpass", 400.0), ("bandpass", (200.0, 900.0)), ("bandstop", (250.0, 350.0))])
def test_butterworth_in_chunks_equals_whole_series(wave, kind, edges):
    df, _ = wave
    whole = collected(S.butterworth(df, kind, edges, K), "smooth")
    parts = collected(S.filter_chain(df, [(kind, edges)], K, chunk_rows=64), "smooth")
    np.testing.assert_allclose(parts, whole, atol=1e-12)


@pytest.mark.parametrize(
    "kind,edges,passed,stopped",
    [("lowpass", 500.0, 1.0, 4500.0), ("highpass", 500.0, 4900.0, 1.0), ("bandpass", (500.0, 1500.0), 870.0, 4500.0), ("bandstop", (500.0, 1500.0), 4900.0, 870.0)],
)
def test_butterworth_response(kind, edges, passed, stopped):
    fs = 10000.0
    sos = S.butter_sections(kind, edges, fs)

    def gain(f):
        z = np.exp(-2j * np.pi * f / fs) ** np.arange(3)
        return abs(np.prod([(s[:3] @ z) / (s[3:] @ z) for s in sos]))

    assert gain(passed) == pytest.approx(1.0, abs=1e-3)
    assert gain(stopped) < 1e-2
    for f in np.atleast_1d(edges):
        assert gain(f) == pytest.approx(np.sqrt(0.5), abs=1e-9)


CASES = [("lowpass", 900.0, 1e4, 120), ("highpass", 1.0, 5e4, 3000), ("bandpass", (5.0, 100.0), 5e4, 3000), ("bandstop", (2e3, 2.2e3), 5e4, 700), ("bandpass", (10.0, 4900.0), 1e4, 500)]


@pytest.mark.parametrize("kind,edges,fs,n", CASES)
def test_zero_phase_is_the_two_pass_recursion(kind, edges, fs, n):
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.normal(size=n)) * 0.1 + rng.normal(size=n)
    sos = S.butter_sections(kind, edges, fs)

    def lfilter(x, steady):
        for b0, b1, b2, _, a1, a2 in sos:
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            # state of a section that has seen `steady` forever
            s2 = steady * (b2 - a2 * gain)
            s1 = steady * (b1 - a1 * gain) + s2
            y = np.empty_like(x)
            for i, v in enumerate(x):
                y[i] = b0 * v + s1
                s1, s2 = b1 * v - a1 * y[i] + s2, b2 * v - a2 * y[i]
            x, steady = y, steady * gain
        return x

    found = S.Pass(sos)
    pad = found.pad
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = lfilter(ext, ext[0])
    y = lfilter(y[::-1], y[-1])[::-1][pad:-pad]
    np.testing.assert_allclose(found.run(x, (True, True))[0], y, atol=1e-9)
    # the same from chunks and the states between them
    cuts = [0, n // 4, n // 2, n]
    parts, ends = [x[a:b] for a, b in zip(cuts, cuts[1:])], [(True, False), (False, False), (False, True)]
    left = [found.run(p, e) for p, e in zip(parts, ends)]
    lengths = [len(p) + pad * sum(e) for p, e in zip(parts, ends)]
    states = found.states(lengths, [v[1] for v in left], [v[2] for v in left])
    whole = np.concatenate([found.run(p, e, a, b)[0] for p, e, a, b in zip(parts, ends, *states)])
    np.testing.assert_allclose(whole, y, atol=1e-9)


def test_chunks_of_a_filter_copy_no_row(spark):
    n = 5000
    rng = np.random.default_rng(8)
    x = np.cumsum(rng.normal(size=n)) * 0.1
    pdf = pd.DataFrame({"k": "a", "seq": np.arange(n), "t": np.arange(n) * 2e-5, "value": x})
    df = spark.createDataFrame(pdf).withColumn("seq", F.col("seq").cast("bigint"))
    sos = S.butter_sections("highpass", 1.0, 1 / 2e-5)
    got = collected(S.filter_chain(df, [("highpass", 1.0)], K, chunk_rows=600), "smooth")
    np.testing.assert_allclose(got, S.Pass(sos).run(x, (True, True))[0], atol=1e-9)


def test_lowpass_above_half_the_rate_changes_nothing(wave):
    df, pdf = wave
    got = collected(S.butterworth(df, "lowpass", 6000.0, K), "smooth")
    np.testing.assert_array_equal(got, pdf[pdf.k == "a"]["value"].to_numpy())


@pytest.mark.parametrize("direct", [1 << 17, 8])
def test_spectrum_equals_fft(wave, direct):
    df, pdf = wave
    rows = S.spectrum(df.withColumnRenamed("k", "series"), ["series"], direct).collect()
    for key in ("a", "b"):
        got = np.array([r["magnitude"] for r in sorted(rows, key=lambda r: r["k"]) if r["series"] == key])
        np.testing.assert_allclose(got, np.abs(np.fft.fft(pdf[pdf.k == key]["value"].to_numpy())), atol=1e-8)


@pytest.mark.parametrize("n, direct", [(1009, 64), (2 * 499, 64), (24, 8)])
def test_spectrum_of_awkward_lengths(spark, n, direct):
    rng = np.random.default_rng(n)
    rows = [(key, i, i * 1e-3, float(v)) for key in "ab" for i, v in enumerate(rng.normal(size=n - (key == "b")))]
    got = S.spectrum(spark.createDataFrame(rows, "k2 string, seq bigint, t double, value double"), ["k2"], direct).toPandas()
    for key in "ab":
        mine = got[got.k2 == key].sort_values("k")
        want = np.abs(np.fft.fft([r[3] for r in rows if r[0] == key]))
        np.testing.assert_allclose(mine["magnitude"], want, atol=1e-8)
        assert mine["freq"].iloc[1] == pytest.approx(1000 / len(want))


def test_peaks_with_plateaus_and_distance(spark):
    x = [0, 3, 3, 3, 1, 5, 1, 4, 1, 6, 0, 2, 0, 0, 7, 0]
    d = spark.createDataFrame([("a", i, float(i), float(v)) for i, v in enumerate(x)], "k string, seq bigint, t double, value double")
    assert [r["seq"] for r in S.local_maxima(d, 2.0, K).orderBy("seq").collect()] == [2, 5, 7, 9, 11, 14]
    assert [r["seq"] for r in S.peaks(d, 2.0, 3, K).orderBy("seq").collect()] == [2, 5, 9, 14]


def spaced(pos, value, distance):
    """The highest candidate first, one after another."""
    keep = {}
    for i in sorted(range(len(pos)), key=lambda i: (value[i], pos[i]), reverse=True):
        if all(abs(pos[i] - p) >= distance for p in keep):
            keep[pos[i]] = value[i]
    return sorted(keep)


@pytest.mark.parametrize("shape", ["noise", "steps", "rising", "falling"])
def test_spaced_peaks_in_tiles_equal_the_sequential_rule(spark, shape):
    rng = np.random.default_rng(11)
    n, distance = 3000, 9
    x = {"noise": rng.normal(size=n), "steps": rng.integers(0, 5, n), "rising": np.arange(n) * 0.01 + np.arange(n) % 2, "falling": -np.arange(n) * 0.01 + np.arange(n) % 2}[shape]
    pdf = pd.DataFrame({"k": np.repeat(["a", "b"], [n - 400, 400]), "seq": np.r_[np.arange(n - 400), np.arange(400)], "t": 0.0, "value": x.astype(float)})
    df = spark.createDataFrame(pdf).withColumn("seq", F.col("seq").cast("bigint"))
    tops = S.local_maxima(df, -1e9, K).toPandas()
    got = S.peaks(df, -1e9, distance, K, tile_rows=200).toPandas()
    for key in "ab":
        t = tops[tops.k == key]
        assert sorted(got[got.k == key]["seq"]) == spaced(t["seq"].tolist(), t["value"].tolist(), distance)
    assert len(got) < len(tops)


def test_stored_angles_carry_over_chunks(spark):
    rng = np.random.default_rng(5)
    pts = rng.random((41, 2)) * 10
    d = spark.createDataFrame([("c", i + 1, float(a), float(b)) for i, (a, b) in enumerate(pts)], "crack_id string, frame int, x_mm double, y_mm double")
    want, last = [0.0], 0.0
    for p, q in zip(pts, pts[1:]):
        last = abs(last - np.degrees(np.arctan2(q[1] - p[1], q[0] - p[0])))
        want.append(last)
    for rows in (1 << 17, 10):
        got = [r["angle"] for r in S.track(d, chunk_rows=rows).orderBy("frame").collect()]
        np.testing.assert_allclose(got, want, atol=1e-9)


def test_track_stops_after_a_closing_status(spark):
    rows = [("c", 1, 0, 0.0, 0.0), ("c", 2, 0, 1.0, 0.0), *[("c", 3, k, 2.0 + k, 0.0) for k in range(3)], ("c", 4, 0, 9.0, 0.0)]
    d = spark.createDataFrame(rows, "crack_id string, frame int, pixel int, x_mm double, y_mm double")
    got = S.track(d, turning="plain").orderBy("frame").collect()
    assert [(r["frame"], r["status"], r["distance"]) for r in got] == [(1, 1, 0.0), (2, 1, 1.0), (3, 3, 2.0)]


def test_recordings_without_the_drop_channel_are_rejected(spark):
    rows = [(s, c, i * dt) for s, c, dt in [(1, "Fall_g1", 1e-5), (2, "Fall_g1", 1e-3), (3, "Acc_1", 1e-5)] for i in range(5)]
    d = spark.createDataFrame(rows, "specimen_id int, channel string, t double")
    assert [r[0] for r in S.acceptable(d).collect()] == [1]


def test_short_series_are_handed_to_python_together(spark):
    rows = [(s, "a", i, i * 1.0, None if i == 3 and s == 2 else float(i * s)) for s in range(40) for i in range(12)]
    d = spark.createDataFrame(rows, "specimen_id int, channel string, seq bigint, t double, value double")
    smoothed = S.savgol(d, 5, 2)
    # one call of Python for each of many short series costs more than the work on them
    assert "FlatMapGroups" not in smoothed._jdf.queryExecution().toString()
    got = {(r.specimen_id, r.seq): r for r in smoothed.collect()}
    assert len(got) == len(rows) and got[2, 3].value is None and got[2, 3].smooth is None
    assert all(abs(got[s, i].smooth - i * s) < 1e-9 for s in range(3, 40) for i in range(12))
