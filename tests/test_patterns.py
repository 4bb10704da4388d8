"""Spatial, geometric and tabular operators on small hand-made inputs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from craquelure.functions import geometry as G, names as N
from craquelure.operators import brackets, catalog, cells, fits, kernels, layers, metrics, neighbours, panes, pointstats, scalp
from craquelure.sources import scalp as xml, stores


def points(spark, n=300, seed=2, pile=0):
    rng = np.random.default_rng(seed)
    xy = np.round(rng.random((n, 2)) * 500, 1)
    if pile:
        xy[:pile] = [250.0, 250.0]
    pdf = pd.DataFrame({"specimen_id": 1, "splinter_key": [f"s{i:04d}" for i in range(n)], "x_mm": xy[:, 0], "y_mm": xy[:, 1], "area": 1.0})
    return spark.createDataFrame(pdf), xy


@pytest.mark.parametrize("tile", [4096, 25])
def test_nearest_equals_brute_force_with_a_pile_of_copies(spark, tile):
    d, xy = points(spark, 260, pile=90)
    k = 7
    got = neighbours.nearest(d, ["specimen_id"], "splinter_key", k, tile_points=tile).toPandas()
    dist = np.hypot(*(xy[:, None, :] - xy[None, :, :]).transpose(2, 0, 1))
    keys = np.array([f"s{i:04d}" for i in range(len(xy))])
    for i, key in enumerate(keys):
        order = np.lexsort((keys, dist[i]))[:k]
        mine = got[got.splinter_key == key].sort_values("rank")
        assert mine["neighbour"].tolist() == keys[order].tolist()


def test_fewer_points_than_neighbours(spark):
    d, _ = points(spark, 5)
    got = neighbours.nearest(d, ["specimen_id"], "splinter_key", 30)
    assert got.count() == 25


def test_pair_counts_merge_copies(spark):
    d, xy = points(spark, 200, pile=60)
    got = {r["step"]: r["pairs"] for r in neighbours.pair_counts(d, ["specimen_id"], 40.0, 10).collect()}
    dist = np.hypot(*(xy[:, None, :] - xy[None, :, :]).transpose(2, 0, 1))
    np.fill_diagonal(dist, np.inf)
    for step in range(11):
        want = (dist == 0).sum() if step == 0 else ((dist > 4.0 * (step - 1)) & (dist <= 4.0 * step)).sum()
        assert got.get(step, 0) == want


def test_k_of_a_regular_grid(spark):
    rows = [(1, float(5 + 10 * i), float(5 + 10 * j)) for i in range(50) for j in range(50)]
    d = spark.createDataFrame(rows, "specimen_id int, x_mm double, y_mm double")
    k = pointstats.k_function(d, ["specimen_id"], 12.0, F.max(F.lit(250000.0)), steps=12).toPandas().set_index("step")["k"]
    assert k[9] == 0
    # 4 neighbours at 10 mm, fewer along the edges: 2 * 2 * 49 * 50 ordered pairs
    assert k[10] == pytest.approx(250000.0 * 9800 / 2500**2)


def test_first_minimum():
    y = np.concatenate([np.linspace(0, -5, 40), np.linspace(-5, 3, 60)])
    assert abs(pointstats.first_minimum_index(y) - 40) <= 3
    # strictly rising: only the zero padding at the far end can dip, the last value counts
    rising = np.linspace(0, 1, 100) ** 2
    assert len(pointstats.minima(rising, 20)) == 0


def test_chi2_quantile():
    assert pointstats.chi2_quantile(0.95, 16) == pytest.approx(26.2962276, abs=1e-6)
    assert pointstats.chi2_quantile(0.95, 1) == pytest.approx(3.8414588, abs=1e-6)


def square(spark, contour):
    pts = [{"px": a, "py": b} for a, b in contour]
    return spark.createDataFrame([(1, pts)], "id int, contour array<struct<px:int,py:int>>")


def test_rectangle_geometry(spark):
    d = square(spark, [(10, 10), (50, 10), (50, 30), (10, 30)]).withColumn("m", G.measures("contour")).withColumn("h", G.hull_columns())
    s = G.Shape(F.col("m"))
    row = d.select(s.area_px.alias("a"), s.perimeter.alias("u"), s.open_length.alias("o"), s.centroid[0].alias("x"), s.centroid_px[1].alias("y"), s.orientation_deg.alias("deg"), "h").first()
    assert (row.a, row.u, row.o, row.x, row.y, row.deg) == (800.0, 120.0, 100.0, 30.0, 20, 0.0)
    assert (row.h["hull"], max(row.h["la"], row.h["lb"]), min(row.h["la"], row.h["lb"])) == (120.0, 40.0, 20.0)


def test_degenerate_contour_has_no_centroid(spark):
    d = square(spark, [(5, 5), (9, 5)]).withColumn("m", G.measures("contour"))
    row = d.select(*[c.alias(f"c{i}") for i, c in enumerate(G.Shape(F.col("m")).centroid_px)]).first()
    assert row.c0 is None and row.c1 is None


def test_code_of_the_axes_is_short_enough_to_be_compiled(spark, capsys):
    d = square(spark, [(0, 0), (40, 0), (80, 0), (80, 20), (80, 40), (40, 40), (0, 40), (0, 20)])
    major, minor = G.Shape(F.col("m")).axis_lengths
    d = d.withColumn("m", G.measures("contour")).select(major.alias("major"), minor.alias("minor"))
    row = d.first()
    assert row.major == pytest.approx(4 * 80 / math.sqrt(12)) and row.minor == pytest.approx(4 * 40 / math.sqrt(12))
    capsys.readouterr()
    d.explain("codegen")
    # HotSpot leaves methods beyond 8000 bytes interpreted
    sizes = [int(part.split(";")[0]) for part in capsys.readouterr().out.split("maxMethodCodeSize:")[1:]]
    assert sizes and max(sizes) < 8000


def test_hull_of_random_contours_matches_brute_force():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 20, (50, 11)).astype(float), rng.integers(0, 20, (50, 11)).astype(float)
    hx, hy = G.hull_points(x, y)
    for i in range(50):
        pts = sorted(set(zip(x[i], y[i])))

        def chain(seq):
            out = []
            for p in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        hull = chain(pts) + chain(pts[::-1])
        assert set(zip(hx[i], hy[i])) == set(hull)


def test_simplification_keeps_corners():
    side = np.array([(i, 0) for i in range(10)] + [(10, i) for i in range(10)] + [(10 - i, 10) for i in range(10)] + [(0, 10 - i) for i in range(10)], float)
    thin = G.simplified(side, 0.02)
    assert {tuple(p) for p in thin} == {(0, 0), (10, 0), (10, 10), (0, 10)}


def test_norm_count_scores(spark):
    box = [(3100, 3100), (3200, 3100), (3200, 3200), (3100, 3200)]
    part = [(3390, 3100), (3395, 3100), (3399, 3200), (3500, 3200)]
    far = [(10, 10), (20, 10), (20, 20), (10, 20)]
    rows = [(1, [{"px": a, "py": b} for a, b in c], 400.0, 400.0, 500.0, 500.0) for c in (box, part, far)]
    d = spark.createDataFrame(rows, "specimen_id int, contour array<struct<px:int,py:int>>, x_mm double, y_mm double, w_mm double, h_mm double")
    assert panes.norm_count(d).first()["n50"] == 2.0
    assert panes.norm_count(d, score="doc").first()["n50"] == 1.5


def test_window_grid_skips_the_last_centre(spark):
    d = spark.createDataFrame([(1, x, 60.0, 1.0) for x in (60.0, 449.9, 470.0)], "specimen_id int, x_mm double, y_mm double, area double")
    d = d.withColumn("w_mm", F.lit(500.0)).withColumn("h_mm", F.lit(500.0))
    assert cells.windows(d).agg(F.max("i")).first()[0] == 23
    assert cells.grid_points(-1, (500.0, 300.0), 40.0) == (13, 8)


def pane_of(spark, n, seed=5):
    d, xy = points(spark, n, seed)
    return d.withColumns({"w_mm": F.lit(500.0), "h_mm": F.lit(500.0), "area": F.col("x_mm") + 1}), xy


def test_counted_windows_equal_each_window_by_itself(spark):
    d, _ = pane_of(spark, 400)
    holes = spark.createDataFrame([(2, "a", 100.0, 100.0, None, 500.0, 500.0), (2, "b", None, 60.0, 3.0, 500.0, 500.0)], d.schema)
    d = d.unionByName(holes)
    columns = ["specimen_id", "i", "j", "n", "count", F.round("intensity", 12), "intensity_std"]
    rows = lambda g: set(map(tuple, g.select(*columns).collect()))
    got = rows(panes.window_grid(d, ["count", "intensity"]))
    assert got == rows(kernels.aggregate(cells.windows(d), ["specimen_id", "i", "j"], ["count", "intensity"]))
    assert {r[5] for r in got if r[0] == 2} == {None}


def test_pane_grids_are_filled_where_they_are_made(spark):
    """splinters are added up before they are copied to windows; panes and values meet by the pane alone."""
    d, xy = pane_of(spark, 300)
    listed = spark.createDataFrame([(1,), (1,), (3,), (None,)], "specimen_id int")
    values = panes.window_grid(d, ["intensity"]).select("specimen_id", "i", "j", "intensity")
    full = panes.filled_grid(values, listed, ["intensity"])
    plan = full._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    # below the copies to windows there is an aggregate already
    assert "Aggregate" in plan.partition("Generate explode(sequence(_is")[2]
    got = full.toPandas()
    assert got["specimen_id"].fillna(0).value_counts().to_dict() == {1: 1152, 3: 576, 0: 576}
    centre = 50 + np.arange(24) * (400 / 24)
    inside = lambda v: (centre[:, None] - 25 <= v) & (v < centre[:, None] + 25)
    x, y = (inside(xy[:, k]).astype(float) for k in (0, 1))
    n, area = x @ y.T, (x * (xy[:, 0] + 1)) @ y.T
    flat = np.where(n > 0, n / np.where(n > 0, area, 1), np.nan).T.ravel()
    known = np.flatnonzero(~np.isnan(flat))
    want = np.interp(np.arange(576), known, flat[known])
    mine = got[got.specimen_id == 1].sort_values(["j", "i"])["intensity"].to_numpy()
    assert mine == pytest.approx(np.repeat(want, 2))
    assert got[got.specimen_id != 1]["intensity"].isna().all()


def test_exact_half_turn_falls_out_of_the_sectors(spark):
    d = spark.createDataFrame([(1, 100.0, 250.0), (1, 400.0, 250.0)], "specimen_id int, x_mm double, y_mm double")
    d = d.withColumns({"ip_x": F.lit(250.0), "ip_y": F.lit(250.0), "w_mm": F.lit(500.0), "h_mm": F.lit(500.0)})
    assert [r["x_mm"] for r in cells.polar(d).collect()] == [400.0]


def test_gap_filling_runs_across_rows_and_holds_the_ends(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 2.0, None, None, 5.0, float("nan")])], "k int, p int, v double")
    got = [r["v"] for r in kernels.fill_gaps(d, ["k"], "p", ["v"]).orderBy("p").collect()]
    assert got == pytest.approx([2.0, 2.0, 3.0, 4.0, 5.0, 5.0])


def test_nan_is_skipped_and_deviation_is_of_the_population(spark):
    d = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, float("nan"))], "k int, v double")
    row = kernels.aggregate(d, ["k"], ["v"]).first()
    assert (row["n"], row["v"], row["v_std"]) == (3, 2.0, 1.0)


def test_metrics_of_equal_vectors(spark):
    d = spark.createDataFrame([(1, i, v, v) for i, v in enumerate([1, 4, 2, 0])], "k int, pos int, ref int, meas int")
    row = d.groupBy("k").agg(metrics.jaccard().alias("j"), metrics.lb_error().alias("lb"), metrics.abs_error().alias("e")).first()
    assert (row.j, row.lb, row.e) == (100.0, 100.0, 0)
    assert metrics.ks(metrics.stacked(d, ["k"]), ["k"], "value", "sample").first()["d"] == 0.0


def test_name_filters(spark):
    d = spark.createDataFrame([(n,) for n in ("4.70.A.01", "4.70.A.011", "8.70.B.02-x", "12.100.Z.03")], "name string")
    pick = lambda text: [r[0] for r in d.filter(N.name_filter(F.col("name"), text)).collect()]
    assert pick("4.70.A.01") == ["4.70.A.01"]
    assert pick("4.70.A.01,12.100.Z.03") == ["4.70.A.01", "12.100.Z.03"]
    assert pick("4.70.A.01*") == ["4.70.A.01", "4.70.A.011"]
    assert pick("4:8.70") == []
    assert pick("4:8.70.*") == ["4.70.A.01", "4.70.A.011", "8.70.B.02-x"]
    assert pick("*.*.[A!B].*") == ["4.70.A.01", "4.70.A.011", "8.70.B.02-x"]
    assert pick(None) == [r[0] for r in d.collect()]


def test_swapped_name_parts(spark):
    row = spark.createDataFrame([("8.70.12.B",)], "name string").select(*[c.alias(k) for k, c in N.name_parts(F.col("name")).items()]).first()
    assert (row.thickness, row.boundary, row.nbr, row.comment) == (8, "B", 12, "")


def test_stress_ranges():
    assert N.stress_range("70-100") == (70.0, 100.0)
    assert N.stress_range("all") == (0.0, 1000.0)
    assert N.stress_range("5") == (0.0, 15.0)


def test_settings_defaults_and_overrides(spark):
    d = spark.createDataFrame([(1, '{"break_pos":"center","nope":3}'), (2, "{}")], "id int, s string")
    rows = {r["id"]: r for r in catalog.impact_position(catalog.settings(d, "s")).collect()}
    assert (rows[1]["break_pos"], rows[1]["ip_x"], rows[1]["fall_height_m"]) == ("center", 250.0, 0.07)
    assert (rows[2]["ip_x"], rows[2]["excluded_positions_radius"]) == (50.0, 100.0)


@pytest.mark.parametrize("rows", [65536, 40])
def test_bracket_on_a_crowded_axis(spark, rows):
    rng = np.random.default_rng(4)
    axis = {"a": np.unique(np.round(np.r_[rng.random(900) * 1e-3, rng.random(60) * 100, 50.0], 6)), "b": np.array([3.0]), "c": np.array([1.0, 2.0])}
    marks = [(k, float(v)) for k, values in axis.items() for v in values for _ in range(2)]
    asked = [(i, k, float(v)) for i, (k, v) in enumerate([(k, v) for k in "abc" for v in np.r_[rng.random(300) * 110 - 5, rng.random(100) * 1e-3, axis[k][:40], -9.0, 999.0]])]
    q = spark.createDataFrame([*asked, (-1, "none", 1.0)], "i int, k string, x double")
    got = brackets.bracket(q, spark.createDataFrame(marks, "k string, v double"), ["k"], "x", "v", "b", rows=rows).collect()
    assert len(got) == len(asked)
    for r in got:
        v = axis[r.k]
        b = min(max(r.x, v[0]), v[-1])
        at = max(int(np.searchsorted(v, b)), 1)
        lo, hi = (v[0], v[0]) if len(v) == 1 else (v[at - 1], v[at])
        assert (r.b, r.b_lo, r.b_hi) == (b, lo, hi)


def test_bracket_lookup_clamps(spark):
    axis = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 4.0, 8.0)], "k int, v double")
    q = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.5, 1.0, 2.0, 3.0, 8.0, 9.0])], "k int, i int, x double")
    got = brackets.bracket(q, axis, ["k"], "x", "v", "b").orderBy("i").collect()
    assert [(r["b_lo"], r["b_hi"]) for r in got] == [(1.0, 2.0), (1.0, 2.0), (1.0, 2.0), (2.0, 4.0), (4.0, 8.0), (4.0, 8.0)]


def test_layer_lookup_returns_node_values(spark):
    grid = [("A", 4, "corner", u, r, u * 10 + r, 1.0) for u in (1.0, 2.0, 3.0) for r in (20.0, 45.0)]
    layer = spark.createDataFrame(grid, "boundary string, thickness int, break_pos string, u double, r double, value double, std double")
    q = spark.createDataFrame([("A", 4, "corner", 0, 2.0, 45.0), ("A", 4, "corner", 1, 1.5, 32.5), ("A", 4, "corner", 2, 9.0, 0.0)], "boundary string, thickness int, break_pos string, i int, u_q double, r_q double")
    got = {r["i"]: r["value"] for r in layers.lookup(layer, q, ["i"]).collect()}
    assert got == pytest.approx({0: 65.0, 1: 47.5, 2: 50.0})


def test_layer_store(spark, tables, tmp_path):
    from craquelure.plans.layers import area_layer

    path = str(tmp_path / "layers")
    assert not stores.has_layer(spark, path, prop="area")
    long = layers.long(area_layer(tables))
    # bands beyond a pane without any splinter stay missing and are refused
    complete = long.filter("value is not null")
    stores.save_layer(complete, path)
    assert stores.has_layer(spark, path, prop="area", boundary="A")
    assert stores.load_layer(spark, path).count() == complete.count()
    with pytest.raises(ValueError):
        stores.save_layer(complete.withColumn("value", F.lit(float("nan"))), path)


def test_splinter_store_prunes_folders(spark, tables, tmp_path):
    path = str(tmp_path / "splinters")
    stores.save_splinters(tables.splinter, path, buckets=4)
    assert stores.load_splinters(spark, path).count() == tables.splinter.count()
    some = stores.load_splinters(spark, path, [3], buckets=4)
    assert some.count() == tables.splinter.filter("specimen_id = 3").count()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_csv_export_with_decimal_comma(spark, tmp_path):
    from craquelure.operators.exports import write_csv

    path = str(tmp_path / "out")
    write_csv(spark.createDataFrame([(1, 2.5), (2, 3.25)], "i int, v double"), path, decimal=",", order=["i"])
    rows = spark.read.option("sep", ";").option("header", True).csv(path).orderBy("i").collect()
    assert [tuple(r) for r in rows] == [("1", "2,5"), ("2", "3,25")]


def test_fall_heights_file(spark, tmp_path):
    f = tmp_path / "heights.csv"
    f.write_text("name;a;b;c;d;e;f;g;h\n4.70.A.01;1;2;3;4;5;6;7;12.5\n")
    row = stores.read_fall_heights(spark, str(f)).first()
    assert (row["name"], row["fall_height_m"]) == ("4.70.A.01", 0.125)


def test_project_file(spark, tmp_path):
    import base64

    b = lambda a, t: base64.b64encode(np.asarray(a, t).tobytes()).decode()
    curve = f"<Retardation>{b([1, 2], np.float32)}</Retardation>"
    text = f"""<Project><Measurements>
<Measurement><Specimen Name="8.70.A.3-x" Note="ul" Direction="XY-axis" GlassThickness="7.8"/>
<StressDistribution><Depth>{b([0, 0.5], np.float32)}</Depth><Stress>{b([-70, -60], np.float32)}</Stress><Active>{b([True, False], np.bool_)}</Active><Fit>{b([1, -1], np.int8)}</Fit></StressDistribution>
<MeasuredData><Data><StressDistribution>{curve}</StressDistribution></Data><Data><StressDistribution>{curve}</StressDistribution></Data></MeasuredData>
<StressValues><Surface Col1="-70.5" Col2="0.3"/><Mid Col1="35"/></StressValues></Measurement>
<Measurement><Specimen Name="9" Note="m" Direction="X-axis" GlassThickness="4"/></Measurement>
</Measurements></Project>"""
    path = tmp_path / "p.xml"
    path.write_text(text)
    rows = xml.read_projects(spark, str(path))
    got = rows.collect()
    assert len(got) == 1
    m = got[0]
    assert (m.specimen, m.location, m.orientation, m.measured_thickness) == ("8.70.A.03-x", "ul", "XY", 7.8)
    assert (m.depth, m.stress, m.active, m.fit) == ([0.0, 0.5], [-70.0, -60.0], [True, False], [1, -1])
    assert [tuple(v) for v in m.stress_values] == [("Surface", -70.5, 0.3), ("Mid", 35.0, 0.0)]
    assert [r.retardation for r in xml.retardations(rows).orderBy("nr").collect()] == [[1.0, 2.0]] * 2
    assert xml.depth_rows(rows).count() == 2


def test_missing_direction_can_be_entered(spark):
    d = spark.createDataFrame([(1, "ul", "X", 1, -70.0), (1, "ul", "X", 2, -72.0), (1, "ul", "Y", 1, -60.0)], "specimen_id int, location string, orientation string, ord int, stress0 double")
    assert not scalp.locations(d).first()["valid"]
    manual = spark.createDataFrame([(1, "ul", "Xy", -66.0), (1, "ul", "X", -1.0)], "specimen_id int, location string, orientation string, stress0 double")
    row = scalp.locations(d, manual=manual).first()
    assert (row["valid"], row["s_x"], row["s_xy"]) == (True, -72.0, -66.0)
    assert row["sig_1"] == pytest.approx(-72.0, abs=1e-9) and row["sig_2"] == pytest.approx(-60.0, abs=1e-9)


def test_polynomials_and_models(spark):
    x = np.linspace(1, 9, 60)
    d = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x, "y": 2 - x + 0.5 * x**3, "e": 3 * np.exp(0.2 * x), "h": 1 + 8 / (2 + x)}))
    coef = fits.polynomial(d, ["k"], "x", "y", 3).first()["coef"]
    assert coef == pytest.approx([2, -1, 0, 0.5], abs=1e-8)
    assert fits.nonlinear(d, "exponential", "x", "e", [1.0, 0.1]) == pytest.approx([3, 0.2], rel=1e-5)
    assert fits.nonlinear(d, "hyperbolic", "x", "h", [0.0, 1.0, 1.0], [(-10, 10), (0, 100), (0.01, 50)]) == pytest.approx([1, 8, 2], rel=1e-3)
    curve = fits.fitted_curve(d, "exponential", "x", "e", [1.0, 0.1])
    assert curve.count() == 100 and curve.first()["r2"] == pytest.approx(1.0)
    assert fits.fitted_curve(d.filter("x < 0"), "exponential", "x", "e", [1.0, 0.1]).isEmpty()


def test_singular_fit_is_missing(spark):
    d = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 3.0)], "k int, x double, y double")
    assert fits.linear(d, ["k"], [F.lit(1.0), F.col("x")], F.col("y")).first()["coef"] is None


def test_custom_kernel_adds_up_over_batches(spark):
    d = spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "k int, v double").repartition(7)
    got = kernels.custom(d, ["k"], ["v"], lambda p: (np.ones(len(p)), p["v"]), 2, lambda n, s: (s / n, F.lit(0.0)))
    assert {r["k"]: r["value"] for r in got.collect()} == {0: 13.5, 1: 14.5, 2: 15.5}


def test_upsert_and_first_per_key(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert sorted(tuple(r) for r in catalog.upsert(a, b, ["k"]).collect()) == [(1, "a"), (2, "x"), (3, "y")]
    d = catalog.distinct_valid([a.withColumn("o", F.lit(1)), b.withColumn("o", F.lit(2))], ["k"], ["o"])
    assert sorted((r["k"], r["v"]) for r in d.collect()) == [(1, "a"), (2, "b"), (3, "y")]


def test_ring_areas_cover_the_pane(spark):
    d = spark.createDataFrame([(250.0, 250.0, 500.0, 500.0)], "ip_x double, ip_y double, w_mm double, h_mm double")
    got = cells.ring_areas(d).agg(F.sum("ring_area")).first()[0]
    y, x = np.mgrid[0:500, 0:500]
    r = np.hypot(x - 250, y - 250)
    last = 20 + 25 * (math.ceil((math.hypot(250, 250) - 20) / 25) - 1)
    assert got == ((r > 20) & (r <= last)).sum()


def test_skewed_pane_keeps_every_splinter(spark):
    """One pane with most rows gives the same bands as counting directly."""
    n = 20000
    d = spark.range(n).select(
        F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id") % 7 + 2).alias("specimen_id"),
        (F.col("id") * 7 % 5000 / 10.0).alias("x_mm"),
        (F.col("id") * 13 % 5000 / 10.0).alias("y_mm"),
        F.lit(2.0).alias("area"),
    ).withColumns({"w_mm": F.lit(500.0), "h_mm": F.lit(500.0), "ip_x": F.lit(50.0), "ip_y": F.lit(50.0)})
    placed = cells.polar(d)
    total = kernels.aggregate(placed, ["specimen_id", "rb"], ["area"]).agg(F.sum("n")).first()[0]
    assert total == placed.count() > n // 2


def test_nonlinear_fits_of_all_groups(spark):
    rng = np.random.default_rng(6)
    rows = []
    for key, p in {"a": (2.0, 0.03), "b": (40.0, -0.01), "c": (7.0, 0.0)}.items():
        rows += [(key, float(x), float(p[0] * np.exp(p[1] * x) + 0.1 * rng.normal())) for x in rng.random(60) * 80 + 20]
    rows += [("few", 1.0, 2.0), ("null", None, 3.0)]
    d = spark.createDataFrame(rows, "k string, x double, y double")
    starts = {"exponential": [3.0, 0.01], "hyperbolic": [5.0, 10.0, 50.0]}
    bounds = {"hyperbolic": [(-1e6, 1e6), (-1e6, 1e6), (1e-3, 1e6)]}
    got = {(r.k, r.model): r for r in fits.nonlinear_groups(d, ["k"], starts, "x", "y", bounds).collect()}
    assert got["few", "exponential"].params is None and ("null", "exponential") not in got
    for key in "abc":
        x, y = np.array([r[1:] for r in rows if r[0] == key]).T
        r = got[key, "exponential"]
        res, e = y - r.params[0] * np.exp(r.params[1] * x), np.exp(r.params[1] * x)
        # both partial derivatives of the squared residual vanish
        assert abs(e @ res) < 1e-5 * np.abs(e) @ np.abs(res) and abs((x * e) @ res) < 1e-5 * np.abs(x * e) @ np.abs(res)
        assert r.sse == pytest.approx(res @ res, rel=1e-9) and r.r2 == pytest.approx(1 - res @ res / ((y - y.mean()) ** 2).sum(), abs=1e-9)
        one = fits.nonlinear(d.filter(f"k = '{key}'"), "hyperbolic", "x", "y", starts["hyperbolic"], bounds["hyperbolic"])
        p = got[key, "hyperbolic"].params
        q = lambda p: ((y - p[0] - p[1] / (p[2] + x)) ** 2).sum()
        assert q(p) <= q(one) * (1 + 1e-6)


def test_simplified_empty_contour():
    assert G.simplified(np.zeros((0, 2)), 0.02).shape == (0, 2)


@pytest.mark.parametrize("sent", [neighbours.SPOTS_SENT, 0])
def test_shared_contour_points_with_few_and_with_many_places(spark, monkeypatch, sent):
    monkeypatch.setattr(neighbours, "SPOTS_SENT", sent)
    random = np.random.default_rng(5)
    rows = [(int(random.integers(2)), f"s{i % 40}", i // 40, *(int(v) for v in random.integers(0, 9, 2))) for i in range(240)]
    rows += [rows[0], (None, "s1", 9, 1, 1), (None, "s2", 9, 1, 1), (0, "s1", 8, None, 1), (0, "s2", 8, None, 1)]
    d = spark.createDataFrame(rows, "specimen_id long, splinter_key string, k int, px int, py int")
    whole = [r for r in set(rows) if None not in r]
    want = {}
    for a in whole:
        for b in whole:
            if (a[0], *a[3:]) == (b[0], *b[3:]) and a[1] < b[1]:
                want.setdefault((a[0], a[1], b[1]), set()).add(a[3:])
    got = {(r.specimen_id, r.id_a, r.id_b): r.n for r in neighbours.common_points(d).collect()}
    assert got == {k: len(v) for k, v in want.items()}
    pairs = sum((a[0], *a[3:]) == (b[0], *b[3:]) and a[1:3] < b[1:3] for a in rows[1:241] for b in rows[1:241])
    once = spark.createDataFrame(rows[:240], d.schema)
    assert neighbours.shared_points(once).count() == pairs


def test_contours_of_one_length_are_thinned_together_like_one_by_one():
    random = np.random.default_rng(3)
    for k in (1, 2, 3, 8, 21):
        contours = random.integers(0, 40, (300, k, 2)).astype(float)
        contours[::5] = contours[::5, :1]
        assert G.simplified_together(contours, 0.02) == [G.simplified(c, 0.02).tolist() for c in contours]


def test_gaps_of_several_values_are_filled_in_frames_that_only_grow(spark):
    rows = [(k, p, float(p) if p in (2, 5) else None, None if p < 4 else 1.0) for k in (1, None) for p in range(8)]
    d = spark.createDataFrame(rows, "k int, p int, v double, w double")
    filled = kernels.fill_gaps(d, ["k"], "p", ["v", "w"])
    # a frame that ends at the last row is gone through again for every row
    assert "unboundedfollowing" not in filled._jdf.queryExecution().toString().lower()
    got = filled.filter("k = 1").orderBy("p").collect()
    assert [r.v for r in got] == [2.0, 2.0, 2.0, 3.0, 4.0, 5.0, 5.0, 5.0] and {r.w for r in got} == {1.0}
