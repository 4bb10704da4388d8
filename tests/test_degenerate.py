"""Answers that the given tables do not show: wide and crowded panes, constant, empty and single keys."""

import random

import pytest
from pyspark.sql import functions as F

from craquelure.operators import catalog, distributions, metrics, neighbours, panes, signals


def nearest_brute(points, k):
    out = set()
    for key, i, x, y in points:
        near = sorted((((x - b) ** 2 + (y - c) ** 2) ** 0.5, j) for q, j, b, c in points if q == key)[:k]
        out |= {(key, i, r, j) for r, (_, j) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("k, tile", [(1, 4096), (5, 4096), (40, 4096), (1, 8), (5, 20), (40, 70)])
def test_nearest_on_wide_and_crowded_panes(spark, k, tile):
    r = random.Random(k)
    points = [("wide", i, float(x), 0.0) for i, x in enumerate([0, 100, 500, 1100, 1600, 2600])]
    points += [("one", 0, 7.0, 7.0)]
    points += [("piles", i, float(i % 3), 5.0) for i in range(60)]
    points += [("crowd", i, 1300 + 10 * r.random(), 40 + 10 * r.random()) for i in range(500)]
    points += [("crowd", 500 + i, 2600 * r.random(), 2600 * r.random()) for i in range(60)]
    points += [("even", i, 500 * r.random(), 500 * r.random()) for i in range(300)]
    df = spark.createDataFrame(points, "key string, id int, x_mm double, y_mm double")
    got = {(r.key, r.id, r.rank, r.neighbour) for r in neighbours.nearest(df, ["key"], "id", k, tile_points=tile).collect()}
    assert got == nearest_brute(points, k)


@pytest.mark.parametrize("tile", [4096, 20])
def test_totals_of_nearest_equal_the_pairs(spark, tile):
    r = random.Random(3)
    points = [("piles", i, float(i % 3), 5.0) for i in range(60)] + [("one", 0, 7.0, 7.0), ("one", 1, None, 7.0)]
    points += [("even", i, float(r.randrange(50)), float(r.randrange(50))) for i in range(300)]
    points += [("twice", 1, 3.0, 4.0), ("twice", 1, 0.0, 0.0), (None, 1, 1.0, 1.0)]
    df = spark.createDataFrame(points, "key string, id int, x_mm double, y_mm double")
    pairs = neighbours.nearest(df, ["key"], "id", 7, tile_points=tile)
    want = pairs.groupBy("key", "id").agg(F.count("rank").alias("n"), F.max("dist").alias("far"), F.sum("dist").alias("total"))
    totals = neighbours.nearest_totals(df, ["key"], "id", 7, tile_points=tile)
    got = totals.groupBy("key", "id").agg(F.sum("n").alias("n"), F.max("farthest").alias("far"), F.sum("total").alias("total"))
    rows = lambda d: sorted((r.key, r.id, r.n, round(r.far, 9), round(r.total, 6)) for r in d.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 362


def test_panes_share_a_call_and_their_pairs_are_added_up_there(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0)], "key int, id int, x_mm double, y_mm double")
    plan = neighbours.nearest_totals(df, ["key"], "id", 3)._jdf.queryExecution().optimizedPlan().toString()
    small = plan.split("\n")
    # panes of one tile go many at a time, and a point comes back as one row
    assert any("MapInArrow" in line and "farthest" in line for line in small)


@pytest.fixture
def values(spark):
    rows = [("same", 3.0)] * 5 + [("zero", 0.0)] * 3 + [("one", 2.0)] + [("fine", float(v)) for v in (1, 2, 2, 3, 9)]
    return spark.createDataFrame(rows, "key string, v double")


def by_key(df):
    return {r.key: r for r in df.collect()}


def test_density_of_equal_values_is_missing(values):
    got = by_key(distributions.mode(values, ["key"], "v", 50))
    assert got["same"].mode is None and got["one"].mode is None and got["zero"].probability is None
    assert 1 < got["fine"].mode < 4
    assert distributions.kde(values.limit(0), ["key"], "v", 50).count() == 0


def test_share_of_nothing_is_missing(values):
    got = distributions.share_curve(values, ["key"], "v").collect()
    assert {r.share for r in got if r.key == "zero"} == {None}
    assert max(r.share for r in got if r.key == "fine") == pytest.approx(1.0)


def test_two_samples_of_which_one_is_empty(values):
    both = values.withColumn("s", F.when((F.col("key") == "fine") & (F.col("v") > 2), 1).otherwise(0))
    got = by_key(metrics.ks(both, ["key"], "v", "s"))
    assert got["same"].d is None and got["same"].p is None
    assert got["fine"].d == 1.0


def test_resampling_without_extent(spark):
    rows = [("flat", float(i), 1.0, 2.0) for i in range(4)] + [("dot", 1.0, 1.0, 2.0)]
    rows += [("fine", float(i % 5), float(i // 5), 1.0) for i in range(25)]
    df = spark.createDataFrame(rows, "key string, x double, y double, z double")
    got = panes.resample(df, ["key"], 3, 3).collect()
    assert any(r.key == "fine" and r.value == 1.0 for r in got)
    assert all(r.value is None for r in got if r.key in ("flat", "dot"))


def test_catalog_scan_has_no_cap(spark):
    names = spark.range(1500).selectExpr("id as specimen_id", "concat('n', id) as name")
    assert catalog.scan(names).count() == 1500 and catalog.scan(names, max_n=7).count() == 7


def test_tip_is_the_first_pixel_in_image_order(spark):
    rows = [(1, 0, 5.0, 1.0), (1, 0, 2.0, 3.0), (1, 1, 9.0, 4.0), (1, 1, 8.0, 4.0)]
    tips = spark.createDataFrame(rows, "crack_id int, frame int, x_mm double, y_mm double")
    got = {r.frame: (r.x_mm, r.y_mm) for r in signals.track(tips, turning="plain").collect()}
    assert got == {0: (5.0, 1.0), 1: (8.0, 4.0)}


def contour_array(rings):
    import pyarrow as pa

    point = pa.struct([("px", pa.int32()), ("py", pa.int32())])
    return pa.array([[{"px": x, "py": y} for x, y in ring] for ring in rings], pa.list_(point))


def test_long_and_short_contours_have_the_same_hull():
    from craquelure.functions import geometry

    r = random.Random(4)
    rings = [[(r.randrange(60), r.randrange(60)) for _ in range(n)] for n in (1, 2, 3, 8, 40, 64)]
    # the same outlines with so many repeated points that the other way is taken
    longer = [ring + [r.choice(ring) for _ in range(200)] for ring in rings]
    short, long = (geometry.hull_box(contour_array(x)).to_pylist() for x in (rings, longer))
    for a, b in zip(short, long):
        assert a["hull"] == pytest.approx(b["hull"])
        if a["hull"] > 0:
            assert a["la"] * a["lb"] == pytest.approx(b["la"] * b["lb"])


def test_one_long_contour_costs_the_others_nothing():
    import math
    import time

    from craquelure.functions import geometry

    octagons = [[(10, 0), (17, 3), (20, 10), (17, 17), (10, 20), (3, 17), (0, 10), (3, 3)]] * 3000
    ring = [(int(9000 * math.cos(k / 800)), int(9000 * math.sin(k / 800))) for k in range(5000)]
    alone, both = contour_array(octagons), contour_array([*octagons, ring])
    geometry.hull_box(alone)
    start = time.perf_counter()
    geometry.hull_box(alone)
    first = time.perf_counter() - start
    start = time.perf_counter()
    geometry.hull_box(both)
    assert time.perf_counter() - start < 2 * first + 0.5
