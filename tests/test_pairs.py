import math
import random

import pytest

from craquelure.operators import neighbours


def panes(seed):
    """Scattered points on either side of zero, a dense heap, copies of one place, and rows that have no pair."""
    r = random.Random(seed)
    rows = [(p, f"{p}-{i}", r.uniform(-60, 90), r.uniform(-60, 90)) for p in (1, 2) for i in range(250)]
    rows += [(2, f"heap-{i}", r.gauss(10, 0.5), r.gauss(10, 0.5)) for i in range(80)]
    rows += [(3, f"same-{i}", 5.0, 5.0) for i in range(20)] + [(3, f"edge-{i}", 2.0 * i, 0.0) for i in range(40)]
    odd = [(None, "no pane", 1.0, 1.0), (1, "no x", None, 1.0), (1, "no y", 1.0, None)]
    return rows, odd + [(1, "not a number", math.nan, 1.0), (1, "far", math.inf, 1.0), (4, "alone", 1.0, 1.0)]


def brute(rows, d_max):
    found = set()
    for p, a, xa, ya in rows:
        for q, b, xb, yb in rows:
            dx, dy = xa - xb, ya - yb
            if p == q and a < b and math.sqrt(dx * dx + dy * dy) <= d_max:
                found.add((p, a, b, math.sqrt(dx * dx + dy * dy)))
    return found


@pytest.mark.parametrize("bits", [0, 1, 4])
@pytest.mark.parametrize("at_once", [7, 1 << 20])
def test_pairs_equal_brute_force(spark, monkeypatch, bits, at_once):
    monkeypatch.setattr(neighbours, "PAIR_BLOCK_BITS", bits)
    monkeypatch.setattr(neighbours, "PAIRS_AT_ONCE", at_once)
    rows, odd = panes(bits)
    df = spark.createDataFrame(rows + odd, "pane int, name string, x double, y double")
    got = neighbours.pairs_within(df, ["pane"], "name", 2.0, "x", "y").collect()
    assert {(r.pane, r.id_a, r.id_b, r.dist) for r in got} == brute(rows, 2.0)
    assert len(got) == len(brute(rows, 2.0)) > 3000


def test_missing_and_repeated_names(spark):
    rows = [(1, None, 0.1, 0.1), (1, "a", 0.2, 0.2), (1, "a", 0.3, 0.3)]
    df = spark.createDataFrame(rows, "pane int, name string, x double, y double")
    got = neighbours.pairs_within(df, ["pane"], "name", 2.0, "x", "y").collect()
    assert [(r.id_a, r.id_b) for r in got] == [("a", "a")] * 2
    assert neighbours.pairs_within(df.limit(0), ["pane"], "name", 2.0, "x", "y").count() == 0


def test_a_point_is_not_shuffled_for_each_cell(spark):
    """One exchange, and about a fifth more rows than points where a pane has many blocks."""
    df = spark.range(20_000).selectExpr("1 as pane", "cast(id as string) as name", "rand(1)*2000 as x", "rand(2)*2000 as y")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = neighbours.pairs_within(df, ["pane"], "name", 2.0, "x", "y")
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    copies = neighbours._in_blocks(df, 2.0, "x", "y", neighbours.PAIR_BLOCK_BITS).count()
    assert copies < 1.25 * 20_000


def test_points_on_cell_borders(spark):
    """A lattice of 7.5 mm, so that every point lies on the border of a cell and many on that of a block."""
    rows = [(1, f"{i:03}-{j:03}", 7.5 * i, 7.5 * j) for i in range(-18, 18) for j in range(-3, 18)]
    df = spark.createDataFrame(rows, "pane int, name string, x double, y double")
    found = neighbours.pairs_within(df, ["pane"], "name", 7.5, "x", "y")
    got = {(r.id_a, r.id_b, r.dist) for r in found.collect()}
    assert len(got) == found.count() == 35 * 21 + 36 * 20 and {d for _, _, d in got} == {7.5}
