import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from craquelure.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, extra string"


def brute(rows, positives=5, count=5, every=10):
    given = {}
    for i, v, label in sorted({(i, tuple(v), x) for i, v, x in rows if None not in (i, v, x) and None not in v}, key=str):
        if all(math.isfinite(x) for x in v):
            q = [math.floor(256 * x) for x in v]
            if sum(x * x for x in q) < 2**62 and (i not in given or (label, q) < given[i]):
                given[i] = (label, q)
    out = []
    for a, (label, q) in given.items():
        if a % every:
            continue
        met = [(-sum(x * y for x, y in zip(q, v)), i, x) for i, (x, v) in given.items() if i != a and len(v) == len(q)]
        met.sort(key=lambda m: m[:2])
        for score, i, _ in [m for m in met if m[2] == label][:positives]:
            found = [m for m in met if m[2] != label and 80 * -score <= 100 * -m[0] <= 100 * -score]
            out += [(a, i, n + 1, m[1], -score, -m[0]) for n, m in enumerate(found[:count])]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(4)
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 10 == 0, **options).collect()))


def vectors(seed, n=400, d=6):
    r = random.Random(seed)
    centre = [[r.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    rows = []
    for i in range(n):
        label = r.randrange(4) if r.random() < 0.6 else 1
        v = [x + r.gauss(0, 0.7) for x in centre[r.randrange(4)]]
        rows.append((i, [round(x, 1) for x in v] if seed % 2 else v, label))
    return rows


@pytest.mark.parametrize("seed, block", [(1, 8192), (2, 50), (3, 7)])
def test_equals_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", block)
    monkeypatch.setattr(negatives, "ANCHORS", max(3, block // 5))
    rows = vectors(seed)
    want = brute(rows)
    assert want and mined(spark, rows) == want


def test_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 100)
    rows = [(i, [1.0, 0.5], i % 3) for i in range(300)] + [(i, [0.9, 0.5], 7) for i in range(300, 400)]
    want = brute(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=9) == brute(rows, 2, 9)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(5, 60) + [
        (None, [1.0] * 6, 1),
        (1000, None, 1),
        (1001, [1.0] * 5 + [nan], 1),
        (1002, [1.0] * 5 + [inf], 1),
        (1003, [1.0] * 5 + [None], 1),
        (1004, [1.0] * 6, None),
        (1010, [], 1),
        (1011, [], 2),
        (1012, [], 1),
        (1020, [1e30] * 6, 1),
        (1030, [2.0] * 3, 1),
        (1031, [2.0] * 3, 1),
        (1032, [1.8] * 3, 2),
        (1040, [0.0] * 6, 3),
        (1041, [3e6] * 6, 3),
        (1042, [-3e6] * 6, 1),
        (1050, [2.8e6] * 6, 3),
        (1043, [2.9e6] * 6, 2),
    ]
    rows += [rows[3], rows[3], (rows[4][0], [9.0] * 6, 0)]
    want = brute(rows)
    got = mined(spark, rows)
    assert got == want and {1010, 1030, 1040, 1050} <= {r[0] for r in got}
    assert mined(spark, []) == [] and mined(spark, [(7, [1.0], 1)]) == [] and mined(spark, [(10, [1.0], 1)]) == []


def test_large_products_are_exact():
    r = np.random.default_rng(3)
    for most in (2**20, 2**28):
        a, b = (r.integers(-most, most, (20, 30)) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
        assert negatives.scores(a, b).tolist() == want
