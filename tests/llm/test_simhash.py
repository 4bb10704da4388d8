import random

import numpy as np
import pytest
import xxhash

from craquelure.llm import queries, simhash


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """Components by comparing every pair of (id, fingerprint)."""
    fps = np.array([f for _, f in rows], np.uint64)
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 4).tolist():
            group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted((str(d), least[find(i)]) for i, (d, _) in enumerate(rows))


def test_query_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = {r.doc_id: plain(r.text) for r in docs}
    rows = queries.op6_simhash(spark, folder).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == want and len(rows) == len(docs)
    assert all(len(r.fingerprint) == 16 for r in rows)
    assert sorted((str(r.doc_id), r.component_id) for r in rows) == brute(list(want.items()))
    assert len({r.component_id for r in rows}) < len(rows)


def chains(seed, n=1500):
    """Random points, chains of small steps and dense balls."""
    r = random.Random(seed)
    points = [r.getrandbits(64) for _ in range(n)]
    for _ in range(30):
        x = r.getrandbits(64)
        for _ in range(r.randrange(2, 30)):
            for _ in range(r.randrange(1, 6)):
                x ^= 1 << r.randrange(64)
            points.append(x)
    centre = r.getrandbits(64)
    points += [centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(400)]
    return sorted(set(points))


@pytest.mark.parametrize("shard", [64, 100_000])
def test_links_keep_every_component(spark, shard, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", shard)
    points = np.array(chains(shard), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    found = {r.fp: r.root for r in simhash.components(simhash.links(df)).collect()}
    got = {}
    for x in points.view(np.int64).tolist():
        got.setdefault(found.get(x, x), set()).add(x)
    want = {}
    for (name, root) in brute([(int(x), int(x)) for x in points]):
        want.setdefault(root, set()).add(int(np.uint64(int(name)).view(np.int64)))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_tree_keeps_pairs_together():
    points = np.array(chains(9), np.uint64)
    tree = simhash.grow(points, 6)
    shard, row = tree.shards(points)
    together = set()
    for s in np.unique(shard):
        rows = row[shard == s]
        together |= {(int(a), int(b)) for a in rows for b in rows if a < b}
    for i in range(0, len(points), 7):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 4):
            assert i == j or (min(i, j), max(i, j)) in together


def test_odd_rows(odd, empty, spark):
    rows = simhash.groups(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.fp, r.component_id) for r in rows if r.doc_id in (1, 2, 3)} == {(0, 1)}
    assert sorted((str(r.doc_id), r.component_id) for r in rows) == brute(
        [(r.doc_id, np.uint64(plain(r.text))) for r in odd.collect()]
    )
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "7", "None"]
    assert simhash.groups(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
    nameless = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "quite another text")], "doc_id long, text string")
    assert [r.component_id for r in simhash.groups(nameless).collect()] == [None] * 3
    assert simhash.one_of_each(nameless).count() == 2


def test_clashing_columns(spark):
    rows = [(1, "one text", 1, 2, 3), (2, "one text", 1, 2, 3), (3, "quite another one here", 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _hash int, _rows int")
    out = simhash.one_of_each(df)
    assert out.columns == df.columns and sorted(x.doc_id for x in out.collect()) == [1, 3]
