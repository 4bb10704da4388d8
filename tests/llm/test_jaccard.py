import random

import numpy as np
import pytest

from craquelure.llm import jaccard

SCHEMA = "doc_id long, text string"


def plain(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} or ({tuple(words)} if words else set())


def brute(rows):
    """Sizes and components by comparing every pair of (id, text)."""
    sets = [plain(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 85 * (len(a) + len(sets[j]) - common):
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted((str(d), len(sets[i]), str(least[find(i)])) for i, (d, _) in enumerate(rows))


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.groups(df).collect())


def corpus(seed, families=25):
    """Chains of edits on both sides of the bound, a common passage, tiny texts and copies."""
    r = random.Random(seed)
    word = lambda: f"{r.choice('aäBC')}{r.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(families):
        words = [word() for _ in range(r.choice([2, 5, 8, 9, 12, 20, 60, 60, 200, 900]))]
        for _ in range(r.randrange(1, 8)):
            words = list(words)
            for _ in range(r.randrange(1 + max(1, len(words) // 30))):
                k = r.randrange(len(words))
                words[k : k + r.randrange(2)] = [word()] if r.random() < 0.7 else []
            if words:
                texts.append(" ".join(words))
    for _ in range(40):
        texts.append(" ".join(passage + [word() for _ in range(r.choice([2, 4, 30, 60]))]))
    texts += [r.choice(texts) + r.choice(["", " \t", "\n"]) for _ in range(20)] + [texts[0].upper()]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, block, chunk", [(1, 2048, 256), (2, 3, 2), (3, 1, 1)])
def test_equals_brute_force(spark, seed, block, chunk, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = corpus(seed)
    want = brute(rows)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(6)) == want
    assert 50 < len({c for _, _, c in want}) < len(rows) - 30


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SENT", 0)
    rows = corpus(4)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(6)) == brute(rows)


def near_pairs(seed, n):
    """Sets that differ in as many hashes as a link allows, all taken out, all put in or exchanged."""
    r = np.random.default_rng(seed)
    for _ in range(n):
        size = int(r.choice([6, 7, 8, 9, 13, 14, 20, 50, 51, 300, 1000]))
        u = r.integers(0, 2**64, 2 * size, np.uint64)
        for less, more in [(1, 0), (0, 1), (1, 1)]:
            changed = (u[less * i : size + more * i] for i in range(size))
            yield np.sort(u[:size]), [np.sort(c) for c in changed if jaccard.linked(u[:size], c)][-1]


def test_linked_sets_share_a_part_and_near_sketches():
    n = 0
    for a, b in near_pairs(5, 150):
        assert jaccard.linked(a, b)
        if len(np.union1d(a, b)) == len(np.intersect1d(a, b)):
            continue
        n += 1
        assert np.intersect1d(jaccard.part_keys(a), jaccard.part_keys(b)).size
        x, y = jaccard.sketch(a), jaccard.sketch(b)
        words = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(v.reshape(-1, words), axis=0) for v in (x, y))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b)) <= jaccard.differing(len(a) + len(b))
    assert n > 100


def test_layouts_hold_every_partner():
    for n in range(1, 3000):
        for partner in range(n, n * 100 // 85 + 1):
            if jaccard.differing(n + partner):
                both = set(jaccard.layouts(n)) & set(jaccard.layouts(partner))
                assert any(parts > jaccard.differing(n + partner) + spare for _, parts, spare in both), (n, partner)


def test_odd_rows(odd, empty, spark):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd) == brute(rows)
    assert found(empty) == []
    rows = [(None, "a b c d e"), (None, "A b c d e"), (None, ""), (5, "a b c d e"), (4, None), (4, None), (5, "other words")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_forest_joins_what_the_edges_join():
    r = np.random.default_rng(2)
    for edges in (0, 1, 5, 60, 400):
        a, b = r.integers(0, 60, edges) * 10, r.integers(0, 60, edges) * 10
        a, b = a[a != b], b[a != b]
        far = r.random(len(a))
        kept = jaccard._joining(a, b, far)

        def parts(some):
            root = {int(x): int(x) for x in np.unique(np.concatenate([a, b]))}
            for x, y in zip(a[some].tolist(), b[some].tolist()):
                x, y = root[x], root[y]
                root = {k: y if v == x else v for k, v in root.items()}
            return {k: min(q for q in root if root[q] == v) for k, v in root.items()}

        every = parts(np.arange(len(a)))
        assert parts(kept) == every and len(kept) == len(every) - len(set(every.values()))
