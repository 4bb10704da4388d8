import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from craquelure.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least=10):
    """Every term of every pair, one after another, in Python's integers."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]
        groups[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        sources = sorted((s for x, s in groups if x == lang), key=str.encode)
        whole = Counter()
        for s in sources:
            whole.update(groups[lang, s])

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(groups[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s]
            tops = [(t, f(p[s][t], q[t])) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", tops)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, n, i + 1) for i, (x, n) in enumerate(found) if part == "pair" or i < 10]
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def corpus(seed, n=400, sources=9):
    r = random.Random(seed)
    words = [f"Wé{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = []
    for _ in range(n):
        lang, source = r.choice(["en", "en", "en", "de", None]), r.choice(["hot"] * 4 + [f"s{i}" for i in range(sources)])
        text = " ".join(words[int(r.paretovariate(0.6)) % (len(words) if lang == "en" else 30)] for _ in range(r.randrange(60)))
        rows.append((lang, source, r.choice([text, text.upper(), text + "1x_Y\u0000z", None if r.random() < 0.2 else text])))
    return [*rows, ("xx", "a", "alone"), ("xx", "b", ""), ("xx", None, None), ("yy", "only", "one")]


SCHEMA = "lang string, source string, text string"


@pytest.mark.parametrize("rows, columns", [(64, 256), (2, 5), (3, 1000)])
def test_equals_brute_force(spark, rows, columns):
    data = corpus(rows)
    got = divergence.audit(spark.createDataFrame(data, SCHEMA).repartition(5), rows=rows, columns=columns)
    assert rows_of(got) == brute(data)
    assert {"pair", "term"} == {x[2] for x in brute(data)}


def test_small_batches_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GATHERED", 7)
    data = corpus(5, 120)
    assert rows_of(divergence.audit(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_joint_traversal_equals_dense():
    r = np.random.default_rng(1)
    for rows_a, rows_b, columns in [(1, 1, 1), (5, 3, 40), (16, 16, 64), (7, 1, 300)]:
        dense = [r.integers(1, 9, (n, columns)) * (r.random((n, columns)) < 0.1) for n in (rows_a, rows_b)]
        levels = 5
        trees = [divergence.tree(*np.nonzero(d), d[np.nonzero(d)], levels) for d in dense]
        empty, (i, j, c, a, b) = divergence.together(*trees, (rows_a, rows_b, columns), half=False)
        none = (dense[0][:, None] == 0) & (dense[1][None] == 0)
        assert (empty == none.sum(2)).all()
        assert sorted(zip(i, j, c)) == sorted(zip(*np.nonzero(~none)))
        assert (dense[0][i, c] == a).all() and (dense[1][j, c] == b).all()
        assert len(trees[0].below) == levels and len(i) < rows_a * rows_b * columns or columns == 1


def test_shares_are_exact():
    for n, total, v in [(0, 0, 1), (10**12, 3 * 10**12, 10**9), (10**14 // 2, 9 * 10**12, 5), (7, 10**13, 10**12)]:
        got = divergence.share(np.array([n]), np.array([total]), v)[0]
        assert n > total or got == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_odd_rows(odd, empty):
    data = [(r["lang"], r.source, r.text) for r in odd.collect()]
    assert rows_of(divergence.audit(odd)) == brute(data)
    assert rows_of(divergence.audit(odd, least_docs=1)) == brute(data, 1)
    assert divergence.audit(empty).count() == 0
