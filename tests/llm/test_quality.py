import re
from collections import Counter

import numpy as np

from craquelure.llm import quality, queries


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)]


def test_query_equals_brute_force_and_keeps_good_rows(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op3_quality(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    fine = [r.kept for r in rows if good.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in rows if good.get(r.doc_id) == 0]
    assert np.mean(fine) > 0.98 and np.mean(bad) < 0.4


def test_many_different_words_stay_exact():
    words = [b"%d" % i for i in range(20_000)]
    assert quality.repeated_words(words) == 0
    assert quality.repeated_words(words + words[10:15]) == 10
    assert quality.repeated_words([b"a"] * 6) == 6
    assert quality.repeated_words([b"a"] * 5) == 0


def test_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(odd, labels) is None
    rows = quality.judge(odd, None).collect()
    assert len(rows) == odd.count()
    assert all(r.kept == (not r.base_failed) for r in rows)
    assert {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert quality.judge(empty, None).count() == 0
    assert quality.fit(empty, labels.limit(0)) is None


def test_bad_rows_beyond_the_base_rule_are_rejected(spark):
    folder = "/root/testdata/sf0.1"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.judge(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), quality.fit(docs, labels)).collect()
    left = [(label[r.doc_id], r.kept) for r in rows if not r.base_failed]
    bad, fine = [k for y, k in left if y == 0], [k for y, k in left if y == 1]
    print(len(bad), 1 - np.mean(bad), len(fine), 1 - np.mean(fine))
    assert len(bad) > 200 and np.mean(bad) < 0.05 and np.mean(fine) > 0.97


def test_cut_weighs_both_labels():
    good = np.array([True] * 1000 + [False] * 100)
    scores = np.concatenate([np.linspace(0.3, 0.5, 990), np.linspace(0.8, 0.9, 10), np.full(100, 0.6)])
    assert 0.5 < quality.best_cut(scores, good) < 0.6
    assert quality.best_cut(scores[:1000], good[:1000]) == 0.9


def test_the_forest_does_not_depend_on_the_order_of_rows(spark):
    folder = "/root/testdata/sf0.01"
    # ids that several texts share, and labels that contradict each other
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id div 3 as doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id div 3 as doc_id", "quality")
    one = quality.fit(docs.coalesce(1), labels.coalesce(1))
    other = quality.fit(docs.repartition(7).orderBy("text"), labels.orderBy("quality", ascending=False))
    assert one.threshold == other.threshold
    assert (one.cut == other.cut).all() and (one.feature == other.feature).all()


def test_every_labelled_row_counts(spark):
    # more labelled rows than a bounded sample held; the few bad ones come last by the hash that chose it
    n, words = 12_000, "plain words that say what they mean and end here now".split()
    ids = spark.range(n).selectExpr("id", "row_number() over (order by xxhash64(id), id) as place").collect()
    bad = {r.id for r in ids if r.place > n - 200}
    rows = [(i, " ".join(words[:9] + [str(i % 97), "again" * (1 + i % 3)]) + (" ### $$$ &&&" if i in bad else "")) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in range(n)], "doc_id long, quality int")
    forest = quality.fit(docs, labels)
    assert forest is not None
    assert {r.doc_id for r in quality.judge(docs, forest).filter("not kept").collect()} == bad
    # labels that are too many for every task: the same forest
    other = quality.fit(docs, labels, sent=0)
    assert other.threshold == forest.threshold
    assert (other.cut == forest.cut).all() and (other.length == forest.length).all()


def test_bearing_and_ranges_equal_the_plain_computation(spark):
    random = np.random.default_rng(5)
    x = np.round(random.random((300, quality.FEATURES)), 2)
    good = random.random(300) < 0.7
    x[~good, 0] += 0.5
    rows = spark.createDataFrame(
        [(i * 7919, int(g), [float(v) for v in r]) for i, (r, g) in enumerate(zip(x, good))],
        "mark long, quality int, ratios array<double>",
    ).repartition(5)
    below = (x[good][None] < x[~good][:, None]).sum((0, 1)) + (x[good][None] <= x[~good][:, None]).sum((0, 1))
    want = np.maximum(np.abs(below / (good.sum() * (~good).sum()) - 1), quality.LEAST_WEIGHT)
    weight = quality.bearing(rows)
    assert np.allclose(weight, want)
    forest = quality.grow(rows, 300, weight, trees=4, subsample=300)
    # every row is in every tree: leaves and cuts follow from the rows alone
    for t in range(4):
        stack = [(0, 0, x)]
        while stack:
            node, level, part = stack.pop()
            f = forest.feature[t, node]
            if f < 0:
                assert len(part) and np.isclose(forest.length[t, node], level + quality._unfinished(len(part)))
                continue
            right = part[:, f] > forest.cut[t, node]
            assert right.any() and not right.all()
            stack += [(2 * node + 1, level + 1, part[~right]), (2 * node + 2, level + 1, part[right])]
