import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from craquelure.llm import queries, toxicity

D = toxicity.DISCOUNT


def brute_ratios(toxic, plain):
    """The definition, gram by gram."""
    counts = {}
    for kind, texts in (("t", toxic), ("p", plain)):
        counts[kind] = Counter()
        for text in texts:
            raw = b" " * 6 + toxicity.normal(text) + b" " * 6
            for i in range(5, len(raw)):
                if raw[i] != 32 or raw[i - 1] != 32:
                    counts[kind][raw[i - 5 : i + 1]] += 1
    level = {6: set(counts["t"]) | set(counts["p"])}
    kinds = {}
    below = {5: 3, 3: 1}
    for above, n in ((6, 5), (5, 3), (3, 1)):
        kinds[n] = Counter(g[-n:] for g in level[above])
        level[n] = set(kinds[n])

    def shared(g):
        n = len(g)
        if n == 1:
            return kinds[1][g] * 0.99 / sum(kinds[1].values()) + 0.01 / 256
        same = [c for h, c in kinds[n].items() if h[:-1] == g[:-1]]
        return (max(kinds[n][g] - D, 0) + D * len(same) * shared(g[-below[n] :])) / sum(same)

    contexts = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            contexts[k][g[:-1]].append(n)

    def likelihood(k, g):
        here = contexts[k].get(g[:-1])
        if not here:
            return shared(g[1:])
        return (max(counts[k][g] - D, 0) + D * len(here) * shared(g[1:])) / sum(here)

    def ratio(g):
        """Of any n-gram, counted or not; where no shared level knows its end any share will do."""
        if g in level[6]:
            return math.log(likelihood("t", g) / likelihood("p", g))
        held = {k: D * len(c[g[:-1]]) / sum(c[g[:-1]]) if g[:-1] in c else 1 for k, c in contexts.items()}
        return math.log(held["t"] / held["p"])

    return level[6], ratio


TOXIC = ["you stupid idiot", "what an Idiot!", "scum and so on", "you stupid fool"]
PLAIN = ["you and so on", "what a nice day", "an ordinary idea, stupendous", ""]


def table_of(spark):
    rows = [(t, 1, 1) for t in TOXIC] + [(t, 0, 1) for t in PLAIN]
    return toxicity.ratios(toxicity.count(spark.createDataFrame(rows, "text string, toxic int, fold long")))


def test_ratios_equal_their_definition(spark):
    got = {r.gram: r.ratio for r in table_of(spark).collect()}
    counted, ratio = brute_ratios(TOXIC, PLAIN)
    want = {int.from_bytes(g, "big"): ratio(g) for g in counted}
    # a byte that no counted n-gram ends in
    want |= {toxicity._IS_CONTEXT | int.from_bytes(g[:-1], "big"): ratio(g[:-1] + b"\xff") for g in counted}
    assert got.keys() == want.keys()
    assert max(abs(got[g] - want[g]) for g in want) < 1e-9


def test_scores_equal_their_definition(spark):
    """Mean and windows byte by byte, with n-grams and contexts that training never saw."""
    held = table_of(spark).toArrow()
    table = toxicity.Ratios.of(held.column("gram").to_numpy(), held.column("ratio").to_numpy())
    model = toxicity.Model(table, np.array([-1.0, 2.0, 1.5, 3.0, 1.0, 0.5]))
    counted, ratio = brute_ratios(TOXIC, PLAIN)
    texts = ["you stupix idiom", "  what  an idea", "zzz", "", "stupid! stupid? 12 idiocy", "you stupid idiot"]
    evidence, scores = model.evidence(texts), model.score(texts)
    for text, got, score in zip(texts, evidence, scores):
        inside = toxicity.normal(text)
        raw = b" " * 12 + inside + b" " * 12
        at = [
            ratio(raw[i - 5 : i + 1]) if i >= 6 and (raw[i] != 32 or raw[i - 1] != 32) else 0.0 for i in range(len(raw))
        ]
        # windows look at counted n-grams alone
        seen = [x if i >= 5 and raw[i - 5 : i + 1] in counted else 0.0 for i, x in enumerate(at)]
        letters = sum(b != 32 for b in raw)
        means = [sum(x[12 : 12 + len(inside)]) / max(1, letters) for x in (seen, [a - b for a, b in zip(at, seen)])]
        words = [i for i in range(12, 12 + len(inside)) if raw[i] != 32 and raw[i - 1] == 32]
        windows = sorted((max(0.0, sum(seen[i : i + 12]) / 12) for i in words), reverse=True)[:3]
        want = [*means, *windows, *[0.0] * (3 - len(windows))]
        assert got == pytest.approx(want, abs=1e-5)
        z = -1 + float(np.dot([2.0, 1.5, 3.0, 1.0, 0.5], want))
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)
    # the changed letter alone: its context stood in toxic texts only
    assert ratio(b"stupix") != 0


def test_held_out_accuracy(spark, folder):
    rows = queries.op7_toxicity(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    marked = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    # a tenth of these labels is noise, so the bound is low
    tested = [(r.score, marked[r.doc_id]) for r in rows if r.held_out and r.doc_id in marked]
    good = [s for s, y in tested if y == 0]
    bad = [s for s, y in tested if y == 1]
    assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) > 0.75


@pytest.fixture(scope="module")
def model(spark):
    docs = [(i, "you stupid idiot, go away number %d" % i if i % 3 == 0 else "a quiet day by the sea number %d" % i) for i in range(240)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 as quality", "if(doc_id % 3 = 0, 1, 0) as toxic")
    return toxicity.fit(docs, labels.unionByName(labels.limit(3)))


def test_odd_rows(model, odd, empty, spark):
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count()
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert model.score(["you stupid idiot, go away"])[0] > 0.5 > model.score([""])[0]
    assert toxicity.score(empty, model).count() == 0
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(odd, labels) is None and toxicity.fit(empty, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}


def test_long_texts_keep_their_evidence(model):
    quiet = "a quiet day by the sea " * 4000
    assert model.score([quiet + " stupid idiot " + quiet])[0] > 2 * model.score([quiet])[0]


def test_every_n_gram_keeps_its_ratio():
    # many times more n-grams than slots of a bounded table would hold apart
    grams = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 1_000_000).astype(np.uint64))
    ratio = np.arange(len(grams), dtype=np.float32) + 1
    table = toxicity.Ratios.of(grams.astype(np.int64), ratio)
    assert (table(grams) == ratio).all()
    strange = np.setdiff1d(grams + np.uint64(1), grams)
    assert not table(strange).any()
    assert not toxicity.Ratios.of(grams[:0].astype(np.int64), ratio[:0])(grams).any()


def test_joined_ratios_score_as_sent_ones(spark, folder, odd, monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 1 << 18)
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    sent = toxicity.fit(docs, labels)
    joined = toxicity.fit(docs, labels, most=1000)
    assert isinstance(sent, toxicity.Model) and isinstance(joined, toxicity.Joined)
    assert np.allclose(sent.weights, joined.weights)
    want = {r.doc_id: r.score for r in toxicity.score(docs, sent).collect()}
    got = {r.doc_id: r.score for r in toxicity.score(docs, joined).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6
    below = toxicity.keep_below(docs, joined)
    assert below.schema == docs.schema
    assert sorted(r.doc_id for r in below.collect()) == sorted(i for i, s in want.items() if s < 0.5)
    assert toxicity.score(odd, joined).count() == odd.count() == toxicity.keep_below(odd, joined, 2.0).count()
    assert toxicity.score(odd.limit(0), joined).count() == 0


def test_a_score_does_not_depend_on_the_next_text(model):
    alone = model.score(["go away, a"])[0]
    assert model.score(["go away, a", "stupid idiot"])[0] == pytest.approx(alone, abs=1e-12)


def test_the_fit_leaves_the_driver_little_more_than_the_model(spark, monkeypatch):
    import pyarrow as pa

    rows = 1 << 18
    pool = pa.default_memory_pool()
    before = pool.bytes_allocated()
    table = spark.range(rows).selectExpr(
        "id * 7919 as gram", "cast(id % 97 as float) as ratio", "cast(if(id % 3 = 0, null, id % 89) as float) as early"
    )
    held = toxicity._fetched(table)
    assert pool.bytes_allocated() - before < 1 << 20
    assert {n: (len(a), a.dtype.name) for n, a in held.items()} == {
        "gram": (rows, "int64"), "ratio": (rows, "float32"), "early": (rows, "float32")
    }
    by_gram = np.argsort(held["gram"])
    number = np.arange(rows)
    assert (held["gram"][by_gram] == number * 7919).all() and (held["ratio"][by_gram] == number % 97).all()
    early = held["early"][by_gram]
    assert (np.isnan(early) == (number % 3 == 0)).all() and (early[number % 3 > 0] == (number % 89)[number % 3 > 0]).all()


def test_sent_ratios_take_little_more_than_themselves_to_build():
    import tracemalloc

    rows = 1 << 18
    grams, ratio = np.arange(rows) * 7919, (np.arange(rows) % 97).astype(np.float32)
    tracemalloc.start()
    found = toxicity.Ratios.of(grams, ratio)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found(grams.astype(np.uint64)) == ratio).all()
    assert most < 48 * rows
