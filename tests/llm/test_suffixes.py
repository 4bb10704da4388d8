import hashlib
import random

import numpy as np
import pytest

from craquelure.llm import queries, suffixes

N = suffixes.LENGTH


def brute(docs):
    """Removed spans by a dictionary of every string of 100 bytes."""
    seen, out = set(), {}
    for key, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - N + 1):
            s = raw[i : i + N]
            if s in seen:
                gone[i : i + N] = b"\1" * N
            seen.add(s)
        out[key] = (bytes(b for b, g in zip(raw, gone) if not g), bytes(gone).count(1))
    return out


def check(spark, docs, monkeypatch=None):
    rows = suffixes.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    want = brute(sorted(docs))
    assert len(rows) == len(docs)
    for r in rows:
        kept, gone = want[r.doc_id]
        assert bytes(r.kept) == kept and sum(s.end - s.start for s in r.spans) == gone
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


@pytest.mark.parametrize("partitions", [1, 13])
def test_planted_passages(spark, partitions):
    r = random.Random(partitions)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(6)]
    docs = []
    for d in range(60):
        parts = [" ".join(word() for _ in range(r.randrange(0, 80)))]
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            parts += [p[a : a + r.randrange(80, 300)], word()]
        docs.append((d, "".join(parts)))
    docs += [(100, docs[5][1]), (101, docs[5][1][:140]), (102, "é" * 400), (103, "ab" * 300), (104, "x" * 99), (105, "x" * 100)]
    docs += [(106, None), (107, ""), (108, "x" * 101)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    # many small buckets, so that groups run over their boundaries
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        check(spark, docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = brute(sorted(docs))
    rows = queries.op9_suffixes(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        kept, gone = want[r.doc_id]
        assert (r.n_removed, r.kept_sha256) == (gone, hashlib.sha256(kept).hexdigest())
    assert any(r.n_removed for r in rows)


def test_multikey_order():
    r = np.random.default_rng(1)
    a, b, c = (r.integers(0, 4, 500) for _ in range(3))
    order, group = suffixes.multikey_order(500, [lambda i: a[i], lambda i: b[i], lambda i: c[i]])
    rows = list(zip(a[order], b[order], c[order], order))
    assert rows == sorted(rows)
    assert len(set(group)) == len({x[:3] for x in rows})
    assert suffixes.multikey_order(0, [lambda i: a[i]])[0].size == 0


def test_odd_rows(odd, empty):
    rows = suffixes.dedup(odd).collect()
    assert len(rows) == odd.count()
    assert sum(r.doc_id == 4 and not r.spans for r in rows) == 2
    assert all(r.spans for r in rows if r.doc_id in (6, 7))
    assert suffixes.dedup(empty).count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_many_texts_under_one_id_keep_their_own_spans(spark, doc_id):
    r = random.Random(9)
    passage = "".join(r.choice("abcdef ") for _ in range(150))
    texts = []
    for i in range(5000):
        own = "".join(r.choice("ghijkl ") for _ in range(r.randrange(20, 160)))
        texts.append(own + passage + str(i) if i % 3 == 0 else own)
    rows = suffixes.dedup(spark.createDataFrame([(doc_id, t) for t in texts], "doc_id long, text string")).collect()
    # which of the texts comes first is settled by their hashes: all but one lose the passage, and nothing else goes
    gone = sorted(sum(s.end - s.start for s in r.spans) for r in rows)
    several = len([t for t in texts if passage in t])
    assert len(rows) == len(texts) and gone[: len(texts) - several + 1] == [0] * (len(texts) - several + 1)
    assert all(150 <= n <= 165 for n in gone[len(texts) - several + 1 :])
    assert sorted(r.n_bytes for r in rows) == sorted(len(t) for t in texts)
    assert sum(bytes(r.kept).decode() in set(texts) for r in rows) == len(texts) - several + 1
