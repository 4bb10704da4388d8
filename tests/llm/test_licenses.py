import random
import re

from craquelure.llm import licenses, queries


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places = [
        (i, label)
        for phrase, label in licenses.PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    return len(words), places


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op5_licenses(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, places = brute(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(places))
        assert r.first_word == min((p[0] for p in places), default=None)
        assert r.last_word == max((p[0] for p in places), default=None)
        base = {p[1] for p in places}
        assert r.base_labels == ",".join(sorted(base))
        assert base <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert any("gpl-3" in r.labels for r in rows) and sum(r.labels != "" for r in rows) < len(rows) / 4


def test_index_aligns_a_changed_notice():
    index = licenses.Index({b"the": 90, b"software": 5}, 100)
    notice = (
        "x Permission is hereby granted, free of charge, to any person obtaining ONE copy of this software and "
        "associated documentation files, to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
    )
    found = index.scan(licenses.words(notice))
    assert [(f[0], f[1]) for f in found] == [("mit", 1)]
    assert index.scan(licenses.words("permission " * 500 + "software")) == []


def test_index_finds_every_alignment_that_agrees():
    """Against all alignments, with the rarest words changed first and with words changed anywhere."""
    r = random.Random(3)
    counts = {w: r.randrange(1, 100) for w in sorted(licenses._template_words())}
    index = licenses.Index(counts, 100)

    def every(text):
        found = []
        for t, (label, template) in enumerate(index.templates):
            for start in range(-len(template), len(text)):
                here = text[max(0, start) : max(0, start + len(template))]
                pairs = [(start + i, w) for i, w in enumerate(template) if 0 <= start + i < len(text)]
                share = sum(text[i] == w for i, w in pairs) / len(template)
                if share >= licenses.AGREE and all(licenses._inside(here, p) for p in index.mandatory[t]):
                    found.append((label, max(0, start), min(start + len(template), len(text)), share))
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))

    hits = 0
    for _ in range(3):
        for t, (_, template) in enumerate(index.templates):
            fixed = {w for p in index.mandatory[t] for w in p}
            free = [i for i, w in enumerate(template) if w not in fixed]
            for changed in (sorted(free, key=lambda i: counts[template[i]]), r.sample(free, len(free))):
                text = list(template)
                for i in changed[: len(template) // 4]:
                    text[i] = b"other"
                text = [b"x", b"the", *text, b"of", b"y"]
                assert index.scan(text) == every(text)
                hits += bool(every(text))
    assert hits > 60


def test_overlapping_and_adjacent_phrases():
    w = licenses.words("cc-by-nc cc by nc. Under the MIT License under the mit license")
    assert sorted(licenses.phrase_places(w)) == [(0, "cc-by-nc"), (3, "cc-by-nc"), (6, "mit"), (10, "mit")]


def test_odd_rows(odd, empty):
    assert licenses.document_frequencies(empty) == ({}, 0)
    index = licenses.Index(*licenses.document_frequencies(odd))
    rows = licenses.scan(odd, index).collect()
    assert len(rows) == odd.count()
    assert all(r.places == [] for r in rows)
    assert licenses.scan(empty, index).count() == 0
