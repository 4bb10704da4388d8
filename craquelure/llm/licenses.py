"""License scans by a positional index of rare licence words.

The index holds, for every template, its words of highest inverse document frequency with
their positions; frequencies are counted over all documents. A text looks up the words it
shares with the index, postings of one template that agree on the relative position vote
for an alignment, and an alignment counts when the template's mandatory phrases stand
there and a share of at least ``AGREE`` of its words agrees. So many places are indexed that
an alignment which agrees that well has ``VOTES`` of them, wherever it differs.

Words are runs of ASCII digits, lower-cased ASCII letters and non-ASCII characters.
Defined results: a missing or empty text has no words, no labels and score 0; a missing
``doc_id`` is kept; repeated rows are scanned alike, once each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craquelure.llm.common import by_batch, with_text

# fixed values: phrases that name a licence wherever they stand
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# fixed values: (label, words of a public licence notice, phrases that must be in it)
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files to deal in the software without restriction including without limitation the rights to "
        "use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted", "without restriction"),
    ),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license",)),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license you may obtain a copy of the license at",
        ("apache license", "except in compliance"),
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("by nc",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international", ("attribution noncommercial",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("by sa",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        ("gnu general public license", "free software foundation"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        ("source and binary forms", "conditions are met"),
    ),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
)
VOTES = 2
AGREE = 0.75
_KEEP = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str) -> list[bytes]:
    # bytes.lower changes A-Z only; every byte of a non-ASCII character stays in the word
    return text.encode("utf-8", "surrogatepass").lower().translate(_KEEP).split()


def _template_words() -> set[bytes]:
    return {w.encode() for _, text, _ in TEMPLATES for w in text.split()}


def document_frequencies(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word occurs, and the number of documents.

    The result is bounded by the templates' vocabulary.
    """
    vocabulary = _template_words()

    def run(batch: pa.RecordBatch) -> dict:
        found = Counter()
        for text in batch.column("text").to_pylist():
            found.update(vocabulary.intersection(words(text)))
        rows = [("", batch.num_rows), *((w.decode(), n) for w, n in found.items())]
        return {"word": [r[0] for r in rows], "n": pa.array([r[1] for r in rows], pa.int64())}

    rows = by_batch(with_text(docs), "word string, n bigint", run).groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r.word.encode(): r.n for r in rows}
    total = counts.pop(b"", 0)
    return counts, total


class Index:
    """Postings of the rarest words of every template."""

    def __init__(self, frequencies: dict[bytes, int], total: int, votes: int = VOTES):
        def idf(word: bytes) -> float:
            return math.log((total + 1) / (frequencies.get(word, 0) + 1))

        self.templates = [(label, [w.encode() for w in text.split()]) for label, text, _ in TEMPLATES]
        self.mandatory = [[p.encode().split() for p in phrases] for _, _, phrases in TEMPLATES]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for t, (_, template) in enumerate(self.templates):
            differing = len(template) - math.ceil(AGREE * len(template))
            places = []
            for w in sorted(set(template), key=lambda w: (-idf(w), w)):
                if len(places) >= differing + votes:
                    break
                places += [i for i, own in enumerate(template) if own == w]
                self.postings[w] += [(t, i) for i, own in enumerate(template) if own == w]
            self.needed.append(len(places) - differing)
        self.keys = frozenset(self.postings)

    def scan(self, text_words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, share of agreeing words) of every accepted alignment."""
        if self.keys.isdisjoint(text_words):
            return []
        votes = Counter()
        postings = self.postings
        for i, w in enumerate(text_words):
            if w in postings:
                votes.update((t, i - at) for t, at in postings[w])
        found = []
        for (t, start), n in votes.items():
            if n < self.needed[t]:
                continue
            label, template = self.templates[t]
            low, high = max(0, start), start + len(template)
            here = text_words[low:high]
            same = sum(a == b for a, b in zip(here, template[low - start :])) / len(template)
            if same >= AGREE and all(_inside(here, p) for p in self.mandatory[t]):
                found.append((label, low, min(high, len(text_words)), same))
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def _inside(here: list[bytes], phrase: list[bytes]) -> bool:
    return any(here[i : i + len(phrase)] == phrase for i in range(len(here) - len(phrase) + 1))


def phrase_places(text_words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every place where the words of a phrase stand consecutively."""
    joined = b" " + b" ".join(text_words) + b" "
    found = []
    for phrase, label in PHRASES.items():
        sought = b" " + phrase.encode() + b" "
        at, counted, n = joined.find(sought), 0, 0
        while at >= 0:
            n += joined.count(b" ", counted, at)
            counted = at
            found.append((n, label))
            at = joined.find(sought, at + 1)
    return found


def scan(docs: DataFrame, index: Index) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, the phrase ``places`` and the aligned ``spans`` (label, first, until, share)."""

    def run(batch: pa.RecordBatch) -> dict:
        counts, places, spans = [], [], []
        for text in batch.column("text").to_pylist():
            w = words(text)
            counts.append(len(w))
            places.append([{"first": a, "label": b} for a, b in phrase_places(w)])
            spans.append([dict(zip(("label", "first", "until", "share"), s)) for s in index.scan(w)])
        place = pa.struct([("first", pa.int64()), ("label", pa.string())])
        span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("until", pa.int64()), ("share", pa.float64())])
        return {
            "n_words": pa.array(counts, pa.int64()),
            "places": pa.array(places, pa.list_(place)),
            "spans": pa.array(spans, pa.list_(span)),
        }

    schema = (
        "n_words bigint, places array<struct<first: bigint, label: string>>, "
        "spans array<struct<label: string, first: bigint, until: bigint, share: double>>"
    )
    return by_batch(with_text(docs, "doc_id"), schema, run, keep=("doc_id",))
