import random

import pytest
from oracle_check import compare, duck
from pyspark.sql import functions as F

from craquelure.llm import lines, queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs):
    """(doc_id, remaining text) by comparing every line with every earlier one."""
    seen, out = [], {}
    for d, text in sorted(docs):
        kept = []
        for line in text.split("\n"):
            earlier = any(
                x == line or (min(len(x), len(line)) >= 16 and abs(len(x) - len(line)) < 2 and distance(x, line) <= 1)
                for x in seen
            )
            if line.strip(" \t\r\x0b\x0c"):
                seen.append(line)
                if earlier:
                    continue
            kept.append(line)
        out[d] = "\n".join(kept)
    return out


def planted(seed, n=60):
    r = random.Random(seed)
    base = ["".join(r.choice("abcé ") for _ in range(r.choice([3, 15, 16, 17, 40, 300, 700]))) for _ in range(25)]
    base += ["a" * 16, "a" * 17, "a" * 40, "ab" * 20]
    docs = []
    for d in range(n):
        out = []
        for _ in range(r.randrange(6)):
            line = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                at = r.randrange(len(line))
                kind = r.randrange(3)
                line[at : at + (kind != 0)] = [] if kind == 2 else [r.choice("abxé")]
            out.append("".join(line))
        docs.append((d, "\n".join(out)))
    return docs


@pytest.mark.parametrize("seed, sent", [(1, lines.HASHES_SENT), (2, lines.HASHES_SENT), (3, 0)])
def test_planted_edits(spark, seed, sent, monkeypatch):
    docs = planted(seed)
    monkeypatch.setattr(lines.near_copies, "__kwdefaults__", {"sent": sent})
    monkeypatch.setattr(lines.copies, "__kwdefaults__", {"sent": sent})
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup(df).collect()} == brute(docs)


def test_query_equals_sql(spark, folder):
    df = queries.op1_lines(spark, folder)
    problem, _ = compare(df, duck(folder), queries.ORACLES["op1_lines"])
    assert problem is None, problem
    assert df.agg(F.sum("n_exact")).first()[0] > 0


def test_odd_rows(odd, empty, spark):
    out = lines.dedup(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = [(r.doc_id, r.text) for r in out.collect()]
    assert (1, None) in texts and (2, "") in texts and texts.count((4, "same words again and again")) == 2
    assert lines.dedup(empty).count() == 0
    rows = [(2, "x\ny"), (None, "x"), (2, "x"), (1, "y\n\n \ny")]
    got = {(r.doc_id, r.text) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (1, "y\n\n ") in got and (None, "") in got and len(got) == 4


def test_lengths_around_two_blocks(spark):
    r = random.Random(4)
    docs = []
    for n in (16, 17, 30, 31, 510, 511, 512, 513, 1030):
        line = [r.choice("abcdé") for _ in range(n)]
        for at in (0, n // 2 - 1, n // 2, n - 1):
            for change in (["x"], [], [line[at], "y"]):
                docs.append((len(docs), "".join(line[:at] + change + line[at + 1 :])))
        docs.append((len(docs), "".join(line)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id: x.text for x in lines.dedup(df).collect()} == brute(docs)


def test_clashing_columns(spark):
    rows = [(1, "a\nb", 1, 2, 3, 4, 5), (2, "a\nc", 1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _doc int, _hash int, _exact int, _near int, __doc int")
    out = lines.dedup(df)
    assert out.columns == df.columns and sorted(x.text for x in out.collect()) == ["a\nb", "c"]


def test_no_python_in_the_plan(spark, folder):
    plan = queries.op1_lines(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
