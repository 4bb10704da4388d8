import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from craquelure.llm import bpe, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("all", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    enc = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op4_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_small_chunks_stitch_to_the_same_ids(spark):
    r = random.Random(3)
    alphabet = ["word", "Ωmega", " ", "  ", "\n", "'s", "'re", "12", "!?", "\t", "don't", "é", "   \n", "𝔘"]
    texts = ["".join(r.choice(alphabet) for _ in range(n)) for n in (0, 5, 40, 200, 900, 901)]
    texts += ["a" * 500, " " * 500 + "b", "end " + "9" * 300, texts[-1]]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(9, texts[-1])], "doc_id long, text string")
    enc = library()
    got = bpe.decode(bpe.encode(docs, RANKS, PATTERN, chunk_chars=64, overlap=24), RANKS).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        assert row.token_ids == enc.encode_ordinary(texts[row.doc_id])
        assert bytes(row.decoded).decode() == texts[row.doc_id]


def test_odd_rows(odd, empty):
    enc = library()
    got = bpe.encode(odd, RANKS, PATTERN, chunk_chars=1000, overlap=50).collect()
    want = sorted((str(r.doc_id), enc.encode_ordinary(r.text or "")) for r in odd.collect())
    assert sorted((str(r.doc_id), r.token_ids) for r in got) == want
    assert bpe.encode(empty, RANKS, PATTERN).collect() == []
