import hashlib
import io

import pytest
from oracle_check import compare, duck

from craquelure.llm import queries, warc
from craquelure.llm.common import shared_folder


def test_query_equals_sql(spark, folder):
    problem, _ = compare(queries.op8_warc(spark, folder), duck(folder), queries.ORACLES["op8_warc"])
    assert problem is None, problem


def pages(spark):
    same = "<p>" + "same " * 40 + "</p>"
    rows = [(5, "u", same), (3, None, same), (9, "u\r\nWARC-Type: x", same), (None, "n", same), (3, "again", same)]
    rows += [(1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "ü", "é" * 80), (6, "ü", "é" * 80), (7, "u", "")]
    return spark.createDataFrame(
        [(*r, "clash", 1) for r in rows], "page_id long, url string, html string, record_type string, block int"
    )


def test_records_come_back(spark):
    source = pages(spark)
    listed, records = warc.archive(source, shared_folder(spark, "test"))
    got = records.collect()
    assert sum(r.records for r in listed.collect()) == len(got) == 11
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert ("5", "revisit", 3, 207) in kinds and ("9", "revisit", 3, 207) in kinds
    assert kinds.count(("3", "response", None, 207)) == 2 and ("None", "response", None, 207) in kinds
    assert ("1", "response", None, 5) in kinds and ("2", "response", None, 5) in kinds
    assert kinds.count(("6", "response", None, 160)) == 2 and ("4", "response", None, 0) in kinds
    texts = {r.page_id: r.html or "" for r in source.collect()}
    for r in got:
        assert r.payload_digest == hashlib.sha256(texts[r.page_id].encode()).hexdigest()
        if r.record_type == "response":
            assert bytes(r.block).decode() == texts[r.page_id]


def test_empty_table(spark):
    listed, records = warc.archive(pages(spark).limit(0), shared_folder(spark, "test"))
    assert listed.count() == records.count() == 0


def test_damage_is_noticed():
    digest = hashlib.sha256(b"payload").hexdigest()
    good = warc.record(1, "u", b"payload", digest, None)
    assert warc.parse(good)["block"] == b"payload"
    for bad in (good.replace(b"payload\r", b"paYload\r"), good[:-1], good.replace(b"Length: 7", b"Length: 9"), b"x"):
        with pytest.raises(warc.DamagedArchive):
            warc.parse(bad)
    packed = warc.member(good) * 3
    assert len(list(warc.members(io.BytesIO(packed)))) == 3
    with pytest.raises(warc.DamagedArchive):
        list(warc.members(io.BytesIO(packed[:-9])))
