import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from lectern.llm import warc_store
from lectern.sources.tables import Scratch

ROWS = [
    (1, "http://a/1", "same"), (9, "http://a/9", "same"), (4, None, "same"), (2, "http://b\r\nX: y", None), (3, "http://c", ""),
    (5, "http://d", "WARC/1.1\r\nWARC-Type: resource\r\n\r\n"), (6, "http://e", "é\r\n\r\n" * 3), (7, "http://f", "long \n" * 40_000),
    (None, "http://g", "same"), (8, "http://h", "tie"), (8, "http://i", "tie"), (None, "http://j", "lone"),
]


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return df.selectExpr("*", "'x' as payload", "'y' as sha256", "0 as row", "'z' as header")


def brute(rows, least=0):
    by = {}
    for i, _, html in rows:
        by.setdefault(html or "", []).append(i)
    out = []
    for html, ids in by.items():
        body = html.encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        best, told = max((i for i in ids if i is not None), default=None), False
        for i in ids:
            answer = len(body) < least or (i == best and not told)
            told = told or i == best
            out.append((i, len(body), digest, "response" if answer else "revisit", None if answer else best))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 4, 1000])
def test_equals_brute_force(spark, least):
    got = warc_store.warc_report(pages(spark, ROWS), min_bytes=least).collect()
    assert sorted(map(tuple, got), key=repr) == brute(ROWS, least)


def test_payloads_are_stored_once_and_checked(spark, tmp_path):
    warc_store.write_archive(pages(spark, ROWS), str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a" / "payloads"))
    assert stored.count() == len({r[2] or "" for r in ROWS})
    spoilt = stored.selectExpr("sha256", "sha1", "bytes", "cast('other' as binary) payload")
    spoilt.write.parquet(str(tmp_path / "b" / "payloads"))
    spark.read.parquet(str(tmp_path / "a" / "headers")).write.parquet(str(tmp_path / "b" / "headers"))
    with pytest.raises(Exception, match="differs from its digest"):
        warc_store.read_records(spark, str(tmp_path / "b")).select("payload").collect()


def test_records_are_exact(spark, tmp_path):
    warc_store.write_archive(pages(spark, ROWS), str(tmp_path / "a"), date="2020-02-02T00:00:00Z")
    rows = warc_store.record_bytes(warc_store.read_records(spark, str(tmp_path / "a"))).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        (header, payload), = warc_store.parsed(bytes(r["record"]))
        assert header == bytes(r["header"]) and bytes(r["record"]).endswith(b"\r\n\r\n")
        assert payload == (b"" if r["record_type"] == "revisit" else bytes(r["payload"]))
        assert r["record"][:8] == b"WARC/1.1" and b"\r\nWARC-Date: 2020-02-02T00:00:00Z\r\n" in r["header"]
        assert b"\r\nX: y" not in r["header"].split(b"\r\n\r\n")[0]
    assert {bytes(r["payload"]).decode() for r in rows} == {x[2] or "" for x in ROWS}


def test_files_round_trip(spark, tmp_path):
    warc_store.write_archive(pages(spark, ROWS), str(tmp_path / "a"))
    records = warc_store.read_records(spark, str(tmp_path / "a"))
    warc_store.write_files(records, str(tmp_path / "w"), file_bytes=100_000)
    names = list(Path(tmp_path / "w").glob("*.gz"))
    assert len(names) > 1
    back = warc_store.read_files(spark, str(tmp_path / "w"))
    key = ["page_id", "record_type", "refers_to", "uri", "payload_digest", "header"]
    assert sorted(map(repr, back.select(*key).collect())) == sorted(map(repr, records.select(*key).collect()))
    answers = "record_type = 'response'"
    assert {bytes(r[0]) for r in back.filter(answers).select("payload").collect()} == {(x[2] or "").encode() for x in ROWS}


def test_members_of_other_writers(spark, tmp_path):
    record = b"WARC/1.0\r\nwarc-type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    (tmp_path / "y.warc").write_bytes(record)
    got = warc_store.read_files(spark, str(tmp_path)).collect()
    assert [(r["record_type"], bytes(r["payload"]), r["page_id"]) for r in got] == [("warcinfo", b"hello", None)] * 3


def test_hot_payload_and_empty_table(spark):
    hot = spark.range(0, 3000, numPartitions=20).selectExpr("id page_id", "'u' url", "if(id % 3 = 0, 'hot', concat('p', id)) html")
    got = warc_store.warc_report(hot).collect()
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {2997}
    assert sum(r["record_type"] == "response" for r in got) == 2001
    assert warc_store.warc_report(pages(spark, []), scratch=Scratch(spark, "empty")).count() == 0
