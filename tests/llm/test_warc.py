import hashlib
import io

import pytest

from lodestone.llm import warc
from lodestone.llm.queries import op5_warc
from lodestone.llm.registry import oracle_sql
from tests.oracle import SMALL, ask, same

PAGES = "page_id bigint, url string, html string"


def resolved(rows):
    """By brute force: (payload_bytes, digest, type, refers_to) of each page."""
    payload = {i: (html or "").encode() for i, _, html in rows}
    out = {}
    for i, raw in payload.items():
        first = min(j for j, other in payload.items() if other == raw)
        revisit = len(raw) >= 100 and first != i
        out[i] = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None)
    return out


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in op5_warc(spark, SMALL).collect()}
    assert got == resolved(rows)


BIG = "<p>" + "text ünd mehr " * 20
ROWS = [
    (5, "http://a/1", BIG), (3, "http://a/2", BIG), (9, None, BIG), (4, "http://b/\r\nx%41", "short"), (6, "http://b/2", "short"), (7, "u", None), (8, "", ""),
    (10, "http://long/", "x" * 300_000), (11, "http://edge/", "e" * 100), (12, "http://edge/2", "e" * 100), (13, "http://edge/3", "e" * 99), (14, "http://edge/4", "e" * 99),
]


@pytest.mark.parametrize("digests", [0, 1000])
def test_cases_and_round_trip(spark, monkeypatch, digests):
    monkeypatch.setattr(warc, "DIGESTS", digests)
    pages = spark.createDataFrame(ROWS, PAGES).selectExpr("*", "1 AS payload", "2 AS refers_to", "'x' AS payload_digest").repartition(3)
    manifest = warc.write(pages)
    records = warc.read(manifest, with_payload=True)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records.collect()}
    assert got == resolved(ROWS)
    assert {(r["page_id"], r["url"], bytes(r["payload"])) for r in warc.restored(records).collect()} == {(i, u, (h or "").encode()) for i, u, h in ROWS}


def test_files_roll_over(spark, monkeypatch):
    pages = spark.createDataFrame(ROWS, PAGES).coalesce(1)
    monkeypatch.setattr(warc, "FILE_BYTES", 200)
    manifest = warc.write(pages)
    assert warc.read(manifest).count() == len(ROWS)


def test_odd_tables(spark):
    assert warc.read(warc.write(spark.createDataFrame([], PAGES))).count() == 0
    rows = [(1, "u", BIG), (1, "u", BIG), (None, "v", BIG), (None, None, None)]
    got = warc.read(warc.write(spark.createDataFrame(rows, PAGES))).collect()
    assert len(got) == 4 and {r["record_type"] for r in got} == {"response"}


def test_broken_archives_are_refused():
    raw = warc._member(warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "2024-01-01T00:00:00Z"))
    assert len(list(warc.members(io.BytesIO(raw * 3), chunk=7))) == 3
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(raw[:-3])))
    with pytest.raises(ValueError, match="not a record"):
        warc.parse(b"HTTP/1.1\r\n\r\n")


def test_pages_of_one_id_are_resolved_by_payload(spark):
    """A payload of its own is never a revisit because its page_id has another that is; nothing is multiplied."""
    other, third = BIG + "other", BIG + "third"
    rows = [(1, "u", BIG), (1, "u2", BIG), (2, "v", BIG), (2, "w", other), (3, "x", third), (4, "y", BIG), (4, "z", third)]
    records = warc.read(warc.write(spark.createDataFrame(rows, PAGES).repartition(3)), with_payload=True)
    got = sorted((r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in records.collect())
    response = lambda i, u: (i, u, "response", None)
    assert got == [response(1, "u"), response(1, "u2"), (2, "v", "revisit", 1), response(2, "w"), response(3, "x"), (4, "y", "revisit", 1), (4, "z", "revisit", 3)]
    assert sorted((r["page_id"], r["url"], bytes(r["payload"])) for r in warc.restored(records).collect()) == sorted((i, u, h.encode()) for i, u, h in rows)


def test_query_equals_sql(spark):
    same(op5_warc(spark, SMALL).toPandas(), ask(oracle_sql()["op5_warc"]))
