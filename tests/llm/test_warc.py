import gzip
import hashlib

import pytest

from spanloom.llm import warc

BIG = "WARC/1.1\r\nWARC-Type: response\r\n\r\n<html>é\r\n\r\n" + "x" * 200
PAGES = [
    (1, "http://a.example/x", BIG), (2, "http://a.example/y", BIG), (0, None, "small"), (3, "http://b\r\nInjected: 1", "small"), (4, "", None), (5, "u", ""),
    (7, "q", BIG + "!"), (7, "q", BIG + "!"), (6, "r", "\r\n\r\n" * 60), (8, "s", "\n" * 99), (9, "s", "\n" * 99), (None, "t", BIG), (None, "t", "z" * 150),
    (10, "v", "é" * 50), (11, "v", "é" * 50), (12, "long", "ab " * 300000),
]


def brute(pages):
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        ids = [j for j, _, h in pages if (h or "").encode() == data and j is not None]
        first = min(ids) if ids and len(data) >= 100 else None
        revisit = first is not None and i != first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS size", "2 AS first").write.parquet(f"{path}/pages.parquet")
    return path


def test_round_trip(spark, written):
    assert sorted(map(tuple, warc.op5(spark, written).collect()), key=repr) == brute(PAGES)


def test_nested_rows_hold_payloads(spark, written, tmp_path):
    warc.write_archives(spark.read.parquet(f"{written}/pages.parquet"), str(tmp_path / "w"), captures=2)
    rows = warc.transactions(warc.read_archives(spark, str(tmp_path / "w"), limit=100)).collect()
    assert len(rows) == len(PAGES)
    stored = {bytes(r.capture.payload) for r in rows if r.capture.type == "response"}
    assert stored == {(h or "").encode() for _, _, h in PAGES}
    assert all({x.type for x in r.requests} == {"request"} and r.metadata[0].concurrent_to == r.id for r in rows)
    assert {r.capture.target_uri for r in rows} == {u if u is None else u.replace("\r\n", "  ") for _, u, _ in PAGES}


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    pages = [(i, "http://a.example/", f"{i} " + "x" * size) for i, size in enumerate([10] * 40 + [3000] * 6 + [40_000])]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(frame, str(tmp_path / "w"), captures=20, archive_bytes=60_000)
    sizes = [sorted(int(h["content-length"]) for h, _ in warc.records_of(warc.inflate(f.read_bytes())) if h["warc-type"] == "response") for f in (tmp_path / "w").glob("*.gz")]
    assert max(map(sum, sizes)) < 60_000 and max(map(len, sizes)) == 20 and sum(map(len, sizes)) == len(pages)
    rows = warc.transactions(warc.read_archives(spark, str(tmp_path / "w"))).collect()
    assert {bytes(r.capture.payload) for r in rows} == {h.encode() for _, _, h in pages}


def test_members_and_damage():
    one = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <a>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert len(list(warc.records_of(warc.inflate(gzip.compress(one) + gzip.compress(one))))) == 2
    for bad in (one[:-6], b"x" + one, one.replace(b": 2", b": 1")):
        with pytest.raises(ValueError):
            list(warc.records_of(bad))
    with pytest.raises(ValueError):
        warc.inflate(gzip.compress(one)[:-9])


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op5(spark, str(tmp_path)).count() == 0
