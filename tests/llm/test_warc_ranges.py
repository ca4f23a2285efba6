"""Archives dealt out in byte ranges give the same records, however narrow the ranges and pieces are."""

import base64
import hashlib

import pytest

from quillspar.llm import warc

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("chunk", [16, 97, 1000, 4 << 20])
def test_ranges_of_any_width(spark, monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    trap = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a", "x"), (2, "http://b c", "x"), (3, None, None), (5, "u" * 300, "\r\n\r\n" + trap * 3), (6, "u", "é" * 500 + "\r\n"), (7, "u", "\r\n\r\nWARC/1.1\r\nno field\r\n"), (8, "u", "WARC/1.")]
    pages = spark.createDataFrame(rows, PAGES).coalesce(1)
    out = {r.page_id: (r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.round_trip(pages).collect()}
    data = {i: (h or "").encode() for i, _, h in rows}
    assert out == {i: (len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), 1 if i == 2 else None) for i, d in data.items()}


def test_payloads_are_hashed_in_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 5)
    for k in range(12):
        body = b"a" * k + b"\r\n\r\n" + b"payload\r\n\r\nmore"
        (tmp_path / "x").write_bytes(body)
        size, digest = warc.Archive(f"file:{tmp_path}/x", len(body)).payload(0, len(body))
        assert (size, digest) == (len(body) - k - 4, base64.b32encode(hashlib.sha1(body[k + 4 :]).digest()).decode())
    (tmp_path / "x").write_bytes(b"no blank line at all")
    assert warc.Archive(f"file:{tmp_path}/x", 20).payload(0, 20)[0] == 20


def test_headers_are_read_on_only_while_lines_are_fields(tmp_path):
    head = b"WARC/1.1\r\nA: " + b"x" * 200_000 + b"\r\n folded\r\n\r\nbody"
    (tmp_path / "h").write_bytes(head)
    assert warc.Archive(f"{tmp_path}/h", len(head)).header(0) == head[:-4]
    text = b"WARC/1.1\r\nno field\r\n" + b"y" * 300_000 + b"\r\n\r\n"
    (tmp_path / "t").write_bytes(text)
    assert warc.Archive(f"{tmp_path}/t", len(text)).header(0) is None


def test_files_by_records_without_a_shuffle(spark, tmp_path):
    pages = spark.range(100).selectExpr("id AS page_id", "'u' AS url", "repeat('p', 100 + id) AS html").coalesce(2)
    warc.write_archives(pages, str(tmp_path / "a"), file_bytes=7000)
    sizes = [f.stat().st_size for f in (tmp_path / "a").glob("part-*")]
    assert len(sizes) >= 8 and max(sizes) < 14000
    plan = warc.records(pages)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan and "RoundRobin" not in plan
