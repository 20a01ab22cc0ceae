import base64
import gzip
import hashlib
import itertools
import re
from collections import defaultdict
from pathlib import Path

from skyweave.llm import queries, warc
from tests.oracle import SMALL

from .cases import EXTRA, got

PAGES = [(1, "http://a/ b\r\nX: 1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 5000), (6, "u", "é" * 5000), (7, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>one</p>"), (8, "u", "twice"), (8, "u", "twice"), (9, "u", "\r\n\r\n")]


def pages(spark, rows=PAGES):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit("x").alias(c) for c in EXTRA), F.lit(1).alias("refers_to"), F.lit(2).alias("payload_bytes"))


def brute(rows, min_bytes=0):
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    least = defaultdict(list)
    for page_id, _, html in rows:
        if page_id is not None and len((html or "").encode()) >= min_bytes:
            least[sha(html)].append(page_id)
    out = []
    for page_id, _, html in rows:
        size = len((html or "").encode())
        first = min(least[sha(html)], default=None) if size >= min_bytes else None
        again = first is not None and page_id != first
        out.append((page_id, size, sha(html), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_edge_rows(spark, tmp_path):
    for k, (chunk, archive, least) in enumerate(((1 << 18, 16 << 20, 0), (7, 2000, 0), (1 << 18, 1, 100), (1, 5000, 3))):
        path = f"file://{tmp_path}/{k}"
        warc.write_warc(pages(spark), path, least, chunk, archive)
        assert got(warc.read_records(spark, path)) == brute(PAGES, least)


def test_payloads_come_back_in_bounded_chunks(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    warc.write_warc(pages(spark), path, chunk_bytes=100)
    payloads = defaultdict(bytes)
    for r in sorted(warc.read_chunks(spark, path).where("record_type = 'response'").collect(), key=lambda r: (r.archive, r.record, r.chunk)):
        assert r.bytes <= 100
        payloads[r.page_id] += bytes(r.payload)
    assert payloads[5] == ("é" * 5000).encode() and payloads[7] == PAGES[6][2].encode()


def test_files_are_warc(spark, tmp_path):
    warc.write_warc(pages(spark).where("page_id < 3").coalesce(1), f"file://{tmp_path}/f")
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "f").rglob("part-*"))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")
    assert len(re.findall(rb"^WARC-Target-URI: http://a/%20b%0D%0AX:%201\r$", text, re.M)) == 1


def test_empty_table(spark, tmp_path):
    warc.write_warc(pages(spark, []), f"file://{tmp_path}/e")
    assert warc.read_records(spark, f"file://{tmp_path}/e").count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(queries.op4_warc(spark, SMALL)) == brute(rows)


def written(spark, rows, path, **options):
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, **options)
    return got(warc.read_records(spark, path))


def test_repeated_and_null_page_ids_are_judged_by_their_payloads(spark, tmp_path):
    for k, ids in enumerate(([1, 2, 5, 5, 7, 7], [1, 2, None, None, None, None], [None] * 6)):
        rows = [(i, "u", t) for i, t in zip(ids, ["A", "B", "A", "UNIQUE", "A", "B"], strict=True)]
        assert written(spark, rows, f"file://{tmp_path}/{k}") == brute(rows)
        texts = sorted(bytes(r.payload).decode() for r in warc.read_chunks(spark, f"file://{tmp_path}/{k}").where("record_type = 'response'").collect())
        assert set(texts) == {"A", "B", "UNIQUE"}


def test_line_breaks_at_any_place(spark, tmp_path):
    parts = ["\r", "\n", "\r\n", "\r\n\r\n", "x", "WARC/1.1\r\n"]
    rows = [(n, "u", "".join(t)) for n, t in enumerate(t for k in range(1, 4) for t in itertools.product(parts, repeat=k))]
    assert written(spark, rows, f"file://{tmp_path}/b", chunk_bytes=3) == brute(rows)


def test_a_large_page_comes_in_chunks_and_ends_the_archive_before(spark, tmp_path):
    rows = [(1, "u", "small"), (2, "u", "0123456789abcdef" * (50 << 16)), (3, "u", "also small")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, f"file://{tmp_path}/l", archive_bytes=1 << 20)
    assert got(warc.read_records(spark, f"file://{tmp_path}/l")) == brute(rows)
    chunks = warc.read_chunks(spark, f"file://{tmp_path}/l").selectExpr("page_id", "archive", "bytes", "length(payload) AS n").collect()
    assert max(r.n for r in chunks) == 256 << 10 and sum(r.page_id == 2 for r in chunks) == 200
    assert len({r.archive for r in chunks if r.page_id == 2}) == 1


def test_parser_takes_bytes_bit_by_bit():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 6\r\n\r\n\r\n\r\nab\r\n\r\n"
    for step in range(1, len(record)):
        parser = warc.RecordParser()
        found = [block for i in range(0, 2 * len(record), step) for _, block in parser.feed((record * 2)[i : i + step])]
        assert found == [b"\r\n\r\nab"] * 2 and parser.done()


def test_query_makes_several_chunks(spark, monkeypatch):
    made, read = [], warc.read_records
    monkeypatch.setattr(warc, "read_records", lambda spark, path: made.append(path) or read(spark, path))
    queries.op4_warc(spark, SMALL).count()
    assert warc.read_chunks(spark, made[0]).where("chunk > 0").count()
