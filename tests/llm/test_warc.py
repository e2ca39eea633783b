"""WARC archives: exact round trip, dictionary frame, revisits."""

import hashlib
import io
import struct

import duckdb
import numpy as np
import pytest
import zstandard

import __spark_entry__ as entry
from ledgerlens.llm import warc
from ledgerlens.llm.common import fresh_dir, open_fs

SF01 = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string, refers_to string, digest int, first int"


def _read(spark, rows, **kw):
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA), fresh_dir(spark, "warc"), **kw)
    return manifest, warc.read_archives(manifest).collect()


def test_query_matches_sql_and_payloads_come_back(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF01}/pages.parquet'")
    rel = con.execute(entry.oracle_sql()["op3_warc_dictionary"])
    cols = [d[0] for d in rel.description]
    got = entry.queries()["op3_warc_dictionary"](spark, SF01)
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(rel.fetchall(), key=repr)
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    manifest = warc.write_archives(pages, fresh_dir(spark, "warc"), files=3)
    back = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    for p in pages.collect():
        r = back[p.page_id]
        whole = back[r.refers_to].payload if r.record_type == "revisit" else r.payload
        assert bytes(whole).decode() == (p.html or "") and r.url == warc._header_value(p.url)


def test_files_are_standard_zstandard(spark):
    rows = [(i, f"http://h/{i}", f"<html><body><p>common words of page {i % 17}</p></body></html>" * 5 + str(i), "", 1, 1)
            for i in range(400)]
    manifest, got = _read(spark, rows, files=2)
    assert len(got) == 400 and {r.record_type for r in got} == {"response"}
    for m in manifest.collect():
        fs, path = open_fs(m.path)
        data = fs.open_input_file(path).read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D and data[8:12] == b"\x37\xa4\x30\xec"  # a trained dictionary
        dictionary = zstandard.ZstdCompressionDict(data[8:8 + size])
        # every record is a frame of its own, readable on its own
        frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        assert frame.decompress(data[8 + size:]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        assert frame.unused_data
        assert m.bytes == len(data)
        plain = sum(len(zstandard.ZstdCompressor(level=3).compress(warc._record(list(h.items()), b)))
                    for h, b in warc.read_archive(io.BytesIO(data)))
        assert len(data) - size < plain / 2


def test_revisits_and_edges(spark):
    long, short = "x" * 100, "y" * 99
    rows = [(5, "u", long, "", 1, 1), (3, "u", long, "", 1, 1), (9, None, long, "", 1, 1), (3, "u", long, "", 1, 1),
            (4, "u", short, "", 1, 1), (6, "u", short, "", 1, 1), (7, "a\r\nb%", None, "", 1, 1),
            (8, "u", "", "", 1, 1), (None, "u", long, "", 1, 1), (1, "u", "é" * 400_000, "", 1, 1)]
    _, got = _read(spark, rows, files=2)
    assert len(got) == len(rows)
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got)
    assert kinds == [(-1, "revisit", 3), (1, "response", None), (3, "response", None), (3, "revisit", 3),
                     (4, "response", None), (5, "revisit", 3), (6, "response", None), (7, "response", None),
                     (8, "response", None), (9, "revisit", 3)]
    one = next(r for r in got if r.page_id == 5)
    assert (one.payload_bytes, one.payload_digest, one.payload) == (100, hashlib.sha256(long.encode()).hexdigest(), None)
    assert next(r for r in got if r.page_id == 1).payload_bytes == 800_000
    manifest, got = _read(spark, [])
    assert got == [] and manifest.count() == 0


def test_files_roll_over(spark, monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 1 << 12)
    out, writer = io.BytesIO(), None
    writer = warc.ArchiveWriter(out)
    records = [warc.page_record(i, "u", bytes([65 + i % 26]) * 700, "d", None, False) for i in range(50)]
    for r in records:
        writer.add(r)
    writer.close()
    assert writer.bytes == len(out.getvalue())
    got = list(warc.read_archive(io.BytesIO(out.getvalue())))
    assert [h["x-page-id"] for h, _ in got[1:]] == [str(i) for i in range(50)]
    with pytest.raises((EOFError, zstandard.ZstdError)):
        list(warc.read_archive(io.BytesIO(out.getvalue()[:-3])))
    assert list(warc.read_archive(io.BytesIO(b""))) == []


@pytest.mark.parametrize("long", [0, 1, 6, 7])
def test_a_long_page_among_the_first_leaves_the_dictionary(long):
    random = np.random.default_rng(1)
    records = [warc.page_record(i, f"http://h/{i}", random.bytes(20 << 20) if i == long else
                                f"<html><body><p>common words of page {i % 17}</p></body></html>".encode() * 5, "", None, False)
               for i in range(1500)]
    sink = io.BytesIO()
    writer = warc.ArchiveWriter(sink)
    for r in records:
        writer.add(r)
    writer.close()
    data = sink.getvalue()
    assert struct.unpack("<I", data[:4])[0] == warc.SKIPPABLE_MAGIC
    back = [h["x-page-id"] for h, _ in warc.read_archive(io.BytesIO(data)) if h["warc-type"] != "warcinfo"]
    assert back == [str(i) for i in range(1500)]


def test_every_file_has_its_dictionary(spark):
    """Also with far more shuffle partitions than the pages fill."""
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "200")
    try:
        files = warc.write_archives(pages, fresh_dir(spark, "warc")).collect()
        many = warc.write_archives(pages, fresh_dir(spark, "warc"), files=200)
        assert {r.page_id for r in warc.read_archives(many).collect()} == {r.page_id for r in pages.collect()}
    finally:
        spark.conf.set(key, before)
    assert files and min(f.dictionary_bytes for f in files) > 0
    assert many.count() > 100 and many.where("dictionary_bytes = 0").count() == 0


@pytest.mark.parametrize("n, payload", [(1, b""), (3, b"a few words"), (9, b"z" * 5000), (20, b"same " * 400)])
def test_few_or_equal_records_have_a_raw_dictionary(n, payload):
    sink = io.BytesIO()
    writer = warc.ArchiveWriter(sink)
    for i in range(n):
        writer.add(warc.page_record(i, "u", payload, "", None, False))
    writer.close()
    back = list(warc.read_archive(io.BytesIO(sink.getvalue())))
    assert [h["x-page-id"] for h, _ in back[1:]] == [str(i) for i in range(n)] and writer.dictionary_bytes > 0
    assert all(b.partition(b"\r\n\r\n")[2] == payload for _, b in back[1:])
    assert warc.build_dictionary([b"", b"x"]) is None
