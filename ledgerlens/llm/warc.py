"""WARC archives with an embedded Zstandard dictionary.

Each archive file is a ``.warc.zst``: a leading skippable frame holds a
dictionary built from the file's own first records, then every WARC record is
a Zstandard frame of its own, compressed with that dictionary.  Of records
with equal payloads one is written whole (``response``); the others are
``revisit`` records that refer to it.

Spark decides what is a revisit and deals pages to files; tasks write whole
files into a shared folder and read them back frame by frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (commit_file, make_folder, materialise, narrow, only_cache, open_fs,
                     short_batches, shuffle_partitions)

# fixed values of the formats
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes from which equal payloads are revisits.
MIN_REVISIT = 100
#: Bytes of records a file's dictionary is built from, the dictionary's size,
#: and the compressed size at which a task begins its next file.
SAMPLE_BYTES, DICTIONARY_BYTES, FILE_BYTES = 1 << 20, 32 << 10, 64 << 20
#: Payload bytes of a task, at least and at most.
TASK_LEAST, TASK_MOST = 2 << 20, 256 << 20
#: What a trained dictionary begins with; a raw one is any other bytes.
TRAINED_MAGIC = b"\x37\xa4\x30\xec"
#: A record counts up to so many bytes towards the sample; a dictionary needs so
#: many records, which are waited for; with them, so many whole bytes are held.
RECORD_SAMPLE, MIN_RECORDS, HELD_BYTES = 4096, 8, 16 << 20
LEVEL = 3
#: Records without a capture date of their own carry this one.
DATE = "2024-01-01T00:00:00Z"
_CRLF = "\r\n"


def _header_value(s: str) -> str:
    """A header value on one line."""
    return s.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if any(c in s for c in "\r\n%") else s


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1" + _CRLF + "".join(f"{k}: {_header_value(v)}{_CRLF}" for k, v in headers)
    return f"{head}Content-Length: {len(block)}{_CRLF}{_CRLF}".encode() + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One response, or one revisit without a payload."""
    shared = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)),
              ("WARC-Date", DATE), ("WARC-Target-URI", url if url else "urn:unknown"),
              ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("Content-Type", "application/http; msgtype=response"),
              # not in the standard: the page's key and its full payload's size
              ("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Payload-Bytes", str(len(payload)))]
    http = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: {len(payload)}{_CRLF}{_CRLF}"
    if not revisit:
        return _record(shared, http.encode() + payload)
    return _record([*shared, ("WARC-Profile", REVISIT_PROFILE),
                    ("WARC-Refers-To", _record_id(refers_to, digest)),
                    ("X-Refers-To-Page", "" if refers_to is None else str(refers_to))], http.encode())


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split(_CRLF)
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length does not hold")
    return headers, rest[:n]


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records: trained, or, where they are too few or too
    much alike to train on, the beginnings of the records themselves.  Only
    records of fewer than 8 bytes in all have none."""
    # samples of bounded size, so that one long page does not fill the sample
    samples = [r[:RECORD_SAMPLE] for r in records]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(records) >= MIN_RECORDS and size >= 512:
        try:
            return zstandard.train_dictionary(size, samples, k=512, d=8)
        except zstandard.ZstdError:
            pass
    raw = b"".join(samples)[-DICTIONARY_BYTES:]
    raw = raw[1:] if raw[:4] == TRAINED_MAGIC else raw
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


class ArchiveWriter:
    """Buffers the first records, builds the dictionary, then streams."""

    def __init__(self, sink):
        self._sink, self._head, self._size, self._held = sink, [], 0, 0
        self._compressor: zstandard.ZstdCompressor | None = None
        self.bytes = self.dictionary_bytes = 0

    def add(self, record: bytes) -> None:
        if self._compressor is None:
            self._head.append(record)
            self._size += min(len(record), RECORD_SAMPLE)
            self._held += len(record)
            if len(self._head) >= MIN_RECORDS and (self._size >= SAMPLE_BYTES or self._held >= HELD_BYTES):
                self._begin()
        else:
            self._write(self._compressor.compress(record))

    def _begin(self) -> None:
        dictionary = build_dictionary(self._head)
        info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha256(b''.join(self._head)).hexdigest())}>"),
                        ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")],
                       b"format: WARC File Format 1.1\r\n")
        if dictionary is not None:
            raw = dictionary.as_bytes()
            self.dictionary_bytes = len(raw)
            self._write(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw)
            dictionary.precompute_compress(level=LEVEL)
            self._compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        else:
            self._compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        for record in [info, *self._head]:
            self._write(self._compressor.compress(record))
        self._head = []

    def _write(self, data: bytes) -> None:
        self._sink.write(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self._compressor is None:
            self._begin()


def read_archive(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive, one frame at a time from a stream."""
    head = file.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    rest, dictionary = head, None
    if magic == SKIPPABLE_MAGIC:
        raw = file.read(size)
        trained = raw[:4] == TRAINED_MAGIC
        dictionary, rest = zstandard.ZstdCompressionDict(
            raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT), b""
    frames = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    out: list[bytes] = []
    one = None
    while True:
        data = rest or file.read(1 << 20)
        rest = b""
        if not data:
            break
        while data:
            if one is None:
                one = frames.decompressobj()
            out.append(one.decompress(data))
            data = one.unused_data if one.eof else b""
            if one.eof:
                yield parse_record(b"".join(out))
                out, one = [], None
    if one is not None:
        raise EOFError("the archive ends inside a record")


def with_origins(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """All pages (mark 1: page_id, url, html, digest) and, for each page with a
    repeated payload, a row (mark 0: page_id, digest, first) that names the page
    its payload's response belongs to.  Only ids and digests are grouped; no
    payload is moved for it."""
    rows = narrow(pages, page_id=id_col, url=url_col, html=html_col)
    rows = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    digests = materialise(rows.where(F.octet_length("html") >= min_bytes).select("page_id", "digest"), "warc-digests")
    firsts = materialise(
        digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", "first"), "warc-firsts")
    # one row per page and digest: repeated rows add nothing here
    repeated = digests.join(firsts, "digest").distinct()
    return rows.withColumn("first", F.lit(None).cast("long")).withColumn("mark", F.lit(1)).unionByName(
        repeated.withColumn("mark", F.lit(0)), allowMissingColumns=True)


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", files: int | None = None, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write all pages as WARC records into ``folder``; returns the manifest:
    path, records, bytes, dictionary_bytes (0: the file has none, see
    ``build_dictionary``).

    The number of tasks follows the payloads: as many as Spark's shuffles have,
    but with ``TASK_LEAST`` to ``TASK_MOST`` bytes each (or ``files``), so that
    a file has records enough for a dictionary.

    * payload: the html in UTF-8; null html: empty
    * of equal payloads of ``min_bytes`` or more the smallest page_id is the
      response (a null id only if all are null); repeated rows of that page
      revisit it
    * shorter payloads are always responses; null url: ``urn:unknown``
    * empty table: no files; further columns are not carried
    """
    spark = pages.sparkSession
    make_folder(folder)
    short_batches(spark)
    total = pages.agg(F.sum(F.octet_length(F.col(f"`{html_col}`")))).first()[0] or 0
    n = files or max(1, -(-total // TASK_MOST), min(shuffle_partitions(spark), total // TASK_LEAST))
    dealt = (with_origins(pages, id_col=id_col, url_col=url_col, html_col=html_col, min_bytes=min_bytes)
             .repartition(n, "page_id", "digest").sortWithinPartitions("page_id", "digest", "mark", "url"))

    def write(batches):
        only_cache()
        task = TaskContext.get()
        fs, root = open_fs(folder)
        done, sink, writer, name, tmp, records = [], None, None, "", "", 0
        marked = last = refers_to = None

        def end():
            writer.close()
            sink.close()
            commit_file(fs, tmp, f"{root}/{name}")
            done.append((f"{folder}/{name}", records, writer.bytes, writer.dictionary_bytes))

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "first", "mark")]
            for i in range(batch.num_rows):
                page_id, url, html, digest, first, mark = (c[i].as_py() for c in columns)
                if mark == 0:  # stands before the rows it speaks of
                    marked, refers_to = (page_id, digest), first
                    continue
                payload = (html or "").encode()
                # the first row of the page that is referred to is the response
                repeated = marked == (page_id, digest)
                revisit = repeated and (refers_to != page_id or last == (page_id, digest))
                last = (page_id, digest)
                if writer is None:
                    name = f"pages-{task.partitionId():06d}-{len(done):04d}.warc.zst"
                    tmp = f"{root}/_tmp-{name}-{task.taskAttemptId()}"
                    sink, records = fs.open_output_stream(tmp, compression=None), 0
                    writer = ArchiveWriter(sink)
                writer.add(page_record(page_id, url, payload, digest, refers_to if revisit else None, revisit))
                records += 1
                if writer.bytes >= FILE_BYTES:
                    end()
                    writer = None
        if writer is not None:
            end()
        if done:
            kinds = [pa.string(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)],
                                             ["path", "records", "bytes", "dictionary_bytes"])

    return materialise(dealt.mapInArrow(write, "path string, records long, bytes long, dictionary_bytes long"),
                       "warc-manifest")


def read_archives(manifest: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """Per record of the listed files: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to and (with ``with_payload``) payload,
    null for revisits.  A response's size and digest are taken from its
    payload and must equal its headers."""
    spark = manifest.sparkSession
    paths = manifest.select("path").repartition(shuffle_partitions(spark), "path")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def number(s):
        return int(s) if s else None

    def read(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = open_fs(path)
                rows: list[tuple] = []

                def out():
                    columns = list(zip(*rows))
                    k = len(names) + with_payload
                    return pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns[:k], kinds)], [*names, "payload"][:k])

                held = 0
                with fs.open_input_stream(at, compression=None) as f:
                    for headers, block in read_archive(f):
                        kind = headers["warc-type"]
                        if kind == "warcinfo":
                            continue
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                        size, payload = int(headers["x-payload-bytes"]), None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                                raise ValueError(f"{path}: a payload does not have its digest")
                            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        rows.append((number(headers["x-page-id"]), headers["warc-target-uri"], size, digest, kind,
                                     number(headers.get("x-refers-to-page")) if kind == "revisit" else None, payload))
                        held += len(block) if with_payload else 0
                        if len(rows) >= 1024 or held > 16 << 20:
                            yield out()
                            rows, held = [], 0
                if rows:
                    yield out()

    return paths.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, "
                                  "record_type string, refers_to long" + (", payload binary" if with_payload else ""))
