"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames; a skippable frame at the end of each file is the seek
table of the public seekable format (sizes of each frame). An index table maps each record to its
file, frame and offset within the decompressed frame, so one record costs one frame to read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import filesystem, new_folder, shuffle_partitions, slices, small_or_shuffled, text_column, written

FRAME_BYTES = 1 << 20
#: Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1


class BundleWriter:
    """Appends records to frames of about ``frame_bytes``; a larger record is a frame of its own."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        fs, path = filesystem(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self._f, self._z = fs.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level)
        self._limit, self._held, self._size, self._table = frame_bytes, [], 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in it) of the record."""
        if self._size and self._size + len(record) > self._limit:
            self._flush()
        at = (len(self._table), self._size)
        self._held.append(record)
        self._size += len(record)
        return at

    def _flush(self) -> None:
        data = self._z.compress(b"".join(self._held))
        self._f.write(data)
        self._table.append((len(data), self._size))
        self._held, self._size = [], 0

    def close(self) -> None:
        if self._size:
            self._flush()
        body = b"".join(struct.pack("<II", *x) for x in self._table) + struct.pack("<IBI", len(self._table), 0, SEEKABLE_MAGIC)
        self._f.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self._f.close()


class BundleReader:
    """Reads frames by the seek table at the end of the file."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = filesystem(uri)
        self._f, self._z = fs.open_input_file(path), zstandard.ZstdDecompressor()
        size = self._f.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags & 0x7C:
            raise ValueError(f"{uri} has no seek table")
        width = 12 if flags & 0x80 else 8
        table = self._at(size - 9 - width * n, width * n)
        self.frames, at = [], 0
        for k in range(n):
            packed, whole = struct.unpack_from("<II", table, width * k)
            self.frames.append((at, packed, whole))
            at += packed

    def _at(self, offset: int, size: int) -> bytes:
        self._f.seek(offset)
        return self._f.read(size)

    def frame(self, k: int) -> bytes:
        at, packed, whole = self.frames[k]
        return self._z.decompress(self._at(at, packed), max_output_size=whole)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse_record(self.frame(frame), offset)[:2]

    def records(self):
        """All records in order: (headers, block)."""
        for k in range(len(self.frames)):
            data, at = self.frame(k), 0
            while at < len(data):
                headers, block, at = parse_record(data, at)
                yield headers, block

    def close(self) -> None:
        self._f.close()


def format_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and the offset behind it."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = dict(x.split(": ", 1) for x in lines)
    start = end + 4
    stop = start + int(headers["Content-Length"])
    return headers, data[start:stop], stop + 4


def _record_uri(page_id: int | None, own: str) -> str:
    """A record's id: its page, and what no other record has."""
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{own}>"


def _page_of(uri: str) -> int | None:
    name = uri[len("<urn:x-page:") :].partition(":")[0]
    return None if name == "none" else int(name)


def _one_line(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_warc(pages: DataFrame, min_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) and return the index.

    Index: page_id, file, frame, offset. Of rows with equal payloads of at least ``min_bytes`` the one
    with the smallest page_id is a response and the others are revisits without a payload. A null html
    is an empty payload, a null url is left out. ``date`` (ISO 8601, UTC) is the records' date, by default
    the time of the call. A revisit names its response's page, url and date. Rows that repeat the smallest page_id of their payload
    are responses too; a null page_id revisits the smallest one, or is a response if all are null.

    Payloads of more than one row are found by a count with partial sums. Their table is broadcast if
    it is small by count; else the join shuffles, and a payload that many rows share is split by the
    adaptive skew join. A task that is run again writes a file of another name, and only files named in
    the written index count.
    """
    folder = new_folder(pages.sparkSession, "warc")
    html = text_column("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(F.encode(html, "utf-8")).alias("digest"), F.octet_length(html).alias("size"))
    shared = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.join(small_or_shuffled(written(shared, "payloads")), ["digest", "size"], "left").select("page_id", "url", "html", "digest", "first", "first_url")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        own, n, writer = uuid.uuid4().hex, 0, None
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{own}.warc.zst"
        for batch in slices(batches):
            writer, at = writer or BundleWriter(name), []
            for page, url, text, sha, first, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                payload = text.encode()
                headers = [("WARC-Record-ID", _record_uri(page, f"{own}-{n}")), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
                n += 1
                if url is not None:
                    headers.append(("WARC-Target-URI", _one_line(url)))
                if first is None or first == page:
                    record = format_record([("WARC-Type", "response"), ("Content-Type", "application/http;msgtype=response"), *headers], _HTTP + payload)
                else:
                    to = [("X-Refers-To-Page", str(first)), ("WARC-Refers-To-Date", date), *([("WARC-Refers-To-Target-URI", _one_line(first_url))] if first_url is not None else [])]
                    record = format_record([("WARC-Type", "revisit"), ("WARC-Profile", _IDENTICAL), *to, *headers], b"")
                at.append(writer.add(record))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(at), pa.string()), pa.array([x for x, _ in at], pa.int32()), pa.array([x for _, x in at], pa.int64())], ["page_id", "file", "frame", "offset"])
        if writer:
            writer.close()

    return written(marked.mapInArrow(run, "page_id long, file string, frame int, offset long"), "warc-index")


def read_warc(index: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Read the files named in an index back: a row for each record.

    Columns: page_id, url, payload_bytes, payload_digest (base32 SHA-1), record_type, refers_to and,
    with ``keep_payload``, payload (null for revisits). Digests and sizes of responses are computed
    from the payload that was read; those of revisits are in their headers.
    """

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                reader, rows = BundleReader(uri), []
                for headers, block in reader.records():
                    page, kind = _page_of(headers["WARC-Record-ID"]), headers["WARC-Type"]
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        size, digest, to = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), None
                        if digest != headers["WARC-Payload-Digest"][5:]:
                            raise ValueError(f"{uri}: the payload of {page} is damaged")
                    else:
                        payload, size, digest, to = None, int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"][5:], int(headers["X-Refers-To-Page"])
                    rows.append((page, headers.get("WARC-Target-URI"), size, digest, kind, to, *([payload] if keep_payload else [])))
                    if len(rows) == 256:
                        yield as_batch(rows)
                        rows = []
                if rows:
                    yield as_batch(rows)
                reader.close()

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def as_batch(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names[: len(cols)])

    # written first: a repartition right after the aggregation would merge with its exchange and be coalesced to few tasks
    files = written(index.select("file").distinct(), "warc-files")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep_payload
    return files.repartition(shuffle_partitions(index.sparkSession), F.xxhash64("file")).mapInArrow(run, schema)
