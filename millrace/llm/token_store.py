"""Token ids in files of directly addressable codes.

An id is split into chunks of 8 bits. Level 0 has the lowest chunk of every id; a bitmap tells which
ids go on at level 1, and so forth. To find an id's chunk at the next level one counts the bits before
it: a rank directory has that count for every 512 bits. Any id is read by a few array look-ups,
without decoding its neighbours.

A file holds segments of a bounded number of ids, then the documents' ids and starts, the segments'
places, and a trailer. Files are numbered in ascending doc_id order.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import filesystem, new_folder, shuffle_partitions, slices, text_column, written
from millrace.llm.pieces import encoder

MAGIC = b"MRDAC001"
SEGMENT_IDS = 1 << 20
RANK_BITS = 512
_TRAILER = struct.Struct("<QQQQ8s")  # footer offset, documents, segments, ids


def encode_segment(ids: np.ndarray) -> bytes:
    """Chunk levels, continuation bitmaps and rank directories of ids (unsigned 32-bit)."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u4") if len(blocks) else blocks
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        if not more.any():
            break
        rest = rest[more] >> 8
    head = struct.pack("<I", len(levels)) + b"".join(struct.pack("<I", n) for n, *_ in levels)
    return head + b"".join(chunks + bits + ranks for _, chunks, bits, ranks in levels)


class Segment:
    def __init__(self, data: bytes):
        (n,) = struct.unpack_from("<I", data)
        sizes, at = struct.unpack_from(f"<{n}I", data, 4), 4 + 4 * n
        self.levels = []
        for size in sizes:
            n_bits, n_ranks = (size + 7) // 8, (size + RANK_BITS - 1) // RANK_BITS
            chunks = np.frombuffer(data, np.uint8, size, at)
            bits = np.frombuffer(data, np.uint8, n_bits, at + size)
            ranks = np.frombuffer(data, "<u4", n_ranks, at + size + n_bits)
            self.levels.append((chunks, bits, ranks))
            at += size + n_bits + 4 * n_ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """One id, by rank look-ups alone."""
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * level
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            before = bits[block * RANK_BITS // 8 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + (int(bits[i >> 3]) & (1 << (i & 7)) - 1).bit_count()
        raise ValueError("an id goes on beyond the last level")

    def all(self) -> np.ndarray:
        values, at = self.levels[0][0].astype(np.uint32), None
        for level, (chunks, bits, _) in enumerate(self.levels):
            if level:
                values[at] |= chunks.astype(np.uint32) << np.uint32(8 * level)
            on = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
            at = on if at is None else at[on]
        return values


class TokenFile:
    """Random access to a file: a token by its place, or a document's tokens."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self._f = fs.open_input_file(path)
        size = self._f.size()
        footer, docs, segments, self.n_ids, magic = _TRAILER.unpack(self._at(size - _TRAILER.size, _TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        tail = self._at(footer, 16 * docs + docs + 16 * segments)
        self.starts = np.frombuffer(tail, "<u8", docs)
        self.doc_ids = np.frombuffer(tail, "<i8", docs, 8 * docs)
        self.is_null = np.frombuffer(tail, np.bool_, docs, 16 * docs)
        self._places = np.frombuffer(tail, "<u8", 2 * segments, 17 * docs).reshape(-1, 2)
        self._last: tuple[int, Segment] | None = None

    def _at(self, offset: int, size: int) -> bytes:
        self._f.seek(offset)
        return self._f.read(size)

    def segment(self, k: int) -> Segment:
        if self._last is None or self._last[0] != k:
            self._last = (k, Segment(self._at(int(self._places[k, 0]), int(self._places[k, 1]))))
        return self._last[1]

    def token(self, i: int) -> int:
        return self.segment(i // SEGMENT_IDS)[i % SEGMENT_IDS]

    def documents(self):
        """(doc_id, start in the file, number of ids, crc32 of the ids), segment by segment."""
        ends = np.append(self.starts[1:].astype(np.int64), self.n_ids) if len(self.starts) else self.starts
        values, k = None, -1
        for doc, start, end, null in zip(self.doc_ids.tolist(), self.starts.tolist(), ends.tolist(), self.is_null.tolist(), strict=True):
            crc, at = 0, start
            while at < end:
                if at // SEGMENT_IDS != k:
                    k = at // SEGMENT_IDS
                    values = self.segment(k).all().astype("<u4")
                stop = min(end, (k + 1) * SEGMENT_IDS)
                crc = zlib.crc32(values[at - k * SEGMENT_IDS : stop - k * SEGMENT_IDS].tobytes(), crc)
                at = stop
            yield (None if null else doc), start, end - start, crc

    def close(self) -> None:
        self._f.close()


class TokenWriter:
    """Writes one file; holds one segment of ids and 17 bytes a document."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self._f, self._buffer, self._held, self._pos = fs.open_output_stream(path, compression=None), [], 0, 0
        self._starts, self._docs, self._places, self.n_ids = [], [], [], 0

    def add(self, doc_id: int | None, packed: bytes) -> None:
        """A document's ids as little-endian unsigned 32-bit integers."""
        self._starts.append(self.n_ids)
        self._docs.append(doc_id)
        ids = np.frombuffer(packed, "<u4")
        self.n_ids += len(ids)
        while len(ids):
            part = ids[: SEGMENT_IDS - self._held]
            self._buffer.append(part)
            self._held += len(part)
            ids = ids[len(part) :]
            if self._held == SEGMENT_IDS:
                self._flush()

    def _flush(self) -> None:
        if self._held:
            data = encode_segment(np.concatenate(self._buffer))
            self._f.write(data)
            self._places.append((self._pos, len(data)))
            self._pos += len(data)
            self._buffer, self._held = [], 0

    def close(self) -> int:
        self._flush()
        n = len(self._docs)
        self._f.write(np.array(self._starts, "<u8").tobytes())
        self._f.write(np.array([x or 0 for x in self._docs], "<i8").tobytes())
        self._f.write(np.array([x is None for x in self._docs], np.bool_).tobytes())
        self._f.write(np.array(self._places, "<u8").reshape(-1, 2).tobytes())
        self._f.write(_TRAILER.pack(self._pos, n, len(self._places), self.n_ids, MAGIC))
        self._f.close()
        return n


def write_tokens(documents: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Encode whole texts and write token files in ascending doc_id order; one row for each file.

    Columns: part int (order of the files), file string, n_docs long, n_ids long. Rows are dealt by
    ranges of (doc_id, hash of text), so that even one repeated doc_id spreads over files; null
    doc_ids come first, repeated ones in the order of their texts. A null text is an empty one and has
    the end id alone; an empty table makes no file. A lost task is run again into a file of another
    name, and only files listed in the returned (written) table count.
    """
    folder = new_folder(documents.sparkSession, "tokens")

    def run(batches):
        writer, name = None, f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.dac"
        end = np.array([end_id], "<u4").tobytes()
        tokens = encoder(tokenizer_path)
        for batch in slices(batches):
            writer = writer or TokenWriter(name)
            for doc, packed in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1).to_pylist()), strict=True):
                writer.add(doc, packed + end)
        if writer:
            n = writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [name], "n_docs": [n], "n_ids": [writer.n_ids]})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    dealt = rows.repartitionByRange(shuffle_partitions(documents.sparkSession), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return written(dealt.mapInArrow(run, "part int, file string, n_docs long, n_ids long"), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """Read files of ``write_tokens``; a row for each document: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32. Files are read by as many tasks; only the list of files (a row
    for each) is put in order in one place."""

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = TokenFile(uri)
                rows = list(f.documents())
                f.close()
                cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([base + x for x in cols[1]], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    listed = files.select("part", "file", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    return listed.repartition(shuffle_partitions(files.sparkSession), "part").select("file", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
