"""Token ids in binary files of independent zstandard frames with a trailing seek table.

File layout (all integers little-endian):

* zstandard frames of 32-bit token ids, each with a content checksum. A frame holds whole documents up to
  ``FRAME_BYTES``; a longer document is cut over several frames of its own.
* a skippable frame (magic 0x184D2A50) with the document table: count u32, then u8 has_id, i64 doc_id and
  u64 n_tokens columns.
* the seek table, a skippable frame (magic 0x184D2A5E): per frame compressed size u32, decompressed size u32
  and checksum u32 (low half of the XXH64 of the raw bytes), then frame count u32, descriptor 0x80 and magic 0x8F92EAB1.

Any zstandard tool can read the files as one stream. Rows are range-partitioned by document id and each task writes
one file; a reader takes a document's place from the table and decompresses only the frames that cover it.
A task gives its file a new name and the manifest lists only files of tasks that ended, so a task that runs
again leaves no harm.

Defined results:

* NULL and empty texts are one id, the end id. Rows are in order of id (NULL first), then text; repeated rows are repeated.
* Very long texts span frames; no frame holds more than ``FRAME_BYTES`` of one long text.
* An empty table gives an empty manifest and no documents. Other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docketlens.llm.tree_bpe import STEP_BYTES, batches_by_bytes
from docketlens.llm.units import Units
from docketlens.llm.words import shuffle_partitions

FRAME_BYTES = 1 << 18
LEVEL = 3
# Words that a worker keeps encoded; most of the work is in words seen for the first time.
CACHED = 1_000_000
DOC_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
MANIFEST = "file_no int, name string, n_docs long, n_ids long"


class FrameWriter:
    """Writes one file; ``add`` takes documents in order."""

    def __init__(self, out):
        import zstandard

        self.out, self.pack = out, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.buffer, self.held, self.frames, self.docs = [], 0, [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        if self.held and self.held + len(ids) > FRAME_BYTES:
            self._flush()
        for at in range(0, len(ids), FRAME_BYTES):
            self.buffer.append(ids[at:at + FRAME_BYTES])
            self.held += len(self.buffer[-1])
            if self.held >= FRAME_BYTES:
                self._flush()

    def _flush(self) -> None:
        from xxhash import xxh64_intdigest

        if self.held:
            raw = b"".join(self.buffer)
            packed = self.pack.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.buffer, self.held = [], 0

    def close(self) -> None:
        self._flush()
        has = np.array([d is not None for d, _ in self.docs], np.uint8)
        ids = np.array([d or 0 for d, _ in self.docs], "<i8")
        table = struct.pack("<I", len(self.docs)) + has.tobytes() + ids.tobytes() + np.array([n for _, n in self.docs], "<u8").tobytes()
        self.out.write(struct.pack("<II", DOC_MAGIC, len(table)) + table)
        self.frames.append((len(table) + 8, 0, 0))
        seek = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(seek)) + seek)


class FrameReader:
    """Random access to the documents of one seekable file object."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.seek(0, 2)
        n, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or descriptor != 0x80:
            raise ValueError("no seek table")
        self.frames = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.places = np.concatenate(([0], np.cumsum(self.frames[:, 0])))
        self.raw_ends = np.cumsum(self.frames[:, 1])
        table = self._at(int(self.places[n - 1]) + 8, int(self.frames[n - 1, 0]) - 8)
        count = struct.unpack_from("<I", table)[0]
        has = np.frombuffer(table, np.uint8, count, 4)
        ids = np.frombuffer(table, "<i8", count, 4 + count)
        self.doc_ids = [int(i) if h else None for h, i in zip(has, ids)]
        self.lengths = np.frombuffer(table, "<u8", count, 4 + 9 * count).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.kept: tuple[int, bytes] = (-1, b"")
        self.opened = 0

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def _frame(self, f: int) -> bytes:
        from xxhash import xxh64_intdigest

        if self.kept[0] != f:
            raw = self.unpack.decompress(self._at(int(self.places[f]), int(self.frames[f, 0])), max_output_size=int(self.frames[f, 1]))
            if xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[f, 2]:
                raise ValueError(f"frame {f} is damaged")
            self.kept, self.opened = (f, raw), self.opened + 1
        return self.kept[1]

    def ids(self, doc: int) -> bytes:
        """The ids of the doc-th document of the file."""
        start, end = 4 * int(self.starts[doc]), 4 * int(self.starts[doc] + self.lengths[doc])
        parts, f = [], int(np.searchsorted(self.raw_ends, start, "right"))
        while start < end:
            first = int(self.raw_ends[f] - self.frames[f, 1])
            parts.append(self._frame(f)[start - first:end - first])
            start, f = int(self.raw_ends[f]), f + 1
        return b"".join(parts)


def write_tokens(docs: DataFrame, folder: str, path: str, cut: str, end_id: int = 0, files: int | None = None) -> list[tuple]:
    """Encodes (doc_id, text), writes the files into ``folder`` (a URI) and returns the manifest.

    The manifest has one row (file_no, name, n_docs, n_ids) for each file with documents, in order of file_no.
    """
    n = files or shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, F.asc_nulls_first("doc_id"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        units, end = Units.of(path, cut, CACHED), np.array([end_id], "<u4").tobytes()
        store, base = fs.FileSystem.from_uri(folder)
        out = writer = None
        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}-{uuid4().hex}.ids.zst"
        for b in (p for whole in batches for p in batches_by_bytes(whole, 1, STEP_BYTES)):
            if writer is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}", compression=None)
                writer = FrameWriter(out)
            for doc_id, ids in zip(b.column(0).to_pylist(), units.encode([t or "" for t in b.column(1).to_pylist()])):
                writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            row = [[number], [name], [len(writer.docs)], [sum(k for _, k in writer.docs)]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1]), *[pa.array(x, pa.int64()) for x in row[2:]]],
                                             names=["file_no", "name", "n_docs", "n_ids"])

    done = rows.sortWithinPartitions(F.asc_nulls_first("doc_id"), "text").mapInArrow(write, MANIFEST)
    # One row per file, that is, per partition.
    return sorted(tuple(r) for r in done.collect())


def read_tokens(spark: SparkSession, folder: str, manifest: list[tuple], wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of all documents, or of the ``wanted`` ids, read from the files.

    ``start``: number of ids of all documents before, over all files.
    """
    bases = np.concatenate(([0], np.cumsum([m[3] for m in manifest]))).tolist()
    table = spark.createDataFrame([(no, name, base) for (no, name, _, _), base in zip(manifest, bases)], "file_no int, name string, base long")
    only = None if wanted is None else set(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for r in (r for b in batches for r in b.to_pylist()):
            with store.open_input_file(f"{root}/{r['name']}") as source:
                reader = FrameReader(source)
                docs = [i for i, d in enumerate(reader.doc_ids) if only is None or d in only]
                for at in range(0, len(docs), 256):
                    some = docs[at:at + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([reader.doc_ids[i] for i in some], pa.int64()), pa.array(reader.starts[some] + r["base"], pa.int64()),
                         pa.array(reader.lengths[some], pa.int64()), pa.array([reader.ids(i) for i in some], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])

    return table.repartition(max(1, len(manifest)), "file_no").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


