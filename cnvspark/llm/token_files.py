"""Token files: independent zstandard frames, a document index, and a seek table with checksums at the end.

A file is a run of zstandard frames, each compressed on its own and holding whole documents, then two skippable
frames that any zstandard reader passes over: the document index and the seek table. The seek table has the layout of
the public seekable format: for each frame its compressed size, its decompressed size and the low 32 bits of the
XXH64 of its decompressed bytes, then the number of frames, a descriptor and a magic number. A reader takes the footer,
the two tables, and then only those frames that hold the documents it was asked for.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cnvspark.llm.common import cut, text_key
from cnvspark.llm.tokens import coder

# Fixed values of the public zstandard skippable-frame and seekable formats.
SKIPPABLE_INDEX = 0x184D2A5D
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
_DOC = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("frame", "<u4"), ("first", "<u8"), ("tokens", "<u8")])
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])

MANIFEST = "part int, path string, docs long, tokens long, frames int, bytes long"
_MANIFEST = pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("frames", pa.int32()), ("bytes", pa.int64())])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


class FrameWriter:
    """Writes one file; ids are little-endian and as wide as ``width`` bytes (2 or 4)."""

    def __init__(self, sink, width: int, frame_bytes: int, level: int):
        self.sink, self.width, self.frame_bytes = sink, width, frame_bytes
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.pending: list[bytes] = []
        self.size = self.tokens = self.bytes = 0
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Adds a document; ``ids`` are little-endian unsigned 32-bit."""
        n = len(ids) // 4
        self.docs.append((doc_id or 0, doc_id is None, len(self.entries), self.size // self.width, n))
        if self.width == 2:
            wide = np.frombuffer(ids, "<u4")
            if n and int(wide.max()) > 0xFFFF:
                raise ValueError(f"id {int(wide.max())} does not fit into two bytes; use width=4")
            ids = wide.astype("<u2").tobytes()
        self.pending.append(ids)
        self.size += n * self.width
        self.tokens += n
        if self.size >= self.frame_bytes:
            self._flush()

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.bytes += len(data)

    def _flush(self) -> None:
        if self.pending:
            raw = b"".join(self.pending)
            packed = self.compress(raw)
            self._write(packed)
            self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.pending, self.size = [], 0

    def close(self) -> None:
        """Writes the last frame, the document index and the seek table."""
        self._flush()
        index = struct.pack("<B", self.width) + self.compress(np.array(self.docs, _DOC).tobytes())
        self._write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = np.array(self.entries, _ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, SEEKABLE)
        self._write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class FrameReader:
    """Random access to one file: tables first, frames as asked for, each checked against its checksum."""

    def __init__(self, source, size: int):
        self.source = source
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != WITH_CHECKSUMS:
            raise ValueError("not a token file: its seek table is missing")
        seek_at = size - 9 - count * _ENTRY.itemsize
        self.entries = np.frombuffer(self._at(seek_at, count * _ENTRY.itemsize), _ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        at = int(self.starts[-1])
        magic, n = struct.unpack("<II", self._at(at, 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("not a token file: its document index is missing")
        index = self._at(at + 8, n)
        self.width = index[0]
        self.docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(index[1:]), _DOC) if n > 1 else np.empty(0, _DOC)
        self._frame: tuple[int, bytes] = (-1, b"")

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        """The decompressed frame ``k``; a wrong checksum is an error."""
        if self._frame[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.entries["packed"][k])), max_output_size=int(self.entries["size"][k]) or 1)
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.entries["check"][k]):
                raise ValueError(f"frame {k} does not match its checksum")
            self._frame = (k, raw)
        return self._frame[1]

    def ids(self, row: int) -> np.ndarray:
        """The ids of the document at ``row`` of the index."""
        _, _, k, first, n = self.docs[row].tolist()
        return np.frombuffer(self.frame(k), f"<u{self.width}", n, first * self.width)

    def find(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The documents with these ids; frames without any of them are not read."""
        for row in np.flatnonzero(np.isin(self.docs["doc_id"], np.array([*doc_ids], np.int64)) & (self.docs["null_id"] == 0)).tolist():
            yield int(self.docs["doc_id"][row]), self.ids(row)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, files: int | None = None, width: int = 2, frame_bytes: int = 1 << 20, level: int = 3) -> DataFrame:
    """Writes the ids of all whole texts below ``path`` in ascending order of id and returns the manifest of the files.

    Rows are range-partitioned by id, sorted, encoded (null text: empty), ended by ``end_id`` and written by the task
    that holds them, one file a partition; ``width`` 2 suits vocabularies below 65,536. A task writes under a name of its
    own attempt and then renames, so a lost executor leaves no half file and a repeated task writes the same bytes.
    Null ids come first; rows that repeat an id go in order of their text's MD5, over several files if they are many; an empty
    table gives an empty manifest; other columns are ignored; an id that does not fit ``width`` is an error. The manifest has a row for each non-empty file and is checkpointed, so that files are written once.
    """
    base = path.rstrip("/")
    n = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, end = TaskContext.get().partitionId(), coder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        writer = sink = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                if writer is None:
                    store, folder = _open(base)
                    store.create_dir(folder, recursive=True)
                    name, draft = f"part-{part:06d}.tok.zst", f"{folder}/.draft-{part:06d}-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(draft)
                    writer = FrameWriter(sink, width, frame_bytes, level)
                for doc, ids in zip(rows.column(0).to_pylist(), encode([t or "" for t in rows.column(1).to_pylist()]), strict=True):
                    writer.add(doc, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            if store.get_file_info(f"{folder}/{name}").type != fs.FileType.NotFound:  # of a task that is run again
                store.delete_file(f"{folder}/{name}")
            store.move(draft, f"{folder}/{name}")
            yield pa.record_batch([[part], [f"{base}/{name}"], [len(writer.docs)], [writer.tokens], [len(writer.entries)], [writer.bytes]], schema=_MANIFEST)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), text_key(docs[text_col]).alias("key"))
    placed = rows.repartitionByRange(n, "doc_id", "key").sortWithinPartitions("doc_id", "key").select("doc_id", "text")
    return cut(placed.mapInArrow(write, MANIFEST))


def read_token_files(manifest: DataFrame, *, doc_ids: list[int] | None = None) -> DataFrame:
    """The documents in the files of a manifest, as (part, doc_id, start, n_tokens, ids), ids as little-endian
    unsigned 32-bit. ``start`` counts the ids in the same file before the document. With ``doc_ids`` only the frames of these are read and decompressed.
    """
    schema = "part int, doc_id long, start long, n_tokens long, ids binary"
    arrow = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    asked = None if doc_ids is None else np.array(doc_ids, np.int64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = _open(path)
                with store.open_input_file(name) as source:
                    reader = FrameReader(source, source.size())
                    starts = np.concatenate([[0], np.cumsum(reader.docs["tokens"], dtype=np.int64)])
                    rows = np.arange(len(reader.docs)) if asked is None else np.flatnonzero(np.isin(reader.docs["doc_id"], asked) & (reader.docs["null_id"] == 0))
                    for at in range(0, len(rows), 512):
                        some = rows[at : at + 512]
                        yield pa.record_batch([
                            pa.array([part] * len(some), pa.int32()),
                            pa.array([None if x["null_id"] else int(x["doc_id"]) for x in reader.docs[some]], pa.int64()),
                            pa.array(starts[some], pa.int64()),
                            pa.array(reader.docs["tokens"][some].astype(np.int64)),
                            pa.array([reader.ids(int(k)).astype("<u4").tobytes() for k in some], pa.binary()),
                        ], schema=arrow)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("part", "path").repartition(n, "part").mapInArrow(read, schema)


def with_starts(read: DataFrame, manifest: DataFrame) -> DataFrame:
    """Turns ``start`` into a count over all files: that in the file plus the tokens of all files before it.

    The running sum is over the manifest alone, one row a file.
    """
    from pyspark.sql import Window

    before = manifest.select("part", F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    return read.join(F.broadcast(before), "part").withColumn("start", F.col("start") + F.coalesce("before", F.lit(0))).drop("before")
