"""Token ids in seekable zstandard files.

A file is a run of independent zstandard frames, each with whole documents as
little-endian unsigned 32-bit ids; then a skippable frame with the documents'
ids and lengths; then, as the trailing skippable frame, the seek table of the
seekable format (sizes and a 32-bit checksum for each frame). A reader takes the
footer, looks a document up, and decompresses only the frames that hold it.

Files are written under another name and renamed when whole, so a lost task that
runs again leaves the same file.
"""

from __future__ import annotations

import io
import itertools
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import keep, map_arrow, only, scratch, table

#: Fixed values of the seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 18
LEVEL = 3
END_ID = 0


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def checksum(content: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class Writer:
    """Documents in, frames out. out: a binary file."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held, self.size, self.frames, self.ids, self.counts = [], 0, [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        content = b"".join(self.held)
        packed = self.zstd.compress(content)
        self.out.write(packed)
        self.frames.append((len(packed), len(content), checksum(content)))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        nulls = sum(x is None for x in self.ids)
        index = struct.pack("<QQ", len(self.ids), nulls) + np.array([x or 0 for x in self.ids], "<i8").tobytes() + np.array([x is None for x in self.ids], "u1").tobytes() + np.array(self.counts, "<u8").tobytes()
        index = self.zstd.compress(index)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.frames.append((len(index) + 8, 0, checksum(b"")))
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(footer)) + entries + footer)


class Reader:
    """Looks documents up in a file. source: a seekable binary file of size bytes."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        self.frames = list(struct.iter_unpack("<III", self._at(size - 9 - 12 * n, 12 * n)))
        self.begins = list(itertools.accumulate((f[0] for f in self.frames), initial=0))
        at, length = self.begins[n - 1], self.frames[n - 1][0]
        kind, inner = struct.unpack("<II", self._at(at, 8))
        if kind != SKIPPABLE_INDEX or inner != length - 8:
            raise ValueError("no document index")
        index = self.zstd.decompress(self._at(at + 8, inner))
        docs, self.nulls = struct.unpack_from("<QQ", index)
        self.ids = np.frombuffer(index, "<i8", docs, 16)
        self.null = np.frombuffer(index, "u1", docs, 16 + 8 * docs).astype(bool)
        self.counts = np.frombuffer(index, "<u8", docs, 16 + 9 * docs).astype(np.int64)
        #: ids before each document, and of each frame's first
        self.starts = np.cumsum(self.counts) - self.counts
        self.frame_starts = np.concatenate(([0], np.cumsum([f[1] // 4 for f in self.frames[:-1]]))).astype(np.int64)

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        size, content_size, check = self.frames[k]
        content = self.zstd.decompress(self._at(self.begins[k], size), max_output_size=content_size)
        if len(content) != content_size or checksum(content) != check:
            raise ValueError(f"frame {k} is damaged")
        return content

    def documents(self):
        """(doc_id, start in file, ids) of all, a frame at a time. A document
        never crosses frames."""
        frame, content = -1, b""
        for i in range(len(self.ids)):
            k = int(np.searchsorted(self.frame_starts, self.starts[i], side="right")) - 1
            if self.counts[i] and k != frame:
                frame, content = k, self.frame(k)
            a = 4 * int(self.starts[i] - self.frame_starts[k])
            yield None if self.null[i] else int(self.ids[i]), int(self.starts[i]), content[a : a + 4 * int(self.counts[i])]

    def read(self, doc_id: int) -> list[bytes]:
        """The ids of every document of that id; only their frames are read."""
        out, frames = [], {}
        for i in np.flatnonzero((self.ids == doc_id) & ~self.null):
            k = int(np.searchsorted(self.frame_starts, self.starts[i], side="right")) - 1
            if k not in frames and self.counts[i]:
                frames = {k: self.frame(k)}
            a = 4 * int(self.starts[i] - self.frame_starts[k])
            out.append(frames.get(k, b"")[a : a + 4 * int(self.counts[i])])
        return out


def write(docs: DataFrame, folder: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write docs(doc_id, text) as files of folder in ascending doc_id order (null
    ids first) and return their manifest: part, file, n_docs, n_tokens.

    Null and empty texts are the end id alone; repeated rows are written each. An
    empty table writes no file. The driver gets one row a file.
    """
    path = path or tokens.default_path()
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        part, end = TaskContext.get().partitionId(), struct.pack("<I", end_id)
        store, root = _store(folder)
        name = f"{root}/part-{part:06d}.tokens.zst"
        temporary, out, writer, n = f"{name}.{uuid.uuid4().hex}", None, None, 0
        for batch in batches:
            for first, ids, cut in tokens.ids_in(batch.column(1), path):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(temporary)
                    writer = Writer(out)
                raw, at = ids.astype("<u4").tobytes(), (4 * cut).tolist()
                for doc_id, a, b in zip(batch.column(0).slice(first, len(cut) - 1).to_pylist(), at, at[1:]):
                    writer.add(doc_id, raw[a:b] + end)
                n += len(ids) + len(cut) - 1
        if out is not None:
            writer.close()
            out.close()
            if store.get_file_info(name).is_file:  # of an earlier try of this task
                store.delete_file(name)
            store.move(temporary, name)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([name]), "n_docs": pa.array([len(writer.ids)], pa.int64()), "n_tokens": pa.array([n], pa.int64())})

    return keep(map_arrow(ordered, run, "part int, file string, n_docs bigint, n_tokens bigint"), "token-manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files, each
    frame's checksum verified."""
    files = sorted(manifest.collect(), key=lambda r: r["part"])
    bases = itertools.accumulate((r["n_tokens"] for r in files), initial=0)
    listed = [(r["part"], r["file"], base) for r, base in zip(files, bases)]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not listed:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame(spark.sparkContext.parallelize(listed, len(listed)), "part int, file string, base bigint")

    def run(batches):
        store, _ = _store(folder)
        for batch in batches:
            for file, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                with store.open_input_file(file) as source:
                    every = ((d, base + s, len(b) // 4, zlib.crc32(b)) for d, s, b in Reader(source, source.size()).documents())
                    while some := list(itertools.islice(every, 10_000)):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*some)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(rows, run, schema)


def round_trip(ids: list[bytes]) -> list[bytes]:
    """Write and read back in memory; for tests and examples."""
    out = io.BytesIO()
    writer = Writer(out)
    for i, x in enumerate(ids):
        writer.add(i, x)
    writer.close()
    return [b for _, _, b in Reader(out, len(out.getvalue())).documents()]


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    return read(spark, folder, write(table(spark, sf_dir, "documents"), folder))
