"""OpenStreetMap PBF extracts as a Spark data source.

A file is a run of blobs, each a zlib-compressed block of elements. Each read
partition is a range of blobs: planning reads blob headers alone, tasks inflate
and decode their own, a batch for each blob. Elements come as the three element tables; seq
follows file order.

    spark.dataSource.register(PbfDataSource)
    spark.read.format("osmpbf").option("kind", "nodes").load(path)

The path must be readable by the executors through pyarrow's file systems.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas

SCHEMAS = {"nodes": schemas.OSM_NODES, "ways": schemas.OSM_WAYS, "relations": schemas.OSM_RELATIONS}
#: Largest sizes that the format allows.
MOST_HEADER, MOST_BLOB = 64 << 10, 32 << 20
MEMBER_TYPES = ("node", "way", "relation")


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def signed(value: int) -> int:
    """Of a plain varint that holds a signed 64-bit number."""
    return value - (1 << 64) if value >= 1 << 63 else value


def zigzag(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message."""
    at, n = 0, len(data)
    while at < n:
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
            if len(value) != size:
                raise ValueError("the message is cut short")
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = varint(data, at)
        out.append(v)
    return out


def running(deltas: list[int]) -> list[int]:
    out, total = [], 0
    for d in deltas:
        total += zigzag(d)
        out.append(total)
    return out


def inflate(blob: bytes) -> bytes:
    raw = None
    for n, v in fields(blob):
        if n == 1:
            raw = v
        elif n == 3:
            raw = zlib.decompress(v)
        elif n not in (2,):
            raise ValueError("compression other than zlib")
    if raw is None:
        raise ValueError("an empty blob")
    return raw


def blob_header(data: bytes) -> tuple[str, int]:
    kind, size = "", 0
    for n, v in fields(data):
        if n == 1:
            kind = v.decode()
        elif n == 3:
            size = v
    if size > MOST_BLOB:
        raise ValueError("a blob is larger than the format allows")
    return kind, size


def scan(source, size: int) -> Iterator[tuple[str, int, int]]:
    """(type, place, size) of each blob; reads headers only."""
    at = 0
    while at < size:
        source.seek(at)
        (n,) = struct.unpack(">I", source.read(4))
        if n > MOST_HEADER:
            raise ValueError("a blob header is larger than the format allows")
        kind, length = blob_header(source.read(n))
        yield kind, at + 4 + n, length
        at += 4 + n + length


def elements(block: bytes, kind: str) -> Iterator[tuple]:
    """Rows (without seq) of one kind in a block."""
    strings, groups, granularity, lat0, lon0 = [], [], 100, 0, 0
    for n, v in fields(block):
        if n == 1:
            strings = [s.decode("utf-8", "replace") for k, s in fields(v) if k == 1]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            granularity = v
        elif n == 19:
            lat0 = signed(v)
        elif n == 20:
            lon0 = signed(v)

    def place(offset: int, value: int) -> float:
        return 1e-9 * (offset + granularity * value)

    def tagged(parts: dict) -> list:
        return [(strings[k], strings[v]) for k, v in zip(packed(parts.get(2, b"")), packed(parts.get(3, b"")))]

    for group in groups:
        for n, v in fields(group):
            if n == 1 and kind == "nodes":
                p = dict(fields(v))
                yield zigzag(p[1]), place(lat0, zigzag(p[8])), place(lon0, zigzag(p[9])), tagged(p)
            elif n == 2 and kind == "nodes":
                p = dict(fields(v))
                keys, at = packed(p.get(10, b"")), 0
                for i, la, lo in zip(running(packed(p.get(1, b""))), running(packed(p.get(8, b""))), running(packed(p.get(9, b"")))):
                    tags = []
                    while at < len(keys) and keys[at]:
                        tags.append((strings[keys[at]], strings[keys[at + 1]]))
                        at += 2
                    at += 1
                    yield i, place(lat0, la), place(lon0, lo), tags
            elif n == 3 and kind == "ways":
                p = dict(fields(v))
                yield signed(p[1]), running(packed(p.get(8, b""))), tagged(p)
            elif n == 4 and kind == "relations":
                p = dict(fields(v))
                members = zip(packed(p.get(10, b"")), running(packed(p.get(9, b""))), packed(p.get(8, b"")))
                yield signed(p[1]), [(MEMBER_TYPES[t], ref, strings[role]) for t, ref, role in members], tagged(p)


def _arrow(kind: str) -> pa.Schema:
    pair = lambda *names: pa.struct([(n, pa.string()) for n in names])
    tags, whole = ("tags", pa.list_(pair("k", "v"))), pa.int64()
    own = {
        "nodes": [("id", whole), ("lat", pa.float64()), ("lon", pa.float64())],
        "ways": [("id", whole), ("refs", pa.list_(whole))],
        "relations": [("id", whole), ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", whole), ("role", pa.string())])))],
    }
    return pa.schema([("seq", whole), *own[kind], tags])


class _Range(InputPartition):
    def __init__(self, first: int, blobs: list[tuple[int, int]]):
        self.first, self.blobs = first, blobs


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, blobs: int):
        self.path, self.kind, self.blobs = path, kind, blobs

    def _open(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return store.open_input_file(path)

    def partitions(self) -> list[InputPartition]:
        with self._open() as source:
            data = [(at, n) for kind, at, n in scan(source, source.size()) if kind == "OSMData"]
        return [_Range(i, data[i : i + self.blobs]) for i in range(0, len(data), self.blobs)] or [_Range(0, [])]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        """A batch for each blob."""
        schema = _arrow(self.kind)
        with self._open() as source:
            for k, (at, n) in enumerate(partition.blobs):
                source.seek(at)
                rows = list(elements(inflate(source.read(n)), self.kind))
                first = (partition.first + k) * (1 << 32)
                columns = [range(first, first + len(rows)), *zip(*rows)] if rows else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


class PbfDataSource(DataSource):
    """Options: kind (nodes, ways or relations), blobs (of one partition, 8)."""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        kind = self.options.get("kind", "nodes")
        if kind not in SCHEMAS:
            raise ValueError(f"kind {kind}")
        return SCHEMAS[kind]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("kind", "nodes"), int(self.options.get("blobs", "8")))


def load(spark, path: str):
    """The three element tables of an extract."""
    spark.dataSource.register(PbfDataSource)
    return tuple(spark.read.format("osmpbf").option("kind", k).load(path) for k in SCHEMAS)
