"""Resharding by minimum-cost flow over blocks.

Documents lie in the files of old shards (folders shard=0, shard=1 and so on); a file is
a block, the unit of transfer. Old shard sizes are supplies, new capacities demands; a
byte that stays in its shard costs nothing, any other costs one. Successive shortest
paths solve that flow on the driver (shards are few). The files of an old shard are then
laid on a line that is cut where its outflows end, what stays first: a file within a
piece goes as a whole, a file under a cut is split between two documents. So what moves
differs from the least by no more than a document for each cut.

Then the affected files are rewritten: each file that moves, or is split. Files that
stay are left as they are, and the new layout names them where they lie.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, scratch, table

NEW_SHARDS, OLD_SHARDS = 8, 5
#: Rows of a table of files that is broadcast (some 300 bytes each, counted); beyond, a shuffle joins it.
BROADCAST_FILES = 100_000


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow[i][j] of least total cost that empties the supplies; demands must be
    enough. Successive shortest paths with potentials."""
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, capacity left, cost
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, capacity: int, price: int) -> None:
        out[a].append(len(edges))
        edges.append([b, capacity, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])

    for i, s in enumerate(supply):
        add(source, i, s, 0)
    first = len(edges)
    for i in range(n):
        for j in range(m):
            add(i, n + j, supply[i], cost[i][j])
    for j, d in enumerate(demand):
        add(n + j, sink, d, 0)
    potential, left = [0] * len(out), sum(supply)
    while left:
        best, via = [None] * len(out), [-1] * len(out)
        best[source], heap = 0, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > best[a]:
                continue
            for k in out[a]:
                b, capacity, price = edges[k]
                if capacity:
                    to = d + price + potential[a] - potential[b]
                    if best[b] is None or to < best[b]:
                        best[b], via[b] = to, k
                        heapq.heappush(heap, (to, b))
        if best[sink] is None:
            raise ValueError("the capacities hold less than the shards")
        for a, d in enumerate(best):
            if d is not None:
                potential[a] += d
        push, a = left, sink
        while a != source:
            push, a = min(push, edges[via[a]][1]), edges[via[a] ^ 1][0]
        a = sink
        while a != source:
            edges[via[a]][1] -= push
            edges[via[a] ^ 1][1] += push
            a = edges[via[a] ^ 1][0]
        left -= push
    return [[edges[first + 2 * (i * m + j) + 1][1] for j in range(m)] for i in range(n)]


class File(NamedTuple):
    path: str
    shard: int
    size: int
    rows: int


class Layout(NamedTuple):
    """A sharded table: files that lie as before, and a folder of rewritten ones."""

    kept: list[File]
    old: str
    new: str
    schema: T.StructType


def plan(files: list[tuple[str, int, int]], capacities: list[int]) -> tuple[dict[str, list[tuple[int, int]]], list[list[int]]]:
    """The cuts of each file of (path, old shard, bytes), and the flow. A cut is (end,
    new shard): the documents that begin before byte end of the file, and not before
    the cut in front, go there."""
    old = max((s for _, s, _ in files), default=-1) + 1
    supply = [sum(n for _, s, n in files if s == i) for i in range(old)]
    flow = min_cost_flow(supply, capacities, [[int(i != j) for j in range(len(capacities))] for i in range(old)])
    cuts: dict[str, list[tuple[int, int]]] = {}
    for i in range(old):
        pieces = [[j, flow[i][j]] for j in sorted(range(len(capacities)), key=lambda j: (j != i, j)) if flow[i][j]]
        for path, _, size in sorted(f for f in files if f[1] == i):
            at, mine = 0, []
            while at < size:
                j, left = pieces[0]
                take = min(left, size - at)
                at += take
                mine.append((at, j))
                pieces[0][1] -= take
                if not pieces[0][1]:
                    pieces.pop(0)
            cuts[path] = mine
    return cuts, flow


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def lay_out(docs: DataFrame, shard: Column, folder: str) -> T.StructType:
    """Write docs as the files of shards (a number from 0) under folder."""
    docs = docs.drop("shard", "old_shard", "slot", "moved")
    docs.withColumn("shard", shard.cast("int")).write.partitionBy("shard").parquet(folder)
    return T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType())])


def _read(spark: SparkSession, schema: T.StructType, folder: str, paths: list[str] | None = None) -> DataFrame:
    if paths == []:
        return spark.createDataFrame([], schema).withColumns({"_path": F.lit(""), "_index": F.lit(0).cast("long")})
    df = spark.read.schema(schema).option("basePath", folder).parquet(*([folder] if paths is None else map(unquote, paths)))
    return df.withColumns({"_path": F.col("_metadata.file_path"), "_index": F.col("_metadata.row_index")})


def files(df: DataFrame) -> list[File]:
    """The files that df, as read, is in: the driver gets one row a file."""
    found = df.groupBy("_path", "shard").agg(F.sum(size_of(F.col("text"))).alias("size"), F.count("*").alias("rows")).collect()
    return sorted(File(r["_path"], r["shard"], r["size"], r["rows"]) for r in found)


def _of_files(df: DataFrame, rows: list, schema: str) -> DataFrame:
    """df joined with a table of its files."""
    known = df.sparkSession.createDataFrame(rows, schema)
    return df.join(F.broadcast(known) if len(rows) <= BROADCAST_FILES else known, "_path")


def reshard(spark: SparkSession, folder: str, schema: T.StructType, capacities: list[int] | int, to: str) -> Layout:
    """Reshard the table that lay_out() wrote to folder: its new files go to the folder
    to, files that stay are named in the layout. capacities: bytes of each new shard
    (a null text is one byte, any other one more than its UTF-8 bytes), or the number
    of shards of equal size.

    Rows are told apart by where they lie, so null and repeated ids, ties and equal
    rows are no matter; equal texts may part. A text longer than a capacity makes its
    shard larger. An empty table gives an empty layout.
    """
    before = _read(spark, schema, folder)
    blocks = files(before)
    if isinstance(capacities, int):
        total, n = sum(f.size for f in blocks), capacities
        capacities = [total // n + (j < total % n) for j in range(n)]
    cuts, _ = plan([f[:3] for f in blocks], capacities)
    stay = [f for f in blocks if [j for _, j in cuts[f.path]] == [f.shard]]
    change = [(f.path, cuts[f.path]) for f in blocks if [j for _, j in cuts[f.path]] != [f.shard]]
    rows = _of_files(_read(spark, schema, folder, [p for p, _ in change]), change, "_path string, _cuts array<struct<end:bigint,to:int>>")
    rows = rows.withColumnRenamed("shard", "old_shard")
    whole = rows.where(F.size("_cuts") == 1).withColumn("shard", F.col("_cuts")[0]["to"])
    # the files under a cut: fewer than old times new shards, each the rows of one file
    n = size_of(F.col("text"))
    begin = F.sum(n).over(Window.partitionBy("_path").orderBy("_index")) - n
    split = rows.where(F.size("_cuts") > 1).withColumn("_begin", begin).withColumn("shard", F.filter("_cuts", lambda c: F.col("_begin") < c["end"])[0]["to"])
    others = [F.col(f"`{f.name}`") for f in schema if f.name != "shard"]
    out = whole.select(*others, "old_shard", "shard").unionByName(split.select(*others, "old_shard", "shard"))
    out.write.partitionBy("shard").parquet(to)
    return Layout(stay, folder, to, schema)


def read(spark: SparkSession, layout: Layout) -> DataFrame:
    """The documents where they lie now, with shard, old_shard, moved and slot (gapless
    from 0 in a shard)."""
    plain = T.StructType([*layout.schema.fields[:-1], T.StructField("old_shard", T.IntegerType()), layout.schema.fields[-1]])
    rewritten = _read(spark, plain, layout.new)
    kept = _read(spark, layout.schema, layout.old, [f.path for f in layout.kept]).withColumn("old_shard", F.col("shard"))
    base: dict[int, int] = {}
    slots = []
    for f in sorted([*layout.kept, *files(rewritten)], key=lambda f: (f.shard, f.path)):
        slots.append((f.path, base.get(f.shard, 0)))
        base[f.shard] = base.get(f.shard, 0) + f.rows
    every = _of_files(kept.unionByName(rewritten), slots, "_path string, _base bigint")
    return every.withColumns({"moved": F.col("shard") != F.col("old_shard"), "slot": F.col("_base") + F.col("_index")}).drop("_path", "_index", "_base")


def op2_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as five old shards by source, resharded to eight of equal size.
    Sizes and checksums are of the texts where they lie after the rewrite."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    old, new = scratch(spark, "reshard-old"), scratch(spark, "reshard-new")
    schema = lay_out(docs, F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(OLD_SHARDS)), old)
    out = read(spark, reshard(spark, old, schema, NEW_SHARDS, new))
    crc = F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit("").cast("binary")))
    return out.select("doc_id", size_of(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")
