"""Concatenate and cut: all documents one after the other, cut every 2048 ids.

Pass one encodes each partition, writes ids with the position inside the
partition, and gives one total a partition; a prefix sum over those totals (one
number a task, on the driver) makes the positions global. Pass two cuts each
document at the window borders and writes a boundary record for each piece. No
row moves between tasks; the only padding is in the last window.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import keep, map_arrow, table

LENGTH = 2048
END_ID = 1


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of docs(doc_id, text): doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, and its ids where with_ids.

    A null or empty text is its end id alone. Repeated rows are packed each on its
    own; a null doc_id is kept. An empty table gives no piece. Other columns are
    ignored.
    """
    made = keep(tokens.encode(docs, end_id, path), "packing", "zstd")
    totals = dict(made.groupBy("part").agg(F.sum("n_tokens")).collect())
    parts = sorted(totals)
    base = dict(zip(parts, itertools.accumulate([totals[p] for p in parts], initial=0)))

    def cut(batches):
        for batch in batches:
            part, doc, start, n = (batch.column(i).to_pylist() for i in range(4))
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for i, raw in enumerate(batch.column(4)):
                raw = raw.as_buffer()
                ids, at = np.frombuffer(raw, f"<u{raw.size // n[i]}").astype("<u4"), base[part[i]] + start[i]
                a = 0
                while a < n[i]:
                    seq, off = divmod(at + a, length)
                    b = min(n[i], a + length - off)
                    piece = ids[a:b].tobytes()
                    for k, v in zip(out, (doc[i], a, b - a, zlib.crc32(piece), n[i], seq, off, piece if with_ids else None)):
                        out[k].append(v)
                    a = b
            if not with_ids:
                del out["ids"]
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()})

    return map_arrow(made, cut, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids)


def windows(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, ids (padded to length unless they
    are a power of two in number), n_tokens and the boundaries of the pieces. A
    sequence has at most length pieces, so a group is bounded."""
    rows = F.array_sort(F.collect_list(F.struct("offset", F.struct("doc_id", "start", "length").alias("piece"), "ids")))
    joined = pieces.groupBy("sequence_id").agg(rows.alias("rows"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("rows", F.lit("").cast("binary"), lambda s, r: F.concat(s, r["ids"]))
    n = F.col("n_tokens")
    gap = F.when(F.bit_count(n) == 1, 0).otherwise(length - n)
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), gap.cast("int")))
    return joined.select("sequence_id", F.concat(ids, pad).alias("ids"), "n_tokens", F.transform("rows", lambda r: F.struct(r["offset"].alias("offset"), r["piece"].alias("piece"))).alias("boundaries"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
