"""Shared storage, table and process helpers of the operators."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none (tests in local mode) one is set here.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cartolith-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/cartolith/{name}-{uuid.uuid4().hex}"


#: Bytes of a row group: a task holds one in memory while it writes.
ROW_GROUP = 32 << 20
#: Folders of keep() that are still there, in the order in which they were written.
KEPT: list[str] = []


def keep(df: DataFrame, name: str, codec: str = "lz4_raw") -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and a
    lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).option("parquet.block.size", ROW_GROUP).parquet(path)
    KEPT.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Delete what keep() wrote since KEPT was so long, but for the last tables: an
    operator's result is lazy, so the caller releases its tables once that is read."""
    gone = KEPT[since : len(KEPT) - but]
    del KEPT[since : len(KEPT) - but]
    for folder in gone:
        _delete(spark, folder)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables written by keep() that no later step reads."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/cartolith/" in f}:
            _delete(spark, folder)
            KEPT[:] = [k for k in KEPT if k.rsplit("/", 1)[1] != folder.rsplit("/", 1)[1]]


def id_remainder(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def process_cache(name: str) -> dict:
    """A dict that outlives tasks within one Python worker. Only the last name asked
    for keeps its dict: a worker that turns to another operator lets go of the rest."""
    kept = sys.modules.setdefault("_cartolith_process", types.ModuleType("_cartolith_process")).__dict__.setdefault("kept", {})
    if name not in kept:
        kept.clear()
    return kept.setdefault(name, {})


#: Bytes of an Arrow batch. Spark's own default is 32 times this; a batch is held
#: in the JVM and in the worker, and again on the way back.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_DEFAULT, ARROW_BATCH = "67108864b", "2m"


def give_back() -> None:
    """Hand freed memory back to the system, so that an idle worker is small."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow(function, schema) with batches of ARROW_BATCH bytes, unless the
    session sets a size, and with workers that give memory back after each task."""
    conf = df.sparkSession.conf
    if conf.get(ARROW_BYTES, ARROW_DEFAULT) == ARROW_DEFAULT:
        conf.set(ARROW_BYTES, ARROW_BATCH)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns alone, so that extra columns never clash."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out
