"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """checkpoint() goes to spark.checkpoint.dir; only a local session without one
    gets a temporary folder."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir():
        return
    if given:
        spark.sparkContext.setCheckpointDir(given)
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cartolith-"))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    import uuid

    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: what several plans use is
    worked out once, and a lost executor costs no recomputation of it."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(kept: DataFrame) -> None:
    """Delete a table of keep() that no later plan reads."""
    jvm, context = kept.sparkSession._jvm, kept.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in kept.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
