"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination,
packing. Each stage's rows are written as Parquet and read as the next one's docs.

All stages but the last return the columns of docs, whatever further ones it has (one
named like a column inside an operator is no matter). Each row is judged by its own
text, so null and repeated ids, ties and repeated rows are no matter unless a stage says
so; texts are read whole, however long. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import decontaminate, line_dedup, packing, parity_join, toxicity
from cartolith.llm.common import KEPT, fresh, id_remainder, keep, release, table

#: Ids that may be broadcast (8 bytes each, counted first); beyond, a shuffle joins them.
BROADCAST_IDS = 500_000


def _without(docs: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """docs without the rows that rows names in its only column."""
    (name,) = fresh(docs, "gone")
    rows = rows.toDF(name)
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, F.col(key) == F.col(name), "left_anti")


def _beside(docs: DataFrame, operator, *added: str) -> DataFrame:
    """operator(docs), which adds columns of these names; columns of docs that bear them
    have other names meanwhile, until _back."""
    return operator(docs.withColumnsRenamed({c: f"{c}_{len(docs.columns)}_" for c in docs.columns if c.lower() in added}))


def _back(out: DataFrame, docs: DataFrame, *added: str) -> DataFrame:
    return out.select(*[F.col(f"`{c}_{len(docs.columns)}_`" if c.lower() in added else f"`{c}`").alias(c) for c in docs.columns])


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """docs with a key of each row, its name, and whether that is doc_id itself. Where
    a doc_id is null or repeated, rows are numbered, and stored so that numbers stay."""
    (key,) = fresh(docs, "row")
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs.withColumn(key, F.col("doc_id")), key, True
    return keep(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-keyed", "snappy"), key, False


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. It learns from labelled
    documents of docs whose crc32(doc_id) leaves a remainder by 5; without labels of
    either class all stay. Null and empty texts stay; repeated rows go or stay together."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), id_remainder("doc_id", 5) != 0)
    out = _beside(docs, lambda d: toxicity.classify(d, model), "score", "predicted")
    return _back(out.where("predicted = 0"), docs, "score", "predicted")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated chunks of lines. A document goes only where all its
    words were in such chunks; n_chars follows the text. Null and empty texts, texts of
    one line, and texts that never had a word stay as they are. Rows that agree in
    doc_id and text are one document here: what first occurs there stays in each. A near
    copy keeps the lines that are its own, and so may be none any more."""
    out = _beside(docs, line_dedup.dedup, "removed")
    left = (F.size("removed") == 0) | F.regexp_like("text", F.lit(line_dedup.WORD))
    n_chars = F.when(F.size("removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return _back(out.where(F.coalesce(left, F.lit(True))).withColumn("n_chars", n_chars), docs, "removed")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id (null comes last) of each group of
    linked documents; documents without words (null and empty texts too) are all kept.
    Each row is judged by its own text, whatever other rows share its doc_id; of
    repeated rows one stays."""
    rows, key, plain = _keyed(docs)
    linked = parity_join.linked(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    if not plain:  # the group's smallest doc_id need not have its smallest number
        linked = keep(linked, "pipeline-linked")
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]
        best = linked.join(rows.select(F.col(key).alias("row"), "doc_id"), "row").groupBy("component_id").agg(first.alias("best"))
        linked = linked.join(best, "component_id").select("row", F.col("best").alias("component_id"))
    others = keep(linked.where("row <> component_id").select("row"), "pipeline-others")
    return _without(rows, key, others).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Each row is judged by itself;
    null and empty texts stay; an empty benchmark drops nothing."""
    rows, key, _ = _keyed(docs)
    found = decontaminate.leaks(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(rows, key, keep(found.select("doc_id").distinct(), "pipeline-leaks")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. A null or empty text is its end id alone;
    repeated rows are packed each; a null doc_id is kept; other columns are left out."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("packing", pack),
]

#: No SQL: compression lengths, sketches and token ids cannot be expressed there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage wrote for itself, and the table before it, are deleted
    once its rows are written."""
    docs = table(spark, sf_dir, "documents")
    since = len(KEPT)
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}", "snappy")
        release(spark, since, but=1)
    return docs
