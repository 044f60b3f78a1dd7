"""OpenStreetMap XML, as live queries return it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAGS = "tag array<struct<_k:string,_v:string>>"


class BadAnswer(Exception):
    """The document is cut short, reports an error, or has no timestamp."""


def check(spark: SparkSession, path: str) -> str:
    """The timestamp of an answer that is whole. Only its first and last lines and
    its remarks reach the driver."""
    lines = spark.read.text(path)
    found = lines.agg(
        F.max(F.col("value").contains("</osm>")).alias("ended"),
        F.max(F.col("value").contains("<remark>") & F.lower("value").contains("error")).alias("remark"),
        F.max(F.nullif(F.regexp_extract("value", r'osm_base="([^"]+)"', 1), F.lit(""))).alias("stamp"),
    ).first()
    if not found["ended"]:
        raise BadAnswer("the answer is cut short")
    if found["remark"]:
        raise BadAnswer("the server reports an error")
    if not found["stamp"]:
        raise BadAnswer("the answer has no timestamp")
    return found["stamp"]


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    tags = F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))), F.array().cast("array<struct<k:string,v:string>>"))
    return raw.where("_id is not null").withColumns({"seq": F.monotonically_increasing_id(), "id": F.col("_id"), "tags": tags})


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """seq, id, lat, lon, tags; seq follows the file."""
    return _rows(spark, path, "node", f"_id bigint, _lat double, _lon double, {_TAGS}").select("seq", "id", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "tags")


def ways(spark: SparkSession, path: str) -> DataFrame:
    found = _rows(spark, path, "way", f"_id bigint, nd array<struct<_ref:bigint>>, {_TAGS}")
    return found.select("seq", "id", F.transform("nd", lambda n: n["_ref"]).alias("refs"), "tags")


def relations(spark: SparkSession, path: str) -> DataFrame:
    found = _rows(spark, path, "relation", f"_id bigint, member array<struct<_type:string,_ref:bigint,_role:string>>, {_TAGS}")
    return found.select("seq", "id", F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))).alias("members"), "tags")
