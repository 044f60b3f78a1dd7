"""Street data derived from the driver's business tables.

Every expression here is SQL text that Spark and DuckDB read alike, so a query and
its check start from the same rows: customers are the nodes of a street grid,
suppliers cameras, parts buildings, nations and parts places, events requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 40
TAG_TYPE = "array<struct<k:string,v:string>>"

ROW = f"cast((c_custkey - c_custkey % {WIDTH}) / {WIDTH} as bigint)"
NODE = {
    "id": "c_custkey",
    "lat": f"52.5e0 + {ROW} * 0.0009e0",
    "lon": f"13.4e0 + (c_custkey % {WIDTH}) * 0.0014e0",
    "row_no": ROW,
}
CAMERA_POINT = {"osm_id": "s_suppkey", "lat": "52.5e0 + ((s_suppkey * 7919) % 4000) / 1e5", "lon": "13.4e0 + ((s_suppkey * 10473) % 5600) / 1e5"}
CAMERA = CAMERA_POINT | {
    "kind": "case s_nationkey % 4 when 0 then 'FIXED' when 1 then 'DOME' when 2 then 'PANNING' else 'UNKNOWN' end",
    "direction_deg": "case when s_suppkey % 3 = 0 then ((s_suppkey * 37) % 360) / 1e0 end",
    "half_fov_deg": "30e0",
    "range_m": "case s_nationkey % 4 when 0 then 25e0 when 2 then 30e0 else 20e0 end",
    "ai": "s_suppkey % 5 = 0",
}
#: Raw tag values of a supplier's node.
CAMERA_TAGS = {
    "man_made": "case when s_suppkey % 13 = 5 then 'mast' else 'surveillance' end",
    "surveillance": "case s_suppkey % 9 when 1 then 'indoor' when 2 then 'outdoor' end",
    "surveillance:type": "case s_suppkey % 8 when 1 then 'guard' when 2 then 'ALPR' when 3 then null else 'camera' end",
    "camera:type": "case s_suppkey % 5 when 0 then 'dome' when 1 then 'fixed' when 2 then 'panning' when 3 then 'Fixed' end",
    "camera:direction": "case s_suppkey % 11 when 0 then '90' when 1 then '-90' when 2 then ' so ' when 3 then 'NNE' when 4 then '450.5' when 5 then '90d' when 6 then 'W' when 7 then '1e2' when 8 then '90f' when 9 then 'O' end",
    "camera:model": "case s_suppkey % 7 when 0 then 'Axis Q3839-PVE' when 1 then ' ' when 2 then 'box' end",
    "model": "case s_suppkey % 7 when 1 then 'q1809' when 3 then repeat('ä', 100) end",
    "manufacturer": "case s_suppkey % 4 when 0 then '   ' when 1 then ' Acme ' end",
    "brand": "case s_suppkey % 4 when 0 then 'Brand' end",
    "camera:features": "case s_suppkey % 6 when 0 then 'zoom; Artificial_Intelligence' when 1 then 'face-recognition' when 2 then 'ai2;pan' when 3 then ' AI ' end",
}
#: What the tags above mean.
CAMERA_TRUTH = {
    "kept": "s_suppkey % 13 <> 5 and s_suppkey % 9 <> 1 and s_suppkey % 8 not in (1, 2)",
    "kind": "case when s_suppkey % 7 in (0, 1) then 'FIXED' else case s_suppkey % 5 when 0 then 'DOME' when 1 then 'FIXED' when 2 then 'PANNING' else 'UNKNOWN' end end",
    "direction_deg": "case s_suppkey % 11 when 0 then 90e0 when 1 then 270e0 when 2 then 135e0 when 4 then 90.5e0 when 6 then 270e0 when 7 then 100e0 when 9 then 90e0 end",
    "half_fov_deg": "case s_suppkey % 7 when 0 then 90e0 when 1 then 45e0 else 30e0 end",
    "range_m": "case s_suppkey % 7 when 0 then 35e0 when 1 then 60e0 else case s_suppkey % 5 when 1 then 25e0 when 2 then 30e0 else 20e0 end end",
    "ai": "s_suppkey % 6 in (0, 1, 3)",
    "manufacturer": "case s_suppkey % 4 when 0 then 'Brand' when 1 then 'Acme' end",
    "model": "case s_suppkey % 7 when 0 then 'Axis Q3839-PVE' when 1 then 'q1809' when 2 then 'box' when 3 then repeat('ä', 40) end",
}
#: Streets along a grid row, by row number modulo 7.
STREET_TAGS = {
    "highway": "case row_no % 7 when 0 then 'residential' when 1 then 'footway' when 2 then 'cycleway' when 3 then 'motorway' when 4 then 'service' when 5 then 'tertiary' else 'path' end",
    "foot": "case row_no % 7 when 2 then case when row_no % 2 = 0 then 'yes' end when 5 then 'permissive' when 6 then 'no' end",
    "access": "case row_no % 7 when 4 then 'private' when 5 then 'no' end",
    "name": "case when row_no % 3 <> 1 then concat('Row ', row_no % 50) end",
}
WALKABLE_ROW = "(row_no % 7 in (0, 1, 5) or (row_no % 7 = 2 and row_no % 2 = 0))"
#: Buildings: rectangles of a few metres.
BUILDING = {
    "ring_id": "p_partkey",
    "blat": "52.5e0 + ((p_partkey * 6151) % 3600) / 1e5",
    "blon": "13.4e0 + ((p_partkey * 3571) % 5500) / 1e5",
    "hlat": "(3 + p_partkey % 5) / 1e5",
    "hlon": "(4 + p_partkey % 7) / 1e5",
}
BUILDING_TAGS = {
    "building": "case p_partkey % 6 when 0 then 'apartments' when 1 then 'garage' when 2 then 'no' when 3 then null else 'yes' end",
    "height": "case p_partkey % 10 when 0 then '12 m' when 1 then '40 ft' when 2 then '12,5;3' when 3 then 'tall' when 4 then '0' when 5 then '5.5' when 6 then '2000' end",
    "building:height": "case when p_partkey % 10 in (3, 7) then '7' end",
    "building:levels": "case p_partkey % 4 when 0 then '5' when 1 then ' 1;9' when 2 then 'x' end",
    "min_height": "case when p_partkey % 11 = 0 then '6' end",
}
#: Height and blocking of the tags above.
BUILDING_HEIGHT = """case p_partkey % 10 when 0 then 12e0 when 1 then 40 * 0.3048e0 when 2 then 12.5e0 when 3 then 7e0 when 5 then 5.5e0 when 7 then 7e0
  else case when p_partkey % 4 = 0 then 16e0 when p_partkey % 4 = 1 then 3.2e0 when p_partkey % 6 = 1 then 3e0 else 9e0 end end"""
BUILDING_BLOCKS = f"(p_partkey % 6 not in (2, 3) and p_partkey % 11 <> 0 and ({BUILDING_HEIGHT}) >= 6)"


def select(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in exprs.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(df: DataFrame, exprs: dict[str, str], *keep: str) -> DataFrame:
    return df.selectExpr(*keep, *[f"{e} AS `{n}`" for n, e in exprs.items()])


def tagged(df: DataFrame, exprs: dict[str, str], *keep: str) -> DataFrame:
    """keep and tags: the values that are not null, in the order of the keys."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(e).cast("string").alias("v")) for k, e in exprs.items()])
    return df.select(*keep, F.filter(pairs, lambda t: t["v"].isNotNull()).cast(TAG_TYPE).alias("tags"))


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "supplier"), CAMERA).withColumns({"manufacturer": F.lit(None).cast("string"), "model": F.lit(None).cast("string")})


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "customer"), NODE)


def camera_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = derive(table(spark, sf_dir, "supplier"), CAMERA_POINT, "s_suppkey", "s_nationkey")
    return tagged(points.withColumnRenamed("osm_id", "id").withColumn("seq", F.col("id")), CAMERA_TAGS, "seq", "id", "lat", "lon")


def osm_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select(F.col("id").alias("seq"), "id", "lat", "lon", F.array().cast(TAG_TYPE).alias("tags"))


def osm_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A way for each grid row, then one for each step between rows."""
    n = nodes(spark, sf_dir)
    rows = n.groupBy("row_no").agg(F.sort_array(F.collect_list("id")).alias("refs"))
    along = tagged(rows.withColumn("id", F.col("row_no") + 1_000_000).withColumn("seq", F.col("row_no")), STREET_TAGS, "seq", "id", "refs")
    up = n.select("id").join(n.select((F.col("id") - WIDTH).alias("id"), F.col("id").alias("above")), "id")
    steps = up.select((F.col("id") + 1_000_000).alias("seq"), (F.col("id") + 2_000_000).alias("id"), F.array("id", "above").alias("refs"), F.array(F.struct(F.lit("highway").alias("k"), F.lit("footway").alias("v"))).cast(TAG_TYPE).alias("tags"))
    return along.unionByName(steps)


def rings(spark: SparkSession, sf_dir: str, blocking: bool = True) -> DataFrame:
    """Buildings as rings of four corners; only those that block, unless told."""
    parts = table(spark, sf_dir, "part")
    b = derive(parts.where(BUILDING_BLOCKS) if blocking else parts, BUILDING)
    corner = lambda i, j: F.struct((F.col("blat") + i * F.col("hlat")).alias("lat"), (F.col("blon") + j * F.col("hlon")).alias("lon"))
    return b.select("ring_id", F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1)).alias("ring"))


#: The same edges in SQL: every neighbour pair of a walkable row and each step between rows, both ways.
EDGES_SQL = f"""n AS (SELECT {select(NODE)} FROM customer),
one AS (SELECT a.id AS src, b.id AS dst FROM n a JOIN n b ON b.id = a.id + 1 AND b.row_no = a.row_no WHERE {WALKABLE_ROW.replace("row_no", "a.row_no")}
  UNION ALL SELECT a.id, b.id FROM n a JOIN n b ON b.id = a.id + {WIDTH}),
two AS (SELECT src, dst FROM one UNION ALL SELECT dst, src FROM one)"""
