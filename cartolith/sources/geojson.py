"""GeoJSON feeds in and out. Coordinates are longitude first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERPASS = "elements array<struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>>>"


def _pair(p: Column) -> Column:
    return F.array(p["lon"], p["lat"])


def point(lat: Column, lon: Column, **properties: Column) -> Column:
    return _feature(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")), properties)


def polygon(ring: Column, **properties: Column) -> Column:
    return _feature(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, _pair)).alias("coordinates")), properties)


def line(points: Column, **properties: Column) -> Column:
    return _feature(F.struct(F.lit("LineString").alias("type"), F.transform(points, _pair).alias("coordinates")), properties)


def _feature(geometry: Column, properties: dict[str, Column]) -> Column:
    props = F.struct(*[c.alias(n) for n, c in properties.items()]) if properties else F.from_json(F.lit("{}"), "struct<>")
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties")))


def collection(features: DataFrame, column: str = "feature") -> DataFrame:
    """One document of all features; an empty one where there are none. For views:
    the whole result is a single value."""
    body = F.array_join(F.array_sort(F.collect_list(column)), ",")
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("geojson"))


def write_lines(features: DataFrame, path: str, column: str = "feature") -> None:
    """One feature a line, in as many files as there are tasks."""
    features.select(column).write.text(path)


def read_overpass(spark, path: str) -> DataFrame:
    """Nodes of an Overpass answer: seq, id, lat, lon, tags."""
    raw = spark.read.schema(OVERPASS).option("multiLine", "true").json(path)
    each = raw.select(F.posexplode("elements").alias("seq", "e")).where("e.type = 'node'")
    tags = F.transform(F.map_entries("e.tags"), lambda t: F.struct(t["key"].alias("k"), t["value"].alias("v")))
    return each.select(F.col("seq").cast("bigint").alias("seq"), F.col("e.id").alias("id"), "e.lat", "e.lon", F.coalesce(tags, F.array().cast("array<struct<k:string,v:string>>")).alias("tags"))


def camera_feed(osm_nodes: DataFrame) -> DataFrame:
    """feature: each node as a point whose properties are its tags and osm_id."""
    props = F.map_concat(F.map_from_entries(F.filter("tags", lambda t: t["k"] != "osm_id")), F.create_map(F.lit("osm_id"), F.col("id").cast("string")))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return osm_nodes.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("feature"))
