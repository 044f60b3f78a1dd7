"""From element tables to the scored tables, and the queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SEARCH_LIMIT
from ..operators import exposure, network, occluders, places, routing, viewport, zones
from ..sources import store


def build(osm_nodes: DataFrame, osm_ways: DataFrame, osm_relations: DataFrame) -> store.Parts:
    """Cameras first, then the rings near them, then the network and its scores."""
    cameras = network.cameras(osm_nodes)
    found = occluders.rings(occluders.ring_ways(osm_ways, osm_relations), osm_nodes)
    rings = occluders.near_cameras(found, cameras)
    nodes, edges, named = network.network(osm_nodes, osm_ways)
    scored = exposure.score(exposure.with_ends(edges, nodes), cameras, rings)
    kept = places.index(named).drop("key", "part")
    return store.Parts(nodes.select("id", "lat", "lon"), scored.select("src", "dst", "length_m", "exposure"), cameras, kept, rings)


class Router:
    """The queries over one set of tables; every answer is a DataFrame."""

    def __init__(self, parts: store.Parts):
        self.parts = parts
        self.named = places.index(parts.places, "seq")

    @classmethod
    def from_elements(cls, osm_nodes: DataFrame, osm_ways: DataFrame, osm_relations: DataFrame) -> Router:
        return cls(build(osm_nodes, osm_ways, osm_relations))

    @classmethod
    def open(cls, osm_nodes: DataFrame, osm_ways: DataFrame, osm_relations: DataFrame, path: str, source: str) -> Router:
        """The stored tables where they fit the source; else built and stored. That
        storing fails is no error."""
        spark = osm_nodes.sparkSession
        try:
            return cls(store.read(spark, path, source))
        except store.LoadFailed:
            parts = build(osm_nodes, osm_ways, osm_relations)
            if store.write_quietly(parts, path, source):
                parts = store.read(spark, path, source)
            return cls(parts)

    @classmethod
    def open_store(cls, spark: SparkSession, path: str) -> Router:
        """The stored tables alone: raises LoadFailed where they cannot be used."""
        return cls(store.read(spark, path))

    def plan(self, requests: DataFrame) -> DataFrame:
        return routing.plan(requests, self.parts.nodes, self.parts.edges)

    def cameras_near(self, views: DataFrame) -> DataFrame:
        return viewport.near(views, self.parts.cameras)

    def coverage_near(self, views: DataFrame) -> DataFrame:
        seen = self.cameras_near(views)
        wanted = self.parts.cameras.join(seen.select("osm_id").distinct(), "osm_id", "left_semi")
        rings = viewport.coverage(wanted, self.parts.cameras, self.parts.occluders)
        return seen.select("v_id", "osm_id").join(rings, "osm_id")

    def search_places(self, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
        return places.search(self.named, query, limit).select("name", "kind", "lat", "lon")

    def camera_count(self) -> int:
        return self.parts.cameras.count()

    def place_count(self) -> int:
        return self.parts.places.count()

    def counts(self) -> DataFrame:
        return self.parts.cameras.agg(F.count("*").alias("cameras"), F.lit(self.place_count()).cast("bigint").alias("places"))

    def zones(self) -> DataFrame:
        return zones.table(self.parts.nodes.sparkSession)

    def zones_as_of(self) -> str:
        return zones.as_of()

    def camera(self, osm_id: int) -> DataFrame:
        """The camera of that id, or no row."""
        return viewport.first(self.parts.cameras, F.col("osm_id") == osm_id)

    def zone(self, id: str) -> DataFrame:
        """The zone of that id, or no row."""
        return viewport.first(self.zones(), F.col("id") == id)
