"""What a map view asks for: cameras near a point, their coverage, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CONE_RAYS, COVERAGE_CAP, DISC_RAYS, KIND_LABELS, M_PER_DEG_LOCAL
from ..functions import geo
from . import occluders

MOST_AREAS, MOST_LAYERS = 10_000, 1_000


def near(views: DataFrame, cameras: DataFrame) -> DataFrame:
    """v_id and the cameras within radius_m of views (v_id, lat, lon, radius_m).
    Views and cameras meet in square cells as wide as the longest radius."""
    scale = views.agg(F.max("radius_m"), F.max(F.abs("lat"))).first()
    if scale[0] is None:
        return cameras.limit(0).select(F.lit(0).cast(views.schema["v_id"].dataType).alias("v_id"), *cameras.columns)
    size = max(scale[0], 1.0) / 110_000.0
    width = geo.lon_cell(max(scale[0], 1.0), min(scale[1] + size, 89.0), 110_000.0)
    nine = lambda c, s: F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: geo.cell(c, s) + d))
    asked = views.select("v_id", F.col("lat").alias("vlat"), F.col("lon").alias("vlon"), "radius_m").withColumn("ci", nine(F.col("vlat"), size)).withColumn("cj", nine(F.col("vlon"), width))
    placed = cameras.withColumns({"ci": geo.cell(F.col("lat"), size), "cj": geo.cell(F.col("lon"), width)})
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("vlat"), F.col("vlon"))
    return placed.join(asked, ["ci", "cj"]).where(d <= F.col("radius_m")).select("v_id", *cameras.columns)


def rays(cameras: DataFrame) -> DataFrame:
    """osm_id, ray, clat, clon, bearing, range_m, cone of the rays of each outline."""
    cone = (F.col("kind") == "FIXED") & F.col("direction_deg").isNotNull()
    each = cameras.select("osm_id", F.col("lat").alias("clat"), F.col("lon").alias("clon"), "range_m", "direction_deg", "half_fov_deg", cone.alias("cone"))
    each = each.withColumn("ray", F.explode(F.when(F.col("cone"), F.sequence(F.lit(0), F.lit(CONE_RAYS))).otherwise(F.sequence(F.lit(0), F.lit(DISC_RAYS - 1)))))
    sweep = F.col("direction_deg") - F.col("half_fov_deg") + 2 * F.col("half_fov_deg") * (F.col("ray") / F.lit(float(CONE_RAYS)))
    bearing = F.when(F.col("cone"), sweep).otherwise(360.0 * F.col("ray") / DISC_RAYS)
    return each.select("osm_id", "ray", "clat", "clon", bearing.alias("bearing"), "range_m", "cone")


def coverage(cameras: DataFrame, all_cameras: DataFrame, rings: DataFrame) -> DataFrame:
    """osm_id, ring: the closed outline of what each camera sees, cut at walls; a
    wedge begins and ends at its camera."""
    reached = occluders.visible_ranges(rays(cameras), all_cameras, rings)
    b, d = F.radians("bearing"), F.col("reach_m")
    point = F.struct((F.col("clat") + d * F.cos(b) / M_PER_DEG_LOCAL).alias("lat"), (F.col("clon") + d * F.sin(b) / (M_PER_DEG_LOCAL * F.greatest(F.cos(F.radians("clat")), F.lit(0.01)))).alias("lon"))
    made = reached.groupBy("osm_id").agg(F.array_sort(F.collect_list(F.struct("ray", point.alias("p")))).alias("r"), F.first("cone").alias("cone"), F.first(F.struct(F.col("clat").alias("lat"), F.col("clon").alias("lon"))).alias("origin"))
    points = F.transform("r", lambda x: x["p"])
    wedge = F.concat(F.array("origin"), points, F.array("origin"))
    return made.select("osm_id", F.when(F.col("cone"), wedge).otherwise(F.concat(points, F.slice(points, F.lit(1), F.lit(1)))).alias("ring"))


def within_cap(found: DataFrame, cap: int = COVERAGE_CAP) -> DataFrame:
    """Rows of the views that hold no more than cap cameras."""
    few = found.groupBy("v_id").agg(F.count("*").alias("n")).where(F.col("n") <= cap).select("v_id")
    return found.join(few, "v_id", "left_semi")


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def first(rows: DataFrame, wanted: Column, *order: str) -> DataFrame:
    """The first row that is wanted, or none."""
    found = rows.where(wanted)
    return (found.orderBy(*order) if order else found).limit(1)


def lookup(rows: DataFrame, key: str, selected: DataFrame) -> DataFrame:
    """selected (its column key) each with the first row of that key, or with nulls."""
    others = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.min(F.struct(*others)).alias("_row"))
    return selected.join(one, key, "left").select(*selected.columns, "_row.*")


def shown_layers(layers: DataFrame, zoom: Column, tiles: bool = True, glyphs: bool = True) -> DataFrame:
    """layers (layer_id, type, source_layer, classes, min_zoom, max_zoom) that a style
    draws at a zoom: without tiles the background alone, without glyphs no symbols."""
    shown = layers.where((F.coalesce("min_zoom", F.lit(0)) <= zoom) & (zoom < F.coalesce("max_zoom", F.lit(99))))
    shown = shown if tiles else shown.where("type = 'background'")
    return shown if glyphs else shown.where("type <> 'symbol'")


def drawn(features: DataFrame, layers: DataFrame) -> DataFrame:
    """features (feature_id, source_layer, class, admin_level) with each layer that
    draws them: of its source layer, and of its classes and levels where it names any.
    Layers are the few of a style (MOST_LAYERS, counted)."""
    if layers.count() > MOST_LAYERS:
        raise ValueError(f"more than {MOST_LAYERS} layers")
    named = layers.select("layer_id", "source_layer", "classes", "admin_levels")
    any_of = lambda names, value: F.col(names).isNull() | F.coalesce(F.array_contains(F.col(names), F.col(value)), F.lit(False))
    return features.join(F.broadcast(named), "source_layer").where(any_of("classes", "class") & any_of("admin_levels", "admin_level")).select("feature_id", "layer_id")


def camera_card(cameras: DataFrame) -> DataFrame:
    """osm_id, label, faces, cover of a camera's card."""
    cone = (F.col("kind") == "FIXED") & F.col("direction_deg").isNotNull()
    degrees = F.floor(F.col("direction_deg") + 0.5).cast("int").cast("string")
    faces = F.when(F.col("direction_deg").isNotNull(), F.concat(F.lit("Faces "), degrees, F.lit("° ("), geo.compass_point(F.col("direction_deg")), F.lit(")")))
    reach = F.floor(F.col("range_m") + 0.5).cast("int").cast("string")
    cover = F.when(cone, F.concat(F.floor(2 * F.col("half_fov_deg") + 0.5).cast("int").cast("string"), F.lit("° cone, "), reach, F.lit(" m"))).otherwise(F.concat(F.lit("All around, "), reach, F.lit(" m")))
    return cameras.select("osm_id", F.concat(F.initcap("kind"), F.lit(" camera")).alias("label"), faces.alias("faces"), cover.alias("cover"))


def route_text(length_m: Column, exposure: Column) -> Column:
    """Metres and percent, cut to whole numbers."""
    return F.concat(length_m.cast("int").cast("string"), F.lit(" m · "), (exposure * 100).cast("int").cast("string"), F.lit("%"))


def error_text(status: Column) -> Column:
    return F.when(status.isin("NO_START", "NO_END"), "No street nearby").when(status == "UNREACHABLE", "No way through").when(status == "LOAD_FAILED", "Map data could not be read")


def kind_label(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in KIND_LABELS.items() for x in p]), kind)


def in_area(points: DataFrame, area: DataFrame) -> DataFrame:
    """points (lat, lon, others) inside areas (area_id, ring), by the even-odd rule,
    with area_id. Areas are a stated, small set: at most MOST_AREAS, counted before
    every point is tested against their boxes."""
    if area.count() > MOST_AREAS:
        raise ValueError(f"more than {MOST_AREAS} areas")
    box = occluders.boxed(area.withColumnRenamed("area_id", "ring_id")).withColumnRenamed("ring_id", "area_id")
    met = points.withColumn("_p", F.monotonically_increasing_id()).join(F.broadcast(box), (F.col("lat") >= F.col("min_lat")) & (F.col("lat") <= F.col("max_lat")) & (F.col("lon") >= F.col("min_lon")) & (F.col("lon") <= F.col("max_lon")))
    turned = F.concat(F.slice("ring", F.lit(2), F.size("ring") - 1), F.slice("ring", F.lit(1), F.lit(1)))
    edge = met.withColumn("e", F.explode(F.arrays_zip(F.col("ring").alias("a"), turned.alias("b"))))
    a, b = F.col("e.a"), F.col("e.b")
    flips = ((a["lat"] > F.col("lat")) != (b["lat"] > F.col("lat"))) & (F.col("lon") < (b["lon"] - a["lon"]) * (F.col("lat") - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"])
    keys = [*points.columns, "area_id"]
    return edge.groupBy("_p", *keys).agg(F.count_if(flips).alias("n")).where("n % 2 = 1").select(*keys)
