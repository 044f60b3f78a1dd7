"""Meaning of tags. A tag set is an array of (k, v); of equal keys the first counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEFAULT_HEIGHT_M, HALF_FOV_DEG, LEVEL_HEIGHT_M, LOCALITIES, LOW_BUILDINGS, LOW_HEIGHT_M, MODEL_PROFILES, OCCLUDER_MIN_HEIGHT_M, RANGE_M, WALKABLE
from . import text


def tag(tags: Column, key: str) -> Column:
    return F.get(F.filter(tags, lambda t: t["k"] == key), F.lit(0))["v"]


def _is(v: Column, *values: str) -> Column:
    """Membership where null is no member."""
    return F.coalesce(v.isin(*values), F.lit(False))


def is_camera(tags: Column) -> Column:
    kind = tag(tags, "surveillance:type")
    return _is(tag(tags, "man_made"), "surveillance") & ~_is(tag(tags, "surveillance"), "indoor") & (kind.isNull() | _is(kind, "camera"))


def camera(tags: Column) -> dict[str, Column]:
    """kind, direction_deg, half_fov_deg, range_m, ai, manufacturer, model."""
    given = tag(tags, "camera:type")
    kind = F.when(_is(given, "dome", "panning", "fixed"), F.upper(given)).otherwise("UNKNOWN")
    model = text.first_text(tag(tags, "camera:model"), tag(tags, "model"))
    known = [F.coalesce(F.contains(F.lower(model), F.lit(name)), F.lit(False)) for name, _, _ in MODEL_PROFILES]

    def by_model(values, other: Column) -> Column:
        return F.coalesce(*[F.when(k, v) for k, v in zip(known, values)], other)

    return {
        "kind": by_model(["FIXED" for _ in known], kind),
        "direction_deg": text.parse_direction(tag(tags, "camera:direction")),
        "half_fov_deg": by_model([h for _, _, h in MODEL_PROFILES], F.lit(HALF_FOV_DEG)),
        "range_m": by_model([r for _, r, _ in MODEL_PROFILES], F.create_map(*[F.lit(x) for p in RANGE_M.items() for x in p])[kind]),
        "ai": text.has_ai_feature(tag(tags, "camera:features")),
        "manufacturer": text.first_text(tag(tags, "manufacturer"), tag(tags, "brand")),
        "model": model,
    }


def foot_accessible(tags: Column) -> Column:
    highway, foot = tag(tags, "highway"), tag(tags, "foot")
    allowed = _is(foot, "yes", "designated", "permissive")
    known = _is(highway, *WALKABLE) | (_is(highway, "cycleway") & allowed)
    return known & ~_is(foot, "no", "private", "use_sidepath") & ~(_is(tag(tags, "access"), "no", "private") & ~allowed)


def building_height_m(tags: Column) -> Column:
    levels = text.number(text.first_item(tag(tags, "building:levels")))
    low = F.when(_is(tag(tags, "building"), *LOW_BUILDINGS), LOW_HEIGHT_M)
    return F.coalesce(text.parse_metres(tag(tags, "height")), text.parse_metres(tag(tags, "building:height")), F.when(levels > 0, levels * LEVEL_HEIGHT_M), low, F.lit(DEFAULT_HEIGHT_M))


def blocks_cameras(tags: Column) -> Column:
    building = tag(tags, "building")
    lifted = F.coalesce(text.parse_metres(tag(tags, "min_height")), text.parse_metres(tag(tags, "building:min_height")), F.lit(0.0)) >= OCCLUDER_MIN_HEIGHT_M
    return building.isNotNull() & ~_is(building, "no") & ~lifted & (building_height_m(tags) >= OCCLUDER_MIN_HEIGHT_M)


def place_kind(tags: Column) -> Column:
    """LOCALITY, STATION or null."""
    station = _is(tag(tags, "railway"), "station", "halt") | _is(tag(tags, "public_transport"), "station")
    kind = F.when(_is(tag(tags, "place"), *LOCALITIES), "LOCALITY").when(station, "STATION")
    return F.when(tag(tags, "name").isNotNull(), kind)
