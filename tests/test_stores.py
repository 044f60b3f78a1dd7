import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from cartolith.operators import viewport, zones
from cartolith.plans.build import Router
from cartolith.sources import geojson, osm_xml, pbf, store
from tests import fixtures


def parts(spark):
    return store.Parts(
        spark.createDataFrame([(1, 52.5, 13.4), (2, 52.6, 13.5)], "id bigint, lat double, lon double"),
        spark.createDataFrame([(1, 2, 12.5, 0.25)], "src bigint, dst bigint, length_m double, exposure double"),
        spark.createDataFrame([(-7, 52.5, 13.4, "FIXED", 90.0, 30.0, 25.0, True, "Acme", None), (8, 52.5, 13.4, "DOME", None, 30.0, 20.0, False, None, "ä" * 40)], "osm_id bigint, lat double, lon double, kind string, direction_deg double, half_fov_deg double, range_m double, ai boolean, manufacturer string, model string"),
        spark.createDataFrame([(0, "Müllerstraße", "STREET", 52.5, 13.4)], "seq bigint, name string, kind string, lat double, lon double"),
        spark.createDataFrame([(1, [(52.5, 13.4), (52.6, 13.4), (52.6, 13.5)]), (2, [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)])], "ring_id bigint, ring array<struct<lat:double,lon:double>>"),
    )


def test_round_trip(spark, tmp_path):
    path, given = f"file://{tmp_path}/s", parts(spark)
    store.write(given, path, "77", built_utc="2026-01-02T03:04:05Z", camera_source="live")
    for got in (store.read(spark, path, "77"), store.read(spark, path)):
        for name in store.TABLES:
            a, b = getattr(given, name), getattr(got, name)
            assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))
    assert [(r.key, str(r.day)) for r in store.built_on(spark, path).collect()] == [("built_utc", "2026-01-02")]
    before = store.read(spark, path)
    store.write(given, path, "78")
    assert store.read(spark, path, "78").nodes.count() == before.nodes.count() == 2
    for n in ("79", "80"):
        store.write(given, path, n)
    folders = lambda: sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir())
    assert len(folders()) == store.KEPT and len(list((tmp_path / "s").glob("manifest-*.json"))) == store.KEPT
    assert store.read(spark, path, "80").edges.count() == 1


def test_refusals(spark, tmp_path):
    path, given = f"{tmp_path}/s", parts(spark)
    refuse = lambda why: pytest.raises(store.LoadFailed, match=why)
    with refuse("manifest"):
        store.read(spark, path)
    store.write(given, path, "77")
    with refuse("another source"):
        store.read(spark, path, "78")
    manifest = tmp_path / "s" / "manifest-1.json"
    whole = json.loads(manifest.read_text())
    fewer = whole["proofs"] | {"edges": {"rows": "2", "checksum": whole["proofs"]["edges"]["checksum"]}}
    for change, why in (({"format": "x"}, "not a store"), ({"version": 8}, "version 8"), ({"zones": 1}, "other zones"), ({"tables": "gone"}, "not whole"), ({"proofs": fewer}, "edges is not what was written"), ({"proofs": None}, "not what was written")):
        (tmp_path / "s" / ".manifest-1.json.crc").unlink(missing_ok=True)
        manifest.write_text(json.dumps(whole | change))
        with refuse(why):
            store.read(spark, path)
    manifest.write_text("{")
    with refuse("manifest"):
        store.read(spark, path)
    for cameras, places in ((given.cameras.withColumn("kind", F.lit("LASER")), given.places), (given.cameras, given.places.withColumn("kind", F.lit(None).cast("string")))):
        store.write(store.Parts(given.nodes, given.edges, cameras, places, given.occluders), path, "1")
        with refuse("outside its range"):
            store.read(spark, path)
    store.write(given, path, "1")
    (tmp_path / "s" / "manifest.part").write_text("a write that ended before its rename")
    assert store.read(spark, path, "1").nodes.count() == 2
    edges = tmp_path / "s" / store.manifest(spark, path)["tables"] / "edges"
    one = max(edges.glob("part-*.parquet"), key=lambda p: p.stat().st_size)
    one.write_bytes(one.read_bytes()[: one.stat().st_size // 2])
    with refuse("damaged"):
        store.read(spark, path)
    one.unlink()
    with refuse("edges"):
        store.read(spark, path)


def test_signatures():
    table = zones.ZONES
    assert zones.signature() == zones.signature(tuple((*z[:4], "ANY") for z in table))
    assert zones.signature() != zones.signature(table[::-1]) != zones.signature(table[1:])
    assert zones.as_of()


def test_fingerprint(spark, tmp_path):
    found = []
    for name, content in (("a", b"ab"), ("b", b"ba"), ("c", b"b"), ("d", b"ab")):
        (tmp_path / name).write_bytes(content)
        found.append(store.fingerprint(spark, str(tmp_path / name)))
    assert found[0] == found[3] and len(set(found)) == 3


def test_open_builds_then_reads(spark, tmp_path):
    elements = fixtures.quay(spark)
    path = f"file://{tmp_path}/cache"
    fresh = Router.open(*elements, path, "5")
    again = Router.open_store(spark, path)
    assert again.camera_count() == fresh.camera_count() == 2
    assert sorted(map(str, again.parts.edges.collect())) == sorted(map(str, fresh.parts.edges.collect()))
    assert [r.name for r in again.search_places("north").collect()] == ["Northmoor", "Northmoor Halt"]
    assert Router.open(*elements, "/proc/nowhere", "5").place_count() == 4  # storing fails, the answer does not
    with pytest.raises(store.LoadFailed):
        Router.open_store(spark, f"{tmp_path}/none")


# a small writer of the extract format


def _varint(v):
    out = b""
    while True:
        v, low = v >> 7, v & 0x7F
        out += bytes([low | (0x80 if v else 0)])
        if not v:
            return out


def _field(n, v):
    if isinstance(v, int):
        return _varint(n << 3) + _varint(v & (1 << 64) - 1)
    return _varint(n << 3 | 2) + _varint(len(v)) + v


_zz = lambda v: (v << 1) ^ (v >> 63)
_pack = lambda vs: b"".join(map(_varint, vs))
_deltas = lambda vs: _pack([_zz(b - a) for a, b in zip([0, *vs], vs)])


def _blob(kind, raw, compress=True):
    blob = _field(2, len(raw)) + _field(3, zlib.compress(raw)) if compress else _field(1, raw)
    header = _field(1, kind) + _field(3, len(blob))
    return struct.pack(">I", len(header)) + header + blob


def _block(nodes=(), plain=(), ways=(), relations=()):
    strings = [""]

    def s(x):
        if x not in strings:
            strings.append(x)
        return strings.index(x)

    groups = b""
    if nodes:
        keys = [v for _, _, _, t in nodes for kv in (*[x for k, w in t for x in (s(k), s(w))], 0) for v in [kv]]
        dense = _field(1, _deltas([n[0] for n in nodes])) + _field(8, _deltas([round(n[1] * 1e7) for n in nodes])) + _field(9, _deltas([round(n[2] * 1e7) for n in nodes])) + _field(10, _pack(keys))
        groups += _field(2, _field(2, dense))
    tagged = lambda t: _field(2, _pack([s(k) for k, _ in t])) + _field(3, _pack([s(v) for _, v in t]))
    for i, lat, lon, t in plain:
        groups += _field(2, _field(1, _field(1, _zz(i)) + tagged(t) + _field(8, _zz(round(lat * 1e7))) + _field(9, _zz(round(lon * 1e7)))))
    for i, refs, t in ways:
        groups += _field(2, _field(3, _field(1, i) + tagged(t) + _field(8, _deltas(refs))))
    for i, members, t in relations:
        groups += _field(2, _field(4, _field(1, i) + tagged(t) + _field(8, _pack([s(r) for _, _, r in members])) + _field(9, _deltas([m for _, m, _ in members])) + _field(10, _pack([pbf.MEMBER_TYPES.index(t) for t, _, _ in members]))))
    return _field(1, b"".join(_field(1, x.encode()) for x in strings)) + groups


def test_extract(spark, tmp_path):
    nodes = [(5, 52.5, 13.4, [("name", "Ä"), ("place", "town")]), (-3, -33.25, -70.5, []), (1 << 40, 0.0, 0.0000001, [("a", "b")])]
    plain = [(9, 1.5, 2.5, [("k", "v")])]
    ways = [(7, [5, -3, 9, 5], [("highway", "path")]), (8, [], [])]
    relations = [(4, [("way", 7, "outer"), ("node", 5, ""), ("relation", 2, "x")], [("type", "multipolygon")])]
    raw = _blob(b"OSMHeader", _field(4, b"OsmSchema-V0.6")) + _blob(b"OSMData", _block(nodes)) + _blob(b"OSMData", _block((), plain, ways), compress=False) + _blob(b"OSMData", _block((), (), (), relations))
    path = tmp_path / "x.osm.pbf"
    path.write_bytes(raw)
    for where in (str(path), f"file://{path}"):
        n, w, r = pbf.load(spark, where)
        plain_tags = lambda t: [tuple(x) for x in t]
        assert [(x.id, round(x.lat, 7), round(x.lon, 7), plain_tags(x.tags)) for x in n.orderBy("seq").collect()] == [*nodes, *plain]
        assert [(x.id, x.refs, plain_tags(x.tags)) for x in w.orderBy("seq").collect()] == ways
        assert [(x.id, [tuple(m) for m in x.members], plain_tags(x.tags)) for x in r.collect()] == relations
    (tmp_path / "cut.pbf").write_bytes(raw[:-5])
    with pytest.raises(Exception):
        pbf.load(spark, str(tmp_path / "cut.pbf"))[2].collect()


def test_extract_to_router(spark, tmp_path):
    n, w, _ = fixtures.quay(spark)
    rows = lambda df: [tuple([tuple(t) for t in v] if c == "tags" else v for c, v in zip(df.columns[1:], x[1:])) for x in df.orderBy("seq").collect()]
    path = tmp_path / "g.pbf"
    path.write_bytes(_blob(b"OSMData", _block(rows(n))) + _blob(b"OSMData", _block((), (), rows(w))))
    assert Router.from_elements(*pbf.load(spark, str(path))).counts().first().asDict() == {"cameras": 2, "places": 4}


def test_xml(spark, tmp_path):
    body = """<?xml version="1.0"?>
<osm version="0.6">
<meta osm_base="2026-01-02T03:04:05Z"/>
<node id="5" lat="52.5" lon="13.4"><tag k="man_made" v="surveillance"/><tag k="note" v="a &amp; b"/></node>
<node id="6" lat="1.5" lon="-2.5"/>
<way id="7"><nd ref="5"/><nd ref="6"/><tag k="highway" v="path"/></way>
<relation id="8"><member type="way" ref="7" role="outer"/><tag k="type" v="multipolygon"/></relation>
"""
    good, cut, failed = tmp_path / "a.osm", tmp_path / "b.osm", tmp_path / "c.osm"
    good.write_text(body + "</osm>\n")
    cut.write_text(body)
    failed.write_text(body + "<remark> runtime error: timed out </remark>\n</osm>\n")
    assert osm_xml.check(spark, str(good)) == "2026-01-02T03:04:05Z"
    for p in (cut, failed):
        with pytest.raises(osm_xml.BadAnswer):
            osm_xml.check(spark, str(p))
    n = osm_xml.nodes(spark, str(good)).orderBy("seq").collect()
    assert [(x.id, x.lat, x.lon, [tuple(t) for t in x.tags]) for x in n] == [(5, 52.5, 13.4, [("man_made", "surveillance"), ("note", "a & b")]), (6, 1.5, -2.5, [])]
    assert osm_xml.ways(spark, str(good)).first().refs == [5, 6]
    assert tuple(osm_xml.relations(spark, str(good)).first().members[0]) == ("way", 7, "outer")


def test_geojson(spark, tmp_path):
    ring = [(1.0, 2.0), (1.0, 3.0), (1.0, 2.0)]
    df = spark.createDataFrame([(1, 52.5, 13.4, ring)], "id bigint, lat double, lon double, ring array<struct<lat:double,lon:double>>")
    got = df.select(geojson.point(F.col("lat"), F.col("lon"), osm_id=F.col("id")).alias("feature"), geojson.polygon(F.col("ring")).alias("p"), geojson.line(F.col("ring")).alias("l"))
    r = got.first()
    assert json.loads(r.feature) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [13.4, 52.5]}, "properties": {"osm_id": 1}}
    assert json.loads(r.p)["geometry"]["coordinates"] == [[[2.0, 1.0], [3.0, 1.0], [2.0, 1.0]]]
    assert json.loads(r.l)["geometry"]["type"] == "LineString"
    whole = json.loads(geojson.collection(got).first()[0])
    assert whole["type"] == "FeatureCollection" and len(whole["features"]) == 1
    assert json.loads(geojson.collection(got.limit(0)).first()[0])["features"] == []
    answer = {"elements": [{"type": "node", "id": 4, "lat": 1.0, "lon": 2.0, "tags": {"a": "b"}}, {"type": "way", "id": 5}, {"type": "node", "id": 6, "lat": 3.0, "lon": 4.0}]}
    (tmp_path / "o.json").write_text(json.dumps(answer))
    read = geojson.read_overpass(spark, str(tmp_path / "o.json"))
    assert [(x.id, len(x.tags)) for x in read.orderBy("seq").collect()] == [(4, 1), (6, 0)]
    feed = [json.loads(x.feature) for x in geojson.camera_feed(read).collect()]
    assert {f["properties"]["osm_id"]: f["properties"] for f in feed}["4"] == {"a": "b", "osm_id": "4"}
    geojson.write_lines(got, f"{tmp_path}/lines")
    assert spark.read.text(f"{tmp_path}/lines").count() == 1


def test_lookups_and_layers(spark):
    cameras = parts(spark).cameras
    assert viewport.first(cameras, F.col("osm_id") == 8).first().kind == "DOME" and viewport.first(cameras, F.col("osm_id") == 9).count() == 0
    picked = viewport.lookup(cameras.select("osm_id", "kind"), "osm_id", spark.createDataFrame([(8,), (9,)], "osm_id bigint"))
    assert sorted((r.osm_id, r.kind) for r in picked.collect()) == [(8, "DOME"), (9, None)]
    rows = [("bg", "background", None, None, None, None, None), ("road", "line", "transport", ["major", "minor"], None, 5, None), ("name", "symbol", "transport", None, None, 10, 14), ("border", "line", "boundary", None, [2, 4], None, None)]
    layers = spark.createDataFrame(rows, "layer_id string, type string, source_layer string, classes array<string>, admin_levels array<int>, min_zoom int, max_zoom int")
    ids = lambda df: sorted(r.layer_id for r in df.collect())
    assert ids(viewport.shown_layers(layers, F.lit(12))) == ["bg", "border", "name", "road"]
    assert ids(viewport.shown_layers(layers, F.lit(14))) == ["bg", "border", "road"] and ids(viewport.shown_layers(layers, F.lit(4))) == ["bg", "border"]
    assert ids(viewport.shown_layers(layers, F.lit(12), tiles=False)) == ["bg"] and ids(viewport.shown_layers(layers, F.lit(12), glyphs=False)) == ["bg", "border", "road"]
    features = spark.createDataFrame([(1, "transport", "major", None), (2, "transport", "track", None), (3, "boundary", None, 4), (4, "boundary", None, 8), (5, "water", None, None)], "feature_id bigint, source_layer string, class string, admin_level int")
    assert sorted(tuple(r) for r in viewport.drawn(features, layers).collect()) == [(1, "name"), (1, "road"), (2, "name"), (3, "border")]


def test_cards(spark):
    card = viewport.camera_card(parts(spark).cameras).orderBy("osm_id").collect()
    assert [(c.label, c.faces, c.cover) for c in card] == [("Fixed camera", "Faces 90° (E)", "60° cone, 25 m"), ("Dome camera", None, "All around, 20 m")]
