import pytest
from pyspark.sql import functions as F

from cartolith.functions import geo, tags, text
from cartolith.operators import network, places
from cartolith.plans import bridge
from tests import fixtures


def each(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_texts(spark):
    got = each(spark, ["  Acme\t", "  ", None, "ä" * 100, "x" * 80, "x" * 79 + "ß"], text.first_text)
    assert got == ["Acme", None, None, "ä" * 40, "x" * 80, "x" * 79]
    assert each(spark, ["Artificial_Intelligence", "zoom; AI ", "face-recognition;x", "ai2", "", None], text.has_ai_feature) == [True, True, True, False, False, False]
    assert each(spark, [" Müller ", "STRAßE", "Ångström", "Señor Ž"], text.fold) == ["muller", "strasse", "angstrom", "senor ž"]
    import math

    nan = each(spark, ["nan", "inf"], text.parse_direction)
    assert all(math.isnan(x) for x in nan)


def test_first_of_equal_keys_counts(spark):
    t = [("name", "a"), ("name", "b")]
    assert each(spark, [t, [], None], lambda c: tags.tag(c, "name"), "array<struct<k:string,v:string>>") == ["a", None, None]


@pytest.mark.parametrize(
    "given, want",
    [
        ([("highway", "residential")], True),
        ([("highway", "motorway")], False),
        ([("highway", "cycleway")], False),
        ([("highway", "cycleway"), ("foot", "designated")], True),
        ([("highway", "path"), ("foot", "use_sidepath")], False),
        ([("highway", "service"), ("access", "private")], False),
        ([("highway", "service"), ("access", "no"), ("foot", "permissive")], True),
        ([("foot", "yes")], False),
        ([("highway", "cycleway"), ("foot", "yes"), ("access", "no")], True),
    ],
)
def test_foot_access(spark, given, want):
    assert each(spark, [given], tags.foot_accessible, "array<struct<k:string,v:string>>") == [want]


def test_place_kinds(spark):
    cases = [([("name", "x"), ("place", "town")], "LOCALITY"), ([("place", "town")], None), ([("name", "x"), ("place", "island")], None), ([("name", "x"), ("place", "island"), ("railway", "halt")], "STATION"), ([("name", "x"), ("public_transport", "station")], "STATION"), ([("name", "x"), ("place", "city"), ("railway", "station")], "LOCALITY")]
    assert each(spark, [c for c, _ in cases], tags.place_kind, "array<struct<k:string,v:string>>") == [w for _, w in cases]


def test_geometry(spark):
    row = spark.range(1).select(
        geo.steps(F.lit(0.0)).alias("none"), geo.steps(F.lit(float("nan"))).alias("nan"), geo.steps(F.lit(0.1)).alias("one"), geo.steps(F.lit(1e9)).alias("cap"),
        geo.angular_within(F.lit(350.0), F.lit(5.0), F.lit(15.0)).alias("wrap"), geo.angular_within(F.lit(30.0), F.lit(5.0), F.lit(15.0)).alias("out"),
        geo.no_negative(F.lit(float("nan"))).alias("w"), geo.compass_point(F.lit(359.0)).alias("n"), geo.compass_point(F.lit(22.5)).alias("ne"),
        geo.covers(F.lit("DOME"), F.lit(90.0), F.lit(30.0), F.lit(20.0), F.lit(0.0), F.lit(0.0), F.lit(float("nan")), F.lit(0.0)).alias("nowhere"),
        geo.disc_ring(F.lit(52.5), F.lit(13.4), F.lit(100.0)).alias("ring"),
    ).first()
    assert row.none is None and row.nan is None and row.one == 1 and row.cap == 2000
    assert row.wrap and not row.out and row.w == 0 and row.n == "N" and row.ne == "NE" and not row.nowhere
    assert len(row.ring) == 49 and row.ring[0] == row.ring[48]


def test_place_index_and_search(spark):
    rows = [(0, i, n, k, 0.0, 0.0) for i, (n, k) in enumerate([("X", "LOCALITY"), ("X", "STATION"), ("X", "STATION"), ("X", "LOCALITY"), ("Alexanderplatz", "STREET"), ("Alexanderplatz Bahnhof", "STATION"), ("Am Alexanderplatz", "STREET"), ("Müllerstraße", "STREET")])]
    found = places.index(spark.createDataFrame(rows, "part int, seq bigint, name string, kind string, lat double, lon double"))
    assert [r.kind for r in found.where("name = 'X'").orderBy("seq").collect()] == ["LOCALITY", "STATION", "LOCALITY"]
    names = lambda q, n=8: [r.name for r in places.search(found, q, n).collect()]
    assert names("alexander") == ["Alexanderplatz", "Alexanderplatz Bahnhof", "Am Alexanderplatz"]
    assert names("alexander", 1) == ["Alexanderplatz"] and names("mullerstrasse") == ["Müllerstraße"] and names("%") == []
    asked = spark.createDataFrame([(1, "alexander", 2), (2, "", 5), (3, "x", 9), (4, "PLATZ", 5)], "q_id bigint, query string, lim int")
    many = {}
    for r in places.search_many(found, asked).orderBy("q_id", "rank_no").collect():
        many.setdefault(r.q_id, []).append(r.name)
    assert many == {1: ["Alexanderplatz", "Alexanderplatz Bahnhof"], 3: ["X", "X", "X", "Alexanderplatz", "Alexanderplatz Bahnhof"][:3] + [n for n in ("Alexanderplatz", "Am Alexanderplatz", "Alexanderplatz Bahnhof")], 4: ["Alexanderplatz", "Am Alexanderplatz", "Alexanderplatz Bahnhof"]}


def test_network_quirks(spark):
    """Anchors of streets that nobody may walk become nodes; file order decides
    which node names a street; loops and repeats of nodes stay."""
    nodes = [(i, 52.5 + i / 1e4, 13.4, []) for i in range(6)]
    ways = [(1, [0, 1, 1, 2], [("highway", "path")]), (2, [4, 5], [("highway", "motorway"), ("name", "A1")]), (3, [1, 99], [("highway", "path"), ("name", "A1")]), (4, [], [("highway", "path"), ("name", "Empty")]), (5, [98, 1], [("highway", "path"), ("name", "Gone")])]
    osm_nodes, osm_ways, _ = fixtures.tables(spark, nodes, ways)
    got_nodes, edges, named = network.network(osm_nodes, osm_ways)
    assert sorted(r.id for r in got_nodes.collect()) == [0, 1, 2, 4]
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(0, 1), (1, 0), (1, 1), (1, 1), (1, 2), (2, 1)]
    assert [(r.name, r.lat) for r in named.collect()] == [("A1", pytest.approx(52.5004))]


def test_live_cameras(spark):
    tag = [("man_made", "surveillance")]
    own = spark.createDataFrame([(i, i, 52.5, 13.4, tag if i < 4 else []) for i in range(6)], fixtures.NODES)
    fresh = lambda n: spark.createDataFrame([(i, 100 + i, 52.5, 13.4, tag) for i in range(n)], fixtures.NODES)
    ids = lambda live: sorted(r.id for r in network.live_cameras(own, live).collect())
    assert ids(fresh(2)) == [4, 5, 100, 101]
    assert ids(fresh(1)) == ids(fresh(0)) == [0, 1, 2, 3, 4, 5]


def test_snapshot(spark):
    osm_nodes, osm_ways, relations = fixtures.yards(spark)
    more = lambda df, **c: df.unionByName(df.limit(1).selectExpr(*[f"{c[n]} as {n}" if n in c else n for n in df.columns]))
    none = "cast(array() as array<struct<k:string,v:string>>)"
    ways = more(osm_ways, seq="999L", id="999L", refs="array(1L, 888L)", tags=none)
    n, w, r = network.snapshot(more(osm_nodes, seq="888L", id="888L", tags=none), ways, relations)
    assert r.count() == 1 and sorted(x.id for x in w.collect()) == [700, 701, 702, 703, 750, 751, 752, 753, 754]
    assert sorted(x.id for x in n.collect()) == sorted(x.id for x in osm_nodes.collect())


def test_bridge_reads_alike(spark):
    assert bridge.derive(spark.createDataFrame([(81,)], "c_custkey bigint"), bridge.NODE).first().row_no == 2


def test_grams_of_names_are_not_broadcast(spark, monkeypatch, tmp_path):
    rows = [(0, i, n, "STREET", 0.0, 0.0) for i, n in enumerate(("Alexanderplatz", "Am Alexanderplatz", "Müllerstraße"))]
    spark.createDataFrame(rows, "part int, seq bigint, name string, kind string, lat double, lon double").write.parquet(str(tmp_path / "p"))
    found = places.index(spark.read.parquet(str(tmp_path / "p")))
    asked = spark.createDataFrame([(1, "alexander", 2), (2, "strasse", 5)], "q_id bigint, query string, lim int")
    want = [(1, "Alexanderplatz"), (1, "Am Alexanderplatz"), (2, "Müllerstraße")]
    for most, build in ((10_000, "BuildRight"), (1, None)):
        monkeypatch.setattr(places, "BROADCAST_SEARCHES", most)
        got = places.search_many(found, asked)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert (build in plan) if build else ("SortMergeJoin" in plan and "BroadcastHashJoin" not in plan)
        assert "BuildLeft" not in plan and sorted((r.q_id, r.name) for r in got.collect()) == want
