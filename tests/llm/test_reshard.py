import itertools
import random
import zlib

from pyspark.sql import functions as F

from cartolith.llm import reshard as r


def test_flow_against_enumeration():
    rnd = random.Random(0)
    for _ in range(40):
        supply = [rnd.randint(0, 4), rnd.randint(0, 4)]
        demand = [rnd.randint(0, 3), rnd.randint(0, 3)]
        demand.append(max(0, sum(supply) - sum(demand)) + rnd.randint(0, 2))
        cost = [[rnd.randint(0, 5) for _ in demand] for _ in supply]
        splits = [[c for c in itertools.product(range(s + 1), repeat=3) if sum(c) == s] for s in supply]
        best = min(sum(f[i][j] * cost[i][j] for i in (0, 1) for j in range(3)) for f in itertools.product(*splits) if all(f[0][j] + f[1][j] <= demand[j] for j in range(3)))
        flow = r.min_cost_flow(supply, demand, cost)
        assert [sum(x) for x in flow] == supply and all(sum(f[j] for f in flow) <= demand[j] for j in range(3))
        assert sum(flow[i][j] * cost[i][j] for i in (0, 1) for j in range(3)) == best


def test_only_the_surplus_moves():
    flow = r.min_cost_flow([100, 10, 70], [45, 45, 45, 45], [[int(i != j) for j in range(4)] for i in range(3)])
    assert [flow[i][i] for i in range(3)] == [45, 10, 45]


def rows_of(rnd, n=3000):
    rows = [(i, "é" * rnd.randint(0, 300), f"s{min(rnd.randrange(9), 3)}", 1) for i in range(n)]
    return rows + [(5000, None, None, 1), (5001, "", "s0", 1), (5002, "same", "s1", 1), (5002, "same", "s1", 1), (None, "n", "s1", 1), (None, "n", "s1", 1), (None, "other", "s1", 1)]


def resharded(spark, rows, folder, capacities, parts=6):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, slot int").repartition(parts)
    old = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(5))
    schema = r.lay_out(docs.selectExpr("*", "3 as shard", "4 as old_shard", "5 as extra"), old, f"{folder}/old")
    return r.reshard(spark, f"{folder}/old", schema, capacities, f"{folder}/new")


def test_moves_no_more_than_the_flow_and_a_document_for_each_cut(spark, tmp_path):
    rnd = random.Random(1)
    rows = rows_of(rnd)
    layout = resharded(spark, rows, f"file://{tmp_path}", 8)
    got = r.read(spark, layout).collect()
    key = lambda d, t: (d is None, d or 0, t is None, t or "")
    assert sorted(key(x.doc_id, x.text) for x in got) == sorted(key(d, t) for d, t, *_ in rows)
    assert all(x.extra == 5 and x.moved == (x.shard != x.old_shard) for x in got)
    size = lambda x: len((x.text or "").encode()) + 1
    by = {}
    for x in got:
        by.setdefault(x.shard, []).append(x)
    assert sorted(by) == list(range(8)) and all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    total, largest = sum(map(size, got)), max(map(size, got))
    assert all(abs(sum(map(size, v)) - total / 8) <= 5 * largest for v in by.values())
    supply = [sum(size(x) for x in got if x.old_shard == i) for i in range(5)]
    capacities = [total // 8 + (j < total % 8) for j in range(8)]
    _, flow = r.plan([(str(i), i, n) for i, n in enumerate(supply)], capacities)
    least = sum(max(0, s - c) for s, c in zip(supply, capacities))
    assert sum(flow[i][j] for i in range(5) for j in range(8) if i != j) == least
    cuts = sum(max(0, sum(f > 0 for f in row) - 1) for row in flow)
    assert abs(sum(size(x) for x in got if x.moved) - least) <= cuts * largest


def test_files_that_stay_are_left_as_they_are(spark, tmp_path):
    import os

    rows = rows_of(random.Random(2))
    seen = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{tmp_path}/old") for f in fs if f.endswith(".parquet")}
    layout = resharded(spark, rows, f"file://{tmp_path}", 8, parts=12)
    old = seen()
    local = lambda p: "/" + p.removeprefix("file:").lstrip("/")
    kept = {local(f.path) for f in layout.kept}
    assert kept and kept < set(old) and seen() == old
    got = r.read(spark, layout)
    names = {x[0] for x in got.select(F.input_file_name()).distinct().collect()}
    assert {local(n) for n in names if "/old/" in n} == kept
    # a layout that fits is not touched
    sizes = [sum(f.size for f in r.files(r._read(spark, layout.schema, layout.old)) if f.shard == i) for i in range(5)]
    same = r.reshard(spark, layout.old, layout.schema, sizes, f"file://{tmp_path}/none")
    assert len(same.kept) == len(old) and r.read(spark, same).where("moved").count() == 0
    assert r.read(spark, same).count() == len(rows)


def test_one_file_one_text_and_no_rows(spark, tmp_path):
    one = resharded(spark, [(1, "x" * 1000, "s", 1)] * 16, f"file://{tmp_path}/one", 8, parts=1)
    assert sorted((x.shard, x.slot) for x in r.read(spark, one).collect()) == [(j, k) for j in range(8) for k in range(2)]
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    schema = r.lay_out(docs.limit(0), F.lit(0), f"file://{tmp_path}/empty")
    assert r.read(spark, r.reshard(spark, f"file://{tmp_path}/empty", schema, 8, f"file://{tmp_path}/empty-new")).count() == 0
    long = resharded(spark, [(1, "x" * 3_000_000, "s", 1), (2, "y", "s", 1)], f"file://{tmp_path}/long", 8)
    assert r.read(spark, long).count() == 2


def test_query_checksums(spark):
    from tests import sql

    texts = {x.doc_id: (x.text or "").encode() for x in spark.read.parquet(f"{sql.DATA}/documents.parquet").collect()}
    for x in r.op2_reshard(spark, sql.DATA).collect():
        assert x.size == len(texts[x.doc_id]) + 1 and x.text_crc32 == zlib.crc32(texts[x.doc_id])
