import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    import random

    r = random.Random(0)
    vocab = [f"w{i}" for i in range(3000)]
    text = lambda n=120: " ".join(r.choices(vocab, k=n))
    bench = [(i, text(30)) for i in range(20)]
    rows = [(i, text(), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, text(60) + " mudlump clotbrain grumblefink mudlumps", "en", "s", 0) for i in range(60)]
    near = rows[0][1].split()
    near[5] = "changed"
    rows += [(300, " ".join(near), "en", "s", 0), (301, text(40) + " " + bench[4][1] + " " + text(40), "en", "s", 0), (302, None, None, None, None), (303, "", "en", "s", 0)]
    passage = [text(20) for _ in range(24)]
    rows += [(400 + i, "\n".join([text(30), *passage, text(30)]), "en", "s", 0) for i in range(4)]
    labels = [(d, 1, int(100 <= d < 200)) for d, *_ in rows if d < 200]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = sorted(docs.columns)
    ids = lambda df: {x.doc_id for x in df.select("doc_id").collect()}
    clean = set(range(60)) | {302, 303, 400, 401, 402, 403}
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert sorted(docs.columns) == want
        kept.append(ids(docs))
    assert kept[0] == clean | {300, 301} == kept[1]
    assert kept[2] == clean | {301}
    assert kept[3] == clean == kept[4]
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{d}/1").collect()}
    # the passage stays once; in the others only what shares a chunk with their own lines
    assert all(p in texts[400] for p in passage) and all(sum(p in texts[i] for p in passage) <= 18 for i in (401, 402, 403))
    assert [x.doc_id for x in corpus_pipeline.run(spark, d).select("doc_id").distinct().orderBy("doc_id").collect()] == sorted(clean)


def test_null_and_repeated_ids(spark, tmp_path):
    import random

    r = random.Random(3)
    text = lambda n=40: " ".join(r.choices([f"w{i}" for i in range(3000)], k=n))
    item, copied, again = text(30), text(), text()
    alone = [(None, text()), (None, text()), (7, text()), (7, text()), (8, " \n"), (8, ""), (8, None), (None, "")]
    near = [(5, copied), (None, copied), (3, copied), (None, again), (9, again), (None, item)]
    d = str(tmp_path)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = [(i, t, "en", "s", 0) for i, t in alone + near]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    docs = docs.selectExpr("*", "1 as `row`", "2 as gone", "3 as component_id", "4 as _row", "5 as removed", "6 as score")
    kept = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=repr) if df.columns == docs.columns else df.columns
    assert kept(corpus_pipeline.drop_near_duplicates(spark, docs, d)) == sorted([*alone, (3, copied), (9, again), (None, item)], key=repr)
    assert kept(corpus_pipeline.drop_leaks(spark, docs, d)) == sorted([*alone, *near[:-1]], key=repr)


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "a b c d e f g. h i j")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    extra = ["row", "gone", "removed", "score", "predicted", "key", "marks", "n_words", "component_id", "node"]
    docs = spark.createDataFrame([(1, "some text\nof two lines", "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", *[f"'mine' as `{c}`" for c in extra])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, d)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr), name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0, name


def test_near_copies_reach_the_join(spark, tmp_path):
    """A near copy whose chunks are all changed goes as a whole to the join; one that
    shares chunks with the first keeps its own lines alone, and these stay."""
    import random

    r = random.Random(11)
    text = lambda n: [" ".join(r.choices([f"w{i}" for i in range(3000)], k=12)) for _ in range(n)]
    one_line, many = " ".join(text(8)), text(60)
    changed = one_line.split()
    changed[50] = "changed"
    own = list(many)
    own[30] = "a line of its own in the near copy"
    rows = [(1, one_line), (2, " ".join(changed)), (3, "\n".join(many)), (4, "\n".join(own))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path))
    by = {x.doc_id: x.text for x in left.collect()}
    assert by[1] == rows[0][1] and by[2] == rows[1][1] and by[3] == rows[2][1]
    assert "its own" in by[4] and len(by[4].split("\n")) < 20
    assert {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, left, str(tmp_path)).collect()} == {1, 3, 4}
