import random

from pyspark.sql import functions as F

from cartolith.llm import site_quality

ADDRESS = "concat(coalesce(source, ''), '/', coalesce(lang, ''))"
DOCS = "doc_id bigint, text string, source string, lang string, p double"


def corpus():
    r = random.Random(7)
    rows, labels = [], []
    for i in range(1500):
        host = r.choice(["good", "good", "bad", "mixed", f"tiny{i % 40}"])
        junk = r.random() < {"good": 0.02, "bad": 0.9}.get(host, 0.4)
        words = [r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(300)) for _ in range(r.randint(12, 80))]
        if junk:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w + "###" for w in words]
        rows.append((i, " ".join(words), host, r.choice(["a", "b"]), 0.0))
        if i % 3 == 0:
            labels.append((i, int(not junk)))
    return rows, labels


def test_scores(spark):
    rows, labels = corpus()
    odd = [(9000, None, None, None, 0.0), (9001, "", "good", "a", 0.0), (9002, "x " * 20_000, "good", "a", 0.0), (None, "alpha beta", "good", "a", 0.0)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = {x.doc_id: x for x in site_quality.posteriors(docs, lab, ADDRESS).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= x.score <= 1 and 0 < x.host_posterior < 1 and x.kept == (x.score >= 0.5) for x in got.values())
    right = [got[i].kept == ("!!" not in t and "###" not in t) for i, t, *_ in rows]
    assert sum(right) >= 0.98 * len(right)
    mean = lambda h: sum(got[i].path_posterior for i, _, s, *_ in rows if s == h) / sum(s == h for _, _, s, *_ in rows)
    assert mean("bad") < mean("mixed") < mean("good")
    tiny = [got[i].path_posterior for i, _, s, *_ in rows if s.startswith("tiny")]
    assert min(tiny) > 0.05 and max(tiny) < 0.97  # sparse sites stay near the prior


def test_no_labels_and_no_rows(spark):
    rows, _ = corpus()
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    docs = spark.createDataFrame(rows[:30], DOCS)
    assert {x.evidence for x in site_quality.posteriors(docs, none, ADDRESS).collect()} == {0.0}
    assert site_quality.posteriors(docs.limit(0), none, ADDRESS).count() == 0


def test_sites_of_addresses(spark):
    known = {"https://user@www.Example.org:8080/a/b?q#f": ("example.org", "a"), "//x.y/z": ("x.y", "z"), "src4/en": ("src4", "en"), "http://h?x/y": ("h", ""), "": ("", ""), None: ("", ""), "h/": ("h", ""), "ftp://a.b:21": ("a.b", "")}
    rows = spark.createDataFrame([(k,) for k in known], "a string").select("a", *[c.alias(n) for c, n in zip(site_quality.site(F.col("a")), ("host", "path"))]).collect()
    assert {r.a: (r.host, r.path) for r in rows} == known


def test_a_document_is_not_judged_by_its_own_label(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    score = lambda of: {x.doc_id: x.evidence for x in site_quality.posteriors(docs, spark.createDataFrame(of, "doc_id bigint, quality int"), ADDRESS).collect()}
    before = score(labels)
    after = score([(i, 1 - y) if i % site_quality.FOLDS == 2 else (i, y) for i, y in labels])  # all of a fold turned round
    assert all(before[i] == after[i] for i in before if i % site_quality.FOLDS == 2)
    assert any(before[i] != after[i] for i in before if i % site_quality.FOLDS != 2)


def test_repeated_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows[:200] + rows[:200] + [(None, "alpha beta", "good", "a", 0.0)] * 2, DOCS)
    got = site_quality.posteriors(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"), ADDRESS).collect()
    assert len(got) == 402 and len({(x.doc_id, x.evidence, x.score) for x in got}) == 201
