import math
import random
import re

from pyspark.sql import functions as F

from cartolith.llm import quality_rules as q

DOCS = "doc_id bigint, text string, lang string, stratum int, cut string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    rep = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def test_measures_against_brute_force(spark):
    r = random.Random(8)
    texts = [None, "", " \t\n", "a", "é|é\x0bñ  x", "a b c d e a b c d e", "a a a a a a", "a b\na b\n\n\na b", "x " * 5000, "ü" * 3000]
    for _ in range(150):
        texts.append("".join(r.choice(["a", "b", "c!", "D", "#", "|"]) + r.choice([" ", " ", "\n", "\t", "\r\n"]) for _ in range(r.randint(1, 60))))
    df = spark.createDataFrame([(i, t, None, 1, "x") for i, t in enumerate(texts)], DOCS)
    for x in q.measure(df).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute(x.text), x.text


def test_binomial_tail(spark):
    cases = [(0, 10), (3, 10), (10, 10), (7, 900), (0, 5000), (60, 5000)]
    rows = spark.createDataFrame(cases, "k bigint, n bigint").select("k", "n", q.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for x in rows:
        assert abs(x.p - sum(math.comb(x.n, i) * 0.01**i * 0.99 ** (x.n - i) for i in range(x.k + 1))) < 1e-9


def test_risk_is_held_in_each_stratum(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(6000):
        lang = "en" if i % 3 else None
        good = r.random() < 0.8
        words = [r.choice(["one", "two", "three", "four", "five"]) + str(r.randrange(1000)) for _ in range(40)]
        if not good and i % 2:
            words = [w + "##" for w in words]
        elif not good:
            words = [w.upper() + "!!" for w in words]
        elif r.random() < 0.001:
            words = [w + "#" for w in words]
        rows.append((i, " ".join(words), lang, 1, "x"))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", "text", "lang")
    lab = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id bigint, quality int")
    out = {x.doc_id: x for x in q.decide(docs, lab).collect()}
    for lang in ("en", "und"):
        good = [out[i] for i, g in labels if g and out[i].stratum == lang]
        bad = [out[i] for i, g in labels if not g and out[i].stratum == lang]
        assert sum(not x.kept for x in good) <= q.RISK * len(good)
        assert sum(not x.kept for x in bad) == len(bad)
    # few labels prove nothing, so nothing more is rejected
    few = q.decide(docs, lab.limit(50)).where("not base_failed")
    assert few.where("not kept").count() == 0
    assert q.decide(docs.limit(0), lab).count() == 0 and q.decide(docs.limit(20), lab.limit(0)).count() == 20


def test_clashing_columns_repeats_and_null_ids(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["one", "two"]) + str(r.randrange(500)) for _ in range(30)) + " ##" * (i % 7 == 0) * 20, "en") for i in range(3000)]
    lab = spark.createDataFrame([(i, int(i % 7 > 0)) for i, *_ in rows], "doc_id bigint, quality int")
    odd = [(None, rows[0][1], "en"), (None, "x", None), (7, rows[1][1], "en")]
    extra = ["cut", "of", "_cut", "text_", "words_", "lines_", "rule", "cutoff", "key", "n", "t", "quality"]
    plain = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string")
    docs = plain.select("*", *[F.lit("mine").alias(c) for c in extra])
    got = q.decide(docs, lab).collect()
    assert len(got) == len(rows) + len(odd) and all(x[c] == "mine" for x in got for c in extra)
    # rows that repeat a document prove nothing more
    twice = plain.unionByName(plain).unionByName(plain)
    chosen = lambda d: sorted(tuple(x) for x in q.cutoffs(q.measure(d).withColumn("stratum", F.coalesce("lang", F.lit("und"))).withColumns(q.measures()), lab).collect())
    assert chosen(plain) == chosen(twice)
    kept = {(x.doc_id, x.text): x.kept for x in got}
    assert not kept[None, rows[0][1]] and not kept[None, "x"] and kept[7, rows[1][1]] and not kept[7, rows[7][1]]
