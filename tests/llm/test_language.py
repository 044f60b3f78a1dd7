import random

from cartolith.llm import language

DOCS = "doc_id bigint, text string, lang string, score string"
PARTS = {"en": "the ing tion and er", "de": "sch ung der ein ich", "fr": "eau que les ent oi", "es": "ción ado los que mente", "xx": "ɓa kwe zu"}


def corpus(n=600):
    r = random.Random(6)
    rows = []
    for i in range(n):
        lang = r.choice(list(PARTS))
        words = ["".join(r.choices(PARTS[lang].split(), k=r.randint(1, 3))) for _ in range(r.randint(3, 60))]
        rows.append((i, " ".join(words), lang if i % 11 else None, "s"))
        if lang != rows[-1][2]:
            rows[-1] = (i, " ".join(words), None, lang)
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    held = language.id_remainder("doc_id", 4) == 2
    model = language.fit(docs, ~held)
    assert model.family.names == ["germanic", "romance", "xx"]
    odd = [(9000, None, "en", ""), (9001, "", "en", ""), (9002, "123 !? £—", "en", ""), (9003, "the ing " * 50_000, "en", ""), (None, "tionand ering the", None, "")]
    got = {x.doc_id: x for x in language.identify(spark.createDataFrame(rows + odd, DOCS), model).collect()}
    test = [x for x in spark.createDataFrame(rows, DOCS).where(held).collect()]
    right = [got[x.doc_id].lang_pred == (x.lang or x.score) for x in test]
    assert sum(right) >= 0.97 * len(right)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (9000, 9001, 9002))
    assert got[9003].lang_pred == got[None].lang_pred == "en"
    assert all(0 <= x.score <= 1 for x in got.values())


def test_no_examples(spark):
    docs = spark.createDataFrame([(1, "a b", None, "")], DOCS)
    model = language.fit(docs)
    assert model is None and [x.lang_pred for x in language.identify(docs, model).collect()] == ["und"]
    assert language.identify(docs.limit(0), model).count() == 0
    one = language.fit(spark.createDataFrame([(1, "abc", "en", "")] * 2, DOCS))
    assert language.identify(docs, one).first().lang_pred == "en"


def brute(model, text):
    """Counts of letter strings, then every pair of classes, one after the other."""
    import numpy as np

    data, letters = (text or "").encode(), []
    for b in data:
        low = b | 32
        if 97 <= low <= 122 or b >= 128:
            letters.append(low if b < 128 else b)
        elif letters and letters[-1] != 32:
            letters.append(32)
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    letters = [32, *(letters if letters[0] != 32 else letters[1:])]
    letters += [32]
    # a leading or trailing mark leaves one space more
    first, last = data[0] | 32, data[-1] | 32
    if not (97 <= first <= 122 or data[0] >= 128):
        letters.insert(0, 32)
    out = np.zeros(language.BUCKETS * len(language.LENGTHS))
    for k, n in enumerate(language.LENGTHS):
        for i in range(len(letters) - n + 1):
            h = 0
            for b in letters[i : i + n]:
                h = (h << 8 | b) & (1 << 64) - 1
            out[k * language.BUCKETS + ((h * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 53)] += 1
    out /= np.sqrt((out**2).sum())

    def choose(machines):
        names, least = machines.names, {}
        if len(names) == 1:
            return names[0], np.inf
        votes, sums = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for w, (i, j) in zip(machines.w, machines.pairs):
            m = float(w[:-1] @ out + w[-1])
            votes[names[i] if m >= 0 else names[j]] += 1
            sums[names[i]] += m
            sums[names[j]] -= m
            least[names[i]], least[names[j]] = min(least.get(names[i], m), m), min(least.get(names[j], -m), -m)
        best = max(names, key=lambda n: (votes[n], sums[n]))
        return best, least[best]

    family, a = choose(model.family)
    lang, b = choose(model.language[family])
    return lang, 1 / (1 + np.exp(-np.clip(2 * min(a, b), -50, 50)))


def test_against_brute_force_and_repeated_rows(spark):
    rows = corpus(300)
    model = language.fit(spark.createDataFrame(rows, DOCS))
    odd = [(900, "The!! ting, EDing?", None, ""), (901, " ción ado ", None, ""), (902, "--sch", None, ""), (903, "é", None, ""), (904, "1 2", None, ""), (905, None, None, "")]
    docs = spark.createDataFrame(rows[:80] + odd + rows[:80], DOCS)
    got = language.identify(docs, model).collect()
    assert len(got) == 166
    texts, by = {r[0]: r[1] for r in rows + odd}, {}
    for x in got:
        by.setdefault(x.doc_id, set()).add((x.lang_pred, x.score))
    assert all(len(v) == 1 for v in by.values())
    for doc, ((lang, score),) in by.items():
        want = brute(model, texts[doc])
        assert lang == want[0] and abs(score - want[1]) < 1e-4, texts[doc]
