import random
import re

from cartolith.llm import parity_join
from cartolith.llm.parity_join import linked

DOCS = "doc_id bigint, text string, lang string"


def brute(rows):
    """(doc_id, size, component) of each row, judged by its own text."""
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if same and 100 * same >= 80 * (len(a) + len(sets[j]) - same):
                up[root(i)] = root(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, *_) in enumerate(rows)), key=repr)


def result(df, **how):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in linked(df, **how).collect()), key=repr)


def corpus(seed, n=260):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = r.choices(vocab, k=60)
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.5:
            words = (r.choice(rows)[1] or "x").split()
            for _ in range(r.randint(0, max(1, len(words) // 40))):
                words[r.randrange(len(words))] = r.choice(vocab)
        else:
            words = r.choices(vocab, k=r.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 30, 60, 150, 400, 1500]))
            if kind > 0.8:
                words = passage + words
        rows.append((i * 7 + 3, " ".join(words), "en"))
    rows += [(1, None, None), (2, "", "en"), (4, " \n\t ", "en"), (5, "A b C", None), (6, "a B c", "x"), (8, "é " * 4000, "fr")]
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert result(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_null_and_repeated_ids(spark):
    """A row links by its own text, whatever rows share its id or have none."""
    r = random.Random(5)
    rows = [(r.choice([None, None, 1, 2, 3, d]), t, x) for d, t, x in corpus(3, 150)]
    rows += r.sample(rows, 20)
    assert result(spark.createDataFrame(rows, DOCS).repartition(3)) == brute(rows)


def test_exact_blocks_and_recall_on_long_texts(spark, monkeypatch):
    """Long texts that just link: both modes find all links; large keys are dealt out."""
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(5000)]
    rows = []
    for k in range(60):
        words = r.choices(vocab, k=r.choice([400, 900, 2500]))
        rows.append((2 * k, " ".join(words), "x"))
        # every edit costs five shingles of either set: the most that 80 percent bears
        edits = (len(words) - 4) // 45 - k % 3
        for i in range(edits):
            words[5 + i * (len(words) - 10) // edits] = f"edit{k}-{i}"
        rows.append((2 * k + 1, " ".join(words), "x"))
    want = brute(rows)
    assert sum(d != c for d, _, c in want) > 40
    docs = spark.createDataFrame(rows, DOCS)
    assert result(docs) == result(docs, exact=True) == want
    assert all(sure for _, _, _, sure in parity_join._EXACT_BANDS)
    monkeypatch.setattr(parity_join, "PART_ROWS", 2)
    monkeypatch.setattr(parity_join, "MOST_PIVOTS", 1)
    rows = corpus(4, 150)
    assert result(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_edges(spark):
    assert linked(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(3, "a b c d e f", "x")] * 3 + [(9, "A B C D E F", "y")]
    got = linked(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as n", "2 as fp", "3 as node")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(3, 2, 3)] * 3 + [(9, 2, 3)]


def test_bands_hold_every_pair():
    for b in range(1, 4000):
        for a in {b, -(-b * 4 // 5)}:
            assert any(lo <= a <= b <= hi for lo, hi, _, _ in parity_join._BANDS)


def test_appended_and_prepended_words(spark):
    """Every linked pair of which one set holds the other, up to 40 shingles."""
    pairs = [(long, short, front) for long in range(1, 41) for short in range(-(-long * 4 // 5), long + 1) for front in (False, True)]
    rows = []
    for k, (long, short, front) in enumerate(pairs):
        words = [f"p{k}w{i}" for i in range(long + 4)]
        rows += [(2 * k, " ".join(words), None), (2 * k + 1, " ".join(words[-short - 4 :] if front else words[: short + 4]), None)]
    got = {r.doc_id: r.component_id for r in linked(spark.createDataFrame(rows, DOCS)).collect()}
    assert [pairs[k] for k in range(len(pairs)) if got[2 * k + 1] != 2 * k] == []
