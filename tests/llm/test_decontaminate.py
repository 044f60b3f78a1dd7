import random

import numpy as np

from cartolith.llm import decontaminate as d


def items(r, n=150):
    vocab = [f"w{i}" for i in range(300)] + ["the", "of"] * 20
    return [(i, ". ".join(" ".join(r.choices(vocab, k=r.randint(3, 14))) for _ in range(r.randint(1, 4)))) for i in range(n)]


def test_wand_equals_scoring_every_item():
    r = random.Random(1)
    for block in (2, 64):
        d.BLOCK, before = block, d.BLOCK
        index = d.Index(items(r))
        for _ in range(300):
            terms = r.sample(range(len(index.terms)), r.randint(1, 60))
            if r.random() < 0.5:
                i = r.randrange(len(index.ids))
                terms = list({t for t in range(len(index.terms)) if i in index.posting(t)[0]} | set(terms[:10]))
            full = np.zeros(len(index.ids))
            for t in terms:
                full[index.posting(t)[0]] += index.posting(t)[1]
            for threshold in (0.2, 0.5, 0.7):
                want = {i: round(v, 9) for i, v in enumerate(full) if v >= threshold - 1e-9}
                assert {i: round(v, 9) for i, v in index.retrieve(terms, threshold)} == want
        d.BLOCK = before


def test_blocks_are_skipped(monkeypatch):
    """A frequent word's list is not walked where only a rare word's items can reach
    the threshold."""
    index = d.Index([(i, f"often rare{i % 5000} word{i} other{i}") for i in range(20_000)])
    read = []

    class Watched:
        def __init__(self, view):
            self.view = view

        def __getitem__(self, i):
            read.append(i)
            return self.view[i]

        def __len__(self):
            return len(self.view)

    made = d._List.__init__

    def watched(self, *args):
        made(self, *args)
        self.item = Watched(self.item)

    monkeypatch.setattr(d._List, "__init__", watched)
    terms = index.numbers(np.array(d.hashed("often rare77 word77 other77"), np.uint64)).tolist()
    assert [i for i, _ in index.retrieve(terms)] == [77] and len(index.posting(terms[0])[0]) == 20_000
    assert len(read) < 200


def brute(docs, bench):
    """Every passage against every item, score by score."""
    every = [(i, t.lower()) for i, t in bench if t is not None]
    of = d.corpus([every])
    step, out = max(of.longest, 8), set()
    kept = [(i, d.hashed(t), d.question_and_answer(t)) for i, t in every if d.hashed(t)]
    for doc, text in docs:
        words = d.hashed((text or "").lower())
        for item, w, parts in kept:
            impact = {x: np.log1p((of.items - of.df[x] + 0.5) / (of.df[x] + 0.5)) * w.count(x) * (d.K1 + 1) / (w.count(x) + d.K1 * (1 - d.B + d.B * len(w) / of.mean)) for x in w}
            best = None
            for begin in range(0, len(words), step):
                passage = words[begin : begin + 2 * step]
                score = sum(v for x, v in impact.items() if x in set(passage)) / sum(impact.values())
                shares = []
                for part in parts:
                    n = min(d.GRAM, len(part))
                    want, have = d.grams(part, n) if part else set(), d.grams(passage, n)
                    shares.append(len(want & have) / len(want) if want else 1.0)
                if score >= d.THRESHOLD - 1e-9 and min(shares) >= d.SHARE:
                    best = max(best or (-1.0,), (round(score, 9), round(sum(shares), 9), -begin, *(round(x, 9) for x in shares)))
            if best:
                out.add((doc, item, best[0], best[3], best[4], -best[2]))
    return out


def corpus(r):
    bench = items(r, 60)
    vocab = [f"v{i}" for i in range(500)] + ["the", "of"] * 30
    rows = []
    for i in range(200):
        words = r.choices(vocab, k=r.choice([3, 40, 300, 900]))
        if i % 5 == 0:
            text = r.choice(bench)[1]
            at = r.randrange(len(words) + 1)
            words[at:at] = text.upper().split() if i % 2 else text.split()
        elif i % 5 == 1:  # the question alone is no leak
            words += r.choice([t for _, t in bench if t.count(".") > 1]).rsplit(". ", 1)[0].split()
        elif i % 5 == 2:  # one word in the middle changed
            text = r.choice(bench)[1].split()
            text[len(text) // 2] = "changed"
            words += text
        rows.append((i, " ".join(words)))
    bench += [(70, "Élan ça où. Übermut öffnet große Wälder, très tôt."), (71, bench[3][1]), (900, None), (901, " ., ")]
    rows += [(2000, "x " * 40 + bench[60][1].upper().replace("SS", "ß") + " y" * 30), (1000, None), (1001, ""), (None, bench[3][1]), (1002, "the of " * 3000), (1003, bench[5][1]), (1003, bench[5][1])]
    return rows, bench


def found(spark, rows, bench):
    docs = spark.createDataFrame([(i, t, 0.0, 1) for i, t in rows], "doc_id bigint, text string, score double, item_id int")
    b = spark.createDataFrame([*bench, bench[0]], "item_id bigint, text string")
    return [(x.doc_id, x.item_id, round(x.score, 9), round(x.question_share, 9), round(x.answer_share, 9), x.first_word) for x in d.leaks(docs, b).collect()]


def test_leaks_equal_brute_force_however_the_items_are_split(spark, monkeypatch):
    rows, bench = corpus(random.Random(2))
    want = brute(rows, bench)
    assert {(None, 3), (None, 71), (2000, 70)} <= {x[:2] for x in want} and len(want) > 40
    got = found(spark, rows, bench)
    assert set(got) == want and sum(x[0] == 1003 for x in got) == 2 * sum(x[0] == 1003 for x in want)
    monkeypatch.setattr(d, "INDEX_BYTES", 600)
    monkeypatch.setattr(d, "RUN_BYTES", 20_000)
    assert sorted(found(spark, rows, bench), key=repr) == sorted(got, key=repr)  # several scans
    monkeypatch.setattr(d, "INDEXES", 100)
    assert sorted(found(spark, rows, bench), key=repr) == sorted(got, key=repr)  # one scan
    docs = spark.createDataFrame(rows[:2], "doc_id bigint, text string")
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    assert d.leaks(docs.limit(0), b).count() == 0 and d.leaks(docs, b.limit(0)).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    """A text read in pieces gives what it gives as a whole."""
    r = random.Random(6)
    bench = items(r, 40)
    index = d.Index(bench)
    words = r.choices([f"v{i}" for i in range(900)], k=30_000)
    for _ in range(60):
        at = r.randrange(len(words))
        words[at:at] = r.choice(bench)[1].split()
    data = np.frombuffer((" ".join(words) + "." * 3000 + "z" * 5000).encode(), np.uint8)
    off = np.array([0, len(data)])
    whole = d.leaks_in(index, data, off)[0]
    assert len(whole) > 20
    for size in (50, 700, 5000, 60_000):
        monkeypatch.setattr(d, "PIECE_BYTES", size)
        assert d.leaks_of(index, data, off) == whole


def test_ten_million_words():
    bench = items(random.Random(3), 30)
    text = ("x " * 10_500_000 + bench[7][1]).encode()
    data = np.frombuffer(text, np.uint8)
    got = d.leaks_of(d.Index(bench), data, np.array([0, len(data)]))
    assert 7 in {item for _, item in got} and all(-v[2] > 10_400_000 for v in got.values())
