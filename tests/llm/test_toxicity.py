import random
import re

import numpy as np

from cartolith.llm import toxicity

DOCS = "doc_id bigint, text string"


def corpus(n=500):
    r = random.Random(5)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(r.randint(8, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["grumblefink", "Snotwhistle", "mudlump", "clotbrain"]) + r.choice(["", ".", "!"])
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, lab, toxicity.id_remainder("doc_id", 5) != 0)
    odd = [(1000, None), (1001, ""), (1002, "x" * 300_000), (None, "mudlump clotbrain grumblefink mudlump"), (1001, "")]
    got = toxicity.classify(spark.createDataFrame(rows + odd, DOCS).selectExpr("*", "1L as score", "'y' as extra"), model).collect()
    assert len(got) == len(rows) + len(odd) and got[0].extra == "y"
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert by[1000].predicted == by[1001].predicted == by[1002].predicted == 0 and by[None].predicted == 1
    right = [by[i].predicted == t for i, _, t in labels]
    assert sum(right) >= 0.98 * len(right)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, none)
    assert model is None
    assert [r.score for r in toxicity.classify(docs, model).collect()] == [0.0]
    assert toxicity.classify(docs.limit(0), model).count() == 0


def plain_windows(text):
    """Words by fours, one space between; more than WINDOW_BYTES bytes in pieces."""
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    for mark in toxicity.APART.decode():
        text = text.replace(mark, " ")
    words, out, size = [w.encode() for w in re.split("[\x20\x09-\x0D]+", text) if w], [], toxicity.WINDOW_BYTES
    for i in range(0, len(words), toxicity.WORDS):
        w = b" ".join(words[i : i + toxicity.WORDS])
        at = 0
        while at + size < len(w):
            out.append(w[at : at + size])
            at += size // 2
        out.append(w[max(0, len(w) - size) :] if at else w)
    return out


def test_windows_cover_texts_whole():
    texts = ["", " .. ", "One, two!  three\n\tfour five", "é" * 300, "a " * 4001, "x" * 97 + " yy zz", "w" * 96, "Grumblefink (z) " * 3, "k" * 1000 + " end"]
    data, off = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    made, row, start, end = toxicity.windows(data, off)
    got = [[made[a:b].tobytes() for a, b in zip(start[row == i], end[row == i])] for i in range(len(texts))]
    assert got == [plain_windows(t) for t in texts]
    assert all(len(w) <= toxicity.WINDOW_BYTES for g in got for w in g)
    half = toxicity.WINDOW_BYTES // 2
    assert all(any(b"k" * i + b" end" in w for w in got[8]) for i in range(half - 4)) and len(got[3]) > 1


def test_dictionaries_are_trained_apart():
    """Each holds the words of its own documents alone, and the toxic one only what
    ordinary text does not explain."""
    rows, labels = corpus(800)
    text = dict(rows)
    toxic, ordinary = [text[i] for i, _, t in labels if t], [text[i] for i, _, t in labels if not t]
    model = toxicity.train(toxic, ordinary)
    insults = [b"grumblefink", b"snotwhistle", b"mudlump", b"clotbrain"]
    assert all(w in model.toxic and w not in model.ordinary for w in insults)
    assert set(model.toxic.split()) <= {w for t in toxic for w in toxicity.words_of(t)}
    assert set(model.ordinary.split()) <= {w for t in ordinary for w in toxicity.words_of(t)}
    gain = lambda w: int(model.gains(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    assert gain(b"thon er grumblefink an") >= 4 and abs(gain(b"thon er on an")) <= 1


def test_the_draw_is_bounded_and_ties_score_alike(spark, monkeypatch):
    rows, labels = corpus(200)
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 20)
    monkeypatch.setattr(toxicity, "MOST_ORDINARY", 30)
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda t, o: seen.append((t, o)) or train(t, o))
    docs = spark.createDataFrame([*rows, *rows, (None, rows[0][1]), (4, "x" * 40_000)], DOCS)
    lab = spark.createDataFrame([*labels, *labels], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    (toxic, ordinary), text = seen[0], dict(rows)
    assert len(toxic) == 20 and len(ordinary) == 30 and model is not None
    assert set(toxic) <= {text[i] for i, _, t in labels if t} and set(ordinary) <= {text[i] for i, _, t in labels if not t}
    by = {}
    for r in toxicity.classify(docs, model).collect():
        by.setdefault(r.text, set()).add(r.score)
    assert all(len(v) == 1 for v in by.values())


def test_scores_against_window_by_window(spark):
    """The score of a text from the lengths of one window after the other."""
    import math

    import zstandard

    rows, labels = corpus(300)
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    shape = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=20, min_match=4, hash_log=15, chain_log=20, search_log=7, strategy=zstandard.STRATEGY_BTLAZY2, target_length=32)
    both = []
    for content in (model.ordinary, model.toxic + model.ordinary):
        made = zstandard.ZstdCompressionDict(content + toxicity.FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(compression_params=shape)
        both.append(zstandard.ZstdCompressor(dict_data=made, compression_params=shape))
    odd = [(900, "Grumblefink, mudlump! é" + "z" * 300 + " SNOTWHISTLE"), (901, None), (902, " \n "), (903, "clotbrain " * 50)]
    for r in toxicity.classify(spark.createDataFrame(rows[:60] + odd, DOCS), model).collect():
        worth = []
        for w in plain_windows(r.text):
            gain = len(both[0].compress(toxicity.BEFORE + w + toxicity.BEHIND)) - len(both[1].compress(toxicity.BEFORE + w + toxicity.BEHIND))
            row, column = toxicity._cells(np.array([gain]), np.array([len(w)]))
            worth.append(max(0.0, float(model.value[row[0], column[0]])))
        total = sum(sorted(worth, reverse=True)[: toxicity.BEST])
        assert abs(r.score - 1 / (1 + math.exp(model.cut - total))) < 1e-9
