import hashlib
import random
import re

from pyspark.sql import functions as F

from cartolith.llm import line_dedup

DOCS = "doc_id bigint, text string, marks int, row int, stay string, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def spans(lines):
    """(pos, n) of the chunks: cut where the rolling hash says so."""
    may = [False] + [md5(md5(a) + md5(b))[0] in line_dedup.ENDS for a, b in zip(lines, lines[1:])]
    out, at = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or may[i] and not may[i - 1] and i <= len(lines) - 3:
            n = i + 1 - at
            while n > line_dedup.MOST_LINES + 1:
                out.append((at, line_dedup.MOST_LINES))
                at, n = at + line_dedup.MOST_LINES, n - line_dedup.MOST_LINES
            out.append((at, n))
            at = i + 1
    return [(p, n) for p, n in out if n > 1]


def brute(rows):
    seen, cut = {}, {}
    order = sorted({(d is not None, d or 0, t) for d, t in rows if t is not None}, key=str)
    order.sort(key=lambda r: r[:2])
    for has, d, t in order:
        for pos, n in spans(t.split("\n")):
            c = "\n".join(t.split("\n")[pos : pos + n])
            if WORD.search(c):
                seen.setdefault(c, []).append(((d if has else None, t), pos, n))
    for places in seen.values():
        for where, pos, n in places[1:]:
            cut.setdefault(where, set()).update(range(pos, pos + n))
    return sorted(((d, t if t is None or not cut.get((d, t)) else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut[d, t]), sorted(cut.get((d, t), ()))) for d, t in rows), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, "s", 3) for d, t in rows], DOCS).repartition(4)


def result(df):
    return sorted(((x.doc_id, x.text, list(x.removed)) for x in line_dedup.dedup(df).collect()), key=repr)


def corpus(r):
    vocab = [f"w{i}" for i in range(30)]
    line = lambda: " ".join(r.choices(vocab, k=r.choice([0, 1, 2, 3, 8, 20, 60])))
    passage = [line() for _ in range(14)]
    rows = []
    for i in range(150):
        lines = [line() for _ in range(r.randint(1, 9))]
        if i % 3 == 0:
            at = r.randrange(len(lines) + 1)
            lines[at:at] = passage[: r.randint(2, 14)]
        rows.append((i, "\n".join(lines)))
    rows += [(500, rows[3][1]), (501, None), (502, ""), (503, "\n\n\n"), (504, "\n\n\n"), (505, rows[0][1] + "\n" + rows[0][1]), (506, "x"), (507, "x"), (508, "y " * 60), (509, "y " * 60), (3, rows[3][1])]
    rows += [(600, "same\n" * 200), (601, "same\n" * 200 + "other"), (602, "\n".join(line() for _ in range(3000)))]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = corpus(random.Random(4))
    want = brute(rows)
    assert result(frame(spark, rows)) == want
    assert sum(len(x[2]) for x in want) > 100 and max(len(t.split("\n")) for _, t in rows if t) > 2000
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 3)  # hot keys go by the broadcast and the salt
    assert result(frame(spark, rows)) == want
    assert line_dedup.dedup(frame(spark, rows).limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    """Rows are told apart by text where they share an id."""
    passage = "one line here\nanother line there\na third line of it"
    rows = [(1, passage), (2, passage), (2, "something\nelse"), (None, "a null\nrow"), (None, passage), (None, passage), (7, "a null\nrow"), (7, None)]
    got = result(frame(spark, rows))
    left = {(d, t) for d, t, _ in got}
    # the null ids come first and keep what they hold
    assert left == {(1, ""), (2, ""), (2, "something\nelse"), (None, "a null\nrow"), (None, passage), (7, ""), (7, None)}
    assert len(got) == len(rows)


def test_bytes_decide(spark, monkeypatch):
    """Chunks whose keys collide stay, unless they equal the first."""
    monkeypatch.setattr(line_dedup, "key", lambda hashes, chunk: F.lit(1).cast("long"))
    rows = [(1, "a b\nc d"), (2, "e f\ng h"), (3, "a b\nc d"), (4, "e f\ng h")]
    assert {d: t for d, t, _ in result(frame(spark, rows))} == {1: "a b\nc d", 2: "e f\ng h", 3: "", 4: "e f\ng h"}


def test_an_insertion_moves_the_chunks_around_it_alone(spark):
    r = random.Random(8)
    lines = [" ".join(r.choices("abcdefghij", k=12)) for _ in range(400)]
    before = spans(lines)
    assert len(before) < 110 and sorted(n for _, n in before)[len(before) // 2] > 3
    for at in (0, 57, 200, 399):
        changed = lines[:at] + ["a new line"] + lines[at:]
        chunks = lambda x: {"\n".join(x[p : p + n]) for p, n in spans(x)}
        assert len(chunks(lines) - chunks(changed)) <= 2
    got = spark.createDataFrame([("\n".join(lines),), ("x\ny",), ("x",)], "t string").select(line_dedup.chunks(F.split("t", "\n")).alias("c")).collect()
    assert [[tuple(s) for s in x.c] for x in got] == [before, [(0, 2)], []]
