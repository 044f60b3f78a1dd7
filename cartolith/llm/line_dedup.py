"""Line dedup over content-defined chunks of lines, with DataFrame functions only.

A hash rolls over the hashes of each two lines that follow one another. Where its
value falls in a quarter of its range, and the one before it does not, a chunk ends
after the second line. So a boundary depends on three lines alone, chunks have two
lines or more (5.3 on average in long texts), and text that is inserted or removed
moves only the chunks around it. A run without boundary is cut every MOST_LINES lines;
a single last line belongs to the chunk before it. A text of one line has no chunk.

Chunks that occur more than once in all documents are compared byte by byte with
their first occurrence (smallest doc_id, null first, then line), and every later
occurrence that is equal loses its lines. Only keys and positions are shuffled to
find them. Keys of many rows are few, so a broadcast finds their rows, and the byte
comparison deals them out by a salt; no task holds a key with more than about
HOT_ROWS rows (or a millionth of all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, fresh, keep, only, table

#: First hexadecimal digits of the rolling hash at which a chunk may end: a quarter.
ENDS = "0123"
MOST_LINES = 64
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of a key from which it is hot, and the most keys that are broadcast (24 bytes each).
HOT_ROWS, HOT_KEYS = 1_000, 1_000_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def chunks(lines: Column) -> Column:
    """Array of (pos, n): first line (from 0) and number of lines of each chunk."""
    rolled = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - 1), lambda i: F.instr(F.lit(ENDS), F.left(F.md5(F.concat(h[i - 1], h[i])), F.lit(1))) > 0)
    # ends[i] is about lines i and i + 1: the chunk ends after line i + 1
    cuts = lambda e: F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i <= F.size(e) - 3) & e[i] & ~F.coalesce(F.get(e, i - 1), F.lit(False)))
    begins = lambda c: F.concat(F.array(F.lit(0)), F.transform(c, lambda i: i + 2))
    runs = lambda b: F.transform(b, lambda x, j: F.struct(x.alias("pos"), (F.coalesce(F.get(b, j + 1), F.size(lines)) - x).alias("n")))
    pieces = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((s["n"] - 1) / MOST_LINES).cast("int") - 1, F.lit(0))), lambda k: F.struct((s["pos"] + k * MOST_LINES).alias("pos"), F.when(s["n"] - 1 <= (k + 1) * MOST_LINES, s["n"] - k * MOST_LINES).otherwise(MOST_LINES).alias("n")))
    several = let(let(let(F.transform(lines, lambda x: F.md5(x)), rolled), cuts), lambda c: F.flatten(F.transform(let(begins(c), runs), pieces)))
    kind = "array<struct<pos:int,n:int>>"
    return F.when(F.size(lines) > 1, several.cast(kind)).otherwise(F.array().cast(kind))


def key(hashes: Column, chunk: Column) -> Column:
    return F.xxhash64(F.slice(hashes, chunk["pos"] + 1, chunk["n"]))


def content(lines: Column, pos: Column, n: Column) -> Column:
    return F.array_join(F.slice(lines, pos + 1, n), "\n")


def dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others) with text without its repeated chunks, and
    removed: an array of the removed line numbers (from 0, in the text as it was).

    A chunk with no word is never removed. A null text stays null, an empty one
    empty; a text of one line is never touched. Rows are told apart by doc_id and
    text: a null or repeated doc_id is no matter, and rows that agree in both are
    one document (what first occurs there stays in each). An empty table gives an
    empty table. A column named removed is replaced.
    """
    spark, docs = docs.sparkSession, docs.drop("removed")
    others = docs.columns
    row = F.struct("doc_id", F.xxhash64("text").alias("t"))
    lines = only(docs, "doc_id", "text").where(F.contains("text", F.lit("\n"))).select(row.alias("row"), F.split("text", "\n").alias("lines"))
    has_word = lambda a, s: F.exists(F.slice(a, s["pos"] + 1, s["n"]), lambda x: F.regexp_like(x, F.lit(WORD)))
    found = let(F.transform("lines", lambda x: F.xxhash64(x)), lambda h: F.transform(F.filter(chunks(F.col("lines")), lambda s: has_word(F.col("lines"), s)), lambda s: F.struct(s["pos"].alias("pos"), s["n"].alias("n"), key(h, s).alias("key"))))
    every = keep(lines.select("row", F.explode(found).alias("c")).select("row", "c.*"), "line-chunks")
    firsts = keep(every.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("row", "pos")).alias("first")).where("c > 1"), "line-firsts")
    # no more than HOT_KEYS keys have that many rows
    hot = max(HOT_ROWS, every.count() // HOT_KEYS)
    usual = every.join(firsts.where(F.col("c") < hot), "key")
    common = every.join(F.broadcast(firsts.where(F.col("c") >= hot)), "key")
    met = usual.unionByName(common).withColumn("leads", F.struct("row", "pos") == F.col("first")).withColumn("parts", F.ceil(F.col("c") / hot).cast("int"))
    row_, marks_, stay_ = fresh(docs, "row", "marks", "stay")
    marks = met.groupBy(F.col("row").alias(row_)).agg(F.collect_set(F.struct("pos", "n", "key", "leads", "parts")).alias(marks_))
    # in a struct a null doc_id equals another
    marked = keep(docs.join(marks, row == F.col(row_), "left").drop(row_), "line-marked", "snappy")
    forget(spark, every, firsts)

    # byte by byte against the first occurrence; what differs stays
    whole = only(marked, "doc_id", "text", marks_).where(F.col(marks_).isNotNull())
    texts = whole.select(row.alias("row"), F.split("text", "\n").alias("lines"), F.explode(marks_).alias("m")).select("row", "m.*", content(F.col("lines"), F.col("m.pos"), F.col("m.n")).alias("bytes"))
    part = F.pmod(F.xxhash64("row", "pos"), F.col("parts")).cast("int")
    leads = texts.where("leads").select("key", F.col("bytes").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    unlike = texts.where("not leads").withColumn("part", part).join(leads, ["key", "part"]).where("bytes <> lead").select("row", "pos").distinct()
    unlike = keep(unlike, "line-unlike")
    if not unlike.isEmpty():
        stay = unlike.groupBy(F.col("row").alias(row_)).agg(F.collect_set("pos").alias(stay_))
        marked = marked.join(stay, row == F.col(row_), "left").drop(row_).withColumn(marks_, F.when(F.col(stay_).isNull(), F.col(marks_)).otherwise(F.filter(marks_, lambda m: ~F.array_contains(stay_, m["pos"])))).drop(stay_)
    gone = F.array_sort(F.flatten(F.transform(F.filter(marks_, lambda m: ~m["leads"]), lambda m: F.sequence(m["pos"], m["pos"] + m["n"] - 1))))
    out = marked.withColumn("removed", F.coalesce(gone, F.array().cast("array<int>")))
    # in a line's place, whether it is removed
    left = let(F.transform(F.col("removed"), lambda i: i), lambda r: F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(r, i)))
    return out.withColumn("text", F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(left, "\n"))).select(*[F.col(f"`{c}`") for c in others], "removed")


SQL = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE contains(text, chr(10))),
l AS (SELECT doc_id, unnest(ls) AS x, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS i, len(ls) AS lines FROM d),
e AS (SELECT doc_id, i, lines, i > 0 AND contains('{ENDS}', left(md5(concat(md5(lag(x) OVER o), md5(x))), 1)) AS may FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, CAST(coalesce(lag(ends) OVER o, i = 0) AS INTEGER) AS new FROM (SELECT doc_id, i, may AND NOT lag(may) OVER o AND i <= lines - 3 AS ends FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
r0 AS (SELECT doc_id, run, min(i) AS pos, count(*) AS n FROM g GROUP BY doc_id, run),
r AS (SELECT doc_id, g.i, r0.pos + {MOST_LINES} * least((g.i - r0.pos) // {MOST_LINES}, greatest((n + {MOST_LINES - 2}) // {MOST_LINES} - 1, 0)) AS pos FROM g JOIN r0 USING (doc_id, run)),
t AS (SELECT doc_id, r.pos, string_agg(l.x, chr(10) ORDER BY l.i) AS body FROM r JOIN l USING (doc_id, i) GROUP BY doc_id, r.pos),
k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS k FROM t WHERE regexp_matches(body, '{WORD}')),
x AS (SELECT r.doc_id, r.i FROM r JOIN k USING (doc_id, pos) WHERE k > 1),
y AS (SELECT doc_id, list_sort(list(i)) AS removed FROM x GROUP BY doc_id),
z AS (SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.i) AS body FROM l ANTI JOIN x ON x.doc_id = l.doc_id AND x.i = l.i GROUP BY l.doc_id),
w AS (SELECT o.doc_id, CASE WHEN o.text IS NULL THEN NULL WHEN y.removed IS NULL THEN o.text ELSE coalesce(z.body, '') END AS body, coalesce(y.removed, []) AS removed FROM documents o LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id))
SELECT doc_id, CAST(len(string_split(body, chr(10))) AS INTEGER) AS n_lines_left, CAST(len(removed) AS INTEGER) AS n_removed, array_to_string(removed, ',') AS removed,
  CAST(strlen(body) AS INTEGER) AS n_bytes_left, md5(body) AS text_md5 FROM w"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number of lines left, the removed lines, and the length
    and md5 of the text that stays."""
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n"))).alias("n_lines_left"), F.size("removed").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.octet_length("text").alias("n_bytes_left"), F.md5("text").alias("text_md5"))
