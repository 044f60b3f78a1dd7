"""Quality rules with risk-controlled cutoffs, with DataFrame functions only.

Five measures of a text (thousandths of its words or characters) each reject it
above a cutoff. Cutoffs are chosen for each stratum (language) on labelled good
documents that nothing was fitted to: a cutoff is valid where the exact binomial
test rejects "more than RISK / rules of the good documents of this stratum would
be lost" at LEVEL / (strata x rules x cutoffs), so with probability 1 - LEVEL all
chosen cutoffs hold at once, and no stratum loses more than RISK of its good
documents to all rules together. Of the valid cutoffs the lowest is taken; where
none is valid (few labels) the rule rejects nothing in that stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, keep, table

RISK, LEVEL = 0.05, 0.05
WIDTH = 5
WORD = "[^\\x20\\x09-\\x0D]+"
RULES = ("symbols", "bangs", "capitals", "repeats", "dup_lines")
CUTOFFS = (100, 150, 200, 300, 400, 500, 700, 900)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WIDTH words found twice or more."""

    def windows(h):
        return F.transform(F.sequence(F.lit(0), F.size(h) - WIDTH), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WIDTH)]))

    def in_order(w):
        return F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def places(s):
        met = F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(met, lambda x: x["i"]))

    def covered(p):  # places p1 < p2 < ... cover min(WIDTH, p2 - p1) + ... + WIDTH words
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WIDTH), F.coalesce(F.get(p, j + 1) - x, F.lit(WIDTH)))), F.lit(0), lambda a, x: a + x)

    def count(w):
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(let(in_order(w), places), covered))

    return F.when(F.size(words) <= WIDTH, F.lit(0)).otherwise(let(let(F.transform(words, lambda x: F.xxhash64(x)), windows), count)).cast("long")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_capitals", "base_failed")


def measure(docs: DataFrame) -> DataFrame:
    """docs with MEASURES (long, base_failed boolean). Whole texts count; a null text
    has no words (and so fails). Columns of these names are replaced, others stay."""
    docs = docs.drop(*MEASURES)
    text, words, lines = fresh(docs, "text_", "words_", "lines_")
    split = docs.withColumn(text, F.coalesce("text", F.lit(""))).withColumn(words, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    split = split.withColumn(lines, F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD))))
    out = split.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(F.col(words)),
        "n_lines": F.size(lines).cast("long"),
        "n_bangs": F.regexp_count(text, F.lit("!")).cast("long"),
        "n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
    }).drop(text, words, lines)
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def measures() -> dict[str, Column]:
    share = lambda x, n: F.expr(f"(1000 * {x}) div greatest({n}, 1)")
    return {"symbols": share("n_symbols", "n_words"), "bangs": share("n_bangs", "n_words"), "capitals": share("n_capitals", "word_chars"), "repeats": share("n_repeat_words", "n_words"), "dup_lines": share("n_dup_lines", "n_lines")}


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed term by term; terms are ratios of their
    predecessor, in logarithms, so that no factor leaves the range of doubles."""
    odds = p / (1 - p)
    start = F.struct((n * F.log(F.lit(1 - p))).alias("l"), F.exp(n * F.log(F.lit(1 - p))).alias("s"))

    def step(a, i):
        l = a["l"] + F.log((n - i + 1) / i * odds)
        return F.struct(l.alias("l"), (a["s"] + F.exp(l)).alias("s"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, start, step, lambda a: F.least(a["s"], F.lit(1.0)))


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "stratum") -> DataFrame:
    """The chosen cutoff of each stratum and rule: stratum, rule, cutoff.

    measured has doc_id, the stratum and the measures; labels(doc_id, quality). A
    document counts once in its stratum, by its largest measures, however many rows
    share its doc_id; of several labels the worst holds; null ids and labels are none.
    Only a count for each stratum, rule and cutoff leaves the aggregation.
    """
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    losses = [F.count_if(F.col(r) > c).alias(f"{r}_{c}") for r in RULES for c in CUTOFFS]
    once = measured.join(good, "doc_id", "left_semi").groupBy(stratum, "doc_id").agg(*[F.max(r).alias(r) for r in RULES])
    counts = once.groupBy(stratum).agg(F.count("*").alias("n"), *losses)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{c}").alias("k")) for r in RULES for c in CUTOFFS])
    counts = keep(counts, "quality-counts")
    tests = max(counts.count(), 1) * len(RULES) * len(CUTOFFS)
    each = counts.select(stratum, "n", F.explode(rows).alias("t"))
    # at the mean and above it the tail is a quarter or more: no sum is needed
    low = (F.col("t.k") < F.col("n") * (RISK / len(RULES))) | (F.col("t.k") == 0)
    valid = each.where(F.when(low, binomial_tail(F.col("t.k"), F.col("n"), RISK / len(RULES)) <= LEVEL / tests).otherwise(False))
    return valid.groupBy(stratum, F.col("t.rule").alias("rule")).agg(F.min("t.cutoff").alias("cutoff"))


def decide(docs: DataFrame, labels: DataFrame, with_text: bool = True) -> DataFrame:
    """measure(docs) with stratum, the measures, the rules that reject (an array)
    and kept: false where the base rules fail or a rule rejects. A null lang is
    the stratum und; each row is judged by its own text, also where its doc_id is null
    or repeated. An empty table gives an empty table. Columns of the added names are
    replaced, others stay. Without with_text the texts are left out, and the measures
    are written once and read twice."""
    found = measure(docs).withColumn("stratum", F.coalesce(F.col("lang").cast("string"), F.lit("und"))).withColumns(measures())
    found = found if with_text else keep(found.drop("text"), "quality-measures")
    cut, of = fresh(found, "cut", "of")
    chosen = cutoffs(found, labels).groupBy(F.col("stratum").alias(of)).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias(cut))
    # one row a stratum: its number is that of the languages, counted before it is broadcast
    chosen = F.broadcast(chosen) if chosen.count() <= 10_000 else chosen
    rejects = F.array_compact(F.array(*[F.when(F.col(r) > F.try_element_at(F.col(cut), F.lit(r)), F.lit(r)) for r in RULES]))
    out = found.join(chosen, F.col("stratum") == F.col(of), "left").withColumn("rejected_by", rejects).drop(cut, of)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decide(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"), with_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The measures in SQL, as table expressions that end in m.
MEASURED_SQL = rf"""d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, 'und') AS stratum FROM documents),
s AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
e0 AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s),
g0 AS (SELECT doc_id, i, CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] END AS g FROM e0 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c0 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g0 WHERE g IS NOT NULL),
r0 AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c0, range(5) AS x(k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT s.doc_id, stratum, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(regexp_extract_all(t, '!')) AS BIGINT) AS n_bangs, CAST(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) AS n_capitals,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM s LEFT JOIN r0 USING (doc_id))"""


def _sql() -> str:
    grid = ", ".join(f"('{r}', {c})" for r in RULES for c in CUTOFFS)
    share = {"symbols": ("n_symbols", "n_words"), "bangs": ("n_bangs", "n_words"), "capitals": ("n_capitals", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines")}
    long = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, (1000 * {x}) // greatest({n}, 1) AS v FROM m" for r, (x, n) in share.items())
    p = RISK / len(RULES)
    return f"""
WITH {MEASURED_SQL},
v AS ({long}),
q AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
grid(rule, cutoff) AS (VALUES {grid}),
o AS (SELECT stratum, rule, doc_id, max(v) AS v FROM v SEMI JOIN q USING (doc_id) GROUP BY ALL),
k AS (SELECT stratum, grid.rule, cutoff, count(*) AS n, count(*) FILTER (v > cutoff) AS k FROM o v JOIN grid ON v.rule = grid.rule GROUP BY ALL),
p AS (SELECT stratum, rule, cutoff, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))) FROM range(k + 1) AS y(i)) AS tail FROM k),
cut AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM p WHERE tail <= {LEVEL} / ((SELECT count(DISTINCT stratum) FROM k) * {len(RULES) * len(CUTOFFS)}) GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM v JOIN cut USING (stratum, rule) WHERE v > cutoff)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND bad.doc_id IS NULL AS kept FROM m LEFT JOIN bad ON bad.doc_id = m.doc_id"""


SQL = _sql()
