"""Quality by hierarchical empirical Bayes: document, path, host, all.

Document evidence is a log-likelihood ratio: binned measures of the text, each
bin with the smoothed shares of labelled good and bad documents in it. Documents lie
in FOLDS folds by their id, and the shares and the base rate that a fold is judged by
are those of the labelled documents of the other folds, so no document is judged by
its own label. With the base rate the evidence gives each document a probability.

Sites come from an address: its host and the first segment of its path. A host's mean
is shrunk toward the global mean, a path's toward its host's, each by a prior whose
strength is estimated from how much the groups below differ (method of moments), so a
site with few documents says little. The document's own probability is left out of its
sites' sums, and its evidence is added to the log-odds of its path. All sums are
grouped aggregations, combined before any shuffle, so a host with a third of the rows
is a few numbers a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_rules
from .common import forget, keep, table

FOLDS = 5

#: Upper edges of the bins of each measure (thousandths, words or mean characters).
EDGES = {
    "symbols": (0, 10, 50, 100, 200, 500),
    "bangs": (0, 10, 50, 100, 200, 500),
    "capitals": (0, 20, 40, 80, 150, 400),
    "repeats": (0, 20, 100, 200, 400),
    "dup_lines": (0, 50, 150, 300, 600),
    "words": (9, 30, 100, 300, 1000, 5000),
    "word_length": (2000, 3500, 5000, 7000, 10000),
}
SMOOTHING = 1.0
#: What lies before the host, around it, and the first segment of the path.
SCHEME, AUTHORITY, PORT, SEGMENT = "^([A-Za-z][A-Za-z0-9+.-]*:)?//", "^([^/?#]*@)?([^/?#]*)", ":[0-9]*$", "^[^/?#]*/([^/?#]*)"
#: Bounds of a prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1e6


def _bins(measured: DataFrame) -> dict[str, Column]:
    value = quality_rules.measures() | {"words": F.col("n_words"), "word_length": F.expr("(1000 * word_chars) div greatest(n_words, 1)")}
    out = {}
    for name, edges in EDGES.items():
        bin_ = F.lit(len(edges))
        for k in reversed(range(len(edges))):
            bin_ = F.when(value[name] <= edges[k], F.lit(k)).otherwise(bin_)
        out[name] = bin_
    return out


def site(address: Column) -> tuple[Column, Column]:
    """Host (lower case, without user, port and www.) and first segment of the path
    of an address, with or without a scheme. Null is the empty address."""
    rest = F.regexp_replace(F.coalesce(address.cast("string"), F.lit("")), SCHEME, "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, AUTHORITY, 2)), PORT, "")
    return F.regexp_replace(host, "^www\\.", ""), F.regexp_extract(rest, SEGMENT, 1)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(doc_id, F.lit(FOLDS)), F.lit(0)).cast("int")


def evidence_table(binned: DataFrame, labels: DataFrame) -> tuple[dict[str, list[float]], list[float]]:
    """Log-likelihood ratio of each bin, fold after fold, and the log-odds of the base
    rate of each fold. A row of counts for each fold leaves the aggregation."""
    import math

    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    joined = binned.join(known, "doc_id")
    sums = [F.count_if((F.col(f"b_{n}") == k) & (F.col("quality") == q)).alias(f"{n}_{k}_{q}") for n, e in EDGES.items() for k in range(len(e) + 1) for q in (0, 1)]
    rows = joined.groupBy("fold").agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good"), *sums).collect()
    other = lambda f, name: sum(r[name] for r in rows if r["fold"] != f)
    ratio: dict[str, list[float]] = {n: [] for n in EDGES}
    for f in range(FOLDS):
        good, bad = other(f, "good"), other(f, "bad")
        for n, e in EDGES.items():
            size = len(e) + 1
            share = lambda k, q, of: (other(f, f"{n}_{k}_{q}") + SMOOTHING) / (of + SMOOTHING * size)
            ratio[n] += [math.log(share(k, 1, good) / share(k, 0, bad)) for k in range(size)]
    return ratio, [math.log((other(f, "good") + 1) / (other(f, "bad") + 1)) for f in range(FOLDS)]


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> Column:
    """Beta-prior strength from groups with n, s (sum), q (sum of squares) and the
    mean they are compared with: m (1 - m) / between-variance - 1."""
    weight = F.sum("n")
    spread = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)) / weight
    noise = F.sum(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))) / weight
    level = F.sum(mean * (1 - mean) * F.col("n")) / weight
    between = F.greatest(spread - noise, F.lit(1e-9))
    return F.coalesce(F.least(F.greatest(level / between - 1, F.lit(WEAKEST)), F.lit(STRONGEST)), F.lit(STRONGEST))


def posteriors(docs: DataFrame, labels: DataFrame, address: str) -> DataFrame:
    """doc_id, evidence, doc_probability, host_posterior, path_posterior, score and
    kept (score of 0.5 or more) of docs(doc_id, text); address is an SQL expression
    that gives each row's address (see site()).

    Null and empty hosts are one group, so are null and empty paths of a host. A null
    or empty text has the evidence of a text without words; a host or path with this
    document alone has the mean above it. Without labels every evidence is 0. Each row
    is judged by itself; repeated rows count each in their sites. An empty table gives
    an empty table. Other columns are ignored.
    """
    host, path = site(F.expr(address))
    docs = docs.select("doc_id", "text", host.alias("host"), path.alias("path"))
    measured = quality_rules.measure(docs)
    bins = measured.select("doc_id", "host", "path", fold(F.col("doc_id")).alias("fold"), *[c.alias(f"b_{n}") for n, c in _bins(measured).items()])
    bins = keep(bins, "site-bins")
    ratio, base = evidence_table(bins, labels)
    evidence = sum((F.element_at(F.array(*map(F.lit, ratio[n])), F.col("fold") * (len(e) + 1) + F.col(f"b_{n}") + 1) for n, e in EDGES.items()), F.lit(0.0))
    odds = F.element_at(F.array(*map(F.lit, base)), F.col("fold") + 1)
    each = bins.select("doc_id", "host", "path", evidence.alias("evidence"), odds.alias("odds")).withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + F.col("odds"))))).drop("odds")
    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    paths = keep(each.groupBy("host", "path").agg(*sums), "site-paths")
    hosts = keep(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")), "site-hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    n_all, s_all = float(total["n"] or 0), float(total["s"] or 0)
    mean = s_all / n_all if n_all else 0.5
    k_host = hosts.agg(_strength(hosts, F.lit(mean)).alias("k")).first()["k"]
    shrunk = hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs"), ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("hm"))
    tied = paths.join(shrunk, "host")
    k_path = tied.agg(_strength(tied, F.col("hm")).alias("k")).first()["k"]
    sites = keep(tied.select("host", "path", F.col("n").alias("pn"), F.col("s").alias("ps"), "hn", "hs"), "site-posteriors")
    forget(docs.sparkSession, paths, hosts)
    # the document itself is left out of every sum
    own = F.col("p")
    all_but = (F.lit(s_all) - own) / F.greatest(F.lit(n_all) - 1, F.lit(1.0))
    above = F.when(F.lit(n_all) > 1, all_but).otherwise(F.lit(mean))
    host_mean = (F.col("hs") - own + k_host * above) / (F.col("hn") - 1 + k_host)
    path_mean = (F.col("ps") - own + k_path * F.col("host_posterior")) / (F.col("pn") - 1 + k_path)
    out = each.join(sites, ["host", "path"]).withColumn("host_posterior", host_mean).withColumn("path_posterior", path_mean)
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_posterior")))))
    return out.select("doc_id", "evidence", F.col("p").alias("doc_probability"), "host_posterior", "path_posterior", score.alias("score")).withColumn("kept", F.col("score") >= 0.5)


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents carry no address: their source is the host, their language the first
    segment of the path."""
    address = "concat(coalesce(source, ''), '/', coalesce(lang, ''))"
    out = posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), address)
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("evidence", "doc_probability", "host_posterior", "path_posterior", "score")], "kept")


def _sql() -> str:
    value = {"symbols": "(1000 * n_symbols) // greatest(n_words, 1)", "bangs": "(1000 * n_bangs) // greatest(n_words, 1)", "capitals": "(1000 * n_capitals) // greatest(word_chars, 1)", "repeats": "(1000 * n_repeat_words) // greatest(n_words, 1)", "dup_lines": "(1000 * n_dup_lines) // greatest(n_lines, 1)", "words": "n_words", "word_length": "(1000 * word_chars) // greatest(n_words, 1)"}
    bins = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS f, {len(e) + 1} AS size, CASE {' '.join(f'WHEN {value[n]} <= {x} THEN {k}' for k, x in enumerate(e))} ELSE {len(e)} END AS b FROM m" for n, e in EDGES.items())
    grid = ", ".join(f"('{n}', {k}, {len(e) + 1})" for n, e in EDGES.items() for k in range(len(e) + 1))
    logit = "ln(least(greatest({0}, 1e-6), 1 - 1e-6) / (1 - least(greatest({0}, 1e-6), 1 - 1e-6)))".format("pm")

    def strength(groups: str, mean: str) -> str:
        return f"(SELECT least(greatest((sum({mean} * (1 - {mean}) * n) / sum(n)) / greatest(sum(n * pow(s / n - {mean}, 2)) / sum(n) - sum(greatest(q / n - pow(s / n, 2), 0)) / sum(n), 1e-9) - 1, {WEAKEST}), {STRONGEST}) FROM {groups})"

    return f"""
WITH {quality_rules.MEASURED_SQL},
bins AS ({bins}),
fo AS (SELECT unnest(range({FOLDS})) AS fold),
y AS (SELECT doc_id, min(quality) AS quality, doc_id % {FOLDS} AS own FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
c AS (SELECT fold, f, b, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM bins JOIN y USING (doc_id), fo WHERE own <> fold GROUP BY ALL),
tot AS (SELECT fold, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM fo LEFT JOIN (SELECT * FROM y SEMI JOIN m USING (doc_id)) ON own <> fold GROUP BY fold),
ratio AS (SELECT tot.fold, g.f, g.b, ln((coalesce(c.good, 0) + 1) / (tot.good + g.size)::DOUBLE / ((coalesce(c.bad, 0) + 1) / (tot.bad + g.size)::DOUBLE)) AS r FROM (VALUES {grid}) g(f, b, size) CROSS JOIN tot LEFT JOIN c ON c.f = g.f AND c.b = g.b AND c.fold = tot.fold),
ev AS (SELECT doc_id, sum(r) AS evidence FROM bins JOIN ratio ON ratio.f = bins.f AND ratio.b = bins.b AND ratio.fold = doc_id % {FOLDS} GROUP BY doc_id),
e AS (SELECT o.doc_id, lower(coalesce(o.source, '')) AS host, coalesce(o.lang, '') AS path, evidence, 1 / (1 + exp(-(evidence + ln((tot.good + 1) / (tot.bad + 1)::DOUBLE)))) AS p FROM documents o JOIN ev USING (doc_id) JOIN tot ON tot.fold = o.doc_id % {FOLDS}),
pa AS (SELECT host, path, count(*) AS n, sum(p) AS s, sum(p * p) AS q FROM e GROUP BY ALL),
ho AS (SELECT host, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM pa GROUP BY ALL),
al AS (SELECT sum(n)::DOUBLE AS n, sum(s) AS s, sum(s) / sum(n) AS mean FROM ho),
hs AS (SELECT ho.*, al.mean FROM ho, al),
kh AS (SELECT {strength("hs", "mean")} AS kh),
ps AS (SELECT pa.*, (ho.s + kh * mean) / (ho.n + kh) AS hm FROM pa JOIN ho USING (host), al, kh),
kp AS (SELECT {strength("ps", "hm")} AS kp),
h AS (SELECT e.*, pa.n AS pn, pa.s AS ps, (ho.s - p + kh * CASE WHEN al.n > 1 THEN (al.s - p) / greatest(al.n - 1, 1) ELSE al.mean END) / (ho.n - 1 + kh) AS hp FROM e JOIN pa USING (host, path) JOIN ho ON ho.host = e.host, al, kh),
x AS (SELECT h.*, (ps - p + kp * hp) / (pn - 1 + kp) AS pm FROM h, kp),
z AS (SELECT *, 1 / (1 + exp(-(evidence + {logit}))) AS score FROM x)
SELECT doc_id, round(evidence, 6) AS evidence, round(p, 6) AS doc_probability, round(hp, 6) AS host_posterior, round(pm, 6) AS path_posterior, round(score, 6) AS score, score >= 0.5 AS kept FROM z"""


SQL = _sql()
