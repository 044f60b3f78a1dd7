"""Language identification in two levels.

A text becomes the counts of its byte strings of two to four letters (lower-cased,
anything but letters is one space), hashed and scaled to unit length. Linear
support vector machines, one for each pair, first choose the language family and
then, within it, one language against another; most votes win, margins break
ties. Machines are trained by dual coordinate descent on a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels
from .common import id_remainder, map_arrow, only, table

#: Training texts of one language, of all, and the longest in bytes.
PER_LANGUAGE, MOST_TEXTS, LONGEST_TRAINING = 300, 6_000, 1 << 20
BUCKETS, LENGTHS = 2048, (2, 3, 4)
COST, EPOCHS = 10.0, 30
UNDETERMINED = "und"
_U = np.uint64

#: Families of common languages by ISO 639-1 code. Others are a family of their own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no nb sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt tk ug uz",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "semitic": "am ar he mt",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "malayic": "id jv ms su tl",
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


def family(lang: str) -> str:
    return _FAMILY_OF.get(lang, lang)


def features(data: np.ndarray) -> np.ndarray | None:
    """Unit vector of one text's bytes; None where no byte belongs to a letter."""
    low = data | np.uint8(32)
    letter = ((low >= 97) & (low <= 122)) | (data >= 128)
    if not letter.any():
        return None
    b = np.where(letter, np.where(data < 128, low, data), np.uint8(32))
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))].astype(np.uint64)
    b = np.concatenate(([32], b, [32])).astype(np.uint64)
    out = np.zeros(BUCKETS * len(LENGTHS), np.float32)
    for k, n in enumerate(LENGTHS):
        m = len(b) - n + 1
        if m > 0:
            h = np.zeros(m, np.uint64)
            for i in range(n):
                h = (h << _U(8)) | b[i : i + m]
            h = (h * _U(0x9E3779B97F4A7C15)) >> _U(53)
            out[k * BUCKETS : (k + 1) * BUCKETS] = np.bincount(h.astype(np.int64), minlength=BUCKETS)
    return out / np.linalg.norm(out)


def svm(x: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (bias last) of the hinge-loss machine for y in {-1, 1}. Each class
    gets the same total cost."""
    x = np.column_stack((x, np.ones(len(x), np.float32))).astype(np.float64)
    most = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    a, w, square = np.zeros(len(x)), np.zeros(x.shape[1]), (x * x).sum(1)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1
            new = min(max(a[i] - g / square[i], 0.0), most[i])
            if new != a[i]:
                moved = max(moved, abs(new - a[i]))
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
        if moved < 1e-3:
            break
    return w.astype(np.float32)


class Machines:
    """One-versus-one machines over named classes."""

    def __init__(self, x: np.ndarray, names: np.ndarray):
        self.names = sorted(set(names.tolist()))
        self.pairs = [(i, j) for i in range(len(self.names)) for j in range(i + 1, len(self.names))]
        ws = []
        for i, j in self.pairs:
            use = np.isin(names, [self.names[i], self.names[j]])
            ws.append(svm(x[use], np.where(names[use] == self.names[i], 1.0, -1.0)))
        self.w = np.array(ws, np.float32).reshape(len(self.pairs), x.shape[1] + 1)

    def choose(self, f: np.ndarray) -> tuple[str, float]:
        """The winner and its least margin over another class."""
        if len(self.names) == 1:
            return self.names[0], np.inf
        margin = self.w[:, :-1] @ f + self.w[:, -1]
        votes, sums = np.zeros(len(self.names)), np.zeros(len(self.names))
        for (i, j), m in zip(self.pairs, margin.tolist()):
            votes[i if m >= 0 else j] += 1
            sums[i] += m
            sums[j] -= m
        best = max(range(len(self.names)), key=lambda k: (votes[k], sums[k]))
        least = min(m if i == best else -m for (i, j), m in zip(self.pairs, margin.tolist()) if best in (i, j))
        return self.names[best], least


class Model:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        families = np.array([family(v) for v in langs.tolist()])
        self.family = Machines(x, families)
        self.language = {f: Machines(x[families == f], langs[families == f]) for f in self.family.names}

    def predict(self, data: np.ndarray) -> tuple[str, float]:
        f = features(data)
        if f is None or (not ((data | 32) - 97 < 26).any() and not any(c.isalpha() for c in data.tobytes().decode(errors="replace"))):
            return UNDETERMINED, 0.0
        name, a = self.family.choose(f)
        lang, b = self.language[name].choose(f)
        return lang, float(1 / (1 + np.exp(-np.clip(2 * min(a, b), -50, 50))))


def fit(docs: DataFrame, usable: Column | None = None) -> Model | None:
    """Train on docs(doc_id, text, lang): at most PER_LANGUAGE texts of a language
    and MOST_TEXTS in all, drawn by a hash of the text. Null languages and texts
    without letters are no examples. None where there is no example."""
    docs = docs if usable is None else docs.where(usable)
    docs = only(docs, "doc_id", "text", "lang").where("lang is not null").where(F.octet_length("text").between(1, LONGEST_TRAINING))
    hashed = docs.select("doc_id", "lang", F.xxhash64("text").alias("h"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    drawn = hashed.withColumn("k", order).where(F.col("k") <= PER_LANGUAGE).orderBy("k", "h").limit(MOST_TEXTS).select("doc_id", "lang", "h")
    chosen = docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(drawn), ["doc_id", "lang", "h"]).select("lang", "text")

    def run(batches):
        for batch in batches:
            langs, vectors = [], []
            for first, data, off in kernels.slices(batch.column(1)):
                for i in range(len(off) - 1):
                    f = features(data[off[i] : off[i + 1]])
                    if f is not None:
                        langs.append(batch.column(0)[first + i].as_py())
                        vectors.append(f.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(vectors, pa.binary())], ["lang", "v"])

    rows = sorted(((r["lang"], bytes(r["v"])) for r in map_arrow(chosen, run, "lang string, v binary").collect()))
    if not rows:
        return None
    return Model(np.array([np.frombuffer(v, np.float32) for _, v in rows]), np.array([lang for lang, _ in rows]))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) as doc_id, lang_pred, score. A null text, or one without
    letters, is und with score 0; so is every text where there is no model.
    Repeated rows are each predicted."""

    def run(batches):
        for batch in batches:
            langs, scores = [], []
            for _, data, off in kernels.slices(batch.column(1)):
                for i in range(len(off) - 1):
                    lang, score = model.predict(data[off[i] : off[i + 1]]) if model else (UNDETERMINED, 0.0)
                    langs.append(lang)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_arrow(only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint")), run, "doc_id bigint, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = id_remainder("doc_id", 4) == 2
    return identify(docs, fit(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
