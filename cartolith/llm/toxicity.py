"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart. The ordinary one holds the words of
ordinary documents, the toxic one those of toxic documents, each by the number of its own
documents that hold them, the most frequent nearest the end. As toxic documents are mostly
ordinary too, the toxic dictionary is then trained again, in ROUNDS, on those of their
words that compress clearly better with it than without, the words of one half judged by
the dictionary of the other.

A text is read in windows of WORDS words, side by side. Each window is compressed with the
ordinary dictionary and with the toxic one before it: where only the toxic one knows a
string, the second length is shorter. Both lengths are of the window in the same frame, so
nothing else differs. Thresholds are calibrated on labelled documents that neither
dictionary has seen: each gain, for windows of like length, gets the log ratio of its
shares of toxic and ordinary windows (that or more), a document's sum is over its best windows, and the
cut between the classes is where the calibration documents part best.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .common import id_remainder, map_arrow, only, table

#: Labelled documents used for training, and the longest of them in bytes: 172 MiB at most.
MOST_TOXIC, MOST_ORDINARY, LONGEST_TRAINING = 1500, 4000, 1 << 15
DICT_ORDINARY, DICT_TOXIC = 400_000, 8_192
#: Training on windows that read toxic, and how many times more often a document of that class must have one.
ROUNDS, TIMES = 3, 5
WORDS, WINDOW_BYTES, BEST = 4, 96, 3
#: The shortest match that the compressors take.
LEAST_MATCH = 4
APART = b".,!?;:#*$%&|\"'()[]<>"
#: The frame of a window: its first bytes are the last of both dictionaries, so that no
#: window is too short to be compressed; its last ones let matches reach the window's end.
FRAME = bytes(range(128, 192))
BEFORE, BEHIND = FRAME[-32:] + b" ", b" " + FRAME[:16]
#: Gains and classes of window lengths that are told apart.
_GAINS, _MIDDLE, _CLASS, _CLASSES = 40, 10, 16, 4
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13, *APART]] = True


def words_of(text: str) -> list[bytes]:
    """The distinct words of a text, as windows read them."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return sorted(set(np.where(_BLANK[raw], np.uint8(32), kernels.lower_ascii(raw)).tobytes().split(b" ")) - {b""})


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and row, start and end of each window, of a run of rows: lower case, marks
    and white space between words as one space, and one at either end. A window of more than WINDOW_BYTES bytes
    is taken in pieces that overlap by half, the last of which ends with it."""
    begins, ends, _, at = kernels.words(data, off, True, APART)
    length = ends - begins
    starts = np.cumsum(length + 1) - length
    out = np.full(int((length + 1).sum()) + 1, 32, np.uint8)
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(starts, length) + place] = kernels.lower_ascii(data)[np.repeat(begins, length) + place]
    n = np.diff(at)
    count = -(-n // WORDS)
    row = np.repeat(np.arange(len(n)), count)
    first = at[row] + WORDS * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    last = np.minimum(first + WORDS, at[row + 1]) - 1
    start, end = starts[first], starts[last] + length[last]
    # pieces of long windows
    half = WINDOW_BYTES // 2
    pieces = np.maximum(1, -(-(end - start - WINDOW_BYTES) // half) + 1)
    k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    row, start, end = (np.repeat(x, pieces) for x in (row, start, end))
    final = k == np.repeat(pieces, pieces) - 1
    start = np.where(final, np.maximum(end - WINDOW_BYTES, start), start + half * k)
    return out, row, start, np.where(final, end, start + WINDOW_BYTES)


def dictionary(documents: list[list[bytes]], size: int) -> bytes:
    """The words that two documents or more hold, as many as size bytes take, the most
    frequent last."""
    counts = Counter(w for words in documents for w in words)
    kept, room = [], size
    for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        room -= len(w) + 1
        if n < 2 or room < 0:
            break
        kept.append(w)
    return b" " + b" ".join(kept[::-1]) + b" "


class Model:
    """What the executors need: two dictionaries, the value of each gain, and the cut."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.value = np.zeros((_CLASSES, _GAINS), np.float64)
        self.cut = math.inf
        self._open()

    def _open(self) -> None:
        import zstandard as z

        shape = z.ZstdCompressionParameters(format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=20, min_match=LEAST_MATCH, hash_log=15, chain_log=20, search_log=7, strategy=z.STRATEGY_BTLAZY2, target_length=32)
        self._compressors = []
        for content in (self.ordinary + FRAME, self.toxic + self.ordinary + FRAME):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=shape)
            self._compressors.append(z.ZstdCompressor(dict_data=d, compression_params=shape))
        self._known = np.zeros(1 << 18, bool)
        self._known[_strings(np.frombuffer(self.toxic, np.uint8))] = True

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._open()

    def gains(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """By how many bytes the toxic dictionary shortens each window. It cannot shorten
        one that shares no string of LEAST_MATCH bytes with it: there are no matches."""
        out = np.zeros(len(start), np.int64)
        before = np.concatenate(([0], np.cumsum(self._known[_strings(data)])))
        spaced = (start > 0) & (end < len(data)) & (data[start - 1] == 32) & (data[np.minimum(end, len(data) - 1)] == 32) if len(start) else start > 0
        last = np.clip(end + 2 - LEAST_MATCH, 0, len(before) - 1)
        may = np.flatnonzero(~spaced | (before[np.maximum(last, start - 1)] > before[np.clip(start - 1, 0, len(before) - 1)]))
        if len(may):
            out[may] = self._gains(data, start[may], end[may])
        return out

    def _gains(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        import zstandard as z

        length = end - start
        whole = length + len(BEFORE) + len(BEHIND)
        at = np.cumsum(whole) - whole
        framed = np.empty(int(whole.sum()), np.uint8)
        framed[(at[:, None] + np.arange(len(BEFORE))).ravel()] = np.tile(np.frombuffer(BEFORE, np.uint8), len(at))
        framed[((at + len(BEFORE) + length)[:, None] + np.arange(len(BEHIND))).ravel()] = np.tile(np.frombuffer(BEHIND, np.uint8), len(at))
        place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        framed[np.repeat(at + len(BEFORE), length) + place] = data[np.repeat(start, length) + place]
        segments = z.BufferWithSegments(framed.tobytes(), np.stack((at, whole), 1).astype("<u8").tobytes())
        ordinary, toxic = (np.fromiter(map(len, c.multi_compress_to_buffer(segments, threads=1)), np.int64, len(at)) for c in self._compressors)
        return ordinary - toxic

    def values(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The value of each window: none is below zero."""
        return np.maximum(self.value[_cells(self.gains(data, start, end), end - start)], 0)

    def score(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.cut - total, -50, 50)))


def _strings(data: np.ndarray) -> np.ndarray:
    """A hash of 18 bits of each string of LEAST_MATCH bytes."""
    if len(data) < LEAST_MATCH:
        return np.zeros(0, np.int64)
    b, n = data.astype(np.uint32), len(data) - LEAST_MATCH + 1
    v = b[:n].copy()
    for i in range(1, LEAST_MATCH):
        v |= b[i : i + n] << np.uint32(8 * i)
    return (v * np.uint32(2654435761)) >> np.uint32(14)


def _cells(gain: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(length // _CLASS, _CLASSES - 1), np.clip(gain + _MIDDLE, 0, _GAINS - 1)


def _sums(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """The sum of the BEST values of each row."""
    out, hit = np.zeros(rows), np.flatnonzero(value > 0)
    order = np.lexsort((-value[hit], row[hit]))
    r, v = row[hit][order], value[hit][order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    np.add.at(out, r[rank < BEST], v[rank < BEST])
    return out


def _word_gains(words: set[bytes], ordinary: bytes, toxic: bytes) -> dict[bytes, int]:
    listed = sorted(words)
    length = np.array([len(w) for w in listed], np.int64)
    end = np.cumsum(length)
    return dict(zip(listed, Model(ordinary, toxic).gains(np.frombuffer(b"".join(listed), np.uint8), end - length, end).tolist()))


def _toxic_words(toxic: list[list[bytes]], spare: list[list[bytes]], ordinary: bytes) -> list[list[bytes]]:
    """Of the words of toxic documents those that the dictionary of the other half
    shortens by so much that documents of spare, which are ordinary and in neither
    dictionary, seldom have such a word."""
    halves = [toxic[::2], toxic[1::2]]
    for _ in range(ROUNDS):
        trained = [dictionary(h, DICT_TOXIC) for h in halves]
        gains = [_word_gains({w for d in h for w in d}, ordinary, t) for h, t in zip(halves, trained[::-1])]
        usual = _word_gains({w for d in spare for w in d}, ordinary, dictionary(halves[0] + halves[1], DICT_TOXIC))
        for least in range(1, _GAINS):
            often = sum(g[w] >= least for h, g in zip(halves, gains) for d in h for w in d) / max(1, len(toxic))
            seldom = (sum(usual[w] >= least for d in spare for w in d) + 0.5) / max(1, len(spare))
            if often >= TIMES * seldom:
                break
        else:
            break
        halves = [[[w for w in d if g[w] >= least] for d in h] for h, g in zip(halves, gains)]
    return halves[0] + halves[1]


def _values(toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """The value of each gain, for each class of lengths, from counts of windows: the log
    ratio of the shares of windows with that gain or more. A larger gain is worth no less,
    so that one which calibration has not met has a value too; a gain below the least
    that a toxic window had is worth nothing."""
    tail = lambda c: (c[:, ::-1].cumsum(1)[:, ::-1] + 0.5) / (c.sum(1, keepdims=True) + 1)
    value = np.log(tail(toxic)) - np.log(tail(ordinary))
    met = toxic.copy()
    met[:, : _MIDDLE + 1] = 0
    return np.maximum.accumulate(np.where(met.cumsum(1) > 0, value, 0), 1)


def _runs(texts: list[str]):
    """kernels.slices of some texts."""
    return kernels.slices(pa.array(texts, pa.string()))


def train(toxic: list[str], ordinary: list[str]) -> Model | None:
    """None where either class has no document."""
    toxic, ordinary = (list(dict.fromkeys(x)) for x in (toxic, ordinary))
    if not toxic or not ordinary:
        return None
    part = lambda texts, keep: [t for t in texts if keep(zlib.crc32(t.encode()) % 4)] or texts
    fit_t, fit_o, check_t, check_o = part(toxic, lambda r: r > 0), part(ordinary, lambda r: r > 1), part(toxic, lambda r: r == 0), part(ordinary, lambda r: r == 0)
    usual = dictionary([words_of(t) for t in fit_o], DICT_ORDINARY)
    spare = [words_of(t) for t in part(ordinary, lambda r: r == 1)]
    model = Model(usual, dictionary(_toxic_words([words_of(t) for t in fit_t], spare, usual), DICT_TOXIC))

    counts, seen = [], []
    for texts in (check_t, check_o):
        count = np.zeros((_CLASSES, _GAINS))
        for _, data, off in _runs(texts):
            made, row, start, end = windows(data, off)
            gain = model.gains(made, start, end)
            np.add.at(count, _cells(gain, end - start), 1)
            seen.append((row, gain, end - start, len(off) - 1))
        counts.append(count)
    model.value = _values(*counts)
    totals = np.concatenate([_sums(row, np.maximum(model.value[_cells(gain, length)], 0), n) for row, gain, length, n in seen])
    truth = np.arange(len(totals)) < len(check_t)
    levels = np.unique(np.concatenate((totals, [0.5])))
    f1 = [2 * (truth & (totals >= c)).sum() / (truth.sum() + (totals >= c).sum()) for c in levels]
    best = int(np.argmax(f1))
    below = levels[best - 1] if best else 0.0
    model.cut = max(0.5, (levels[best] + below) / 2)
    return model


def totals(model: Model, column: pa.Array):
    """(first row, sums) over a string column."""
    for first, data, off in kernels.slices(column):
        made, row, start, end = windows(data, off)
        yield first, _sums(row, model.values(made, start, end), len(off) - 1)


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with score and predicted in place of any columns of those names.

    Whole texts are scored, each row by its own, whatever its doc_id; equal texts have
    equal scores. A null or empty text has the score of a text without windows (below
    0.5). Without a model every score is 0. Other columns stay. An empty table gives an
    empty table.
    """
    docs = docs.drop("score", "predicted")
    names = list(docs.columns)

    def run(batches):
        for batch in batches:
            column = batch.column(names.index("text"))
            scores = np.zeros(len(column))
            if model is not None:
                for first, sums in totals(model, column):
                    scores[first : first + len(sums)] = model.score(sums)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_arrow(docs, run, schema)


def fit(docs: DataFrame, labels: DataFrame, usable=None) -> Model | None:
    """Train on a bounded sample of docs(doc_id, text) with labels(doc_id, toxic):
    at most MOST_TOXIC and MOST_ORDINARY labelled documents, those with the smallest
    hashes, none longer than LONGEST_TRAINING bytes. usable: a condition on doc_id. A
    null label is none; of several, the largest holds; a null doc_id has none. Of rows
    that share a doc_id each text is an example, equal ones once, until there are as
    many examples as documents may be drawn."""
    labels = labels.where("doc_id is not null and toxic is not null")
    if usable is not None:
        labels = labels.where(usable)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # each task keeps no more than the bound of a class
    draw = lambda rows, n: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    drawn = draw(labels.where("toxic = 1"), MOST_TOXIC).unionByName(draw(labels.where("toxic <> 1"), MOST_ORDINARY))
    texts = only(docs, "doc_id", "text").where(F.octet_length("text").between(1, LONGEST_TRAINING))
    found = texts.join(F.broadcast(drawn), "doc_id").select("toxic", "text", F.xxhash64("text").alias("h"), "doc_id")
    rows = lambda toxic, n: [r["text"] for r in found.where(toxic).orderBy("h", "doc_id").limit(n).collect()]
    return train(rows("toxic = 1", MOST_TOXIC), rows("toxic <> 1", MOST_ORDINARY))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    held = id_remainder("doc_id", 5) == 0
    model = fit(docs, table(spark, sf_dir, "labels"), ~held)
    return classify(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
