"""Benchmark decontamination: BM25 with block-max WAND, then question and answer.

The test items, not the corpus, are indexed: each word of the items has a posting
list with its BM25 impact, divided by the item's own full score, so that a passage
holding all words of an item scores 1 for it; lists are cut into blocks with the
largest impact of each, and a pointer that moves on skips the blocks that end before
its goal. Every passage of every training document (windows that overlap by the
longest item) is a query. Bounds over ranges of items reject most passages at once;
the rest go through block-max WAND, which returns every item that scores THRESHOLD or
more. An item counts as leaked only where the passage also holds most five-word
strings of its question and of its answer.

Document frequencies, mean length and passage width are those of all items, so it does
not matter over how many indexes a large benchmark is spread.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import map_arrow, only, table

K1, B = 1.2, 0.75
THRESHOLD = 0.7
BLOCK, RANGES = 64, 32
GRAM, SHARE = 5, 0.8
#: Bytes of item texts in one index (broadcast; some 5 bytes a byte of text, 80 at worst),
#: indexes that one scan of the documents meets, and bytes of text that meet one index
#: after the other.
INDEX_BYTES, INDEXES, RUN_BYTES = 8 << 20, 8, 32 << 20
#: A longer text is taken in pieces of so many bytes.
PIECE_BYTES = 4 << 20
APART = b".,!?;:|\"'()[]<>#*$%&"
_ANSWER = re.compile(r"(?:^|\n)\s*(?:answer|a)\s*:", re.I)
_U = np.uint64


def hashed(text: str) -> list[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return kernels.words(raw, np.array([0, len(raw)]), True, APART)[2].tolist()


def question_and_answer(text: str) -> tuple[list[int], list[int]]:
    """Split at an answer mark, else before the last sentence, else in halves."""
    mark = _ANSWER.search(text)
    if mark:
        return hashed(text[: mark.start()]), hashed(text[mark.end() :])
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n", text) if hashed(p)]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in hashed(p)], hashed(parts[-1])
    words = hashed(text)
    return words[: len(words) // 2], words[len(words) // 2 :]


class _List:
    """A pointer into a posting list: at its place, now the item there."""

    __slots__ = ("n", "item", "impact", "most", "blocks", "block_last", "block_most", "at", "now")

    def __init__(self, index: Index, t: int):
        a, b, c, d = (int(x) for x in (index.at[t], index.at[t + 1], index.block_at[t], index.block_at[t + 1]))
        # memoryviews give Python numbers without a copy of the list
        self.item, self.impact = memoryview(index.item)[a:b], memoryview(index.impact)[a:b]
        self.block_last, self.block_most = memoryview(index.block_last)[c:d], memoryview(index.block_most)[c:d]
        self.n, self.blocks, self.most = b - a, d - c, float(index.most[t])
        self.at, self.now = 0, self.item[0]

    def block_of(self, item: int) -> int:
        """The block in which item would lie, at the pointer or after it."""
        b = self.at // BLOCK
        return b if self.block_last[b] >= item else bisect.bisect_left(self.block_last, item, b + 1)

    def go(self, to: int) -> None:
        """On to the first item that is not less than to; blocks that end before it
        are not read."""
        if self.now < to:
            b = self.block_of(to)
            self.at = bisect.bisect_left(self.item, to, max(self.at + 1, b * BLOCK), min(self.n, (b + 1) * BLOCK)) if b < self.blocks else self.n
            if self.at < self.n:
                self.now = self.item[self.at]


def grams(words: list[int], n: int) -> set[tuple[int, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


class Corpus(NamedTuple):
    """What BM25 needs of all items: their number, mean and greatest number of
    words, and in how many items each word is."""

    items: int
    mean: float
    longest: int
    df: dict[int, int]


def corpus(parts) -> Corpus:
    """parts: lists of (item id, text). Items without words are left out."""
    n = total = longest = 0
    df: Counter = Counter()
    for items in parts:
        for _, text in items:
            w = hashed(text)
            if w:
                n, total, longest = n + 1, total + len(w), max(longest, len(w))
                df.update(set(w))
    return Corpus(n, total / max(1, n), longest, dict(df))


class Index:
    """items: (item id, text). Items without words are left out. Posting lists lie one
    after the other in flat arrays; list t is at[t] to at[t + 1]."""

    def __init__(self, items: list[tuple[int, str]], of: Corpus | None = None):
        of = of or corpus([items])
        kept = [(i, w, question_and_answer(t)) for i, t in items for w in [hashed(t)] if w]
        self.ids = [i for i, _, _ in kept]
        self.parts = [qa for _, _, qa in kept]
        self.longest = of.longest
        words, numbers, impacts = [], [], []
        for number, (_, w, _) in enumerate(kept):
            tf = Counter(w)
            part = {x: np.log1p((of.items - of.df[x] + 0.5) / (of.df[x] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / of.mean)) for x, n in tf.items()}
            whole = sum(part.values())
            words += part
            impacts += [v / whole for v in part.values()]
            numbers += [number] * len(part)
        self.terms, term = np.unique(np.array(words, np.uint64), return_inverse=True)
        order = np.lexsort((np.array(numbers, np.int64), term))
        self.item, self.impact = np.array(numbers, np.int64)[order], np.array(impacts, np.float64)[order]
        self.at = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        length = np.diff(self.at)
        blocks = -(-length // BLOCK)
        self.block_at = np.concatenate(([0], np.cumsum(blocks))).astype(np.int64)
        place = np.arange(self.block_at[-1]) - np.repeat(self.block_at[:-1], blocks)
        begin = np.repeat(self.at[:-1], blocks) + place * BLOCK
        end = np.minimum(begin + BLOCK, np.repeat(self.at[1:], blocks))
        self.block_most = np.maximum.reduceat(self.impact, begin) if len(begin) else np.zeros(0)
        self.block_last = self.item[end - 1] if len(begin) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(self.impact, self.at[:-1]) if len(self.terms) else np.zeros(1)
        self.range_size = -(-len(kept) // RANGES) or 1
        self.range_most = np.zeros((len(self.terms), RANGES), np.float32)
        np.maximum.at(self.range_most, (np.repeat(np.arange(len(self.terms)), length), self.item // self.range_size), self.impact.astype(np.float32))
        self.filter = np.zeros(1 << 18, bool)
        self.filter[(self.terms & _U((1 << 18) - 1)).astype(np.int64)] = True

    def posting(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Item numbers and impacts of list t."""
        return self.item[self.at[t] : self.at[t + 1]], self.impact[self.at[t] : self.at[t + 1]]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The term number of each word, -1 where the index has none."""
        out = np.full(len(h), -1, np.int64)
        if len(self.terms):
            may = np.flatnonzero(self.filter[(h & _U((1 << 18) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.terms, h[may]), len(self.terms) - 1)
            hit = self.terms[at] == h[may]
            out[may[hit]] = at[hit]
        return out

    def retrieve(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Every item whose impacts over the distinct terms sum to threshold or
        more, by block-max WAND."""
        least = threshold - 1e-9
        lists = [_List(self, t) for t in terms]
        out = []
        while lists:
            lists.sort(key=lambda x: x.now)
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x.most
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot].now
            while pivot + 1 < len(lists) and lists[pivot + 1].now == item:
                pivot += 1
            # the blocks in which the item would lie, of the lists up to the pivot
            bound, until = 0.0, None
            for x in lists[: pivot + 1]:
                b = x.block_of(item)
                if b < x.blocks:
                    bound += x.block_most[b]
                    until = x.block_last[b] if until is None else min(until, x.block_last[b])
            if bound < least:  # no item up to the nearest block end can reach the threshold
                to = max(item, until if until is not None else item) + 1
                if pivot + 1 < len(lists):
                    to = min(to, max(item + 1, lists[pivot + 1].now))
            elif lists[0].now == item:
                score = sum(x.impact[x.at] for x in lists[: pivot + 1])
                if score >= least:
                    out.append((item, score))
                to = item + 1
            else:
                to = item
            for x in lists[: pivot + 1]:
                x.go(to)
            lists = [x for x in lists if x.at < x.n]
        return out

    def verify(self, item: int, passage: list[int]) -> tuple[float, float]:
        """Shares of the question's and of the answer's word strings in a passage;
        a part without words counts as held."""
        shares = []
        for part in self.parts[item]:
            want = grams(part, min(GRAM, len(part))) if part else set()
            shares.append(len(want & grams(passage, min(GRAM, len(part)))) / len(want) if want else 1.0)
        return shares[0], shares[1]


Found = dict[tuple[int, int], tuple[float, float, int, float, float]]


def leaks_in(index: Index, data: np.ndarray, off: np.ndarray, whole: bool = True) -> tuple[Found, int, int]:
    """(row, item number) -> score, both shares, minus the first word of the best
    passage, question share, answer share, of each verified leak of a run of rows.
    Where the run is a piece of a text that goes on (not whole), passages that reach its
    end are left out, and the first of them is returned as its word and byte."""
    step = max(index.longest, 8)
    width = 2 * step
    start, _, h, at = kernels.words(data, off, True, APART)
    n = np.diff(at)
    # a row has as many passages as steps that begin in it; of a piece, those that end in it
    places = -(-n // step)
    if not whole:
        places = np.maximum(0, (n - width) // step + 1)
    rest = (0, 0)
    if not whole and places[0]:
        rest = (int(places[0]) * step, int(start[places[0] * step]))
    base = np.concatenate(([0], np.cumsum(places)))
    term = index.numbers(h)
    known = np.flatnonzero(term >= 0)
    row = np.searchsorted(at, known, side="right") - 1
    place = (known - at[row]) // step
    # a word lies in the passages that begin at its own step and at the one before
    both = [(base[row] + place)[ok := place < places[row]], (base[row] + place - 1)[before := (place > 0) & (place <= places[row])]]
    passages, terms = np.concatenate(both), np.concatenate((term[known][ok], term[known][before]))
    if not len(passages):
        return {}, *rest
    # (passage, term) once each
    passage, inverse = np.unique(passages, return_inverse=True)
    pairs = np.unique(inverse * len(index.terms) + terms)
    which, terms = pairs // len(index.terms), pairs % len(index.terms)
    first = np.searchsorted(which, np.arange(len(passage) + 1))
    sums = np.add.reduceat(index.most[terms], first[:-1])
    found: Found = {}
    for p in np.flatnonzero(sums >= THRESHOLD - 1e-6).tolist():
        mine = terms[first[p] : first[p + 1]]
        if index.range_most[mine].sum(axis=0).max() < THRESHOLD - 1e-4:
            continue
        r = int(np.searchsorted(base, passage[p], side="right")) - 1
        begin, words = int(passage[p] - base[r]) * step, None
        for item, score in index.retrieve(mine.tolist()):
            if words is None:
                words = h[at[r] + begin : min(at[r] + begin + width, at[r + 1])].tolist()
            q, a = index.verify(item, words)
            if q >= SHARE and a >= SHARE:
                found[r, item] = max(found.get((r, item), (-1.0,)), (score, q + a, -begin, q, a))
    return found, *rest


def leaks_of(index: Index, data: np.ndarray, off: np.ndarray) -> Found:
    """leaks_in of a run of rows; a long text, which is a run of its own, is read a
    piece after the other, each from where the last one's passages end."""
    if len(off) > 2 or len(data) <= PIECE_BYTES:
        return leaks_in(index, data, off)[0]
    found: Found = {}
    blank = np.zeros(256, bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    at = word = 0
    size = PIECE_BYTES
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and not blank[data[end]]:
            end += 1
        part, words, bytes_ = leaks_in(index, data[at:end], np.array([0, end - at]), end == len(data))
        for (r, item), v in part.items():
            found[r, item] = max(found.get((r, item), (-1.0,)), (v[0], v[1], v[2] - word, *v[3:]))
        if end == len(data):
            break
        if bytes_:
            at, word, size = at + bytes_, word + words, PIECE_BYTES
        else:  # too few words for a passage and its successor: a longer piece
            size *= 2
    return found


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document of docs(doc_id, text) and item of
    benchmark(item_id, text) that it leaks: doc_id, item_id, score,
    question_share, answer_share, first_word.

    Null and empty texts leak nothing; items without words are leaked by nothing.
    Items with equal texts are each reported; rows of docs are judged one by one,
    so repeated rows give repeated leaks; a null doc_id is kept. Ties between passages
    go to the first. Empty tables give an empty table. Other columns are ignored.

    The items go to the driver INDEX_BYTES of text at a time, and to every task as
    that index. One scan of docs meets up to INDEXES of them; a larger benchmark takes
    more scans. Scores do not depend on that.
    """
    # lower case in all scripts, the same way for both
    docs = only(docs, "doc_id", "text").withColumn("text", F.lower("text"))
    items = only(benchmark, "item_id", "text").where("text is not null and item_id is not null").select("item_id", F.lower("text").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // INDEX_BYTES + 1
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    part = lambda k: sorted((r["item_id"], r["text"]) for r in items.where(bucket == k).collect())
    of = corpus(part(k) for k in range(n))
    out = None
    for k in range(0, n, INDEXES):
        # by value, as workers need not have the package
        shared = [docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(Index(part(j), of))) for j in range(k, min(n, k + INDEXES))]
        some = _leaks(docs, shared)
        out = some if out is None else out.unionByName(some)
    return out


def _leaks(docs: DataFrame, shared: list) -> DataFrame:
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
    names = ["doc_id", "item_id", "score", "question_share", "answer_share", "first_word"]

    def runs(batches):
        """Batches of RUN_BYTES together, so that several indexes are opened seldom."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= RUN_BYTES or len(shared) == 1:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches):
        opened = (-1, None)
        for held in runs(batches):
            for k, value in enumerate(shared):
                if opened[0] != k:
                    opened = (-1, None)  # one at a time
                    opened = (k, cloudpickle.loads(value.value))
                index = opened[1]
                for batch in held:
                    found, doc = [], batch.column(0)
                    for first, data, off in kernels.slices(batch.column(1)) if index.ids else ():
                        found += [(doc[first + r].as_py(), index.ids[item], v[0], v[3], v[4], -v[2]) for (r, item), v in sorted(leaks_of(index, data, off).items())]
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], names)

    return map_arrow(docs, run, "doc_id bigint, item_id bigint, score double, question_share double, answer_share double, first_word bigint")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
