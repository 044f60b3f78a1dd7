"""Token ids of whole texts by a byte-level BPE file of the tokenizers library.

The library splits a text into pre-tokens, encodes each on its own, and always
splits before a space that a visible character follows, and between letters and
marks. So a text is cut there,
and equal pieces have equal ids: a run of texts is cut and hashed with vector
operations (two 64-bit hashes), a worker remembers the ids of pieces it has met,
and only new ones go to the library. Texts with characters whose class may differ
between Unicode versions, with rare white space, or with the string of an added
token go to the library whole, by the plain call. So does every text where the file
has another pre-tokenizer, a normalizer, truncation or padding: the cuts are those
of the byte-level pattern alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import map_arrow, only, process_cache

#: Pieces that a worker remembers, ids it keeps for them, and their longest length in bytes.
REMEMBERED, IDS_KEPT, LONGEST = 700_000, 4_000_000, 64
_BASES = (kernels.BASE, 0xD1342543DE82EF95)
_U = np.uint64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        split = self.library.pre_tokenizer
        plain = type(split).__name__ == "ByteLevel" and split.use_regex and not split.add_prefix_space
        self.cuts = plain and self.library.normalizer is None and not self.library.truncation and not self.library.padding
        #: strings that the library takes out of a text before it splits it
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        # hash, second hash, place and number of ids of the pieces in self.flat; sorted by hash, in two layers
        none = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.layers = [none, none]
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0

    def _ask(self, pieces: list[str], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and where each ends. Whole texts
        are encoded by the plain call, one by one; the others many at a time."""
        if whole.any():
            each: list = [None] * len(pieces)
            for i in np.flatnonzero(whole).tolist():
                each[i] = np.array(self.library.encode(pieces[i], add_special_tokens=False).ids, self.dtype)
            rest = np.flatnonzero(~whole)
            ids, ends = self._ask([pieces[i] for i in rest.tolist()], np.zeros(len(rest), bool))
            for i, a, b in zip(rest.tolist(), ends.tolist(), ends[1:].tolist()):
                each[i] = ids[a:b]
            return np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))
        ids, ends, base = [np.zeros(0, self.dtype)], [np.zeros(1, np.int64)], 0
        for i in range(0, len(pieces), 4096):
            part = pieces[i : i + 4096]
            got = self.library.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(got.ids, dtype=self.dtype))
            ends.append(base + np.searchsorted(np.array(got.word_ids, dtype=np.int64), np.arange(1, len(part) + 1)))
            base += len(got.ids)
        return np.concatenate(ids), np.concatenate(ends)

    def _keep(self, u: np.ndarray, v: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        merged = [np.concatenate(x) for x in zip(self.layers[1], (u, v, at, n))]
        order = np.argsort(merged[0], kind="stable")
        self.layers[1] = [x[order] for x in merged]
        if len(self.layers[1][0]) > 1 << 16:
            merged = [np.concatenate(x) for x in zip(*self.layers)]
            order = np.argsort(merged[0], kind="stable")
            self.layers = [[x[order] for x in merged], [x[:0] for x in merged]]

    def _uncut(self, data: np.ndarray, raw: bytes) -> np.ndarray:
        """Places whose rows must not be cut."""
        places = [_unsettled(data)]
        for text in self.added:
            at, found = raw.find(text), []
            while at >= 0:
                found.append(at)
                at = raw.find(text, at + 1)
            places.append(np.array(found, np.int64))
        return np.concatenate(places)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of rows of UTF-8 bytes, and where each row's ids begin, with
        one more entry at the end."""
        n = len(data)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(len(off), np.int64)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        begins = np.zeros(n, bool)
        begins[:-1] = (data[:-1] == 32) & ~blank[1:]
        kind = _KINDS[data]
        a, b = kind[:-1], kind[1:]
        bare = np.append(True, ~blank[:-2]) if n > 1 else blank[:0]  # no white space before the left byte
        begins[1:] |= (a == _LETTER) & (b > _LETTER) | (b == _LETTER) & ((a == _MARK) | (a == _LINE) & bare) | (a == _MARK) & (b == _LINE)
        rows = off[:-1]
        full = rows < off[1:]
        last = off[1:][full] - 1
        begins[last] = False  # a space that ends its row has nothing after it
        raw = data.tobytes()
        odd = np.unique(np.searchsorted(off, self._uncut(data, raw), side="right") - 1) if self.cuts else np.flatnonzero(full)
        for r in odd.tolist():
            begins[off[r] : off[r + 1]] = False
        begins[rows[full]] = True
        start = np.flatnonzero(begins)
        alone = np.isin(start, off[odd])
        end = np.append(start[1:], n)
        hashes = []
        wide = data.astype(np.uint64) + _U(1)
        for base in _BASES:
            p = kernels._power(base, n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(wide * p[:n], out=total[1:])
            h = (total[end] - total[start]) * p[n - start]
            hashes.append(kernels.mix(h * _U(pow(base, -n, 1 << 64)) ^ (end - start).astype(np.uint64)))
        u, first, which = np.unique(hashes[0], return_index=True, return_inverse=True)
        v = hashes[1][first]
        if (v[which] != hashes[1]).any():  # two pieces with one hash: keep all apart
            first = which = np.arange(len(start))
            u, v, fresh = hashes[0], hashes[1], np.ones(len(start), bool)
            at, count, keep = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64), False
        else:
            at, count, fresh, keep = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64), np.ones(len(u), bool), True
            for known in self.layers:
                if len(known[0]):
                    k = np.minimum(np.searchsorted(known[0], u), len(known[0]) - 1)
                    hit = (known[0][k] == u) & (known[1][k] == v)
                    at[hit], count[hit] = known[2][k[hit]], known[3][k[hit]]
                    fresh &= ~hit
        new = np.flatnonzero(fresh)
        flat = self.flat
        if len(new):
            spans = zip(start[first[new]].tolist(), end[first[new]].tolist())
            ids, ends = self._ask([raw[a:b].decode(errors="replace") for a, b in spans], alone[first[new]])
            count[new] = np.diff(ends)
            short = (end - start)[first[new]] <= LONGEST
            room = sum(len(x[0]) for x in self.layers) + len(new) <= REMEMBERED and self.used + len(ids) <= IDS_KEPT
            if keep and room and short.all():
                if self.used + len(ids) > len(self.flat):
                    self.flat = np.concatenate((self.flat, np.zeros(max(len(self.flat), len(ids)), self.dtype)))
                flat = self.flat
                flat[self.used : self.used + len(ids)] = ids
                at[new] = self.used + ends[:-1]
                self.used += len(ids)
                self._keep(u[new], v[new], at[new], count[new])
            else:
                at[new] = self.used + ends[:-1]
                flat = np.concatenate((self.flat[: self.used], ids))
        lengths = count[which]
        before = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        out = flat[np.repeat(at[which] - before, lengths) + np.arange(total)]
        piece = np.searchsorted(start, off)
        return out, np.append(before, total)[piece]


#: The library also splits between an ASCII letter and a mark or line break, either way (after one line break, not more), and before a line break after a mark; an apostrophe may belong to the letters after it.
_LETTER, _MARK, _LINE = 1, 2, 3
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _MARK
_KINDS[[9, 10, 13]] = _LINE


def _unsettled(data: np.ndarray) -> np.ndarray:
    """Places of bytes that may belong to a character outside tab, line feed,
    carriage return, x20-x7E, U+00A1-U+052F, U+2010-U+2027 and the euro sign."""
    table = np.ones(256, bool)
    table[[9, 10, 13]] = False
    table[32:127] = False
    table[0x80:0xC0] = False
    table[0xC3:0xD4] = False
    maybe = np.flatnonzero(table[data])
    if not len(maybe):
        return maybe
    lead, a, b = data[maybe], data[np.minimum(maybe + 1, len(data) - 1)], data[np.minimum(maybe + 2, len(data) - 1)]
    fine = (lead == 0xC2) & (a >= 0xA1) | (lead == 0xD4) & (a <= 0xAF) | (lead == 0xE2) & ((a == 0x80) & (b >= 0x90) & (b <= 0xA7) | (a == 0x82) & (b == 0xAC))
    return maybe[~fine]


def encoder(path: str) -> Encoder:
    cache = process_cache("encoders")
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]


def ids_in(column: pa.Array, path: str):
    """(first row, ids, where each row's begin) over short runs of a string column;
    null texts are empty."""
    enc = encoder(path)
    for first, data, off in kernels.slices(column):
        yield first, *enc.encode(data, off)


def encode(docs: DataFrame, end_id: int, path: str | None = None) -> DataFrame:
    """part, doc_id, start (ids before it in its part), n_tokens and ids of
    docs(doc_id, text), with end_id after each document. A part is a task's share
    of the rows, in the order in which the task reads them; ids are little-endian
    unsigned integers of 16 bits where the vocabulary has no more, else of 32."""
    path = path or default_path()

    def run(batches):
        from pyspark import TaskContext

        part, start, dtype = TaskContext.get().partitionId(), 0, encoder(path).dtype
        end = np.array([end_id], dtype).tobytes()
        for batch in batches:
            for first, ids, cut in ids_in(batch.column(1), path):
                n = np.diff(cut) + 1
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                raw, at = ids.tobytes(), (cut * dtype.itemsize).tolist()
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(n), part, np.int32)),
                    "doc_id": batch.column(0).slice(first, len(n)),
                    "start": pa.array(starts),
                    "n_tokens": pa.array(n),
                    "ids": pa.array([raw[a:b] + end for a, b in zip(at, at[1:])], pa.binary()),
                })

    return map_arrow(only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint")), run, "part int, doc_id bigint, start bigint, n_tokens bigint, ids binary")
