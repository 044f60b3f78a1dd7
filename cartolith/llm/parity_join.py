"""N-gram Jaccard join through parity sketches.

A text's set holds the hashes of its distinct five-word shingles. For every size
band that a set falls in, the hash space is cut into p blocks, and each block's
sketch word is the XOR of the hashes in it. One token more or less changes one
word, so the number of differing words is a lower bound of the symmetric
difference, and two sets that link (Jaccard of 0.8 or more: at most a ninth of
the sum of their sizes differs) agree in all words but so many. p exceeds that
count, so by the pigeonhole rule they agree in some word, and equal (band, block,
word) keys give the candidates. A second sketch holds one parity bit for each of
2048 hash classes: its Hamming distance is a lower bound of the symmetric
difference too and rejects candidates before their sets are compared exactly.

Steps: equal sets become one class (any number of copies is one row from here
on); keys of one member are dropped; of its most frequent keys in a band a set drops as
many as the pigeonhole count allows, so that widely shared passages make few
pairs; each key's members are compared with a pivot, and only the members that
still lie in different components are compared with each other. No pair inside a
component is ever listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels
from .common import forget, keep, map_arrow, only, table
from .components import components

WIDTH = 5
PERCENT = 80
BITS = 2048
SPARE = 8
#: Low bits of a key, which hold its band.
BAND_MASK = 63
RATIO = 1.6
#: Ids of candidate sets that may be broadcast (8 bytes each); beyond, the texts are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Members of different components are compared with each other once that makes no more than so many pairs a row, or once a turn with new pivots leaves more than this share of the pairs; until then there are further pivots, for so many turns at most.
PAIRS_PER_ROW, PIVOTS_HELP, MOST_PIVOTS = 4, 0.7, 10
#: Members of a key that one task compares with all others of the key.
PART_ROWS = 1_000
_U = np.uint64


def most_apart(total: int, percent: int = PERCENT) -> int:
    """Largest symmetric difference of two linked sets whose sizes sum to total:
    100 i >= p (total - i) gives i >= p total / (100 + p)."""
    return total - 2 * -(-percent * total // (100 + percent))


def most_apart_within(total: int, percent: int = PERCENT) -> int:
    """Largest symmetric difference of two linked sets whose sizes sum to total or
    less. most_apart() has the parity of the sum and only rises along one parity,
    so the two largest sums are enough."""
    return max(most_apart(total, percent), most_apart(total - 1, percent))


def bands(percent: int = PERCENT, largest: int = 1 << 31, exact: bool = False) -> list[tuple[int, int, int, bool]]:
    """(smallest size, largest size, blocks, whether the pigeonhole rule alone
    vouches for it) of each band. Sizes of any linked pair (ratio of percent / 100
    at least) lie together in one band or more.

    Blocks: one more than a linked pair can differ in, and SPARE more; small sets
    get so many that each token is nearly alone. For large sets fewer do, as
    differing tokens fall on the same blocks: the number of equal words is then
    about Poisson, and a mean of 45 leaves a pair a chance below 1e-10 of SPARE
    equal words or fewer. With exact, large sets too get one more than a pair can
    differ in, and SPARE more.
    """
    out, lo = [], 1
    while lo <= largest:
        step = max(lo + 1, math.ceil(lo * RATIO))
        hi = max(lo, (step - 1) * 100 // percent)
        apart = most_apart_within(2 * hi, percent)
        p, sure = max(apart + 1 + SPARE, 128 if hi > 100 else 256 if hi > 24 else 1 << 32), True
        few = next((q for q in range(136, p, 8) if q * math.exp(-apart / q) >= 45), p) if hi > 300 and not exact else p
        if few < p:
            p, sure = few, False
        out.append((lo, hi, p, sure))
        lo = step
    return out


_BANDS, _EXACT_BANDS = bands(), bands(exact=True)


def sketch(u: np.ndarray, exact: bool = False) -> tuple[bytes, np.ndarray, list[tuple[int, int]]]:
    """Parity bits and join keys of a sorted set of hashes, and for each band how
    many of its keys may go: a linked set shares more keys than that in the band.
    The low bits of a key are its band."""
    bits = np.packbits((np.bincount((u & _U(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()
    keys, rooms, n = [], [], len(u)
    for k, (lo, hi, p, sure) in enumerate(_EXACT_BANDS if exact else _BANDS):
        if lo > n:
            break
        if n <= hi:
            block = ((u >> _U(32)) * _U(p)) >> _U(32)
            first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            word = np.bitwise_xor.reduceat(kernels.mix(u), first)
            full = word != 0
            mixed = kernels.mix(word[full] ^ kernels.mix(block[first][full] * _U(0x9FB21C651E98DF25) + _U(k + 1)))
            keys.append((mixed & ~_U(BAND_MASK)) | _U(k))
            rooms.append((k, max(0, len(mixed) - most_apart_within(n + min(hi, n * 100 // PERCENT)) - 1) if sure else SPARE))
    return bits, np.concatenate(keys), rooms


def _sketches(batches, width: int, exact: bool):
    """doc_id, text hash, size, fingerprint, parity bits, rooms and keys of each text."""
    for batch in batches:
        for first, data, off in kernels.slices(batch.column(1)):
            _, _, h, at = kernels.words(data, off, lower=True)
            sets = [kernels.shingle_set(h[at[i] : at[i + 1]], width) for i in range(len(off) - 1)]
            made = [sketch(u, exact) if len(u) else (b"", np.zeros(0, np.uint64), []) for u in sets]
            sizes = np.array([len(x) for _, x, _ in made])
            flat = np.concatenate([x for _, x, _ in made])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).slice(first, len(sets)),
                "text_hash": batch.column(2).slice(first, len(sets)),
                "n": pa.array([len(u) for u in sets], pa.int64()),
                "fp": pa.array([fingerprint(u) for u in sets], pa.binary()),
                "bits": pa.array([np.frombuffer(b, "<i8") if b else None for b, _, _ in made], pa.list_(pa.int64())),
                "rooms": pa.array([[{"band": k, "room": r} for k, r in rooms] for _, _, rooms in made], pa.list_(pa.struct([("band", pa.int32()), ("room", pa.int32())]))),
                "keys": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat.view(np.int64))),
            })


def fingerprint(u: np.ndarray) -> bytes:
    return len(u).to_bytes(8, "little") + np.add.reduce(kernels.mix(u)).tobytes() + np.bitwise_xor.reduce(kernels.mix(u ^ _U(0xA5A5A5A5))).tobytes()


def _sets(batches, width: int):
    """row and set of each text (row, text, fp) that has the fingerprint fp."""
    for batch in batches:
        for first, data, off in kernels.slices(batch.column(1)):
            _, _, h, at = kernels.words(data, off, lower=True)
            sets = [kernels.shingle_set(h[at[i] : at[i + 1]], width) for i in range(len(off) - 1)]
            same = pa.array([fingerprint(u) == batch.column(2)[first + i].as_py() for i, u in enumerate(sets)], pa.bool_())
            out = pa.RecordBatch.from_pydict({"row": batch.column(0).slice(first, len(sets)), "hashes": pa.array([u.tobytes() for u in sets], pa.binary())})
            yield out.filter(same)


def _verify(batches, percent: int):
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("x_set"), batch.column("y_set")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            same = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * same >= percent * (len(x) + len(y) - same))
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "ok": pa.array(ok, pa.bool_())})


def linked(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach,
    its own included) of docs(doc_id, text).

    Null or empty texts, and texts without words, have n_shingles 0 and are alone.
    Each row is judged by its own text, whatever rows share its doc_id or have none;
    a component without any doc_id has a null component_id. Repeated rows and ties
    are equal sets and so one class. An empty table gives an empty table. Other
    columns are ignored. exact: also large sets get as many blocks as the pigeonhole
    rule asks for (slower for long texts).
    """
    if percent != PERCENT:
        raise ValueError(f"the size bands are laid out for {PERCENT} percent")
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text", "doc_id"))
    # rows are numbered as they are written, so their numbers stay
    made = map_arrow(docs, lambda it: _sketches(it, width, exact), "doc_id bigint, text_hash bigint, n bigint, fp binary, bits array<bigint>, rooms array<struct<band:int,room:int>>, keys array<bigint>")
    made = keep(made.withColumn("row", F.monotonically_increasing_id()), "parity")
    sizes = keep(made.select("row", "doc_id", "n", "fp", "rooms"), "parity-sizes")
    # a class: its least row stands for it, its least doc_id names it
    reps = keep(sizes.groupBy("fp").agg(F.min("row").alias("rep"), F.min("doc_id").alias("name"), F.first("n").alias("n"), F.first("rooms").alias("rooms")), "parity-reps")
    members = sizes.select("doc_id", "n", "fp").join(reps.select("fp", "rep", "name"), "fp")

    copies = keep(sizes.join(reps.select("fp", "rep"), "fp").where("row <> rep or n = 0").select("row"), "parity-copies")
    # A key holds a set once, and a set has many keys: no key has more than a small share of the rows.
    keys = made.select("row", "keys").join(_small(copies), "row", "left_anti").select("row", F.explode("keys").alias("key"))
    keys = keys.repartition("key")
    often = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    band = F.expr(f"cast(key & {BAND_MASK} as int)")
    rank = F.row_number().over(Window.partitionBy("row", "band").orderBy(F.desc("c"), "key"))
    sized = reps.select(F.col("rep").alias("row"), "n", F.explode("rooms").alias("r")).select("row", "n", "r.*")
    met = keep(keys.join(often, "key").withColumn("band", band).withColumn("rank", rank).join(sized, ["row", "band"]).where("rank > room").select("row", "n", "key"), "parity-met")
    often = met.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    groups = keep(met.join(often, "key"), "parity-groups")

    ids = keep(groups.select("row").distinct(), "parity-ids")
    bits = keep(made.select("row", "n", "bits").join(_small(ids), "row", "left_semi"), "parity-bits")
    # the texts of these rows, by one long key; fingerprints settle what two texts share
    wanted = keep(made.select("row", "text_hash", "fp").join(_small(ids), "row", "left_semi"), "parity-wanted")
    forget(spark, copies, met, made)
    chosen = docs.join(_small(wanted), "text_hash").select("row", "text", "fp")
    sets = keep(map_arrow(chosen, lambda it: _sets(it, width), "row bigint, hashes binary"), "parity-sets")
    if sets.count() > ids.count():  # repeated rows
        sets = keep(sets.dropDuplicates(["row"]), "parity-sets")

    links, label, before = None, None, None
    for turn in range(MOST_PIVOTS + 1):
        now, full = groups.withColumn("comp", F.col("row")), False
        if label is not None:
            now = groups.where("c > 2").join(label, F.col("row") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "row")).drop("node", "component", "c")
            held = now.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("c"), F.sum(F.col("m") * F.col("m")).alias("q"), F.count("*").alias("comps"))
            still = keep(held.where("comps > 1"), "parity-still")
            left = still.agg(F.sum(F.expr("(c * c - q) div 2")).alias("pairs"), F.sum("c").alias("rows")).first()
            if not left["rows"]:
                break
            now = keep(now.join(still.select("key", "c"), "key"), "parity-open")
            helped = before is None or left["pairs"] < PIVOTS_HELP * before
            full = left["pairs"] <= PAIRS_PER_ROW * left["rows"] or not helped or turn == MOST_PIVOTS
            before = left["pairs"]
        near = (F.col("ac") != F.col("bc")) & (100 * F.least("an", "bn") >= percent * F.greatest("an", "bn"))
        if not full:  # a pivot or two for each key, others in each turn
            orders = [F.col("row")] if turn == 0 else [F.xxhash64(F.lit(2 * turn + i), "row") for i in (0, 1)]
            pivots = F.array(*[F.min_by(F.struct("row", "n", "comp"), by) for by in orders])
            pivot = now.groupBy("key").agg(pivots.alias("p")).select("key", F.explode(F.array_distinct("p")).alias("p"))
            left = now.select("key", F.col("row").alias("a"), F.col("n").alias("an"), F.col("comp").alias("ac"))
            right = pivot.select("key", F.col("p.row").alias("b"), F.col("p.n").alias("bn"), F.col("p.comp").alias("bc"))
            pairs = left.join(right, "key").where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            pairs = pairs.join(bits.toDF("a", "an", "a_bits"), "a").join(bits.toDF("b", "bn", "b_bits"), "b").where(_close(percent))
        else:  # what is left of different components; a large key's members are dealt out
            whole = now.join(bits.select("row", "bits"), "row").withColumn("parts", F.ceil(F.col("c") / PART_ROWS).cast("int"))
            left = whole.select("key", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), F.col("row").alias("a"), F.col("n").alias("an"), F.col("comp").alias("ac"), F.col("bits").alias("a_bits"))
            right = whole.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("row").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("bc"), F.col("bits").alias("b_bits"))
            pairs = left.join(right, ["key", "part"]).where(near & (F.col("a") < F.col("b")) & _close(percent))
        with_sets = pairs.select("a", "b").distinct().join(sets.toDF("a", "x_set"), "a").join(sets.toDF("b", "y_set"), "b")
        good = keep(map_arrow(with_sets, lambda it: _verify(it, percent), "a bigint, b bigint, ok boolean").where("ok").select("a", "b"), "parity-links")
        if label is not None:
            forget(spark, now, still)
        links = good if links is None else links.unionByName(good)
        label = components(links)
        if full:
            break
    forget(spark, groups, ids, bits, sets, links)
    # the least name of a component's classes
    tied = keep(reps.select("rep", "name").join(label, F.col("rep") == F.col("node")).select("component", "rep", "name"), "parity-tied")
    named = tied.join(tied.groupBy("component").agg(F.min("name").alias("least")), "component").select(F.col("rep").alias("of_rep"), "least", F.lit(True).alias("is_tied"))
    out = members.join(named, F.col("rep") == F.col("of_rep"), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("is_tied"), F.col("least")).otherwise(F.col("name"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _small(ids: DataFrame) -> DataFrame:
    """Marked for broadcast while its counted size allows; else joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _close(percent: int):
    """Whether the parity bits allow a link: their distance is at most the
    symmetric difference."""
    distance = F.aggregate(F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return distance * (100 + percent) <= (F.col("an") + F.col("bn")) * (100 - percent)


def op10_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
