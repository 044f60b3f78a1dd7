"""Place names: deduplication and ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Searches that may be broadcast (their strings, a row each); beyond, names and searches are joined by a shuffle.
BROADCAST_SEARCHES = 10_000


def index(places: DataFrame, *order: str) -> DataFrame:
    """Places without neighbours of equal name and kind: of each name's places in
    the given order (part and seq, unless told), one is dropped where the one before
    it has its kind. L, S, S, L leaves L, S, L."""
    order = order or ("part", "seq")
    before = F.lag("kind").over(Window.partitionBy("name").orderBy(*order))
    kept = places.withColumn("_before", before).where("_before is null or _before <> kind").drop("_before")
    return kept.withColumn("key", text.fold(F.col("name")))


def search(places: DataFrame, query: str, limit: int) -> DataFrame:
    """Best matches first: names that begin with the query, then those that hold
    it; shorter names first, then by name. An empty query finds nothing."""
    needle = text.fold(F.lit(query))
    rank = F.when(F.startswith("key", needle), 0).when(F.contains("key", needle), 1)
    found = places.withColumn("rank", F.when(needle != "", rank)).where("rank is not null")
    order = [c for c in ("part", "seq") if c in places.columns]
    return found.orderBy("rank", F.char_length("name"), "name", *order).limit(limit)


def search_many(places: DataFrame, searches: DataFrame) -> DataFrame:
    """The same for searches(q_id, query, lim), as q_id, rank_no (from 1) and the
    place. Searches are keyed by the first three letters of the folded query (or all of
    a shorter one), so that a name meets only searches for strings it holds."""
    wanted = searches.withColumn("needle", text.fold(F.col("query"))).where("needle <> ''").withColumn("gram", F.left("needle", F.lit(3)))
    sizes = wanted.groupBy(F.char_length("gram")).count().collect()  # three at most
    lengths = [r[0] for r in sizes]
    # never the grams of the names, which Spark reckons by the size of their file
    wanted = F.broadcast(wanted) if sum(r[1] for r in sizes) <= BROADCAST_SEARCHES else wanted.hint("merge")
    pieces = lambda n: F.when(F.char_length("key") >= n, F.transform(F.sequence(F.lit(1), F.char_length("key") - (n - 1)), lambda i: F.substring(F.col("key"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = F.array_distinct(F.concat(F.array().cast("array<string>"), *map(pieces, sorted(lengths))))
    both = places.withColumn("gram", F.explode(grams)).join(wanted, "gram").drop("gram").where(F.contains("key", F.col("needle")))
    ranked = both.withColumn("rank", F.when(F.startswith("key", F.col("needle")), 0).otherwise(1))
    order = [c for c in ("part", "seq") if c in places.columns]
    number = F.row_number().over(Window.partitionBy("q_id").orderBy("rank", F.char_length("name"), "name", *order))
    return ranked.withColumn("rank_no", number).where("rank_no <= lim").select("q_id", "rank_no", "rank", "name", "kind", "lat", "lon")
