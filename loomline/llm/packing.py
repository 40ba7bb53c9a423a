"""Filling fixed-capacity containers with documents (problem 9): large-item matching, then best fit of the rest."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.bpe import token_counts, vocabulary_path
from loomline.session import stage
from loomline.sources import tables

#: Tokens that a container holds.
CAPACITY = 2048

#: Rows of one size that a single window may number; larger classes are cut into salted runs.
RUN = 50_000


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Packs sizes by their counts. Returns runs (size, first rank, items, first bin, items per bin) and the number of bins.

    Items of one size are interchangeable, so runs of equal bins are packed together; the plan's length depends on the number of different sizes, which the
    capacity bounds, and not on the number of items.
    1. Items above a third of the capacity: at most two fit in a bin. From the largest down, each is matched with the largest partner that still fits.
    2. Smaller items, from the largest down: best fit into the tightest remaining gap, as many as the gap takes; new bins where no gap is left.
    """
    left = {s: n for s, n in histogram.items() if 0 < s <= capacity and n > 0}
    placed = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first bin, bins)
    order: list[int] = []
    bins = 0

    def put(size: int, first: int, count: int, per: int) -> None:
        runs.append((size, placed[size], count * per, first, per))
        placed[size] += count * per
        left[size] -= count * per

    def keep(gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, count))

    large = sorted(s for s in left if 3 * s > capacity)
    alive = list(large)
    for a in reversed(large):
        while left[a]:
            at = bisect_left(alive, capacity - a + 1) - 1
            while at >= 0 and (left[alive[at]] == 0 or (alive[at] == a and left[a] < 2)):
                if left[alive[at]] == 0:
                    alive.pop(at)
                at -= 1
            if at < 0:
                n = left[a]
                put(a, bins, n, 1)
                keep(capacity - a, bins, n)
            elif alive[at] == a:
                n = left[a] // 2
                put(a, bins, n, 2)
                keep(capacity - 2 * a, bins, n)
            else:
                b = alive[at]
                n = min(left[a], left[b])
                put(a, bins, n, 1)
                put(b, bins, n, 1)
                keep(capacity - a - b, bins, n)
            bins += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(order, s)
            if at < len(order):
                gap = order[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
                per = min(gap // s, left[s])
                n = min(count, left[s] // per)
                keep(gap, first + n, count - n)
            else:
                per = min(capacity // s, left[s])
                n, first, gap = left[s] // per, bins, capacity
                bins += n
            put(s, first, n, per)
            keep(gap - per * s, first, n)
    return runs, bins


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """doc_id, n_tokens -> doc_id, piece_no, size. Only a document above the capacity is split: full pieces and a rest."""
    full = F.floor(F.col("n_tokens") / capacity)
    rest = F.col("n_tokens") % capacity
    cut = F.when(F.col("n_tokens") <= capacity, F.array(F.col("n_tokens"))).otherwise(F.concat(F.array_repeat(F.lit(capacity).cast("long"), full.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>"))))
    return sizes.select("doc_id", F.posexplode(cut).alias("piece_no", "size"))


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece_no, n_tokens, bin_id. sizes: doc_id, n_tokens (null counts as 0).

    The counts per size (at most `capacity` rows, whatever the data) are packed on the driver; the documents find their bins by their rank within their
    size, in parallel. Ranks are numbered in salted runs, so a size that a third of the documents share is no single task's.
    Items without tokens take no room and lie in bin 0, or in a bin of their own if there is no other. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = stage(pieces(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")), capacity).withColumn("_row", F.monotonically_increasing_id()))
    spark = items.sparkSession
    counts = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # capacity + 1 rows at most
    runs, _ = plan(counts, capacity)
    salts = max(1, max(counts.values(), default=0) // RUN)
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    here = salted.withColumn("_at", F.row_number().over(Window.partitionBy("size", "_salt").orderBy("_row")) - 1)
    before = Window.partitionBy("size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = salted.groupBy("size", "_salt").agg(F.count("*").alias("_n")).select("size", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    ranked = here.join(offset, ["size", "_salt"]).withColumn("_rank", F.col("_at") + F.col("_off"))
    table = spark.createDataFrame(runs, "size long, r_first long, r_items long, b_first long, per long")
    hit = ranked.join(F.broadcast(table), (ranked["size"] == table["size"]) & (F.col("_rank") >= F.col("r_first")) & (F.col("_rank") < F.col("r_first") + F.col("r_items")), "left")
    bin_id = F.when(ranked["size"] == 0, F.lit(0)).otherwise(F.col("b_first") + F.floor((F.col("_rank") - F.col("r_first")) / F.col("per")))
    return hit.select("doc_id", F.col("piece_no").cast("int").alias("piece_no"), ranked["size"].alias("n_tokens"), bin_id.cast("long").alias("bin_id"))


def p9_bins(spark: SparkSession, base: str) -> DataFrame:
    return pack(token_counts(tables.read(spark, base, "documents"), vocabulary_path()))


def p9_fill(spark: SparkSession, base: str) -> DataFrame:
    """Bins, tokens and unused room of the whole packing."""
    per = p9_bins(spark, base).groupBy("bin_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n_items"))
    return per.agg(F.count("*").alias("n_bins"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), (F.count("*") * CAPACITY - F.sum("used")).alias("unused")).withColumn("capacity", F.lit(CAPACITY))
