"""What changed between full snapshots of a table (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.jsonvalue import json_hash
from loomline.sources import tables

#: Low bits of the row hash that break ties of equal sequence numbers.
TIE = 1 << 20


def _steps(rows: DataFrame, version: str, last: int | None, versions: list[int] | None) -> DataFrame:
    """version, next: each snapshot and the one after it (null: none), and whether it is the first. As many rows as there are snapshots."""
    spark = rows.sparkSession
    if versions is None:
        found = sorted(r[0] for r in rows.select(F.col(version).cast("long")).filter(F.col(version).isNotNull()).distinct().collect())  # as many as snapshots
        versions = list(range(found[0], last + 1)) if found and last is not None else found
    order = sorted(set(versions))
    nexts = [(v, order[i + 1] if i + 1 < len(order) else None, i == 0) for i, v in enumerate(order)]
    return spark.createDataFrame(nexts, "_at long, _next long, _is_first boolean").coalesce(1)


def snapshot_changes(
    rows: DataFrame, keys: list[str], row_hash: str = "row_hash", version: str = "_version", seq: str = "_seq", last: int | None = None, versions: list[int] | None = None
) -> DataFrame:
    """Records added, removed or changed between each version and the one before.

    Both snapshots of each step are united, tagged by side, grouped by key and classified from the sides' row hashes: one aggregation whose state is two
    pairs of numbers, combined before the only shuffle, so repeated rows of one key (hot keys) never reach one task.

    * versions: the snapshots in the log; each is compared with the one before it in their order, whatever the gaps, and one without rows is an empty snapshot.
      Without it the versions are those in rows, and with `last` every number from the first of them to `last`. Rows of other versions, or of none, are ignored.
      The first version has no step. An empty table gives no rows.
    * The valid row of a key and version is the one with the highest seq, which may be any long; a null seq comes before all others. Of rows with equal seq the
      one with the greater low hash bits wins.
    * A null hash counts as the value 0; null keys form one key of their own (filter before where they are none).
    """
    least = F.lit(-(1 << 63)).cast("long")
    h = F.coalesce(F.col(row_hash), F.lit(0).cast("long"))
    # a decimal has room for seq and tie and, unlike a struct, can be updated in place by a hash aggregate
    order = F.coalesce(F.col(seq).cast("long"), least).cast("decimal(20,0)") * F.lit(TIE).cast("decimal(8,0)") + F.pmod(h, F.lit(TIE).cast("long")).cast("decimal(8,0)")
    steps = _steps(rows, version, last, versions)
    of = rows.select(*keys, F.col(version).cast("long").alias("_at"), h.alias("_h"), order.cast("decimal(38,0)").alias("_o")).join(F.broadcast(steps), "_at")  # one row per snapshot
    now = F.when(~F.col("_is_first"), F.struct(F.col("_at").alias("step"), F.lit(False).alias("old")))
    was = F.when(F.col("_next").isNotNull(), F.struct(F.col("_next").alias("step"), F.lit(True).alias("old")))
    sides = of.select(*keys, "_h", "_o", F.explode(F.array_compact(F.array(now, was))).alias("_s"))
    sides = sides.select(*keys, F.col("_s.step").alias(version), F.col("_s.old").alias("_old"), "_h", "_o")

    def side(old: bool, value: Column) -> Column:
        return F.when(F.col("_old") == F.lit(old), value)

    grouped = sides.groupBy(*keys, version).agg(
        F.max_by(side(False, F.col("_h")), side(False, F.col("_o"))).alias("_new"),
        F.max_by(side(True, F.col("_h")), side(True, F.col("_o"))).alias("_was"),
        F.max(side(False, F.col("_o"))).isNotNull().alias("_has_new"),
        F.max(side(True, F.col("_o"))).isNotNull().alias("_has_old"),
    )
    kind = F.when(~F.col("_has_old"), "added").when(~F.col("_has_new"), "removed").when(F.col("_new") != F.col("_was"), "changed")
    return grouped.withColumn("change_kind", kind).filter("change_kind is not null").select(*keys, version, "change_kind")


def text_hash(*cols: Column) -> Column:
    """Row hash that tells a null from an empty text."""
    return F.xxhash64(*[x for c in cols for x in (c.isNull(), c)])


def node_changes(nodes: DataFrame, last: int | None = None, versions: list[int] | None = None) -> DataFrame:
    """Changes of node records: type, name and description as text (null and '' descriptions are equal), properties as JSON values."""
    rows = nodes.filter(tables.filled("id")).select("_version", "_seq", "id", text_hash(F.col("type"), F.col("name"), F.coalesce("description", F.lit(""))).alias("_t"), json_hash(F.col("properties")).alias("_p"))
    return snapshot_changes(rows.withColumn("row_hash", F.xxhash64("_t", "_p")), ["id"], last=last, versions=versions)


def edge_changes(edges: DataFrame, last: int | None = None, versions: list[int] | None = None) -> DataFrame:
    """Changes of edge records; rows with a null or empty endpoint are ignored."""
    rows = edges.filter(tables.filled("source_id", "target_id")).select("_version", "_seq", "source_id", "target_id", "type", json_hash(F.col("properties")).alias("row_hash"))
    return snapshot_changes(rows, ["source_id", "target_id", "type"], last=last, versions=versions)


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    nodes, edges = tables.read(spark, base, "nodes"), tables.read(spark, base, "edges")
    log = [r[0] for r in tables.read(spark, base, "commits").select("version").distinct().collect()]  # as many as snapshots
    n = node_changes(nodes, versions=log).select(F.lit("node").alias("rec_kind"), "_version", F.col("id").alias("key_a"), F.lit("").alias("key_b"), F.lit("").alias("key_c"), "change_kind")
    e = edge_changes(edges, versions=log).select(F.lit("edge").alias("rec_kind"), "_version", F.col("source_id").alias("key_a"), F.col("target_id").alias("key_b"), F.col("type").alias("key_c"), "change_kind")
    return n.unionByName(e)
