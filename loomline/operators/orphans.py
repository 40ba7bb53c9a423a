"""References to records that do not exist (problem 6)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.session import figure, stage
from loomline.sources import tables

#: A key is heavy if it holds at least this share of all references; so there are at most 1 / HEAVY_SHARE heavy keys, which bounds the broadcast.
HEAVY_SHARE = 1e-4

#: Counted key rows up to which a frame is broadcast (some MB); larger ones meet the other side in a shuffled join.
BROADCAST_ROWS = 100_000

KEY = ["_version", "missing_id"]


#: Characters in all its text columns up to which such a frame is broadcast.
BROADCAST_CHARS = 16_000_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS) -> bool:
    """Whether df has few rows and little text; counting stops at the bound."""
    text = [F.coalesce(F.length(c), F.lit(0)) for c, t in df.dtypes if t == "string"]
    n, size = df.limit(rows + 1).agg(F.count("*"), F.sum(sum(text, F.lit(0)))).first()
    return n <= rows and (size or 0) <= chars


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if is_small(df, rows) else df


class Counted(NamedTuple):
    """References per key (_version, missing_id, n_refs), and those of them that are heavy (at most 1 / heavy_share) and light."""

    heavy: DataFrame
    light: DataFrame


def count_keys(refs: DataFrame, heavy_share: float = HEAVY_SHARE) -> Counted:
    counted = stage(refs.filter(tables.filled("missing_id")).groupBy(*KEY).agg(F.count("*").alias("n_refs")))
    total = counted.agg(F.sum("n_refs")).first()[0] or 0
    least = max(1000.0, total * heavy_share)
    return Counted(counted.filter(F.col("n_refs") >= least), counted.filter(F.col("n_refs") < least))


def holders_of(rows: DataFrame, keys: DataFrame, counted: Counted) -> DataFrame:
    """The rows that refer to one of the keys. Few keys are broadcast; of many, the heavy ones are, and the light ones meet in a shuffle the rows that refer to no
    heavy key at all, so no hot id is ever shuffled, whether it is missing or not."""
    if is_small(keys):
        return rows.join(F.broadcast(keys), KEY)
    hot = F.broadcast(counted.heavy.select(*KEY))
    return rows.join(F.broadcast(keys.join(hot, KEY, "left_semi")), KEY).unionByName(rows.join(hot, KEY, "left_anti").join(keys.join(hot, KEY, "left_anti"), KEY))


def orphan_keys(refs: DataFrame, held: DataFrame, fixed: DataFrame, heavy_share: float = HEAVY_SHARE, counted: Counted | None = None) -> DataFrame:
    """_version, missing_id, reason and n_refs of the referenced ids that their version does not hold.

    refs: _version, missing_id, a row per reference. held: _version, id (any number of rows). fixed: id, held by every version (a short list).

    References are counted per key and period before anything else is shuffled. Heavy keys, of which there are at most 1 / heavy_share, are broadcast to
    the scan of the held ids; the remaining keys meet the held ids in a shuffled anti-join. Both results are united.
    Null and empty ids are no references. Empty refs give no rows; empty held makes every reference 'never'.
    """
    spark = refs.sparkSession
    heavy, light = counted or count_keys(refs, heavy_share)
    held = held.filter(tables.filled("id")).select("_version", F.col("id").alias("missing_id"))
    present = held.join(F.broadcast(heavy.select(*KEY)), KEY, "left_semi").distinct()  # no more rows than heavy
    lost = heavy.join(F.broadcast(present), KEY, "left_anti").unionByName(light.join(held, KEY, "left_anti"))
    lost = stage(lost.join(small(fixed.select(F.col("id").alias("missing_id")).distinct()), "missing_id", "left_anti"))
    if not figure(lost):
        return spark.createDataFrame([], "_version long, missing_id string, n_refs long, reason string")
    spans = held.join(small(lost.select("missing_id").distinct()), "missing_id", "left_semi").groupBy("missing_id").agg(F.min("_version").alias("_first"), F.max("_version").alias("_last"))
    reason = F.when(F.col("_first") < F.col("_version"), "gone").when(F.col("_last") > F.col("_version"), "later").otherwise("never")
    return stage(lost.join(spans, "missing_id", "left").select(*KEY, "n_refs", reason.alias("reason")))


def edge_references(edges: DataFrame) -> DataFrame:
    """Both endpoints of each edge row with their holder; rows with a null or empty endpoint are ignored. Repeated rows are repeated here."""
    ends = F.explode(F.array(*[F.struct(F.lit(f"edges.{c}").alias("f"), F.col(c).alias("x")) for c in ("source_id", "target_id")])).alias("_e")
    rows = edges.filter(tables.filled("source_id", "target_id")).select("_version", F.col("source_id").alias("holder_a"), F.col("target_id").alias("holder_b"), F.col("type").alias("holder_type"), ends)
    return rows.select(F.col("_e.f").alias("ref_field"), "_version", "holder_a", "holder_b", "holder_type", F.col("_e.x").alias("missing_id"))


def column_references(nodes: DataFrame) -> DataFrame:
    """dataset_id of each Column row, outdated rows included. A dataset_id that is no string counts as its JSON text; invalid JSON holds none."""
    cols = nodes.filter(tables.filled("id")).filter("type = 'Column'")
    return cols.select(F.lit("nodes.dataset_id").alias("ref_field"), "_version", F.col("id").alias("holder_a"), F.get_json_object("properties", "$.dataset_id").alias("missing_id"))


def orphan_references(nodes: DataFrame, edges: DataFrame, fixed: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Every valid reference of edges and of Column properties whose id its version does not hold, with its holder and the reason.

    The orphan keys are found from all rows, valid or not; only the rows that hold an orphan key are then looked at again, and only their holders are
    checked for validity. So the tables themselves are never sorted or shuffled whole: an edge key is valid if any row has it, and for a Column the row with
    the highest _seq decides.
    """
    of_edges, of_cols = edge_references(edges), column_references(nodes)
    refs = of_edges.select(*KEY).unionByName(of_cols.select(*KEY))
    counted = count_keys(refs, heavy_share)
    keys = orphan_keys(refs, nodes.select("_version", "id"), fixed, heavy_share, counted).drop("n_refs")
    cols = ["ref_field", "_version", "holder_a", "holder_b", "holder_type", "missing_id", "reason"]
    found = holders_of(of_edges, keys, counted).select(*cols).distinct()
    holders = stage(holders_of(of_cols, keys, counted).select("_version", F.col("holder_a").alias("id")).distinct())
    again = nodes.filter(tables.filled("id")).join(small(holders), ["_version", "id"], "left_semi").select("_version", "_seq", "id", "type", F.get_json_object("properties", "$.dataset_id").alias("missing_id"))
    valid = tables.last_wins(again, ["_version", "id"], ["_seq"]).filter("type = 'Column'")
    columns = holders_of(valid, keys, counted).select(F.lit("nodes.dataset_id").alias("ref_field"), "_version", F.col("id").alias("holder_a"), F.lit("").alias("holder_b"), F.lit("Column").alias("holder_type"), "missing_id", "reason")
    return found.unionByName(columns)


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return orphan_references(*[tables.read(spark, base, t) for t in ("nodes", "edges", "reference_nodes")])


def p6_report(spark: SparkSession, base: str) -> DataFrame:
    """Orphan references per table, period and reason."""
    return p6_found(spark, base).groupBy("ref_field", "_version", "reason").agg(F.count("*").alias("n_orphans"), F.countDistinct("missing_id").alias("n_missing_ids"))
