"""Differences between two graphs, as the lineage engine reports them: properties compared as texts, edges by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import is_global_scope
from loomline.model import Graph
from loomline.operators.traversal import scoped_ids


def node_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, status ('added', 'removed', 'modified') and both sides' fields: one full outer join; equal nodes do not come out."""
    fields = ["type", "name", "description", "properties"]
    a = old.select("id", *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("_a"))
    b = new.select("id", *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("_b"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~same, "modified")
    return a.join(b, "id", "full_outer").withColumn("status", status).filter("status is not null").drop("_a", "_b")


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """source_id, target_id, type, status ('added' or 'removed'); both edge sets are united and grouped by key in one shuffle."""
    key = ["source_id", "target_id", "type"]
    both = old.select(*key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(new.select(*key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    g = both.groupBy(*key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).filter("_a <> _b")
    return g.select(*key, F.when(F.col("_b") == 1, "added").otherwise("removed").alias("status"))


def scoped(graph: Graph, scope: str | None) -> Graph:
    """The part of a graph in the neighbourhood of a scope; an edge belongs to it if one of its ends does."""
    if scope is None or graph.nodes.sparkSession.range(1).select(is_global_scope(F.lit(scope)).alias("g")).first()[0]:
        return graph
    ids = scoped_ids(graph, scope)
    one, two = ids.select(F.col("id").alias("source_id"), F.lit(True).alias("_s")), ids.select(F.col("id").alias("target_id"), F.lit(True).alias("_t"))
    e = graph.edges.join(one, "source_id", "left").join(two, "target_id", "left").filter("_s or _t").drop("_s", "_t")
    return Graph(graph.nodes.join(ids, "id", "left_semi"), e.select("source_id", "target_id", "type", "properties"))


def graph_diff(old: Graph, new: Graph, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(node_diff, edge_diff) of two graphs, each cut to its own neighbourhood of the scope."""
    a, b = scoped(old, scope), scoped(new, scope)
    return node_diff(a.nodes, b.nodes), edge_diff(a.edges, b.edges)
