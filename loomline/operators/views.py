"""What a display of the graph needs: roll-ups, collapsed pairs, column groups, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.model import CONTAINMENT, Graph
from loomline.operators.ordering import numbered


def column_parents(graph: Graph) -> DataFrame:
    """id, dataset_id: a containment edge decides (the least target, if there are several), else the property, else the id without its last part."""
    cols = graph.nodes.filter("type = 'Column'").select("id", F.get_json_object("properties", "$.dataset_id").alias("_p"))
    prefix = F.when(F.col("id").contains("."), F.regexp_replace("id", r"\.[^.]*$", ""))
    guess = cols.select("id", F.coalesce(F.when(F.col("_p") != "", F.col("_p")), prefix).alias("_g")).filter("_g is not null")
    held = graph.edges.filter(F.col("type") == CONTAINMENT).groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("_b"))
    return guess.join(held, "id", "full_outer").select("id", F.coalesce("_b", "_g").alias("dataset_id"))


def rolled_up(graph: Graph) -> DataFrame:
    """Edges without containment, with columns replaced by their datasets and the original ends kept; loops are dropped, and so are edges to ids that are
    no visible (non-Column) node."""
    up = column_parents(graph)
    e = graph.edges.filter(~F.col("type").eqNullSafe(CONTAINMENT)).select(F.col("source_id").alias("raw_source"), F.col("target_id").alias("raw_target"), "type")
    e = e.join(up.select(F.col("id").alias("raw_source"), F.col("dataset_id").alias("_s")), "raw_source", "left").join(up.select(F.col("id").alias("raw_target"), F.col("dataset_id").alias("_t")), "raw_target", "left")
    e = e.select(F.coalesce("_s", "raw_source").alias("source_id"), F.coalesce("_t", "raw_target").alias("target_id"), "type", "raw_source", "raw_target").filter("source_id <> target_id")
    seen = graph.nodes.filter(~F.col("type").eqNullSafe("Column")).select("id")
    return e.join(seen.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(seen.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def collapsed_joins(rolled: DataFrame) -> DataFrame:
    """One JOINS_WITH edge per unordered pair: the one that looks most like foreign key to key; ties go to the least original ends."""
    s, t = F.lower("raw_source"), F.lower("raw_target")
    score = F.when(s.endswith(".id") & t.contains("_id"), 2).when(s.contains("_id") & t.endswith(".id"), 1).otherwise(0)
    j = rolled.filter("type = 'JOINS_WITH'").select(F.least("source_id", "target_id").alias("id_a"), F.greatest("source_id", "target_id").alias("id_b"), F.struct((-score).alias("neg"), "raw_source", "raw_target", "source_id", "target_id").alias("e"))
    best = j.groupBy("id_a", "id_b").agg(F.min("e").alias("e"))
    return best.select("id_a", "id_b", "e.source_id", "e.target_id", (-F.col("e.neg")).alias("score"))


def display_edges(rolled: DataFrame) -> DataFrame:
    """All edges of the display: the collapsed joins and the other edges, each once."""
    other = rolled.filter("type <> 'JOINS_WITH'").select("source_id", "target_id", "type").distinct()
    return other.unionByName(collapsed_joins(rolled).select("source_id", "target_id", F.lit("JOINS_WITH").alias("type")))


def column_groups(graph: Graph) -> DataFrame:
    """dataset_id, n_columns, columns: 'name (type)' of its columns in order of position, then name. A group is as large as a dataset has columns."""
    up = column_parents(graph)
    cols = graph.nodes.filter("type = 'Column'").select("id", "name", F.get_json_object("properties", "$.data_type").alias("_t"), F.get_json_object("properties", "$.ordinal_position").try_cast("int").alias("_o"))
    item = F.struct(F.coalesce("_o", F.lit(1 << 30)).alias("o"), "name", F.concat("name", F.lit(" ("), F.coalesce("_t", F.lit("")), F.lit(")")).alias("x"))
    g = cols.join(up, "id").groupBy("dataset_id").agg(F.count("*").alias("n_columns"), F.array_sort(F.collect_list(item)).alias("_c"))
    return g.select("dataset_id", "n_columns", F.array_join(F.transform("_c", lambda c: c["x"]), ", ").alias("columns"))


def layout(levels: DataFrame) -> DataFrame:
    """x, y of each id: levels are 360 apart; the ids of a level are 280 apart and centred, in order of id.

    Positions within a level are numbered through range-partitioned runs, since a level may hold most of the nodes.
    """
    n = levels.groupBy("level").agg(F.count("*").alias("_n"))
    placed = numbered(levels, "level", "id", "_i").join(F.broadcast(n), "level")
    return placed.select("id", "level", (F.col("level") * 360).cast("double").alias("x"), ((F.col("_i") - (F.col("_n") - 1) / 2) * 280).alias("y"))


def diff_tags(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Each node with the colour class of its change: added, removed, modified or same."""
    s = changes.select("id", "status")
    return nodes.join(s, "id", "left").select("id", F.coalesce("status", F.lit("same")).alias("tag"))


def visible(nodes: DataFrame, term: str, hits: DataFrame | None = None) -> DataFrame:
    """Nodes of the high-level view: no columns; those among the hits of a search, if there was one, else those whose id, name or type contain the term."""
    base = nodes.filter(~F.col("type").eqNullSafe("Column"))
    t = term.lower()
    if not t:
        return base
    if hits is not None:
        return base.join(hits.select("id"), "id", "left_semi")
    cond = F.lit(False)
    for f in ("name", "id", "type"):
        cond = cond | F.lower(F.col(f)).contains(t)
    return base.filter(cond)
