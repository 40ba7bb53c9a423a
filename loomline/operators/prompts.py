"""Results as structured texts: one string per question, put together by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lines(df: DataFrame, line: Column, title: str) -> DataFrame:
    """One row: a title with the number of lines, and the lines in order."""
    agg = df.select(line.alias("l")).agg(F.array_sort(F.collect_list("l")).alias("l"), F.count("*").alias("n"))
    return agg.select(F.concat(F.lit(f"{title} ("), "n", F.lit(")\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x)), "\n")).alias("text"))


def _by_type(nodes: DataFrame) -> DataFrame:
    item = F.concat(F.coalesce("name", F.lit("?")), F.lit(" <"), "id", F.lit(">"))
    g = nodes.groupBy(F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("i"))
    part = g.select(F.struct("type", F.concat("type", F.lit(": "), "n", F.lit("\n"), F.array_join(F.transform("i", lambda x: F.concat(F.lit("- "), x)), "\n")).alias("t")).alias("s"))
    return part.agg(F.array_sort(F.collect_list("s")).alias("s")).select(F.array_join(F.transform("s", lambda x: x["t"]), "\n").alias("text"))


def _join(question: str, *parts: DataFrame) -> DataFrame:
    """One-row frames in order under a heading."""
    out = parts[0].select(F.col("text").alias("_0"))
    for i, p in enumerate(parts[1:], 1):
        out = out.join(F.broadcast(p.select(F.col("text").alias(f"_{i}"))))  # one row each
    return out.select(F.concat_ws("\n\n", F.lit(question), *[F.col(f"_{i}") for i in range(len(parts))]).alias("prompt"))


def _edge_line(e: DataFrame) -> Column:
    depth = F.concat(F.lit(" at hop "), F.col("depth")) if "depth" in e.columns else F.lit("")
    return F.concat("source_id", F.lit(" -"), F.coalesce("type", F.lit("?")), F.lit("-> "), "target_id", depth)


def impact_prompt(start: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What is affected if `start` changes: nodes by type, and the edges with their hop."""
    return _join(f"What is affected downstream if {start} changes or fails? Name risks and people to tell.", _by_type(nodes), _lines(edges, _edge_line(edges), "Edges"))


def origin_prompt(target: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _join(f"Where does {target} come from, and what upstream could explain a fault in it?", _by_type(nodes), _lines(edges, _edge_line(edges), "Edges"))


def discovery_prompt(query: str, nodes: DataFrame) -> DataFrame:
    item = F.concat_ws(" | ", F.concat(F.coalesce("name", F.lit("?")), F.lit(" ["), F.coalesce("type", F.lit("?")), F.lit("] <"), "id", F.lit(">")), F.when(F.col("description") != "", F.col("description")), F.when(F.col("properties") != "", F.col("properties")))
    return _join(f"Which of these answers the question: {query}", _lines(nodes, item, "Found"))


def diff_prompt(scope: str | None, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = F.concat("status", F.lit(" "), "id")
    e = F.concat("status", F.lit(" "), _edge_line(edges))
    return _join(f"What changed in {scope or 'Global'} between the two points in time, and does it break anything?", _lines(nodes, n, "Nodes"), _lines(edges, e, "Edges"))
