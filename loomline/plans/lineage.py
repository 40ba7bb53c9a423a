"""The engine's queries over the test tables: the graph of the newest version, unless a query is about versions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.engine import node_vectors
from loomline.functions import text as X
from loomline.functions.embed import CORE, base_properties, dot, embed, node_text, token_sums, unit
from loomline.model import Graph
from loomline.operators import builder, diff, ingestion, prompts, search, traversal, views
from loomline.session import stage
from loomline.sources import infoschema, manifests, querylogs, runs, store, tables

QUERY_TEXT = "show me the raw shipment forecast tables"
SCOPE = "ledger"


def newest(spark: SparkSession, base: str) -> int:
    return tables.read(spark, base, "commits").agg(F.max("version")).first()[0]


def graph(spark: SparkSession, base: str, version: int | None = None, whole: bool = True) -> Graph:
    v = newest(spark, base) if version is None else version
    nodes = tables.with_reference(tables.nodes(spark, base, v), tables.read(spark, base, "reference_nodes"))
    edges = tables.edges(spark, base, v).select("source_id", "target_id", "type", "properties")
    return traversal.complete(Graph(nodes, edges)) if whole else Graph(nodes, edges)


def steps_graph(spark: SparkSession, base: str) -> Graph:
    """The newest version for questions that need no properties of edges: which row of an edge is valid then does not matter."""
    v = newest(spark, base)
    nodes = tables.with_reference(tables.nodes(spark, base, v), tables.read(spark, base, "reference_nodes"))
    return traversal.complete(Graph(nodes, tables.edge_keys(spark, base, v).drop("_version")))


def staged(spark: SparkSession, base: str, version: int | None = None) -> Graph:
    """For queries that read the graph many times."""
    g = graph(spark, base, version)
    return Graph(stage(g.nodes), stage(g.edges))


def _top(edges: DataFrame, end: str) -> DataFrame:
    """root: the id with the most DERIVED_FROM edges at that end, the first of them by id."""
    n = edges.filter("type = 'DERIVED_FROM'").groupBy(F.col(end).alias("root")).agg(F.count("*").alias("_n"))
    return n.orderBy(F.desc("_n"), "root").limit(1).select("root")


def _start(g: Graph, column: bool = False) -> DataFrame:
    """The id that most is derived from, or the first column of it."""
    top = _top(g.edges, "source_id")
    if column:
        held = g.edges.filter("type = 'BELONGS_TO'").join(F.broadcast(top.withColumnRenamed("root", "target_id")), "target_id", "left_semi")
        return held.agg(F.min("source_id").alias("root")).filter("root is not null")
    return top


def _end(g: Graph) -> DataFrame:
    return _top(g.edges, "target_id")


def _levels(spark, base, upstream=False, column=False, edges=False, depth=5):
    g = steps_graph(spark, base)
    start = _end(g) if upstream else _start(g, column)
    lv = traversal.walk(g, start, depth, upstream)
    if edges:
        return traversal.walked_edges(g, lv, depth, upstream).drop("root")
    return lv.select("id", "level")


def multi_source(spark, base):
    """Blast radius of every pipeline: how many ids at each level."""
    g = staged(spark, base)
    roots = g.nodes.filter("type = 'Pipeline'").select(F.col("id").alias("root"))
    return traversal.walk(g, roots, 3).groupBy("root", "level").agg(F.count("*").alias("n_ids"))


def depth_by_type(spark, base):
    g = steps_graph(spark, base)
    lv = traversal.walk(g, _start(g), 5)
    return g.nodes.join(lv, "id").groupBy("type", "level").agg(F.count("*").alias("n"))


def counts(spark, base):
    n = tables.nodes(spark, base).groupBy("_version", "type").agg(F.count("*").alias("n")).withColumn("kind", F.lit("node"))
    e = tables.edge_keys(spark, base).groupBy("_version", "type").agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge"))
    return n.unionByName(e)


def synthesized(spark, base):
    g = graph(spark, base, whole=False)
    return traversal.missing_endpoints(g.nodes, g.edges).select("id", "type", "name", "description")


def as_of(spark, base):
    """Which version each document saw when it was written, counted."""
    docs = tables.read(spark, base, "documents").select("doc_id", F.col("written_at").alias("ts"))
    commits = tables.read(spark, base, "commits")
    return store.versions_at(docs, commits).select("doc_id", "version")


def snapshot_as_of(spark, base):
    """The nodes as of half a second before the end of the day after the third commit's eve."""
    commits = tables.read(spark, base, "commits")
    t = spark.sql("select timestamp'2025-05-01 12:00:00' as ts")
    v = store.versions_at(t, commits).first()["version"]
    return graph(spark, base, v, whole=False).nodes.select("id", "type", "name")


def _pair(spark, base):
    v = newest(spark, base)
    return graph(spark, base, v - 1), graph(spark, base, v)


def diff_nodes(spark, base):
    a, b = _pair(spark, base)
    return diff.node_diff(a.nodes, b.nodes).select("id", "status", "old_name", "new_name")


def diff_edges(spark, base):
    a, b = _pair(spark, base)
    return diff.edge_diff(a.edges, b.edges)


def diff_counts(spark, base):
    n = diff_nodes(spark, base).groupBy("status").agg(F.count("*").alias("n")).withColumn("kind", F.lit("node"))
    e = diff_edges(spark, base).groupBy("status").agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge"))
    return n.unionByName(e)


def diff_scoped(spark, base):
    v = newest(spark, base)
    a, b = staged(spark, base, v - 1), staged(spark, base, v)
    n, e = diff.graph_diff(a, b, SCOPE)
    return n.select("id", F.lit("").alias("other"), "status").unionByName(e.select(F.col("source_id").alias("id"), F.concat("type", F.lit(" "), "target_id").alias("other"), "status"))


def diff_tags(spark, base):
    a, b = _pair(spark, base)
    return views.diff_tags(b.nodes, diff.node_diff(a.nodes, b.nodes)).groupBy("tag").agg(F.count("*").alias("n"))


def nodes_by_ids(spark, base):
    g = graph(spark, base)
    wanted = ["team.data_platform", "no.such.id", "term.shared_churn", "team.data_platform"]
    return search.by_ids(g.nodes, wanted).select("pos", "id", "type", "name")


def node_terms(spark, base):
    n = tables.nodes(spark, base, newest(spark, base))
    return n.select("id", F.array_join(X.search_terms(F.concat_ws(" ", "name", "description")), "|").alias("terms"))


def term_search(spark, base):
    return search.by_terms(graph(spark, base).nodes, QUERY_TEXT, 5).select("id", "score")


def _query_vector(spark, base) -> list[float]:
    v = tables.vectors(spark, base).filter(F.exists("vector", lambda x: x != 0))
    return v.orderBy("id").select("vector").limit(1).first()[0]


def vector_topk(spark, base):
    return search.by_vector(tables.vectors(spark, base), _query_vector(spark, base), 10).select("id", F.round("distance", 5).alias("distance"))


def vector_within(spark, base):
    return search.within(tables.vectors(spark, base), _query_vector(spark, base), 0.9).select("id", F.round("distance", 5).alias("distance"))


def token_embedding(spark, base):
    n = tables.nodes(spark, base, newest(spark, base))
    text = node_text(F.col("type"), F.col("name"), F.col("description"), base_properties(F.col("type"), F.col("properties")))
    v = n.select("id", token_sums(text).alias("v"))
    return v.select("id", F.posexplode("v").alias("i", "x")).select("id", "i", (F.round("x", 6) + 0.0).alias("x"))


def hybrid_search(spark, base):
    nodes = stage(graph(spark, base).nodes)
    return search.hybrid(nodes, node_vectors(nodes), QUERY_TEXT, embed(QUERY_TEXT), 5).select("id", "stage", "pos")


def parent_resolution(spark, base):
    g = graph(spark, base)
    return search.parents(g.nodes.filter("type = 'Column'"), g.nodes).select("id", "name")


def scope_match(spark, base):
    return traversal.scope_match(graph(spark, base).nodes, SCOPE).select("id", "name")


def scoped_neighbourhood(spark, base):
    return traversal.scoped_ids(steps_graph(spark, base), SCOPE)


def visible_nodes(spark, base):
    return views.visible(graph(spark, base).nodes, "forecast").select("id", "type")


def column_rollup(spark, base):
    return views.rolled_up(graph(spark, base)).select("source_id", "target_id", "type").distinct()


def column_parents(spark, base):
    return views.column_parents(graph(spark, base))


def join_collapse(spark, base):
    return views.collapsed_joins(views.rolled_up(graph(spark, base)))


def display_edges(spark, base):
    return views.display_edges(views.rolled_up(graph(spark, base)))


def column_clouds(spark, base):
    return views.column_groups(graph(spark, base, whole=False))


def dag_levels(spark, base):
    return traversal.dag_levels(staged(spark, base))


def layout(spark, base):
    return views.layout(dag_levels(spark, base))


def degrees(spark, base):
    e = tables.edge_keys(spark, base, newest(spark, base))
    deg = e.select(F.explode(F.array(F.struct(F.lit("out").alias("side"), F.col("source_id").alias("id")), F.struct(F.lit("in").alias("side"), F.col("target_id").alias("id")))).alias("x")).select("x.*")
    return deg.groupBy("side", "id").agg(F.count("*").alias("degree")).groupBy("side", "degree").agg(F.count("*").alias("n_ids"))


def iso_times(spark, base):
    r = runs.records(tables.read(spark, base, "run_files"), keep=["file_id"])
    return r.select("file_id", "pos", "event_time", X.iso_to_epoch_ms(F.col("event_time")).alias("ms")).select("*", X.epoch_ms_to_iso(F.col("ms")).alias("iso"))


def latex(spark, base):
    d = tables.read(spark, base, "documents")
    marked = F.concat(F.lit(r"$\rightarrow$ \text{x} "), F.col("text"), F.lit(r" a\_b $\leq$ \times"))
    return d.select("doc_id", F.md5(X.latex_to_unicode(marked)).alias("clean"))


def last_segments(spark, base):
    return tables.nodes(spark, base, newest(spark, base)).select("id", X.last_segment(F.col("id")).alias("last"))


def escaped(spark, base):
    return tables.read(spark, base, "documents").select("doc_id", F.md5(X.html_escape(F.col("text"))).alias("html"))


def intents(spark, base):
    d = tables.read(spark, base, "documents").filter("text is not null")
    return d.select("doc_id", X.intent(F.col("text")).alias("intent"))


def _log(spark, base):
    """A query log: each derivation of the newest version as the statement that would make it, and each document as a statement of its author."""
    e = tables.edge_keys(spark, base, newest(spark, base))
    made = e.filter("type in ('DERIVED_FROM', 'JOINS_WITH')").select(
        F.concat("source_id", F.lit(">"), "target_id").alias("query_id"), F.lit("loader").alias("user_name"),
        F.concat(F.lit("select * from "), "source_id", F.lit(" a JOIN "), "target_id", F.lit(" b ON a.id = b.ref_id"), F.lit(" join "), "source_id").alias("query_text"), F.lit(None).cast("string").alias("start_time"))
    d = tables.read(spark, base, "documents")
    told = d.select(F.col("doc_id").cast("string").alias("query_id"), F.col("source").alias("user_name"), F.col("text").alias("query_text"), F.lit(None).cast("string").alias("start_time"))
    return made.unionByName(told)


def table_refs(spark, base):
    return querylogs.user_access(_log(spark, base)).select("query_id", "source_id", "target_id")


def join_refs(spark, base):
    return querylogs.joins(_log(spark, base)).groupBy("query_id", "source_id", "target_id").agg(F.count("*").alias("n"))


def _props(col="properties"):
    return F.from_json(col, "map<string,string>")


def _merged() -> F.Column:
    """The united properties as text: names in order with their last values."""
    spelt = lambda e: F.concat(e["key"], F.lit("="), F.regexp_replace(F.coalesce(e["value"], F.lit("null")), r"\s", ""))
    return F.array_join(F.transform(F.map_entries("properties"), spelt), ",").alias("merged")


def node_merge(spark, base):
    """All rows of all versions merged as ingestion does: first fields, first filled description, united properties."""
    n = tables.read(spark, base, "nodes").filter("id is not null").withColumn("_order", F.struct("_version", "_seq"))
    m = builder.merge(n.select("id", "type", "name", "description", _props().alias("properties"), F.col("_order").alias("_seq")), ["id"])
    return m.select("id", "type", "name", "description", _merged())


def edge_merge(spark, base):
    e = tables.read(spark, base, "edges").filter(tables.filled("source_id", "target_id")).withColumn("_order", F.struct("_version", "_seq"))
    m = builder.merge(e.select("source_id", "target_id", "type", _props().alias("properties"), F.col("_order").alias("_seq")), ["source_id", "target_id", "type"])
    return m.select("source_id", "target_id", "type", _merged())


def alias_resolution(spark, base):
    """Listed tables resolved to the datasets of the newest version by their names, all aliases being registered before."""
    n = tables.nodes(spark, base, newest(spark, base)).filter("type = 'Dataset'")
    get = lambda p: F.get_json_object("properties", f"$.{p}")
    ds = n.select("id", "type", "name", get("database").alias("database"), get("schema").alias("schema"), F.lit(None).cast("string").alias("dataset_id"), "_seq")
    raw = infoschema.listed_tables(tables.read(spark, base, "info_tables"), keep=["rec_id"]).select("rec_id", F.col("id").alias("raw_id"), F.lit(1 << 60).alias("seq"))
    return builder.resolve(raw, builder.aliases(ds)).select("rec_id", "raw_id", "canonical")


def ingest_manifests(spark, base):
    f = tables.read(spark, base, "manifest_files")
    d = manifests.datasets(f, keep=["file_id"])
    return d.select("file_id", "section", "id", "name", "schema", "database", "owner", F.size("columns").alias("n_columns"), F.size("depends_on").alias("n_depends_on"))


def manifest_lineage(spark, base):
    f = tables.read(spark, base, "manifest_files")
    return manifests.derivations(manifests.datasets(f, keep=["file_id"]), keep=["file_id"]).groupBy("source_id", "target_id", "type").agg(F.count("*").alias("n"))


def ingest_tables(spark, base):
    return infoschema.listed_tables(tables.read(spark, base, "info_tables"), keep=["rec_id"])


def ingest_columns(spark, base):
    return infoschema.listed_columns(tables.read(spark, base, "info_columns")).groupBy("id", "dataset_id", "is_nullable").agg(F.count("*").alias("n"))


def ingest_runs(spark, base):
    r = runs.records(tables.read(spark, base, "run_files"), keep=["file_id"])
    return r.select("file_id", "pos", "pipeline_id", F.size("inputs").alias("n_inputs"), F.size("outputs").alias("n_outputs"))


def run_lineage(spark, base):
    r = runs.records(tables.read(spark, base, "run_files"))
    return runs.run_edges(r).groupBy("source_id", "target_id", "type").agg(F.count("*").alias("n"))


def _ingested(spark, base) -> Graph:
    """The graph of all sources: the manifests with their columns, the listing with its columns, the query log, the run records."""
    read = partial(tables.read, spark, base)
    return ingestion.graph_of(ingestion.of_manifests(read("manifest_files")), ingestion.of_listing(read("info_tables"), read("info_columns")), ingestion.of_logs(_log(spark, base)), ingestion.of_runs(read("run_files")))


def ingested_nodes(spark, base):
    return _ingested(spark, base).nodes


def ingested_edges(spark, base):
    return _ingested(spark, base).edges


def ingested_graph(spark, base):
    """Nodes by type and edges by type of the graph of all sources."""
    g = _ingested(spark, base)
    return g.nodes.groupBy(F.lit("node").alias("kind"), "type").agg(F.count("*").alias("n")).unionByName(g.edges.groupBy(F.lit("edge").alias("kind"), "type").agg(F.count("*").alias("n")))


def prompt_blast_radius(spark, base):
    g = staged(spark, base)
    start = _start(g)
    lv = traversal.walk(g, start, 2)
    name = (start.first() or [""])[0]
    return prompts.impact_prompt(name, g.nodes.join(lv, "id"), traversal.walked_edges(g, lv, 2).drop("root"))


def prompt_diff(spark, base):
    v = newest(spark, base)
    n, e = diff.graph_diff(staged(spark, base, v - 1), staged(spark, base, v), SCOPE)
    return prompts.diff_prompt(SCOPE, n, e)


QUERIES = {
    "graph_nodes": lambda s, b: graph(s, b).nodes.select("id", "type", "name", F.coalesce("description", F.lit("")).alias("description")),
    "graph_edges": lambda s, b: graph(s, b).edges.select("source_id", "target_id", "type"),
    "full_graph_counts": counts,
    "dedupe_last_wins_nodes": lambda s, b: tables.nodes(s, b).select("_version", "id", "_seq"),
    "dedupe_last_wins_edges": lambda s, b: tables.edges(s, b).select("_version", "source_id", "target_id", "type", "_seq"),
    "dedupe_last_wins_vectors": lambda s, b: tables.vectors(s, b).select("id", "_seq", F.coalesce(F.size("vector"), F.lit(-1)).alias("dim")),
    "synthesized_endpoints": synthesized,
    "timeline": lambda s, b: store.timeline(tables.read(s, b, "commits")),
    "as_of_version_join": as_of,
    "snapshot_as_of": snapshot_as_of,
    "blast_radius_levels": _levels,
    "blast_radius_edges": partial(_levels, edges=True),
    "blast_radius_from_column": partial(_levels, column=True),
    "blast_radius_depth_10": partial(_levels, depth=10),
    "root_cause_levels": partial(_levels, upstream=True),
    "root_cause_edges": partial(_levels, upstream=True, edges=True),
    "multi_source_blast_counts": multi_source,
    "depth_by_type_summary": depth_by_type,
    "scope_match": scope_match,
    "scoped_neighbourhood": scoped_neighbourhood,
    "diff_nodes": diff_nodes,
    "diff_edges": diff_edges,
    "diff_counts": diff_counts,
    "diff_scoped": diff_scoped,
    "diff_tags": diff_tags,
    "nodes_by_ids": nodes_by_ids,
    "search_terms": node_terms,
    "term_search": term_search,
    "vector_topk": vector_topk,
    "vector_within_distance": vector_within,
    "token_hash_embedding": token_embedding,
    "hybrid_search": hybrid_search,
    "parent_resolution": parent_resolution,
    "visible_nodes": visible_nodes,
    "column_parents": column_parents,
    "column_rollup": column_rollup,
    "join_pair_collapse": join_collapse,
    "display_edges": display_edges,
    "column_clouds": column_clouds,
    "dag_levels": dag_levels,
    "layout_positions": layout,
    "degree_histogram": degrees,
    "iso_to_epoch": iso_times,
    "latex_clean": latex,
    "last_segment": last_segments,
    "html_escape": escaped,
    "intent_route": intents,
    "regex_table_refs": table_refs,
    "regex_pairs": join_refs,
    "node_merge": node_merge,
    "edge_merge": edge_merge,
    "alias_resolution": alias_resolution,
    "ingest_dbt": ingest_manifests,
    "ingest_dbt_lineage": manifest_lineage,
    "ingest_sql_catalog": ingest_tables,
    "ingest_sql_columns": ingest_columns,
    "ingest_openlineage": ingest_runs,
    "ingest_openlineage_edges": run_lineage,
    "ingested_graph": ingested_graph,
    "ingested_nodes": ingested_nodes,
    "ingested_edges": ingested_edges,
    "prompt_blast_radius": prompt_blast_radius,
    "prompt_diff": prompt_diff,
}
