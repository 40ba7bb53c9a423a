"""Bounded traversal of the lineage graph by a frontier join, for one or many starts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import SNAPSHOT_DATASET_WORDS, endpoint_type, is_global_scope, last_segment
from loomline.model import CONTAINMENT, Graph, depth_in_range
from loomline.session import figure, release, stage


def lineage(edges: DataFrame) -> DataFrame:
    """Edges that carry lineage: all but containment; a null type counts as lineage."""
    return edges.filter(~F.col("type").eqNullSafe(CONTAINMENT))


def missing_endpoints(nodes: DataFrame, edges: DataFrame, words: list[str] = SNAPSHOT_DATASET_WORDS) -> DataFrame:
    """Nodes for the ids that edges name and no node has."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    lost = ends.join(nodes.select("id"), "id", "left_anti")
    return lost.select("id", endpoint_type(F.col("id"), words).alias("type"), last_segment(F.col("id")).alias("name"), F.concat(F.lit("External Data Asset / Source ("), "id", F.lit(")")).alias("description"), F.lit('{"source": "lineage_traversal"}').alias("properties"))


def complete(graph: Graph) -> Graph:
    """The graph with the missing endpoints."""
    return Graph(graph.nodes.unionByName(missing_endpoints(graph.nodes, graph.edges)), graph.edges)


def _links(graph: Graph, upstream: bool) -> DataFrame:
    """id, _to, _line: the distinct steps of a direction, written once; so a hop scans three columns and, with a small frontier, shuffles no edge."""
    near, far = _ends(upstream)
    steps = graph.edges.groupBy(F.col(near).alias("id"), F.col(far).alias("_to")).agg(F.max(~F.col("type").eqNullSafe(CONTAINMENT)).alias("_line"))
    return stage(steps)


#: Pairs of root and id, and edges of one hop, up to which a frontier is held by the driver; larger ones stay distributed.
SMALL = 5_000

LEVELS = "root string, id string, level int"


def _ends(upstream: bool) -> tuple[str, str]:
    return ("target_id", "source_id") if upstream else ("source_id", "target_id")


def _small_walk(graph: Graph, starts: list[str], depth: int, upstream: bool) -> tuple[list[tuple[str, str, int]], int]:
    """Levels as far as every frontier is small, and the number of hops done. The ids of the frontier are constants of the scan's filter, so a hop reads only the
    row groups that may hold them and shuffles nothing but what it finds."""
    near, far = _ends(upstream)
    seen = {(r, r) for r in starts}
    out = [(r, r, 0) for r in starts]
    frontier: dict[str, list[str]] = {r: [r] for r in starts}
    for hop in range(1, depth + 1):
        e = graph.edges if hop == 1 and not upstream else lineage(graph.edges)
        found = e.filter(F.col(near).isin(sorted(frontier))).select(near, far).distinct().limit(SMALL + 1).collect()
        new = {(r, to) for at, to in found for r in frontier[at]} - seen
        if len(found) > SMALL or len(new) > SMALL:
            return out, hop - 1
        if not new:
            break
        seen |= new
        out += [(r, to, hop) for r, to in sorted(new)]
        frontier = {}
        for r, to in new:
            frontier.setdefault(to, []).append(r)
    return out, depth


def walk(graph: Graph, starts: DataFrame, depth: int, upstream: bool = False) -> DataFrame:
    """root, id, level for every id within depth hops of each root; the root has level 0.

    starts: root (ids; unknown ones give nothing, repeated ones count once). Downstream, the first hop uses all edges and later hops lineage only, so a
    Column reaches its Dataset; upstream, all hops use lineage only.

    While the frontier is small (a checked number of rows) its ids are pushed down to the scan of the edges. From the first large hop on, the distinct steps are
    written once, each hop joins the frontier, keeps what is new, and is staged, so the plan does not grow with the depth.
    """
    depth = depth_in_range(depth)
    spark = graph.nodes.sparkSession
    few = [r[0] for r in starts.select("root").filter("root is not null").distinct().limit(SMALL + 1).collect()]
    hop = 0
    if len(few) <= SMALL:
        known = sorted(r[0] for r in graph.nodes.filter(F.col("id").isin(few)).select("id").distinct().collect()) if few else []
        rows, hop = _small_walk(graph, known, depth, upstream) if known else ([], depth)
        seen = spark.createDataFrame(rows, LEVELS).coalesce(1)
        if hop == depth:
            return seen
        frontier = seen.filter(F.col("level") == hop)
    else:
        seen = stage(starts.select("root").distinct().join(graph.nodes.select(F.col("id").alias("root")), "root", "left_semi").select("root", F.col("root").alias("id"), F.lit(0).alias("level")))
        frontier = seen
    links = _links(graph, upstream)
    for hop in range(hop + 1, depth + 1):
        usable = links if hop == 1 and not upstream else links.filter("_line")
        found = frontier.select("root", "id").join(usable, "id").select("root", F.col("_to").alias("id")).distinct()
        new = stage(found.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("level", F.lit(hop)))
        if not figure(new):
            release(new)
            break
        seen, frontier = seen.unionByName(new), new
    release(links)
    return seen


def walked_edges(graph: Graph, levels: DataFrame, depth: int, upstream: bool = False) -> DataFrame:
    """root, source_id, target_id, type, depth: every edge that leaves (upstream: enters) an expanded id, also to ids seen before. Edges come out with
    their own type."""
    depth = depth_in_range(depth)
    near, _ = _ends(upstream)
    cond = ~F.col("type").eqNullSafe(CONTAINMENT)
    if not upstream:
        cond = cond | (F.col("level") == 0)
    e = graph.edges.select("source_id", "target_id", "type").join(levels.filter(F.col("level") < depth).withColumnRenamed("id", near), near)
    return e.filter(cond).select("root", "source_id", "target_id", "type", (F.col("level") + 1).alias("depth"))


def depth_reached(levels: DataFrame) -> DataFrame:
    """root and its deepest level with a new id."""
    return levels.groupBy("root").agg(F.max("level").alias("depth_reached"), F.count("*").alias("n_ids"))


def scope_match(nodes: DataFrame, scope: str) -> DataFrame:
    """Nodes that a scope names, regardless of case: all for a global word, else those of exactly that id or name, else those that contain it."""
    s = scope.strip().lower()
    if nodes.sparkSession.range(1).select(is_global_scope(F.lit(scope)).alias("g")).first()[0]:
        return nodes
    tier = F.when((F.lower("id") == s) | (F.lower("name") == s), 1).when(F.lower("id").contains(s) | F.lower("name").contains(s), 2)
    tiers = nodes.withColumn("_tier", tier).filter("_tier is not null")
    best = tiers.agg(F.min("_tier").alias("_best"))
    return tiers.join(F.broadcast(best), F.col("_tier") == F.col("_best")).drop("_tier", "_best")


def scoped_ids(graph: Graph, scope: str, depth: int = 5) -> DataFrame:
    """id of the nodes a scope names, all within depth hops down and up, and the columns of those; one pass for the columns."""
    hit = stage(scope_match(graph.nodes, scope).select(F.col("id").alias("root")))
    whole = graph.nodes.sparkSession.range(1).select(is_global_scope(F.lit(scope)).alias("g")).first()[0]
    if whole:
        return hit.select(F.col("root").alias("id"))
    ids = stage(_reach(graph, hit, depth, False).unionByName(_reach(graph, hit, depth, True)).distinct())
    cols = graph.edges.filter(F.col("type") == CONTAINMENT).join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("id"))
    return ids.unionByName(cols).distinct()


def _reach(graph: Graph, starts: DataFrame, depth: int, upstream: bool) -> DataFrame:
    """id of all within depth hops of any start: the union of the neighbourhoods, not each of them."""
    near, far = _ends(upstream)
    depth, spark = depth_in_range(depth), graph.nodes.sparkSession
    few = [r[0] for r in starts.select("root").distinct().limit(SMALL + 1).collect()]
    seen, frontier, hop = set(few), few, 0
    while len(frontier) <= SMALL and frontier and hop < depth:
        e = graph.edges if hop == 0 and not upstream else lineage(graph.edges)
        found = [r[0] for r in e.filter(F.col(near).isin(sorted(frontier))).select(far).distinct().limit(SMALL + 1).collect()]
        if len(found) > SMALL:
            break
        hop += 1
        frontier = [x for x in found if x not in seen]
        seen |= set(frontier)
    if not frontier or hop == depth:
        return spark.createDataFrame([(x,) for x in sorted(seen)], "id string").coalesce(1)
    if len(few) > SMALL:
        done = starts.select(F.col("root").alias("id")).distinct()
        edge = done
    else:
        done, edge = (spark.createDataFrame([(x,) for x in sorted(ids)], "id string").coalesce(1) for ids in (seen, frontier))
    links = _links(graph, upstream)
    for hop in range(hop + 1, depth + 1):
        usable = links if hop == 1 and not upstream else links.filter("_line")
        new = stage(edge.join(usable, "id").select(F.col("_to").alias("id")).distinct().join(done, "id", "left_anti"))
        if not figure(new):
            break
        done, edge = done.unionByName(new), new
    release(links)
    return done


def dag_levels(graph: Graph) -> DataFrame:
    """id, level: longest path over Dataset and Pipeline nodes; ids on or below a cycle have what their acyclic part gives, as in a queue of nodes whose
    in-edges are used up, and 0 if no in-edge ever is. A Column has its Dataset's level, a User one more than its highest source, others 0.

    Nodes whose in-edges are all used up are peeled per round; the rounds are as many as the longest path is long. A round writes only the nodes that its wave
    touches and those that were touched before and still wait.
    """
    back = graph.nodes.filter(F.col("type").isin("Dataset", "Pipeline")).select("id")
    e = lineage(graph.edges).filter("source_id <> target_id").select("source_id", "target_id")
    e = e.join(back.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(back.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    e = stage(e)
    need = stage(e.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("need")))
    wave = back.join(need.select("id"), "id", "left_anti").select("id", F.lit(0).alias("level"))
    levels, waiting = [wave], None
    while True:
        gain = wave.withColumnRenamed("id", "source_id").join(e, "source_id").select(F.col("target_id").alias("id"), F.lit(1).cast("long").alias("got"), (F.col("level") + 1).alias("level"))
        both = gain if waiting is None else gain.unionByName(waiting.select("id", "got", "level"))
        summed = both.groupBy("id").agg(F.sum("got").alias("got"), F.max("level").alias("level"))
        touched = stage(summed.join(need, "id").withColumn("freed", F.col("got") == F.col("need")), freed=F.col("freed"))
        wave, waiting = touched.filter("freed").select("id", "level"), touched.filter("not freed")
        if not figure(touched, "freed"):
            break
        levels.append(wave)
    done = levels[0]
    for part in levels[1:]:
        done = done.unionByName(part)
    # never freed: the level reached so far
    reached = done.unionByName(waiting.select("id", "level"))
    backbone = stage(back.join(reached, "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("level")))
    cols = graph.nodes.filter("type = 'Column'").select("id", F.get_json_object("properties", "$.dataset_id").alias("_d"))
    col_lv = cols.join(backbone.select(F.col("id").alias("_d"), "level"), "_d", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"))
    users = graph.nodes.filter("type = 'User'").select("id")
    known = backbone.unionByName(col_lv)
    into = graph.edges.join(users.withColumnRenamed("id", "target_id"), "target_id", "left_semi").join(known.withColumnRenamed("id", "source_id"), "source_id")
    user_lv = users.join(into.groupBy(F.col("target_id").alias("id")).agg(F.max("level").alias("_m")), "id", "left").select("id", (F.coalesce("_m", F.lit(0)) + 1).alias("level"))
    rest = graph.nodes.filter(~F.coalesce(F.col("type"), F.lit("")).isin("Dataset", "Pipeline", "Column", "User")).select("id", F.lit(0).alias("level"))
    return backbone.unionByName(col_lv).unionByName(user_lv).unionByName(rest)
