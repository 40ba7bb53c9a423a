"""Parent-child links to full hierarchies (problem 5): peeling, Euler tours, parallel list ranking."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.session import figure, release, stage
from loomline.sources import tables

#: Children of one parent that one window may hold; larger families are cut into runs of this many ids, which are then linked.
RUN = 1 << 14


class Hierarchy(NamedTuple):
    """tours: node, root, depth, entry, exit, n_below of the tree nodes (ids as longs). ids: node, id. states: node, node_state. links: node, parent."""

    tours: DataFrame
    ids: DataFrame
    states: DataFrame
    links: DataFrame


def _peel(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The nodes that are no tree nodes, and those of them on a cycle.

    Round k peels 2^k layers of leaves at once: what is left after j single layers is the image of parent^j, so squaring the parent pointer doubles the
    layers. A pointer that leaves at a root drops out. While trees are left every round loses rows; when none is lost, all trees are gone. From then on
    the image only loses the nodes that hang below cycles; it stops shrinking when it is the cycles themselves. The rounds are logarithmic in the depth.
    """
    hops, n = links, figure(links)
    while n:
        far = hops.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        nxt = stage(hops.join(far, "parent").select("node", F.col("_up").alias("parent")))
        left = figure(nxt)
        if hops is not links:
            release(hops)
        hops, same, n = nxt, left == n, left
        if same:
            break
    if not n:
        return hops, None
    image = stage(hops.select(F.col("parent").alias("node")).distinct())
    size = figure(image)
    while True:
        nxt = stage(image.join(hops, "node").select(F.col("parent").alias("node")).distinct())
        left = figure(nxt)
        release(image)
        image = nxt
        if left == size:
            return hops, image
        size = left


def _arcs(tree: DataFrame) -> DataFrame:
    """The Euler tour of each tree as a linked list. Arc 2v enters v, arc 2v + 1 leaves v; nxt is null at the end of a tour, whose root is then known."""
    fam = tree.withColumn("_run", F.floor(F.col("node") / RUN))
    within = Window.partitionBy("parent", "_run").orderBy("node")
    sib = fam.select("node", "parent", "_run", F.lead("node").over(within).alias("_next"))
    runs = fam.groupBy("parent", "_run").agg(F.min("node").alias("_head"), F.max("node").alias("node"))
    across = Window.partitionBy("parent").orderBy("_run")
    linked = runs.select("parent", "_run", "node", F.lead("_head").over(across).alias("_jump"))
    first = runs.groupBy("parent").agg(F.min("_head").alias("_first"))  # runs are cut from ids in order, so the least head opens the family
    sib = sib.join(linked, ["parent", "_run", "node"], "left").select("node", "parent", F.coalesce("_next", "_jump").alias("_next"))
    inner = tree.select(F.col("node").alias("parent"), F.lit(True).alias("_inner"))
    sib = sib.join(inner, "parent", "left").join(first.select(F.col("parent").alias("node"), "_first"), "node", "left")
    down = F.struct(
        (F.col("node") * 2).alias("arc"), F.coalesce(F.col("_first") * 2, F.col("node") * 2 + 1).alias("nxt"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("s"), F.lit(None).cast("long").alias("root")
    )
    up_next = F.when(F.col("_next").isNotNull(), F.col("_next") * 2).when(F.col("_inner"), F.col("parent") * 2 + 1)
    up = F.struct((F.col("node") * 2 + 1).alias("arc"), up_next.alias("nxt"), F.lit(1).cast("long").alias("n"), F.lit(-1).cast("long").alias("s"), F.when(up_next.isNull(), F.col("parent")).alias("root"))
    return sib.select(F.explode(F.array(down, up)).alias("_a")).select("_a.*")


def _rank(arcs: DataFrame) -> DataFrame:
    """Pointer jumping: n and s become the number and the sum of the arcs from here to the end of the tour; root is known to all."""
    going = F.col("nxt").isNotNull()
    cur = stage(arcs, going=going)
    while figure(cur, "going"):
        other = cur.select(F.col("arc").alias("nxt"), F.col("nxt").alias("_nxt"), F.col("n").alias("_n"), F.col("s").alias("_s"), F.col("root").alias("_root"))
        moved = cur.filter("nxt is not null").join(other, "nxt").select("arc", F.col("_nxt").alias("nxt"), (F.col("n") + F.col("_n")).alias("n"), (F.col("s") + F.col("_s")).alias("s"), F.col("_root").alias("root"))
        nxt = stage(moved.unionByName(cur.filter("nxt is null")), going=going)
        release(cur)
        cur = nxt
    return cur


def build(links: DataFrame) -> Hierarchy:
    """Hierarchy over links (child STRING, parent STRING, any number of rows).

    * Rows with a null or empty end are ignored; repeated links count once.
    * A child with several parents keeps the least parent id, so every node has one path; a link to itself is a cycle.
    * Empty links give empty frames.
    Node ids become dense longs once, so that the rounds move longs only.
    """
    links = links.filter(tables.filled("child", "parent")).groupBy("child").agg(F.min("parent").alias("parent"))
    links = stage(links)
    ids = stage(links.select(F.explode(F.array("child", "parent")).alias("id")).distinct().select(F.monotonically_increasing_id().alias("node"), "id"))
    one = ids.select(F.col("id").alias("child"), "node")
    two = ids.select(F.col("id").alias("parent"), F.col("node").alias("_p"))
    pairs = stage(links.join(one, "child").join(two, "parent").select("node", F.col("_p").alias("parent")))
    release(links)
    rest, cycles = _peel(pairs)
    if cycles is None:
        tree, states = pairs, ids.select("node", F.lit("tree").alias("node_state"))
    else:
        tree = pairs.join(rest.select("node"), "node", "left_anti")
        bad = rest.select("node").join(cycles.withColumn("_c", F.lit(True)), "node", "left").select("node", F.when(F.col("_c"), "on_cycle").otherwise("under_cycle").alias("node_state"))
        states = ids.select("node").join(bad, "node", "left").select("node", F.coalesce("node_state", F.lit("tree")).alias("node_state"))
    ranked = _rank(_arcs(tree))
    side = F.col("arc") % 2 == 0
    per = ranked.groupBy(F.floor(F.col("arc") / 2).alias("node")).agg(
        F.max(F.when(side, F.col("n"))).alias("_in"), F.max(F.when(~side, F.col("n"))).alias("_out"), F.max(F.when(side, 1 - F.col("s"))).alias("depth"), F.max("root").alias("root")
    )
    whole = ranked.groupBy(F.col("root")).agg(F.max("n").alias("_all"))
    inner = per.join(whole, "root").select("node", "root", "depth", (F.col("_all") - F.col("_in") + 1).alias("entry"), (F.col("_all") - F.col("_out") + 1).alias("exit"), F.floor((F.col("_in") - F.col("_out") - 1) / 2).alias("n_below"))
    tops = whole.select(F.col("root").alias("node"), "root", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("entry"), (F.col("_all") + 1).alias("exit"), F.floor(F.col("_all") / 2).alias("n_below"))
    return Hierarchy(stage(inner.unionByName(tops)), ids, states, pairs)


def describe(h: Hierarchy) -> DataFrame:
    """One row per id: node_id, root_id, tree_depth, n_below, entry, exit and node_state. The ids below x are those with its root and an entry between its
    entry and exit; the ancestors of x are those whose interval holds its entry. Off the trees root_id is '' and the figures are -1."""
    root = h.ids.select(F.col("node").alias("root"), F.col("id").alias("root_id"))
    full = h.ids.join(h.states, "node").join(h.tours, "node", "left").join(root, "root", "left")
    tree = F.col("node_state") == "tree"
    fig = lambda c: F.when(tree, F.col(c)).otherwise(F.lit(-1))
    return full.select(
        F.col("id").alias("node_id"),
        F.when(tree, F.col("root_id")).otherwise("").alias("root_id"),
        fig("depth").cast("int").alias("tree_depth"),
        fig("n_below").cast("long").alias("n_below"),
        fig("entry").cast("long").alias("entry"),
        fig("exit").cast("long").alias("exit"),
        "node_state",
    )


def chains(h: Hierarchy) -> DataFrame:
    """node_id and up, the ids of its ancestors from the root down: those whose interval holds the node's entry.

    The intervals are sorted by tree and entry into range partitions, however large one tree is. Within a partition one pass keeps the open intervals on a stack.
    The intervals that are open where a partition begins come along: each row looks which of the partitions' beginnings lie inside it, so these are as many
    rows as there are partitions, times the depth.
    """
    spark = h.ids.sparkSession
    count = 3 * spark.sparkContext.defaultParallelism
    slots = h.tours.join(h.ids, "node").select("root", "entry", "exit", "id")
    slots = stage(slots.repartitionByRange(count, "root", "entry").withColumn("_part", F.spark_partition_id()))
    begins = [(r["_part"], r["b"]["root"], r["b"]["entry"]) for r in slots.groupBy("_part").agg(F.min(F.struct("root", "entry")).alias("b")).collect()]  # one row per partition
    if not begins:
        return spark.createDataFrame([], "node_id string, up array<string>")
    known = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(r).cast("long").alias("r"), F.lit(e).cast("long").alias("e")) for p, r, e in begins])
    inside = F.filter(known, lambda b: (b["r"] == F.col("root")) & (b["e"] > F.col("entry")) & (b["e"] < F.col("exit")))
    opened = slots.select(*[F.col(c).alias(f"o_{c}") for c in ("root", "entry", "exit", "id")], F.explode(F.transform(inside, lambda b: b["p"])).alias("_into"))

    def scan(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["root", "entry"])
        stack = []
        if len(before):
            before = before.sort_values("o_entry")
            stack = list(zip(before["o_root"], before["o_exit"], before["o_id"], strict=True))
        ids, ups = [], []
        for root, entry, end, node in zip(rows["root"], rows["entry"], rows["exit"], rows["id"], strict=True):
            while stack and (stack[-1][0] != root or stack[-1][1] < entry):
                stack.pop()
            ids.append(node)
            ups.append([x[2] for x in stack])
            stack.append((root, end, node))
        return pd.DataFrame({"node_id": ids, "up": pd.Series(ups, dtype="object")})

    return slots.groupBy("_part").cogroup(opened.groupBy("_into")).applyInPandas(scan, "node_id string, up array<string>")


def ancestors(h: Hierarchy) -> DataFrame:
    """Every (node, ancestor) pair of the trees as ids; as many rows as the depths sum up to, which is what was asked for."""
    pairs = chains(h).select("node_id", F.size("up").alias("_n"), F.posexplode("up").alias("_k", "ancestor_id"))
    return pairs.select("node_id", "ancestor_id", (F.col("_n") - F.col("_k")).cast("int").alias("steps_up"))


def paths(h: Hierarchy, sep: str = " > ") -> DataFrame:
    """node_id and its path from the root, the node included; ids off the trees have none. A chain is as long as the tree is deep, not as wide."""
    return chains(h).select("node_id", F.array_join(F.concat("up", F.array("node_id")), sep).alias("path"))


def _links(spark: SparkSession, base: str) -> DataFrame:
    """BELONGS_TO links of the newest version of the commit log."""
    last = tables.read(spark, base, "commits").agg(F.max("version")).first()[0]
    e = tables.read(spark, base, "edges").filter((F.col("_version") == last) & (F.col("type") == "BELONGS_TO"))
    return e.select(F.col("source_id").alias("child"), F.col("target_id").alias("parent"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return describe(build(_links(spark, base))).select("node_id", "root_id", "tree_depth", "n_below", "node_state")


def p5_paths(spark: SparkSession, base: str) -> DataFrame:
    return paths(build(_links(spark, base)))


def p5_descendants(spark: SparkSession, base: str) -> DataFrame:
    """Every id with each id below it."""
    return ancestors(build(_links(spark, base))).select(F.col("ancestor_id").alias("node_id"), F.col("node_id").alias("below_id"), F.col("steps_up").alias("levels_below"))
