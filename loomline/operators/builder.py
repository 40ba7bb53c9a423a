"""From extracted records to a graph: merging, aliases, missing endpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import INGEST_DATASET_WORDS, endpoint_type, last_segment
from loomline.model import Graph
from loomline.session import stage


def _entries(props: str, seq: str) -> Column:
    """Latest value of each property over the rows of a group, as a JSON object with sorted keys. props: map<string,string>, the values being JSON texts."""
    each = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.map_entries(props).alias("e"))))
    flat = F.flatten(F.transform(each, lambda x: F.transform(x["e"], lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))))
    keys = F.array_sort(F.array_distinct(F.transform(flat, lambda e: e["k"])))
    last = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(flat, lambda e: e["k"] == k), -1)["v"].alias("value")))
    return F.map_from_entries(last)


def merge(rows: DataFrame, keys: list[str], seq: str = "_seq") -> DataFrame:
    """One row per key: the first row's fields, the first filled description, and the united properties, of which later ones win.

    rows: the keys, properties (map<string,string>), seq (unique), any fields. Rows that agree in all but seq are dropped first, before anything is
    collected, so that a much repeated record does not make a large group; what remains per key is the number of different property maps it was given.
    """
    fields = [c for c in rows.columns if c not in (*keys, "properties", "description", seq)]
    distinct = rows.withColumn("_p", F.to_json("properties"))
    same = [*keys, "_p", *(["description"] if "description" in rows.columns else [])]
    # per property map the first row (for the fields) and the last (for the order of properties)
    slim = distinct.groupBy(*same).agg(F.max(seq).alias("_last"), F.min(seq).alias("_first"), *[F.min_by(c, seq).alias(c) for c in fields])
    slim = slim.withColumn("properties", F.from_json("_p", "map<string,string>"))
    agg = [F.min_by(c, "_first").alias(c) for c in fields]
    if "description" in rows.columns:
        agg.append(F.coalesce(F.min_by(F.when(F.col("description") != "", F.col("description")), F.when(F.col("description") != "", F.col("_first"))), F.lit("")).alias("description"))
    return slim.groupBy(*keys).agg(*agg, _entries("properties", "_last").alias("properties"), F.min("_first").alias(seq))


def aliases(nodes: DataFrame) -> DataFrame:
    """alias, canonical, seq: what a node may be called, in lower case. nodes: id, type, name, database, schema, dataset_id, _seq; null parts are absent."""
    name = F.col("name")
    forms = F.array(
        F.col("id"),
        F.when(F.col("type") == "Dataset", name),
        F.when((F.col("type") == "Dataset") & (F.col("schema") != ""), F.concat("schema", F.lit("."), name)),
        F.when((F.col("type") == "Dataset") & (F.col("schema") != "") & (F.col("database") != ""), F.concat("database", F.lit("."), "schema", F.lit("."), name)),
        F.when(F.col("type") == "Column", F.concat("dataset_id", F.lit("."), name)),
    )
    own = nodes.select(F.explode(F.array_compact(forms)).alias("alias"), F.col("id").alias("canonical"), F.col("_seq").alias("seq"))
    ds = nodes.filter("type = 'Dataset'").select(F.col("id").alias("dataset_id"), F.col("name").alias("_n"), F.col("schema").alias("_s"), F.col("_seq").alias("_d"))
    cols = nodes.filter("type = 'Column'").select("dataset_id", "id", "name", "_seq").join(ds, "dataset_id").filter("_d <= _seq")
    short = F.array(F.concat("_n", F.lit("."), "name"), F.when(F.col("_s") != "", F.concat("_s", F.lit("."), "_n", F.lit("."), "name")))
    via = cols.select(F.explode(F.array_compact(short)).alias("alias"), F.col("id").alias("canonical"), F.col("_seq").alias("seq"))
    return own.unionByName(via).select(F.lower("alias").alias("alias"), "canonical", "seq").filter("alias <> ''").distinct()


def resolve(raw: DataFrame, known: DataFrame) -> DataFrame:
    """raw (raw_id, seq) with canonical: the last alias registered before seq, for the whole id, else for all but its last part, else the id itself.

    Equal ids at one place are resolved once. The alias lists are joined by key; per (id, seq) an aggregate picks the latest, so repeated names of one
    alias cost no sort.
    """
    asked = raw.select("raw_id", "seq").distinct()
    base = asked.select("raw_id", "seq", F.lower("raw_id").alias("_full"), F.regexp_replace(F.lower("raw_id"), r"\.[^.]*$", "").alias("_pre"), last_segment(F.col("raw_id")).alias("_col"))
    pick = lambda df, on, out: df.join(known.select(F.col("alias").alias(on), F.col("canonical").alias("_c"), F.col("seq").alias("_q")), on).filter("_q < seq").groupBy("raw_id", "seq").agg(F.max_by("_c", "_q").alias(out))
    full = pick(base, "_full", "_whole")
    prefix = pick(base.filter("_full like '%.%'"), "_pre", "_ds")
    half = base.join(full, ["raw_id", "seq"], "left").join(prefix, ["raw_id", "seq"], "left").withColumn("_made", F.concat("_ds", F.lit("."), "_col"))
    again = pick(half.filter("_made is not null").select("raw_id", "seq", F.lower("_made").alias("_again")), "_again", "_known")
    done = half.join(again, ["raw_id", "seq"], "left")
    found = done.select("raw_id", "seq", F.coalesce("_whole", "_known", "_made", "raw_id").alias("canonical"))
    return raw.join(found, ["raw_id", "seq"])


def synthesised(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes for edge ends that no node has, as ingestion makes them."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    kind = endpoint_type(F.col("id"), INGEST_DATASET_WORDS)
    label = F.when(kind == "Dataset", "External Data Asset (").otherwise("External Pipeline (")
    return ends.select("id", kind.alias("type"), last_segment(F.col("id")).alias("name"), F.concat(label, "id", F.lit(")")).alias("description"))


def build(nodes: DataFrame, edges: DataFrame, fold: Callable[[DataFrame], Column] | None = None) -> Graph:
    """The graph of extracted records in their order (_seq over both): aliases resolved, repeated nodes and edges merged, missing ends added.

    nodes: id, type, name, description, database, schema, dataset_id, properties (map), _seq. edges: source_id, target_id, type, properties (map), _seq.
    fold: makes the properties text of the merged nodes, whose first row's other columns it may use. An alias counts for the edges after it. Ends made up for missing ids take part under their own id, not under further names.
    """
    known = stage(aliases(nodes))
    for side in ("source_id", "target_id"):
        edges = resolve(edges.withColumnRenamed(side, "raw_id").withColumnRenamed("_seq", "seq"), known).withColumnRenamed("canonical", side).drop("raw_id").withColumnRenamed("seq", "_seq")
    merged = stage(merge(edges.select("source_id", "target_id", "type", "properties", "_seq"), ["source_id", "target_id", "type"]))
    n = stage(merge(nodes if fold else nodes.select("id", "type", "name", "description", "properties", "_seq"), ["id"]))
    full = n.select("id", "type", "name", "description", (fold(n) if fold else F.to_json("properties")).alias("properties"))
    extra = synthesised(merged, n).withColumn("properties", F.lit("{}"))
    texts = F.transform(F.map_entries("properties"), lambda x: F.concat(F.lit('"'), x["key"], F.lit('":'), x["value"]))
    props = F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}")) if fold else F.to_json("properties")
    return Graph(full.unionByName(extra), merged.select("source_id", "target_id", "type", props.alias("properties")))
