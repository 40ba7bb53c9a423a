"""Ingestion as one job: extracted records of all sources become one graph, get embeddings and are committed together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.embed import spread, vectors_of
from loomline.functions.text import last_segment
from loomline.model import DEFAULT_DIM, Graph
from loomline.operators import builder
from loomline.session import stage
from loomline.sources import infoschema, manifests, querylogs, runs
from loomline.sources.store import Store

#: Attributes that a node has by its type, in the order in which they are written before its other properties.
ATTRIBUTES = {
    "Dataset": ["database", "schema", "table_type", "owner"],
    "Column": ["dataset_id", "data_type", "is_nullable", "ordinal_position"],
    "Pipeline": ["resource_type", "owner"],
}
_KINDS = {"is_nullable": "boolean", "ordinal_position": "int"}
_NAMES = list(dict.fromkeys(a for names in ATTRIBUTES.values() for a in names))

#: Place of a record: source, file, part of it, key, place below the key. Sources come in this order.
ORDER = {"_o1": "int", "_o2": "long", "_o3": "int", "_o4": "string", "_o5": "int"}
MANIFEST, LISTING, LOG, RUN = range(4)


def _none(t: str = "string") -> Column:
    return F.lit(None).cast(t)


def json_text(c: Column) -> Column:
    """A value as JSON text, null for null."""
    whole = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def _map(**values: Column) -> Column:
    """map<string,string> of the JSON texts of the values that are not null."""
    pairs = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), json_text(v).alias("value"))) for k, v in values.items()]
    return F.map_from_entries(F.array_compact(F.array(*pairs))) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def _at(source: int, *place: Column) -> list[Column]:
    values = [F.lit(source), *place]
    values += [F.lit(0)] * (len(ORDER) - len(values))
    return [v.cast(t).alias(n) for v, (n, t) in zip(values, ORDER.items(), strict=True)]


def _node(df: DataFrame, at: list[Column], type_: str, id_: Column, name: Column, description: Column | None = None, properties: Column | None = None, **attributes: Column) -> DataFrame:
    own = [attributes.get(a, _none()).cast(_KINDS.get(a, "string")).alias(a) for a in _NAMES]
    return df.select(*at, id_.alias("id"), F.lit(type_).alias("type"), name.alias("name"), (description if description is not None else _none()).alias("description"), (properties if properties is not None else _map()).alias("properties"), *own)


def _edge(df: DataFrame, at: list[Column], source: Column, target: Column, type_: Column | str, **properties: Column) -> DataFrame:
    kind = F.lit(type_) if isinstance(type_, str) else type_
    return df.select(*at, source.alias("source_id"), target.alias("target_id"), kind.alias("type"), _map(**properties).alias("properties"))


Parts = tuple[list[DataFrame], list[DataFrame]]


def of_manifests(files: DataFrame, catalogs: DataFrame | None = None) -> Parts:
    """Datasets with their columns, and derivations. files: file_id, payload; catalogs: payload. A manifest's owner goes before the catalog's."""
    sets = manifests.datasets(files, keep=["file_id"])
    if catalogs is not None:
        sets = manifests.with_owner(sets, manifests.catalog(catalogs))
    sets = stage(sets)
    c = F.col
    listed = F.when(F.size("columns") > 0, F.transform("columns", lambda x: F.struct(x.alias("name"))))
    ds = _node(sets, _at(MANIFEST, c("file_id"), F.lit(0), c("id")), "Dataset", c("id"), c("name"), c("description"), _map(columns=listed), database=c("database"), schema=c("schema"), owner=c("owner"), table_type=F.lit("BASE TABLE"))
    col = sets.select("file_id", "id", F.posexplode("columns").alias("_i", "_c")).filter("_c is not null")
    place = _at(MANIFEST, c("file_id"), F.lit(0), c("id"), c("_i") + 1)
    cid = F.concat("id", F.lit("."), "_c")
    made = manifests.derivations(sets, keep=["file_id"])
    return (
        [ds, _node(col, place, "Column", cid, c("_c"), dataset_id=c("id"), is_nullable=F.lit(True))],
        [_edge(col, place, cid, c("id"), "BELONGS_TO"), _edge(made, _at(MANIFEST, c("file_id"), F.lit(1), F.concat("target_id", F.lit(">"), "source_id")), c("source_id"), c("target_id"), c("type"))],
    )


def of_listing(listing: DataFrame | None, columns: DataFrame | None = None, keys: DataFrame | None = None) -> Parts:
    """Tables, columns and foreign keys of an information schema; rec_id, if the tables have one, says their order."""
    nodes, edges, c = [], [], F.col
    if listing is not None:
        order = [x for x in ("rec_id",) if x in listing.columns]
        t = infoschema.listed_tables(listing, keep=order).filter("id <> ''")
        nodes.append(_node(t, _at(LISTING, F.lit(0), F.lit(0), F.lpad(c("rec_id").cast("string"), 20, "0") if order else c("id")), "Dataset", c("id"), c("name"), database=c("database"), schema=c("schema"), table_type=c("table_type")))
    if columns is not None:
        cols = infoschema.listed_columns(columns).filter("name <> '' and dataset_id <> ''").distinct()
        place = _at(LISTING, F.lit(0), F.lit(1), c("id"), c("ordinal_position"))
        nodes.append(_node(cols, place, "Column", c("id"), c("name"), dataset_id=c("dataset_id"), data_type=c("data_type"), is_nullable=c("is_nullable"), ordinal_position=c("ordinal_position")))
        edges.append(_edge(cols, place, c("id"), c("dataset_id"), "BELONGS_TO"))
        # the columns of a table, each once, in their order
        own = cols.select("dataset_id", "name", "data_type", F.coalesce("ordinal_position", F.lit(0)).alias("_p"))
        held = own.groupBy("dataset_id").agg(F.array_sort(F.collect_set(F.struct("_p", "name", "data_type"))).alias("_c"))
        listed = F.transform("_c", lambda x: F.struct(x["name"].alias("name"), x["data_type"].alias("data_type")))
        nodes.append(_node(held, _at(LISTING, F.lit(0), F.lit(2), c("dataset_id")), "Dataset", c("dataset_id"), _none(), properties=_map(_listed=listed)))
    if keys is not None:
        fk = infoschema.foreign_keys(keys)
        edges.append(_edge(fk, _at(LISTING, F.lit(0), F.lit(3), F.concat("source_id", F.lit(">"), "target_id")), c("source_id"), c("target_id"), "JOINS_WITH", constraint_name=c("constraint_name")))
    return nodes, edges


def of_logs(log: DataFrame) -> Parts:
    """Users, what they read, and joined columns of a query log."""
    c = F.col
    used, joined = querylogs.user_access(log), querylogs.joins(log)
    who = used.select("target_id").distinct()
    by = lambda part: _at(LOG, F.lit(0), F.lit(part), F.concat_ws(">", "query_id", "source_id", "target_id"))
    return (
        [_node(who, _at(LOG, F.lit(0), F.lit(0), c("target_id")), "User", c("target_id"), F.replace("target_id", F.lit("user:"), F.lit("")))],
        [_edge(used, by(1), c("source_id"), c("target_id"), "CONSUMED_BY", query_id=c("query_id"), execution_time=c("execution_time")), _edge(joined, by(2), c("source_id"), c("target_id"), "JOINS_WITH", query_id=c("query_id"))],
    )


def of_runs(files: DataFrame) -> Parts:
    """Pipelines and datasets of run records (file_id, payload); records without a pipeline give nothing."""
    c = F.col
    r = stage(runs.records(files, keep=["file_id"]).filter("pipeline_id <> ''").select("file_id", "pos", "pipeline_id", "inputs", "outputs"))
    ports = r.select("file_id", "pos", F.posexplode(F.concat("inputs", "outputs")).alias("_i", "_d"))
    e = runs.run_edges(r).distinct()
    return (
        [
            _node(r, _at(RUN, c("file_id"), F.lit(0), c("pipeline_id"), c("pos")), "Pipeline", c("pipeline_id"), last_segment(c("pipeline_id")), resource_type=F.lit("openlineage_job")),
            _node(ports, _at(RUN, c("file_id"), F.lit(1), c("_d"), c("pos") * 1000 + c("_i")), "Dataset", c("_d"), last_segment(c("_d")), table_type=F.lit("BASE TABLE")),
        ],
        [_edge(e, _at(RUN, F.lit((1 << 63) - 1), F.lit(2), F.concat_ws(">", "source_id", "type", "target_id")), c("source_id"), c("target_id"), c("type"))],
    )


def _numbered(frames: list[DataFrame], side: int) -> DataFrame:
    """The records with _seq, unique numbers in the order of their places; side tells nodes from edges, nodes of a place come first."""
    every = reduce(DataFrame.unionByName, frames)
    return every.withColumn("_side", F.lit(side))


def graph_of(*parts: Parts) -> Graph:
    """The graph of the extracted records, in the order of the sources: aliases resolved, repeated nodes and edges merged, missing ends added, and the attributes
    of each type folded into the properties, which win where names agree. No parts give no graph (an error); parts without rows give an empty one.

    Columns listed for a dataset that is known otherwise add to those of its manifest. Of a dataset the first record that has a name gives name and attributes.
    """
    nodes, edges = [n for p in parts for n in p[0]], [e for p in parts for e in p[1]]
    n, e = _numbered(nodes, 0), _numbered(edges, 1)
    blank = lambda df, like: df.select(*[df[c] if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in like])
    like = list(dict(n.dtypes + e.dtypes).items())
    spark = n.sparkSession
    by = [*ORDER, "_side"]
    both = blank(n, like).unionByName(blank(e, like))
    count = 3 * spark.sparkContext.defaultParallelism
    both = stage(both.repartitionByRange(count, *by, "id", "source_id").sortWithinPartitions(*by, "id", "source_id").withColumn("_seq", F.monotonically_increasing_id()))
    n, e = both.filter("_side = 0"), both.filter("_side = 1").select("source_id", "target_id", "type", "properties", "_seq")
    # a dataset that only its listed columns know is no node
    named = n.filter("name is not null or type <> 'Dataset' or not map_contains_key(properties, '_listed')")
    extra = n.filter("name is null and type = 'Dataset' and map_contains_key(properties, '_listed')").join(named.filter("type = 'Dataset'").select("id").distinct(), "id", "left_semi")
    n = named.unionByName(extra.select(*named.columns)).select("id", "type", "name", "description", "properties", "_seq", *_NAMES)
    return builder.build(n, e, fold=fold)


def fold(nodes: DataFrame) -> Column:
    """Attributes of the node's type and its properties as one JSON object. properties: map of JSON texts."""
    attrs = [
        F.when(F.col("type").isin(*[t for t, names in ATTRIBUTES.items() if a in names]) & F.col(a).isNotNull(), F.struct(F.lit(a).alias("key"), json_text(F.col(a)).alias("value")))
        for a in _NAMES
    ]
    listed = F.element_at("properties", "_listed")
    first = F.element_at("properties", "columns")
    joined = F.when(first.isNotNull() & listed.isNotNull(), F.concat(F.substring(first, F.lit(1), F.length(first) - 1), F.lit(","), F.substring(listed, F.lit(2), F.length(listed) - 1)))
    columns = F.coalesce(joined, first, listed)
    base = F.filter(F.map_entries("properties"), lambda x: ~x["key"].isin("_listed", "columns"))
    base = F.concat(base, F.array_compact(F.array(F.when(columns.isNotNull(), F.struct(F.lit("columns").alias("key"), columns.alias("value"))))))
    kept = F.filter(F.array_compact(F.array(*attrs)), lambda x: ~F.exists(base, lambda y: y["key"] == x["key"]))
    text = F.transform(F.concat(kept, base), lambda x: F.concat(json_text(x["key"]), F.lit(":"), x["value"]))
    return F.concat(F.lit("{"), F.array_join(text, ","), F.lit("}"))


def embedded(nodes: DataFrame, known: DataFrame | None = None, dim: int = DEFAULT_DIM) -> DataFrame:
    """id, name, type, vector of the nodes that have no embedding yet. known: id, vector of those that have one."""
    todo = nodes if known is None else nodes.join(known.filter("vector is not null").select("id"), "id", "left_anti")
    return vectors_of(todo).withColumn("vector", spread(F.col("vector"), dim).cast("array<float>"))


def run(store: Store, *parts: Parts, mode: str = "overwrite", dim: int = DEFAULT_DIM, ts_ms: int | None = None) -> int:
    """Builds, embeds and commits the graph and returns the version. An append only embeds nodes without an embedding. A failed step leaves no commit."""
    g = graph_of(*parts)
    nodes = stage(g.nodes)
    known = store.table("vectors") if mode == "append" else None
    return store.write(mode, ts_ms=ts_ms, nodes=nodes, edges=g.edges, vectors=embedded(nodes, known, dim))


def newest_files(files: DataFrame) -> DataFrame:
    """file_id and payload of the newest file of each project, by (generated_at, file_id)."""
    last = Window.partitionBy("project_name").orderBy(F.desc("generated_at"), F.desc("file_id"))
    return files.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("file_id", "payload")
