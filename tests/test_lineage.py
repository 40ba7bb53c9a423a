"""The engine on small graphs: traversal, store, diff, search, views, sources."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomline.engine import Api, BadRequest, LineageEngine, node_vectors
from loomline.functions import text as X
from loomline.functions.embed import embed, sums, tokens
from loomline.model import Graph, depth_in_range
from loomline.operators import builder, diff, search, traversal, views
from loomline.plans import lineage
from loomline.sources import infoschema, manifests, querylogs, runs
from loomline.sources.store import Store, timeline, versions_at

NODE = "id string, type string, name string, description string, properties string"
EDGE = "source_id string, target_id string, type string, properties string"


def graph(spark, nodes, edges):
    n = [(i, t, i.rpartition(".")[2], "", json.dumps(p)) for i, t, p in [(*x, {})[:3] for x in nodes]]
    return Graph(spark.createDataFrame(n, NODE), spark.createDataFrame([(a, b, t, "{}") for a, b, t in edges], EDGE))


CHAIN = ([("a", "Dataset"), ("p", "Pipeline"), ("b", "Dataset"), ("q", "Pipeline")], [("a", "p", "CONSUMED_BY"), ("p", "b", "PRODUCED_BY"), ("b", "q", "CONSUMED_BY")])


def levels(g, start, depth=5, up=False):
    s = g.nodes.sparkSession.createDataFrame([(start,)], "root string")
    lv = traversal.walk(g, s, depth, up)
    e = traversal.walked_edges(g, lv, depth, up)
    return {r.id: r.level for r in lv.collect()}, {(r.source_id, r.target_id, r.type, r.depth) for r in e.collect()}


def test_chain_down_and_up(spark):
    g = graph(spark, *CHAIN)
    lv, e = levels(g, "a")
    assert lv == {"a": 0, "p": 1, "b": 2, "q": 3} and len(e) == 3
    lv, e = levels(g, "q", up=True)
    assert lv == {"q": 0, "b": 1, "p": 2, "a": 3} and len(e) == 3
    assert levels(g, "A") == ({}, set()) and levels(g, "nothing") == ({}, set())
    assert set(levels(g, "a", 0)[0]) == {"a", "p"} and depth_in_range(11) == 10


def test_containment_only_on_the_first_hop_down(spark):
    g = traversal.complete(graph(spark, [("d", "Dataset"), ("d.c1", "Column"), ("d.c2", "Column")], [("d.c1", "d", "BELONGS_TO"), ("d.c2", "d", "BELONGS_TO"), ("raw_source", "d", "DERIVED_FROM")]))
    assert levels(g, "d.c1")[0] == {"d.c1": 0, "d": 1}
    assert levels(g, "d", up=True) == ({"d": 0, "raw_source": 1}, {("raw_source", "d", "DERIVED_FROM", 1)})
    assert {r.id: r.type for r in g.nodes.collect()}["raw_source"] == "Dataset"


def test_cycles_parallel_edges_and_the_last_hop(spark):
    g = graph(spark, [("a", "Dataset"), ("b", "Dataset")], [("a", "b", "X"), ("a", "b", "Y"), ("b", "a", "X")])
    lv, e = levels(g, "a")
    assert lv == {"a": 0, "b": 1} and e == {("a", "b", "X", 1), ("a", "b", "Y", 1), ("b", "a", "X", 2)}


def test_random_graphs_against_a_queue(spark):
    rng = random.Random(7)
    for depth in (1, 3):
        es = {(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}", rng.choice(["X", "BELONGS_TO"])) for _ in range(60)}
        g = graph(spark, [(f"n{i}", "Dataset") for i in range(25)], es)
        starts = ["n0", "n1", "n2"]
        got = {(r.root, r.id): r.level for r in traversal.walk(g, spark.createDataFrame([(s,) for s in starts], "root string"), depth).collect()}
        want = {}
        for s in starts:
            seen = {s: 0}
            for hop in range(1, depth + 1):
                for a, b, t in es:
                    if seen.get(a) == hop - 1 and (hop == 1 or t != "BELONGS_TO"):
                        seen.setdefault(b, hop)
            want |= {(s, k): v for k, v in seen.items()}
        assert got == want


def test_ring_of_strides(spark):
    n = 2000
    g = Graph(
        spark.range(n).selectExpr("concat('asset_', id) id", "'Model' type", "'n' name", "'' description", "'{}' properties"),
        spark.range(n).selectExpr("id", "explode(array(1, 2, 3)) k").selectExpr("concat('asset_', id) source_id", f"concat('asset_', (id + k) % {n}) target_id", "'DEPENDS_ON' type", "'{}' properties"),
    )
    for depth, count in ((5, 16), (10, 31)):
        lv, _ = levels(g, "asset_100", depth)
        assert len(lv) == count and max(lv.values()) == depth


def test_store_versions_and_times(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/g")
    assert s.graph().nodes.count() == 0 and s.timeline().count() == 0
    a, b = graph(spark, CHAIN[0][:2], CHAIN[1][:1]), graph(spark, *CHAIN)
    assert s.write("overwrite", 10_000_000_000, nodes=a.nodes, edges=a.edges) == 0
    assert s.write("append", 10_000_060_000, nodes=b.nodes, edges=b.edges) == 1
    assert s.graph(0).nodes.count() == 2 and s.graph().nodes.count() == 4 and s.graph("1").edges.count() == 3
    assert s.resolve("1970-04-26T17:46:40Z") == 0 and s.resolve("1970-04-26T17:46:39.900Z") == 0 and s.resolve("1970-04-26T17:46:39.899Z") is None
    assert s.resolve("1970-04-26T17:47:39Z") == 1  # without a fraction the end of the second, and 100 ms more
    assert s.graph("1970-01-01").nodes.count() == 0
    for bad in ("7", "yesterday"):
        with pytest.raises(ValueError, match="version"):
            s.graph(bad)
    with pytest.raises(ValueError, match="mode"):
        s.write("merge", nodes=a.nodes)
    assert [(r.version, r.timestamp) for r in s.timeline().collect()] == [(0, "1970-04-26T17:46:40.000Z"), (1, "1970-04-26T17:47:40.000Z")]
    e = LineageEngine(s)
    d = e.diff(0, 1)
    assert {r.status for r in d.nodes.collect()} == {"added"} and d.nodes.count() == 2
    assert e.diff(0, 1, "b").nodes.count() >= 2
    assert s.write("overwrite", 10_000_120_000, nodes=a.nodes.limit(0)) == 2 and s.graph().nodes.count() == 0


def test_as_of_batch(spark):
    commits = spark.sql("select 1L version, timestamp'2025-01-01 00:00:00' ts, 'overwrite' operation union all select 2L, timestamp'2025-01-02 00:00:00', 'overwrite'")
    times = spark.sql("select explode(array(timestamp'2024-12-31 23:59:59.8', timestamp'2024-12-31 23:59:59.95', timestamp'2025-01-05 00:00:00', null)) ts")
    assert [r.version for r in versions_at(times, commits).collect()] == [None, 1, 2, None]
    assert versions_at(times, commits.limit(0)).filter("version is not null").count() == 0
    assert timeline(commits).count() == 2


def test_diff(spark):
    a = graph(spark, [("x", "Dataset"), ("y", "Dataset", {"k": 1}), ("z", "Dataset")], [("x", "y", "T")])
    b = graph(spark, [("x", "Dataset"), ("y", "Dataset", {"k": 2}), ("w", "Dataset")], [("x", "y", "T"), ("x", "y", "U")])
    n, e = diff.graph_diff(a, b)
    assert {(r.id, r.status) for r in n.collect()} == {("y", "modified"), ("z", "removed"), ("w", "added")}
    assert {(r.source_id, r.type, r.status) for r in e.collect()} == {("x", "U", "added")}
    assert {(r.id, r.tag) for r in views.diff_tags(b.nodes, n).collect()} == {("x", "same"), ("y", "modified"), ("w", "added")}


def test_scopes(spark):
    g = graph(spark, [("s.Abc", "Dataset"), ("abc", "Dataset"), ("xabcx", "Dataset"), ("other", "Dataset"), ("abc.c", "Column")], [("abc", "other", "T"), ("abc.c", "abc", "BELONGS_TO")])
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(traversal.scope_match(g.nodes, "ABC")) == {"s.Abc", "abc"}
    assert ids(traversal.scope_match(g.nodes, "bcx")) == {"xabcx"} and not ids(traversal.scope_match(g.nodes, "zzz"))
    assert len(ids(traversal.scope_match(g.nodes, " Global "))) == 5
    assert ids(traversal.scoped_ids(g, "abc")) == {"s.Abc", "abc", "other", "abc.c"}


def test_search(spark):
    g = graph(spark, [("db.orders", "Dataset"), ("db.orders.id", "Column", {"dataset_id": "db.orders"}), ("db.raw_customers", "Dataset"), ("far", "User")], [])
    assert [r.id for r in search.by_terms(g.nodes, "find the orders table", 2).collect()][0] == "db.orders"
    assert search.by_terms(g.nodes, " x ", 2).count() == 0
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None)], "id string, vector array<float>")
    assert [r.id for r in search.by_vector(v, [1.0, 0.0], 2).collect()] == ["a", "b"]
    assert search.within(v, [0.0, 0.0]).count() == 0 and search.within(v, [1.0, 0.0], 1.0).count() == 4
    with pytest.raises(Exception, match="differ in length"):
        search.within(v, [1.0]).collect()
    assert [r.id for r in search.by_ids(g.nodes, ["far", "no", "db.orders", "far"]).collect()] == ["far", "db.orders", "far"]
    q = "id"
    found = search.hybrid(g.nodes, node_vectors(g.nodes), q, embed(q), 5).collect()
    assert {"db.orders", "db.orders.id"} <= {r.id for r in found} and [r.pos for r in found] == list(range(1, len(found) + 1))


def test_token_hash():
    assert tokens("Type: a_b | x") == ["type", "a", "b", "x", "type:", "a_b", "|"] and tokens("") == [""] and tokens("é") == ["é"]
    assert abs(sums("a", {})[0] - (0xCA / 255 * 2 - 1)) < 1e-12


def test_embeddings_know_the_base_properties(spark):
    props = json.dumps({"schema": "s", "tags": ["gold", "pii"], "cost_center": "c 7", "pii": True, "row_count": 0, "note": None, "code": "0"})
    n = spark.createDataFrame([("a", "Dataset", "a", "", props, None), ("b", "Dataset", "b", "d", "{broken", []), ("c", "User", "c", "", "{}", [0.6, 0.8])], f"{NODE}, embedding array<float>")
    got = {r.id: r.vector for r in node_vectors(n).collect()}
    for i, text in (("a", "Type: Dataset | Name: a | Properties: tags=['gold', 'pii'], cost_center=c 7, pii=True, code=0"), ("b", "Type: Dataset | Name: b | Description: d")):
        assert got[i] == pytest.approx(embed(text))
    assert got["c"] == pytest.approx([0.6, 0.8])
    assert {r.id: r.vector for r in node_vectors(n.drop("embedding")).collect()}["a"] == pytest.approx(got["a"])


def plain_terms(text):
    raw = text.strip().lower()
    words = [w for w in re.split(r"\s+", raw) if w and w not in X.STOP_WORDS]
    return "|".join(t for t in dict.fromkeys([*([" ".join(words)] if words else []), *words, raw]) if len(t) >= 2)


def test_search_terms_of_whole_texts(spark, tmp_path):
    texts = ["Größe der Übersicht", "Ключ ЗАКАЗА", "ΟΔΟΣ ΟΔΟΣ", "注文 一覧\u3000表", "\u00a0café\u2003Café\x1fthé \n", "", None, "the  table", "данные таблица"]
    rows = [(1, i, f"n{i}", "Dataset", "Änderung" if i % 2 else "orders", t, "{}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "_version long, _seq long, id string, type string, name string, description string, properties string").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([(1,)], "version long").write.parquet(f"{tmp_path}/commits.parquet")
    got = {r.id: r.terms for r in lineage.QUERIES["search_terms"](spark, str(tmp_path)).collect()}
    assert got == {r[2]: plain_terms(" ".join(x for x in r[4:6] if x is not None)) for r in rows}


def test_scalar_functions(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v")).alias("r")).first().r
    assert one(X.iso_to_epoch_ms, "1970-01-01T00:00:01Z") == 1999 and one(X.iso_to_epoch_ms, "1970-01-01T00:00:01.5Z") == 1500 and one(X.iso_to_epoch_ms, "1970-01-02") == 86_400_000
    assert one(X.iso_to_epoch_ms, "x") is None and one(X.iso_to_epoch_ms, "") is None and one(X.iso_to_epoch_ms, None) is None
    assert one(X.search_terms, " Find the Raw  orders x ") == ["raw orders x", "raw", "orders", "find the raw  orders x"]
    assert one(X.last_segment, "a.b.c") == "c" and one(X.last_segment, "abc") == "abc"
    assert one(X.latex_to_unicode, r"$a \rightarrow b$ \text{x\_y} $\leq$ \longrightarrow {→}") == "a → b x_y ≤ ⟶ →"
    assert one(X.html_escape, "<a&b>") == "&lt;a&amp;b&gt;" and one(X.html_escape, None) == ""
    assert one(X.intent, "What is the IMPACT?") == "downstream" and one(X.intent, "why so") == "upstream" and one(X.intent, "hello") == "search"
    assert one(X.table_refs, "select * from a.b join c on x from a.b") == ["a.b", "c"]


def test_views(spark):
    nodes = [("d", "Dataset"), ("p", "Pipeline"), ("e", "Dataset"), ("d.id", "Column", {"dataset_id": "d", "ordinal_position": 2, "data_type": "INT"}), ("d.a", "Column", {"ordinal_position": 1}), ("e.d_id", "Column"), ("u", "User"), ("t", "Team")]
    edges = [("d", "p", "CONSUMED_BY"), ("p", "e", "PRODUCED_BY"), ("d.id", "e.d_id", "JOINS_WITH"), ("e.d_id", "d.id", "JOINS_WITH"), ("d.id", "d.a", "JOINS_WITH"), ("d.id", "e.d_id", "DERIVED_FROM"), ("d.a", "e.d_id", "DERIVED_FROM"), ("d.a", "d", "BELONGS_TO"), ("e", "u", "CONSUMED_BY")]
    g = graph(spark, nodes, edges)
    assert {(r.source_id, r.target_id, r.type) for r in views.display_edges(views.rolled_up(g)).collect()} == {("d", "p", "CONSUMED_BY"), ("p", "e", "PRODUCED_BY"), ("d", "e", "JOINS_WITH"), ("d", "e", "DERIVED_FROM"), ("e", "u", "CONSUMED_BY")}
    assert [(r.id_a, r.id_b, r.score) for r in views.collapsed_joins(views.rolled_up(g)).collect()] == [("d", "e", 2)]
    assert {r.dataset_id: (r.n_columns, r.columns) for r in views.column_groups(g).collect()} == {"d": (2, "a (), id (INT)"), "e": (1, "d_id ()")}
    lv = {r.id: r.level for r in traversal.dag_levels(g).collect()}
    assert lv == {"d": 0, "p": 1, "e": 2, "d.id": 0, "d.a": 0, "e.d_id": 0, "u": 3, "t": 0}
    pos = {r.id: (r.x, r.y) for r in views.layout(traversal.dag_levels(g)).collect()}
    assert pos["p"] == (360.0, 0.0) and pos["e"][0] == 720.0 and sum(y for x, y in pos.values() if x == 0) == 0
    loop = graph(spark, [("a", "Dataset"), ("b", "Dataset"), ("c", "Dataset"), ("s", "Dataset")], [("a", "b", "T"), ("b", "a", "T"), ("b", "c", "T"), ("s", "a", "T"), ("s", "s", "T")])
    assert {r.id: r.level for r in traversal.dag_levels(loop).collect()} == {"s": 0, "a": 1, "b": 0, "c": 0}


def test_sources(spark):
    m = {"nodes": {"model.x": {"resource_type": "model", "name": "x", "schema": "s", "meta": {"owner": "me"}, "columns": {"a": {}}, "depends_on": {"nodes": ["src.y", None]}}, "test.t": {"resource_type": "test"}, "bad": 3}, "sources": {"src.y": {"name": "y", "columns": [{"name": "c1"}, {"name": "c2"}]}}}
    f = spark.createDataFrame([(1, json.dumps(json.dumps(m))), (2, "{"), (3, None), (4, "[]")], "file_id long, payload string")
    d = {r.id: (r.section, r.owner, r.columns, r.depends_on) for r in manifests.datasets(f).collect()}
    assert d == {"model.x": ("nodes", "me", ["a"], ["src.y", None]), "src.y": ("sources", None, ["c1", "c2"], [])}
    assert [(r.source_id, r.target_id) for r in manifests.derivations(manifests.datasets(f)).collect()] == [("src.y", "model.x")]
    c = spark.createDataFrame([(json.dumps({"nodes": {"src.y": {"metadata": {"type": "T", "owner": "them"}, "columns": {"a": {"type": "INT", "index": 1}}}}}),)], "payload string")
    cat = manifests.catalog(c)
    assert [(r.id, r.owner, [tuple(x) for x in r.columns]) for r in cat.collect()] == [("src.y", "them", [("a", "INT", "", 1)])]
    assert {r.id: r.owner for r in manifests.with_owner(manifests.datasets(f), cat).collect()} == {"model.x": "me", "src.y": "them"}
    t = spark.createDataFrame([("", "S", "T", None), (None, "S", "T", "VIEW")], "table_catalog string, table_schema string, table_name string, table_type string")
    assert [(r.id, r.table_type) for r in infoschema.listed_tables(t).collect()] == [("S.T", "BASE TABLE"), ("S.T", "VIEW")]
    k = spark.createDataFrame([("a", None, "b", "c", "x", "", "y", "z", "n"), (None, None, None, None, "x", "y", "z", "w", "n")], "fk_catalog string, fk_schema string, fk_table string, fk_column string, pk_catalog string, pk_schema string, pk_table string, pk_column string, constraint_name string")
    assert [(r.source_id, r.target_id) for r in infoschema.foreign_keys(k).collect()] == [("a.b.c", "x.y.z")]
    q = spark.createDataFrame([("1", "ann", "select a.x from t1 a join t2 b on a.id = b.t_id JOIN t1 where (select 1 from t3)", "2025"), ("2", None, "from t9", None), ("3", "bob", None, None)], "query_id string, user_name string, query_text string, start_time string")
    assert {(r.source_id, r.target_id) for r in querylogs.user_access(q).collect()} == {("t1", "user:ann"), ("t2", "user:ann"), ("t3", "user:ann")}
    assert [(r.source_id, r.target_id) for r in querylogs.joins(q).collect()] == [("a.id", "b.t_id")]
    e = {"job": {"namespace": "n", "name": "j"}, "inputs": [{"namespace": "x", "name": "i"}, None, "s"], "outputs": [{"namespace": "", "name": ""}, {"name": "o"}], "run": {"runId": "r"}}
    p = spark.createDataFrame([(json.dumps([e, 4, {"job": None}]),), (json.dumps(e),), ("x",), (None,)], "payload string")
    got = runs.records(p).collect()
    assert [(r.pipeline_id, r.inputs, r.outputs) for r in got] == [("n.j", ["x.i"], ["o"]), ("", [], []), ("n.j", ["x.i"], ["o"])]
    assert runs.run_edges(runs.records(p)).distinct().count() == 2


def test_builder(spark):
    n = spark.createDataFrame(
        [("DB.PUBLIC.USERS", "Dataset", "USERS", "", "DB", "PUBLIC", None, {"a": "1", "b": "1"}, 1), ("DB.PUBLIC.USERS.ID", "Column", "ID", "", None, None, "DB.PUBLIC.USERS", {}, 2), ("DB.PUBLIC.USERS", "Dataset", "OTHER", "late", "DB", "X", None, {"b": "2"}, 3), ("DB.PUBLIC.USERS", "Dataset", "OTHER", "later", "DB", "X", None, {"b": "2"}, 4)],
        "id string, type string, name string, description string, database string, schema string, dataset_id string, properties map<string,string>, _seq long",
    )
    e = spark.createDataFrame([("users.id", "stg_orders", "JOINS_WITH", {"x": "1"}, 10), ("DB.PUBLIC.USERS.ID", "stg_orders", "JOINS_WITH", {"y": "2"}, 11), ("Users.name", "job1", "T", {}, 12), ("users", "early", "T", {}, 0)], "source_id string, target_id string, type string, properties map<string,string>, _seq long")
    g = builder.build(n, e)
    nodes = {r.id: r for r in g.nodes.collect()}
    assert nodes["DB.PUBLIC.USERS"].name == "USERS" and nodes["DB.PUBLIC.USERS"].description == "late" and json.loads(nodes["DB.PUBLIC.USERS"].properties) == {"a": "1", "b": "2"}
    assert nodes["stg_orders"].type == "Dataset" and nodes["job1"].type == "Pipeline"
    edges = {(r.source_id, r.target_id): json.loads(r.properties) for r in g.edges.collect()}
    assert edges == {("DB.PUBLIC.USERS.ID", "stg_orders"): {"x": "1", "y": "2"}, ("DB.PUBLIC.USERS.name", "job1"): {}, ("users", "early"): {}}


def test_api(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/g")
    g = graph(spark, *CHAIN)
    s.write(nodes=g.nodes, edges=g.edges, vectors=node_vectors(g.nodes))
    api = Api(LineageEngine(s))
    r = api.handle("/blast-radius", {"start_node_id": "a", "max_depth": 3})
    assert r["count"] == 4 and r["depth_reached"] == 3 and r["root"]["id"] == "a" and "CONSUMED_BY" in r["prompt"]
    assert api.handle("/root-cause", {"start_node_id": "none"})["count"] == 0
    assert api.handle("/chat", {"message": "what is the impact of b"})["target_node_id"] == "a" and api.handle("/chat", {"message": "hello p"})["intent"] == "search"  # the first node by id whose name the message holds
    assert api.handle("/time-travel/diff", {"t1": "0", "t2": "0"})["counts"] == {"added": 0, "removed": 0, "modified": 0}
    assert len(api.handle("/graph")["nodes"]) == 4 and api.handle("/timeline")["timeline"] and api.handle("/healthz") == {"status": "ok"}
    for path, body in (("/x", {}), ("/blast-radius", {}), ("/blast-radius", {"start_node_id": "a", "max_depth": 11}), ("/discovery", {"query": "x", "top_k": 0}), ("/discovery", {"query": ""}), ("/chat", {})):
        with pytest.raises(BadRequest):
            api.handle(path, body)


def test_stream(spark, tmp_path):
    from loomline.streaming.ingest import PAYLOADS, commit_edges, hourly_counts

    e = {"eventType": "COMPLETE", "job": {"name": "j"}, "inputs": [{"name": "i"}], "outputs": [{"name": "o"}], "run": {"runId": "r"}}
    rows = spark.createDataFrame([(1, json.dumps(e)), (2, json.dumps(e))], "file_id long, payload string").selectExpr("file_id", "timestamp'2025-01-01' delivered_at", "payload")
    rows.write.parquet(f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/g")
    stream = lambda: spark.readStream.schema(PAYLOADS).parquet(f"{tmp_path}/in")
    commit_edges(stream(), store, f"{tmp_path}/cp").awaitTermination()
    assert {(r.source_id, r.target_id) for r in store.graph().edges.collect()} == {("i", "j"), ("j", "o")}
    q = hourly_counts(stream()).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("hours").collect()] == [2]


def test_registry_and_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
