"""Ingestion as one job, and the store under several writers."""

import json

import pytest

from loomline.engine import Api, LineageEngine
from loomline.functions.embed import embed
from loomline.operators import ingestion
from loomline.sources.store import Store

MANIFEST = {
    "metadata": {"dbt_version": "1.7"},
    "nodes": {
        "model.shop.stg_orders": {"resource_type": "model", "name": "stg_orders", "schema": "staging", "database": "wh", "description": "Orders", "meta": {}, "columns": {"order_id": {"name": "order_id"}, "total": {"name": "total"}}, "depends_on": {"nodes": ["source.shop.raw_orders"]}},
        "model.shop.fct_sales": {"resource_type": "model", "name": "fct_sales", "schema": "mart", "database": "wh", "meta": {"owner": "ann"}, "columns": {"order_id": {"name": "order_id"}}, "depends_on": {"nodes": ["model.shop.stg_orders"]}},
        "test.shop.t": {"resource_type": "test", "name": "t"},
    },
}
CATALOG = {"nodes": {"model.shop.stg_orders": {"metadata": {"type": "table", "database": "wh", "schema": "staging", "name": "stg_orders", "owner": "bob"}, "columns": {}}}}
RUN = {"eventType": "COMPLETE", "run": {"runId": "r1"}, "job": {"namespace": "jobs", "name": "load"}, "inputs": [{"namespace": "wh", "name": "staging.stg_orders"}], "outputs": [{"namespace": "lake", "name": "export"}]}


def parts(spark):
    manifests = spark.createDataFrame([(1, json.dumps(MANIFEST)), (2, "{broken")], "file_id long, payload string")
    catalogs = spark.createDataFrame([(json.dumps(CATALOG),)], "payload string")
    listed = spark.createDataFrame([(1, "CRM", "PUBLIC", "USERS", None), (2, None, "PUBLIC", "EVENTS", "VIEW")], "rec_id long, table_catalog string, table_schema string, table_name string, table_type string")
    columns = spark.createDataFrame([("CRM", "PUBLIC", "USERS", "ID", "INT", "NO", 1), ("CRM", "PUBLIC", "USERS", "NAME", "TEXT", "YES", 2), ("CRM", "PUBLIC", "USERS", "ID", "INT", "NO", 1), (None, "PUBLIC", "EVENTS", "USER_ID", "INT", "YES", 1)], "table_catalog string, table_schema string, table_name string, column_name string, data_type string, is_nullable string, ordinal_position int")
    keys = spark.createDataFrame([("", "PUBLIC", "EVENTS", "USER_ID", "CRM", "PUBLIC", "USERS", "ID", "fk_user")], ", ".join(f"{s}_{x} string" for s in ("fk", "pk") for x in ("catalog", "schema", "table", "column")) + ", constraint_name string")
    log = spark.createDataFrame([("q1", "ann", "SELECT * FROM USERS u JOIN EVENTS e ON USERS.ID = EVENTS.USER_ID", "2025-01-01T00:00:00Z"), ("q2", "bob", "select 1 from USERS", None), ("q3", None, "select 1 from USERS", None)], "query_id string, user_name string, query_text string, start_time string")
    runs = spark.createDataFrame([(1, json.dumps(RUN)), (2, "[]")], "file_id long, payload string")
    return ingestion.of_manifests(manifests, catalogs), ingestion.of_listing(listed, columns, keys), ingestion.of_logs(log), ingestion.of_runs(runs)


def test_graph_of_all_sources(spark):
    g = ingestion.graph_of(*parts(spark))
    nodes = {r.id: (r.type, r.name, json.loads(r.properties)) for r in g.nodes.collect()}
    edges = {(r.source_id, r.target_id, r.type): json.loads(r.properties) for r in g.edges.collect()}
    assert nodes["model.shop.stg_orders"] == ("Dataset", "stg_orders", {"database": "wh", "schema": "staging", "table_type": "BASE TABLE", "owner": "bob", "columns": [{"name": "order_id"}, {"name": "total"}]})
    assert nodes["model.shop.fct_sales"][2]["owner"] == "ann"
    assert nodes["model.shop.fct_sales.order_id"] == ("Column", "order_id", {"dataset_id": "model.shop.fct_sales", "is_nullable": True})
    assert nodes["CRM.PUBLIC.USERS"][2]["columns"] == [{"name": "ID", "data_type": "INT"}, {"name": "NAME", "data_type": "TEXT"}]
    assert nodes["CRM.PUBLIC.USERS.ID"][2] == {"dataset_id": "CRM.PUBLIC.USERS", "data_type": "INT", "is_nullable": False, "ordinal_position": 1}
    assert nodes["PUBLIC.EVENTS"][2]["table_type"] == "VIEW" and nodes["user:ann"] == ("User", "ann", {})
    assert nodes["jobs.load"] == ("Pipeline", "load", {"resource_type": "openlineage_job"}) and nodes["lake.export"][0] == "Dataset"
    assert nodes["source.shop.raw_orders"][0] == "Dataset"  # made up for the missing end
    assert len(nodes) == 16 and len(edges) == 15
    assert edges["PUBLIC.EVENTS.USER_ID", "CRM.PUBLIC.USERS.ID", "JOINS_WITH"] == {"constraint_name": "fk_user"}
    assert edges["CRM.PUBLIC.USERS", "user:bob", "CONSUMED_BY"] == {"query_id": "q2"}  # an alias of the listed table
    assert edges["CRM.PUBLIC.USERS.ID", "PUBLIC.EVENTS.USER_ID", "JOINS_WITH"] == {"query_id": "q1"}
    assert ("model.shop.stg_orders", "model.shop.fct_sales", "DERIVED_FROM") in edges


def test_run_commits_nodes_edges_and_vectors_and_fills_missing_ones(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    v = ingestion.run(store, *parts(spark), ts_ms=1_000)
    vectors = {r.id: r.vector for r in store.table("vectors").collect()}
    assert v == 0 and len(vectors) == 16 and {len(x) for x in vectors.values()} == {384}
    assert abs(sum(x * x for x in vectors["user:ann"]) - 1) < 1e-5
    extra = spark.createDataFrame([(1, json.dumps(RUN | {"job": {"namespace": "jobs", "name": "second"}}))], "file_id long, payload string")
    ingestion.run(store, ingestion.of_runs(extra), mode="append", ts_ms=2_000)
    assert store.table("vectors").count() == 17 and store.table("nodes", 0).count() == 16
    found = Api(LineageEngine(store)).handle("/api/v1/discovery", {"query": "sales", "top_k": 3})
    assert "model.shop.fct_sales" in {n["id"] for n in found["nodes"]}  # the query has the length of the stored vectors
    hit = Api(LineageEngine(store)).handle("/chat", {"message": "what is downstream of stg_orders"})
    assert hit["target_node_id"] == "model.shop.stg_orders" and "fct_sales" in hit["reply"] and "<code>stg_orders</code>" not in hit["reply"]
    assert len(embed("x", 384)) == 384
    store.compact(ts_ms=3_000)
    assert store.table("nodes").count() == 17 and len(store.log()[-1]["tables"]["nodes"]) == 1


def test_two_writers(spark, tmp_path, monkeypatch):
    node = "id string, type string, name string, description string, properties string"
    rows = lambda who: spark.createDataFrame([("a", "Dataset", who, "", "{}")], node)
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one.write(nodes=rows("zero"), ts_ms=1)
    stale = two.log()
    assert one.write(nodes=rows("first"), ts_ms=2) == 1
    monkeypatch.setattr(two, "log", lambda: stale)
    with pytest.raises(Exception, match="(?i)exist"):
        two.write(nodes=rows("second"), ts_ms=3)
    assert one.table("nodes").first()["name"] == "first"
    assert one.write(nodes=rows("b"), ts_ms=4, batch="x-1") == one.write(nodes=rows("c"), ts_ms=5, batch="x-1") == 2
