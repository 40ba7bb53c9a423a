"""Problems 4 and 7 on small payloads."""

import datetime
import json

import pytest

from loomline.functions.payloads import load
from loomline.operators import drift, shred
from loomline.operators.ordering import numbered, previous
from pyspark.sql import functions as F

T0 = datetime.datetime(2025, 1, 1)
FILES = "file_id long, project_name string, generated_at timestamp, payload string"


def manifest(nodes, **meta):
    return json.dumps({"metadata": meta, "nodes": nodes})


def files(spark, docs):
    return spark.createDataFrame([(i, g, T0 + datetime.timedelta(days=i), p) for i, (g, p) in enumerate(docs)], FILES)


def changes(spark, docs):
    return {(r.group_key, r.step_no, r.change_kind, r.old_field, r.new_field) for r in drift.changes(drift.manifest_leaves(files(spark, docs))).collect()}


def test_added_removed_retyped_renamed_and_moved(spark):
    a = {"m": {"name": "m", "schema": "s", "meta": {"owner": "x", "tier": 1}, "columns": {"id": {"name": "id", "index": 1}}, "gone": 1}}
    b = {"m": {"name": "m", "schema_name": "s", "owner": "x", "meta": {"tier": "1"}, "columns": [{"name": "id", "index": 1}], "new": None, "fresh": [1]}}
    got = changes(spark, [("p", manifest(a, dbt_version="1")), ("p", "{broken"), ("p", None), ("p", json.dumps(manifest(b, dbt_version={"major": 1}))), ("q", manifest(a))])
    assert got == {
        ("p", 3, "renamed", "node.schema", "node.schema_name"), ("p", 3, "renamed", "node.meta.owner", "node.owner"), ("p", 3, "retyped", "node.meta.tier", "node.meta.tier"),
        ("p", 3, "retyped", "node.columns", "node.columns"), ("p", 3, "removed", "node.gone", ""), ("p", 3, "added", "", "node.fresh"), ("p", 3, "retyped", "metadata.dbt_version", "metadata.dbt_version"),
    }


def test_half_of_the_shared_records_makes_a_rename(spark):
    node = lambda k, vals: {f"n{i}": {"name": f"n{i}", k: v} for i, v in enumerate(vals)}
    assert ("p", 1, "renamed", "node.a", "node.b") in changes(spark, [("p", manifest(node("a", [1, 2, 3, 4]))), ("p", manifest(node("b", [1, 2, 9, 9])))])
    assert changes(spark, [("p", manifest(node("a", [1, 2, 3]))), ("p", manifest(node("b", [1, 9, 9])))]) == {("p", 1, "removed", "node.a", ""), ("p", 1, "added", "", "node.b")}


def test_empty_files_and_odd_documents(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [("p", "[]"), ("p", "3"), ("p", '"x"'), (None, "{}")]) == set()


def test_rescue_columns(spark):
    rows = spark.createDataFrame([(1, '{"row_count":"12","pii":"maybe","x":{"y":1}}'), (2, '{"n_rows":7,"pii":true}'), (3, "no json"), (4, None), (5, "[1]"), (6, '{"row_count":null}')], "row_count long, properties string")
    out = drift.ingest(rows, "properties", {"row_count": "bigint", "pii": "boolean"}, {"n_rows": "row_count"})
    got = {r.row_count: (r.field_row_count, r.pii, None if r._rescued is None else json.loads(r._rescued)) for r in out.collect()}
    assert got == {1: (12, None, {"pii": "maybe", "x": {"y": 1}}), 2: (7, True, None), 3: (None, None, {"_text": "no json"}), 4: (None, None, None), 5: (None, None, {"_text": "[1]"}), 6: (None, None, None)}


def test_manifest_records_in_the_consistent_table(spark):
    a = {"m": {"name": "m", "schema": "s", "meta": {"owner": "x", "tier": 1}, "columns": {"id": {"name": "id", "index": 1, "description": "d"}}, "odd": {"deep": [1]}, "none": {}}}
    b = {"m": {"name": "m", "schema_name": "s", "owner": "x", "meta": {"tier": "high"}, "columns": [{"name": "id", "index": 1, "doc": "d"}, 3]}}
    docs = files(spark, [("p", manifest(a, dbt_version="1")), ("p", "{broken"), ("p", manifest(b, dbt_version="2", extra=1))])
    got = {(r.step_no, r.rec_key): r for r in drift.manifest_table(docs, drift.changes(drift.manifest_leaves(docs))).collect()}
    assert set(got) == {(i, k) for i in (0, 2) for k in ("m", "n/nodes/m", "c/nodes/m/id")}
    rescued = {k: json.loads(r._rescued) for k, r in got.items() if r._rescued}
    assert rescued == {(0, "n/nodes/m"): {"odd.deep": [1], "none": {}}, (2, "n/nodes/m"): {"meta.tier": "high"}, (2, "m"): {"extra": 1}}
    assert [(got[i, "n/nodes/m"].schema, got[i, "n/nodes/m"].owner, got[i, "n/nodes/m"].tier) for i in (0, 2)] == [("s", "x", 1), ("s", "x", None)]
    assert [got[i, "c/nodes/m/id"].description for i in (0, 2)] == ["d", "d"] and [got[i, "m"].dbt_version for i in (0, 2)] == ["1", "2"]
    assert json.loads(got[2, "n/nodes/m"].columns) == b["m"]["columns"]


def test_order_over_partitions(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("g"), "id")
    assert all(r.p == (r.id - 3 if r.id >= 3 else None) for r in previous(df, ["g"], ["id"], F.col("id"), "p").collect())
    assert all(r.n == r.id // 3 for r in numbered(df, "g", "id", "n").collect())


def test_payloads():
    assert load('﻿ {"a":1} \n') == (True, {"a": 1})
    assert load(json.dumps('{"a":1}')) == (True, {"a": 1})
    assert load(json.dumps("text"))[0] is False and load("{")[0] is False and load(None)[0] is False and load("[" * 100_000)[0] is False


RUN = {
    "job": {"namespace": ".ns.", "name": "j"},
    "inputs": [{"namespace": "", "name": ""}, "n/a", {"name": "in", "facets": {"schema": {"fields": [{"name": "f"}, 3, {"name": None, "fields": [{"fields": []}, {"name": "deep", "fields": None}]}]}}}],
    "outputs": None,
}


def items(kind, value):
    spec = shred.MANIFEST if kind == "manifest" else shred.RUNS
    leaves = {p: (r, d, v) for p, r, d, v in shred.shred(value, spec)}
    return list(shred.assemble(kind, leaves))


def test_run_records():
    got = items("run", [None, RUN, [], {"job": None}])
    assert got == [
        ("1", "", "ns..j"), ("3", "", ""), ("1/inputs/2", "1", "in"), ("1/inputs/2/fields/0", "1/inputs/2", "f"), ("1/inputs/2/fields/2", "1/inputs/2", ""),
        ("1/inputs/2/fields/2/fields/0", "1/inputs/2/fields/2", ""), ("1/inputs/2/fields/2/fields/1", "1/inputs/2/fields/2", "deep"),
    ]
    assert items("run", []) == [] and items("run", [5]) == []


def test_manifests():
    m = {"nodes": {"a.b": {"name": "B", "columns": {"c": {"name": "C"}, "d": 1}, "depends_on": {"nodes": ["x", "y"]}}, "z": None}, "sources": {"s": {"columns": [1, {"name": "e"}], "depends_on": None}}}
    assert set(items("manifest", m)) == {
        ("nodes/a.b", "", "B"), ("nodes/a.b/columns/c", "nodes/a.b", "C"), ("nodes/a.b/depends_on/0", "nodes/a.b", "x"), ("nodes/a.b/depends_on/1", "nodes/a.b", "y"),
        ("sources/s", "", ""), ("sources/s/columns/1", "sources/s", "e"),
    }
    assert items("manifest", []) == [] and items("manifest", {}) == [] and items("manifest", {"nodes": 3}) == []


def test_levels_of_a_textbook_document():
    leaves = {p: (r, d) for p, r, d, _ in shred.shred([{"job": {"name": "a"}, "inputs": [{"name": "x"}, {"name": None}]}, {"inputs": []}], shred.RUNS)}
    assert leaves["[].inputs[].name"] == ([0, 2, 1], [5, 4, 2])


def test_unreadable_payloads_give_nothing(spark):
    df = spark.createDataFrame([(1, "run", None), (2, "run", "{"), (3, "run", json.dumps(json.dumps(RUN))), (4, "manifest", ""), (None, "run", "[]"), (None, "manifest", "{}")], "file_id long, kind string, payload string")
    assert {r.file_id for r in shred.items(shred.levels(df)).collect()} == {3}
    assert shred.items(shred.levels(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["p4_found", "p4_table", "p7_found", "p7_levels"])
def test_whole_tables(spark, name):
    from loomline.plans import registry

    from .conftest import DATA

    assert registry.queries()[name](spark, DATA).count() > 0


def test_a_rename_of_one_group_says_nothing_of_another(spark):
    rows = [("db1", '{"contact": "ann"}'), ("db1", '{"owner": "bob", "contact": "cy"}'), ("db2", '{"contact": "phone 123", "owner": null}')]
    report = spark.createDataFrame([("db1", "renamed", "owner", "contact")], "group_key string, change_kind string, old_field string, new_field string")
    out = drift.promoted(spark.createDataFrame(rows, "group_key string, properties string"), "properties", {"owner": "string"}, report)
    got = sorted((r.group_key, r.owner or "", r._rescued or "") for r in out.collect())
    assert got == [("db1", "ann", ""), ("db1", "bob", '{"contact":"cy"}'), ("db2", "", '{"contact":"phone 123"}')]


def test_rescued_values_are_what_the_target_cannot_hold(spark):
    leaf = lambda f, v: drift._leaf(f, v)
    rows = [("nodes", "g", 1, None, "a", [leaf("x", 1), leaf("y", "t")]), ("nodes", "g", 2, None, "a", [leaf("x", "one"), leaf("y", "t"), leaf("z", [1])])]
    leaves = spark.createDataFrame(rows, drift.LEAVES)
    target = drift.targets(drift.schemas(leaves), drift.step_order(leaves))
    r = drift.enforce(leaves, target).collect()
    assert len(r) == 1 and [f.field for f in r[0].fields] == ["y"] and {(f.field, f.json, f.was) for f in r[0]._rescued} == {("x", '"one"', drift.KINDS["number"]), ("z", "[1]", None)}


def test_fields_may_be_nested_as_deep_as_json_reads():
    value = {"name": "leaf"}
    for i in range(900):
        value = {"name": f"n{i}", "fields": [value]}
    runs = [{"job": {"name": "j"}, "inputs": [{"name": "d", "facets": {"schema": {"fields": [value]}}}]}]
    leaves = {p: (r, d, v) for p, r, d, v in shred.shred(runs, shred.RUNS)}
    assert sum(x is not None for p, (_, _, v) in leaves.items() if p.endswith("name") and "fields" in p for x in v) == 901
