"""Problems 3 and 6 on small tables with every kind of dirt."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.functions.jsonvalue import canonical
from loomline.operators import orphans, snapshot_changes

NODES = "_version long, _seq long, id string, type string, name string, description string, properties string, extra string"
EDGES = "_version long, _seq long, source_id string, target_id string, type string, properties string"


def test_json_values_are_equal_regardless_of_order_spelling_and_nulls():
    assert canonical('{"a": 1.0, "b": null, "c": {"d": null}}') == canonical('{"c":{},"a":1}')
    assert canonical('{"a":"\\u00e9"}') == canonical('{"a":"é"}')
    assert canonical('{"a":1e3}') == canonical('{"a":1000}')
    assert canonical('{"a":1}') != canonical('{"a":"1"}') != canonical('{"a":true}')
    assert canonical("[1,2]") != canonical("[2,1]")
    assert canonical("not json") != canonical('"not json"')
    assert canonical(None) == canonical("null") != canonical("{}")
    assert canonical('{"a":1e999999999}') == canonical('{"a":1E999999999}')
    assert canonical("[" * 100_000) == canonical("[" * 100_000)


_values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8)


@given(_values)
@settings(max_examples=60, deadline=None)
def test_spelling_never_matters(value):
    assert canonical(json.dumps(value)) == canonical(json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True))


def test_node_changes(spark):
    rows = [
        (1, 1, "a", "T", "n", None, '{"x":1,"y":2}', "z"),
        (2, 9, "a", "T", "n", "", '{"y":2,"x":1.0,"w":null}', "z"),  # equal
        (1, 2, "b", "T", "n", "d", "{}", "z"),  # removed in 2
        (1, 3, "c", "T", "old", "", "{}", "z"),
        (1, 4, "c", "T", "n", "", "{}", "z"),  # the valid row of 1
        (2, 5, "c", "T", "n", "", "{}", "z"),
        (2, 5, "c", "T", "n", "", "{}", "z"),  # repeated
        (2, 6, "d", "T", "n", "", None, "z"),  # added, null properties
        (3, 7, "d", "T", "n", "", "{}", "z"),  # null is not {}
        (2, 8, None, "T", "n", "", "{}", "z"),  # no id
        (3, 11, "a", "T", "N", "", '{"x":1,"y":2}', "z"),
        (3, 12, "c", None, "n", "", "{}", "z"),
    ]
    got = {(r.id, r._version, r.change_kind) for r in snapshot_changes.node_changes(spark.createDataFrame(rows, NODES), 3).collect()}
    assert got == {("b", 2, "removed"), ("d", 2, "added"), ("d", 3, "changed"), ("a", 3, "changed"), ("c", 3, "changed")}


def test_changes_of_empty_tables_and_ties(spark):
    assert snapshot_changes.node_changes(spark.createDataFrame([], NODES), 5).count() == 0
    assert snapshot_changes.edge_changes(spark.createDataFrame([(1, 1, "", "b", "T", "{}"), (1, 2, None, "b", "T", "{}")], EDGES), 2).count() == 0
    a = [(1, 1, "a", "b", "T", '{"k":1}'), (1, 1, "a", "b", "T", '{"k":2}'), (2, 2, "a", "b", "T", '{"k":1}'), (2, 2, "a", "b", "T", '{"k":2}')]
    for rows in (a, a[::-1]):  # ties are broken alike in every order and version
        assert snapshot_changes.edge_changes(spark.createDataFrame(rows, EDGES), 2).count() == 0


def test_one_hot_key_is_combined_before_the_shuffle(spark):
    rows = spark.range(20_000).selectExpr("1L _version", "id _seq", "'hot' source_id", "'t' target_id", "'T' type", "'{}' properties")
    rows = rows.unionByName(spark.range(5).selectExpr("2L _version", "id _seq", "'hot' source_id", "'t' target_id", "'T' type", """'{"a":1}' properties"""))
    assert [r.change_kind for r in snapshot_changes.edge_changes(rows, 2).collect()] == ["changed"]


def test_orphans(spark):
    nodes = spark.createDataFrame(
        [
            (1, 1, "x", "Dataset", "n", "", "{}", "e"),
            (2, 2, "y", "Dataset", "n", "", "{}", "e"),
            (2, 3, "y.c", "Column", "c", "", '{"dataset_id":"x"}', "e"),
            (2, 4, "y.c", "Column", "c", "", '{"dataset_id":"y"}', "e"),  # valid, and held
            (2, 5, "y.d", "Column", "c", "", '{"dataset_id":"x"}', "e"),
            (2, 6, "y.e", "Column", "c", "", "broken", "e"),
            (2, 7, "y.f", "Column", "c", "", None, "e"),
            (1, 8, "y.g", "Column", "c", "", '{"dataset_id":"y"}', "e"),
        ],
        NODES,
    )
    edges = spark.createDataFrame([(2, 1, "y", "x", "T", "{}"), (2, 2, "y", "x", "T", "{}"), (2, 3, "y", "nowhere", "T", None), (2, 4, "y", "r", "T", "{}"), (2, 5, "", "x", "T", "{}"), (2, 6, None, "x", "T", "{}")], EDGES)
    fixed = spark.createDataFrame([("r",)], "id string")
    want = {
        ("edges.target_id", 2, "y", "x", "T", "x", "gone"),
        ("edges.target_id", 2, "y", "nowhere", "T", "nowhere", "never"),
        ("nodes.dataset_id", 2, "y.d", "", "Column", "x", "gone"),
        ("nodes.dataset_id", 1, "y.g", "", "Column", "y", "later"),
    }
    for share in (1e-4, 0.0):  # at share 0 keys of 1000 references and more are heavy
        assert {tuple(r) for r in orphans.orphan_references(nodes, edges, fixed, share).collect()} == want


def test_orphans_with_heavy_keys_and_empty_tables(spark):
    none = spark.createDataFrame([], NODES)
    fixed = spark.createDataFrame([], "id string")
    assert orphans.orphan_references(none, spark.createDataFrame([], EDGES), fixed).count() == 0
    many = spark.range(3000).selectExpr("1L _version", "id _seq", "concat('s', id) source_id", "'hot' target_id", "'T' type", "'{}' properties")
    nodes = spark.range(3000).selectExpr("1L _version", "id _seq", "concat('s', id) id", "'Dataset' type", "'n' name", "'' description", "'{}' properties", "'' extra")
    out = orphans.orphan_references(nodes, many, fixed)
    assert out.count() == 3000 and {r.reason for r in out.collect()} == {"never"}
    assert orphans.orphan_references(nodes.unionByName(nodes.selectExpr("_version", "_seq", "'hot' id", "type", "name", "description", "properties", "extra")), many, fixed).count() == 0


@pytest.mark.parametrize("name", ["p3_found", "p6_found", "p6_report"])
def test_whole_tables(spark, name):
    from loomline.plans import registry

    from .conftest import DATA

    assert registry.queries()[name](spark, DATA).count() > 0


def test_any_sequence_and_first_version_zero(spark):
    rows = [(0, 1025 << 33, "a", "b", "T", '{"k":1}'), (1, 1 << 60, "a", "b", "T", '{"k":2}'), (1, 1 << 59, "a", "b", "T", '{"k":1}'), (1, None, "x", "b", "T", "{}"), (7, 1, "x", "b", "T", "{}")]
    df = spark.createDataFrame(rows, EDGES)
    kinds = lambda out: {(r.source_id, r._version, r.change_kind) for r in out.collect()}
    first = {("a", 1, "changed"), ("x", 1, "added")}
    assert kinds(snapshot_changes.edge_changes(df)) == first | {("a", 7, "removed")}
    assert kinds(snapshot_changes.edge_changes(df, versions=[0, 1, 5, 7])) == first | {("a", 5, "removed"), ("x", 5, "removed"), ("x", 7, "added")}
    assert kinds(snapshot_changes.edge_changes(df, versions=[0, 1])) == first


def test_many_orphan_keys_with_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(orphans, "is_small", lambda df, *_: False)
    nodes = spark.createDataFrame([(1, i, f"n{i}", "Dataset", "n", "", "{}", "") for i in range(50)], NODES)
    rows = [(1, i, f"n{i % 50}", "hub" if i % 2 else f"n{i % 7}", f"T{i}", "{}") for i in range(4000)] + [(1, 9000 + i, f"gone{i}", "n1", "T", "{}") for i in range(30)]
    fixed = spark.createDataFrame([], "id string")
    got = orphans.orphan_references(nodes, spark.createDataFrame(rows, EDGES), fixed).groupBy("missing_id").count().collect()
    assert {r.missing_id: r["count"] for r in got} == {"hub": 2000} | {f"gone{i}": 1 for i in range(30)}
