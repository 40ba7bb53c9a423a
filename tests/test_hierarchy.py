"""Problem 5 against a plain walk over the parents."""

import random

from loomline.operators import hierarchy


def plain(links):
    par = {}
    for c, p in links:
        if c and p:
            par[c] = min(par.get(c, p), p)
    out, below = {}, {}
    for x in set(par) | set(par.values()):
        seen, y = [x], x
        while y in par and par[y] not in seen:
            y = par[y]
            seen.append(y)
        if y in par:
            loop = seen[seen.index(par[y]) :]
            out[x] = ("", -1, "on_cycle" if x in loop else "under_cycle")
        else:
            out[x] = (y, len(seen) - 1, "tree")
            for a in seen[1:]:
                below[a] = below.get(a, 0) + 1
    return {x: (r, d, below.get(x, 0) if s == "tree" else -1, s) for x, (r, d, s) in out.items()}


def run(spark, links):
    h = hierarchy.build(spark.createDataFrame(links, "child string, parent string"))
    rows = hierarchy.describe(h).collect()
    assert len({r.node_id for r in rows}) == len(rows)
    return h, {r.node_id: (r.root_id, r.tree_depth, r.n_below, r.node_state) for r in rows}, rows


def test_trees_cycles_and_dirt(spark):
    links = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "b"), ("e", "d"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("v", "w"), ("s", "s"), (None, "a"), ("", "a"), ("q", None), ("m", "n2"), ("m", "n1")]
    h, got, rows = run(spark, links)
    assert got == plain(links)
    assert got["m"] == ("n1", 1, 0, "tree") and got["s"][3] == "on_cycle" and got["v"][3] == "under_cycle"
    # intervals give the ids below
    inner = {r.node_id: (r.root_id, r.entry, r.exit) for r in rows if r.node_state == "tree"}
    for x, (root, a, b) in inner.items():
        assert sum(r == root and a < i and o < b for r, i, o in inner.values()) == got[x][2]
    assert {r.node_id: r.path for r in hierarchy.paths(h).collect()}["e"] == "a > b > d > e"
    assert {(r.node_id, r.ancestor_id, r.steps_up) for r in hierarchy.ancestors(h).collect() if r.node_id == "e"} == {("e", "d", 1), ("e", "b", 2), ("e", "a", 3)}


def test_empty(spark):
    h, got, _ = run(spark, [(None, None)])
    assert got == {} and hierarchy.paths(h).count() == 0


def test_random_forest_with_a_hot_parent_and_a_long_chain(spark):
    rng = random.Random(4)
    links = [(f"h{i}", "hub") for i in range(300)] + [(f"k{i}", f"k{i - 1}") for i in range(1, 60)]
    links += [(f"r{i}", f"r{rng.randrange(0, 150)}") for i in range(150)]
    _, got, _ = run(spark, links)
    assert got == plain(links)


def test_runs_of_large_families_are_linked(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "RUN", 4)
    links = [(f"h{i:03}", "hub") for i in range(50)] + [(f"g{i}", "h007") for i in range(9)]
    _, got, _ = run(spark, links)
    assert got == plain(links)
