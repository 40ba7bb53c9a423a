"""Deeply nested records to flat tables (problem 7): columnar shredding with repetition and definition levels, and assembly from the levels.

A payload is shredded into one column per leaf path. Each entry holds the value, the repetition level (at which repeated ancestor a new entry starts) and
the definition level (how much of the path is there). Flat tables per repeated ancestor come from the level sequences alone. Both steps work on a row of
their own, so nothing is shuffled, however large or skewed the input is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.payloads import load, text_of
from loomline.sources import tables

LEVELS = "file_id string, kind string, leaves array<struct<path: string, reps: array<int>, defs: array<int>, vals: array<string>>>"


@dataclass
class Leaf:
    """A value; def level + 1 if it is not null."""


@dataclass
class Group:
    """An object; def level + 1 if the value is one."""

    members: dict = field(default_factory=dict)


@dataclass
class Repeated:
    """An array, or an object taken as a map; def and rep level + 1 per entry. `again`: the item's member of that name repeats this very field."""

    item: object
    again: str | None = None


_FIELDS = Repeated(Group({"name": Leaf()}), again="fields")
_PORT = Repeated(Group({"namespace": Leaf(), "name": Leaf(), "facets": Group({"schema": Group({"fields": _FIELDS})})}))
_COLUMNS = Repeated(Group({"name": Leaf()}))
_NODE = Repeated(Group({"name": Leaf(), "columns": _COLUMNS, "depends_on": Group({"nodes": Repeated(Leaf())})}))

#: Members of a transformation manifest and of lineage run records that become tables; other members are not shredded.
MANIFEST = Group({"metadata": Group({"dbt_version": Leaf(), "project_name": Leaf()}), "nodes": _NODE, "sources": _NODE})
RUNS = Repeated(Group({"job": Group({"namespace": Leaf(), "name": Leaf()}), "inputs": _PORT, "outputs": _PORT}))


def _nesting(value: object, again: str) -> int:
    """How many levels of a field that repeats itself there are in value (an array)."""
    deepest, todo = 0, [(value, 1)]
    while todo:
        v, n = todo.pop()
        if isinstance(v, list) and v:
            deepest = max(deepest, n)
            todo += [(x[again], n + 1) for x in v if isinstance(x, dict) and again in x]
    return deepest


def _depth(value: object, spec: object) -> int:
    """The deepest self-repetition below value."""
    if isinstance(spec, Repeated):
        if spec.again:
            return _nesting(value, spec.again)
        items = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
        return max((_depth(x, spec.item) for x in items), default=0)
    if isinstance(spec, Group) and isinstance(value, dict):
        return max((_depth(value.get(k), s) for k, s in spec.members.items()), default=0)
    return 0


def _plan(spec: object, path: str, depth: int) -> tuple:
    """A tree of (kind, path, children, leaf paths below in order) with self-repetition written out to the given depth, from the deepest level outwards."""
    if isinstance(spec, Leaf):
        return ("leaf", path, None, [path])
    if isinstance(spec, Group):
        kids = [(k, _plan(s, f"{path}.{k}" if path else k, depth)) for k, s in spec.members.items()]
        return ("group", path, kids, [p for _, kid in kids for p in kid[3]])
    inner = None
    for level in range(max(depth, 1) if spec.again else 1, 0, -1):
        at = path + f"[].{spec.again}" * (level - 1)
        item = _plan(spec.item, f"{at}[]", depth)
        if inner is not None:
            item = ("group", item[1], [*item[2], (spec.again, inner)], item[3] + inner[3])
        inner = ("repeated", at, item, [f"{at}[].key", *item[3]])
    return inner


def shred(value: object, spec: object) -> list[tuple[str, list[int], list[int], list[str | None]]]:
    """Leaf columns of one document: (path, repetition levels, definition levels, values). The document is walked with a stack of its own, so it may be as deep as
    the reader of JSON allows."""
    plan = _plan(spec, "", _depth(value, spec))
    out = {n: ([], [], []) for n in plan[3]}

    def put(path: str, r: int, d: int, v: object) -> None:
        reps, defs, vals = out[path]
        reps.append(r)
        defs.append(d)
        vals.append(v)

    todo = [(plan, value, 0, 0, 0)]
    while todo:
        (kind, path, kids, below), v, r, d, rep = todo.pop()
        if kind == "leaf":
            put(path, r, d + (v is not None), None if v is None else text_of(v))
            continue
        if kind == "group":
            if isinstance(v, dict):
                todo += [(kid, v.get(k), r, d + 1, rep) for k, kid in reversed(kids)]
                continue
            entries = []
        else:
            entries = [*v.items()] if isinstance(v, dict) else [(None, x) for x in v] if isinstance(v, list) else []
        if not entries:
            for p in below:
                put(p, r, d, None)
            continue
        for i, (k, _) in enumerate(entries):
            put(below[0], r if i == 0 else rep + 1, d + 1, k)
        todo += [(kids, x, r if i == 0 else rep + 1, d + 1, rep + 1) for i, (_, x) in reversed([*enumerate(entries)])]
    return [(n, *out[n]) for n in plan[3]]


def def_level(path: str) -> int:
    """The definition level at which the last [] of a path has an entry: one per group above it and one per []."""
    level = 0
    for k, part in enumerate(path.split(".")):
        here = part.rstrip("[]")
        level += (1 if here or k else 0) + part.count("[]")
    return level


def instances(leaves: dict, table: str) -> Iterator[tuple[tuple[int, ...], str | None, int]]:
    """Of the entries of a repeated path: the position in every repeated ancestor, the map key or None, and the place in its level sequence."""
    reps, defs, keys = leaves[f"{table}.key"]
    need, at = def_level(table), [0] * (table.count("[]") + 1)
    for i, r in enumerate(reps):
        if r:
            at[r] += 1
            at[r + 1 :] = [0] * (len(at) - r - 1)
        else:
            at = [0] * len(at)
        if defs[i] >= need:
            yield tuple(at[1:]), keys[i], i


def _load_levels(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in rows:
        out = []
        for fid, kind, payload in zip(pdf["file_id"], pdf["kind"], pdf["payload"], strict=True):
            ok, value = load(payload)
            if not ok:
                continue
            if kind == "run":
                value = value if isinstance(value, list) else [value]
            spec = MANIFEST if kind == "manifest" else RUNS
            out.append((fid, kind, [{"path": p, "reps": r, "defs": d, "vals": v} for p, r, d, v in shred(value, spec)]))
        for i in range(0, len(out), 256):
            yield pd.DataFrame(out[i : i + 256], columns=["file_id", "kind", "leaves"])


def _identity(space: str | None, name: str | None) -> str:
    return ".".join(x for x in (space, name) if x).strip(".")


def assemble(kind: str, leaves: dict) -> Iterator[tuple[str, str, str]]:
    """(item_path, parent_path, item_name) of one document from its level columns."""
    done: dict[tuple[str, tuple], str] = {}  # the items that are kept, by table and position

    def names(table: str, leaf: str) -> tuple[list, list]:
        return leaves[f"{table}.{leaf}"][1:]

    def table(path: str, parent: str | None, prefix: str, name, label=None):
        """Yields the items of a repeated path whose parent item is kept and for which name(place) is not None."""
        if f"{path}.key" not in leaves:
            return
        for pos, key, i in instances(leaves, path):
            above = "" if parent is None else done.get((parent, pos[:-1]))
            item = name(i) if above is not None else None
            if item is None:
                continue
            own = key if key is not None else str(pos[-1])
            full = "/".join(x for x in (above, prefix, own) if x)
            done[path, pos] = full
            yield full, above, item

    def member(path: str, leaf: str):
        """The leaf of an entry that is an object; '' if the object lacks it."""
        obj = def_level(path) + 1
        defs, vals = names(path, leaf)
        return lambda i: None if defs[i] < obj else vals[i] or ""

    if kind == "manifest":
        for sec in ("nodes", "sources"):
            p = f"{sec}[]"
            yield from table(p, None, sec, member(p, "name"))
            yield from table(f"{p}.columns[]", p, "columns", member(f"{p}.columns[]", "name"))
            vals = names(p, "depends_on.nodes[]")[1]
            yield from table(f"{p}.depends_on.nodes[]", p, "depends_on", lambda i, v=vals: v[i])
        return
    obj = def_level("[]") + 1
    defs = leaves["[].job.name"][1]
    spaces, jobs = leaves["[].job.namespace"][2], leaves["[].job.name"][2]
    yield from table("[]", None, "", lambda i: None if defs[i] < obj else _identity(spaces[i], jobs[i]))
    for side in ("inputs", "outputs"):
        p = f"[].{side}[]"
        space, name = names(p, "namespace")[1], names(p, "name")[1]
        yield from table(p, "[]", side, lambda i, s=space, n=name: _identity(s[i], n[i]) or None)
        parent, path = p, f"{p}.facets.schema.fields[]"
        while f"{path}.key" in leaves:
            yield from table(path, parent, "fields", member(path, "name"))
            parent, path = path, f"{path}.fields[]"


def _assemble_rows(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["file_id", "item_path", "parent_path", "item_name"]
    for pdf in rows:
        out = []
        for fid, kind, leaves in zip(pdf["file_id"], pdf["kind"], pdf["leaves"], strict=True):
            by = {x["path"]: (x["reps"], x["defs"], x["vals"]) for x in leaves}
            out += [(fid, *item) for item in assemble(kind, by)]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=cols)
                out = []
        yield pd.DataFrame(out, columns=cols)


def levels(payloads: DataFrame) -> DataFrame:
    """Level columns of payloads (file_id, kind 'manifest' or 'run', payload). Unreadable and null payloads give no row."""
    text = payloads.select(F.col("file_id").cast("string").alias("file_id"), "kind", "payload")  # pandas has no null integers
    return text.mapInPandas(_load_levels, LEVELS).withColumn("file_id", F.col("file_id").cast("long"))


def items(level_rows: DataFrame) -> DataFrame:
    """Flat items with the link to their parent.

    A null or missing name gives ''; entries of nodes, sources, columns, fields and ports that are no objects, ports with an empty id and null
    dependencies are left out with all below them; positions count every entry. Repeated file_ids give repeated items.
    """
    text = level_rows.withColumn("file_id", F.col("file_id").cast("string"))
    return text.mapInPandas(_assemble_rows, "file_id string, item_path string, parent_path string, item_name string").withColumn("file_id", F.col("file_id").cast("long"))


def payloads(spark: SparkSession, base: str) -> DataFrame:
    m = tables.read(spark, base, "manifest_files").select("file_id", F.lit("manifest").alias("kind"), "payload")
    r = tables.read(spark, base, "run_files").select("file_id", F.lit("run").alias("kind"), "payload")
    return m.unionByName(r)


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return items(levels(payloads(spark, base)))


def p7_levels(spark: SparkSession, base: str) -> DataFrame:
    """The shredded form itself: one row per file and leaf path."""
    x = levels(payloads(spark, base)).select("file_id", "kind", F.explode("leaves").alias("x"))
    return x.select("file_id", "kind", F.col("x.path").alias("leaf_path"), F.col("x.reps").alias("reps"), F.col("x.defs").alias("defs"), F.col("x.vals").alias("vals"))
