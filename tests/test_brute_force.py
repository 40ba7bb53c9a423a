"""Problem 4 on whole tables against a plain program."""

import collections
import json

import pandas as pd

from loomline.functions.payloads import load
from loomline.operators import drift

from .conftest import DATA


def kind(x):
    return "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object"


def opened(prefix, obj, out):
    for k, x in obj.items():
        if isinstance(x, dict) and (prefix, k) != ("node", "columns"):
            opened(f"{prefix}.{k}", x, out)
        elif x is not None:
            out[f"{prefix}.{k}"] = x


def records(doc):
    rec = {"m": {f"metadata.{k}": x for k, x in (doc.get("metadata") or {}).items() if x is not None}}
    for sec in ("nodes", "sources"):
        for key, node in (doc.get(sec) or {}).items():
            if not isinstance(node, dict):
                continue
            opened("node", node, rec.setdefault(("n", sec, key), {}))
            cols = node.get("columns")
            for ck, col in cols.items() if isinstance(cols, dict) else enumerate(cols or []):
                if isinstance(col, dict):
                    rec["c", sec, key, col.get("name", ck)] = {f"column.{a}": b for a, b in col.items() if b is not None}
    return rec


def compare(origin, group, step, old, new, out):
    fields = []
    for side in (old, new):
        f = collections.defaultdict(set)
        for r in side.values():
            for a, b in r.items():
                f[a].add(kind(b))
        fields.append(f)
    was, now = fields
    pairs = []
    for a in was.keys() - now.keys():
        for b in now.keys() - was.keys():
            both = [k for k in old.keys() & new.keys() if a in old[k] and b in new[k]]
            same = [k for k in both if (kind(old[k][a]), old[k][a]) == (kind(new[k][b]), new[k][b])]
            if both and 2 * len(same) >= len(both):
                pairs.append((-len(same) / len(both), -len(both), a, b))
    used = set()
    for _, _, a, b in sorted(pairs):
        if (0, a) not in used and (1, b) not in used:
            used |= {(0, a), (1, b)}
            out.add((origin, group, step, "renamed", a, b))
    out |= {(origin, group, step, "removed", a, "") for a in was.keys() - now.keys() if (0, a) not in used}
    out |= {(origin, group, step, "added", "", b) for b in now.keys() - was.keys() if (1, b) not in used}
    out |= {(origin, group, step, "retyped", a, a) for a in was.keys() & now.keys() if was[a] != now[a]}


def test_drift(spark):
    want, before = set(), None
    for r in pd.read_parquet(f"{DATA}/manifest_files.parquet").sort_values(["project_name", "generated_at", "file_id"]).itertuples():
        ok, doc = load(r.payload)
        if not ok:
            continue
        rec = records(doc)
        if before and before[0] == r.project_name:
            compare("manifest_files", r.project_name, r.file_id, before[1], rec, want)
        before = (r.project_name, rec)
    n = pd.read_parquet(f"{DATA}/nodes.parquet").sort_values("_seq").groupby(["_version", "id"]).tail(1)
    by = collections.defaultdict(dict)
    for version, ident, props in n[n.type == "Dataset"][["_version", "id", "properties"]].itertuples(index=False):
        p = {k: x for k, x in json.loads(props).items() if x is not None}
        if p.get("database"):
            by[p["database"], version][ident] = p
    for (db, version), rec in by.items():
        if (db, version - 1) in by:
            compare("nodes", db, version, by[db, version - 1], rec, want)
    got = [tuple(r) for r in drift.p4_found(spark, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == want
