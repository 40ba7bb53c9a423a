"""Schemas that drift between files and versions (problem 4): rescue-column ingestion and a report of each change."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.jsonvalue import fingerprint
from loomline.functions.payloads import load
from loomline.operators.ordering import previous
from loomline.session import stage
from loomline.sources import tables

#: Bits of the kinds of JSON values, so that the kinds of a field are one long that aggregates by OR.
KINDS = {"string": 1, "number": 2, "boolean": 4, "array": 8, "object": 16}

LEAVES = "origin string, group_key string, step_no long, generated_at timestamp, rec_key string, fields array<struct<field: string, kind: long, hash: long, json: string>>"

#: Share of the records that two fields share in which a renamed field has the same value.
RENAME_SHARE = 0.5


def kind_bit(v: object) -> int:
    if isinstance(v, bool):
        return KINDS["boolean"]
    if isinstance(v, (int, float)):
        return KINDS["number"]
    return KINDS["string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"]


def _leaf(name: str, v: object) -> dict:
    text = json.dumps(v, ensure_ascii=False, sort_keys=True)
    return {"field": name, "kind": kind_bit(v), "hash": fingerprint(text), "json": text}


def _open(prefix: str, obj: dict, whole: tuple[str, ...] = ()) -> list[dict]:
    """Leaves of an object; inner objects are opened at any depth, but for the fields named whole. Null leaves are absent."""
    out, todo = [], [(prefix, obj)]
    while todo:
        p, o = todo.pop()
        for k, v in o.items():
            name = f"{p}.{k}"
            if isinstance(v, dict) and name not in whole:
                todo.append((name, v))
            elif v is not None:
                out.append(_leaf(name, v))
    return out


def manifest_records(value: object) -> Iterator[tuple[str, list[dict]]]:
    """(record key, leaves) of one manifest: its metadata, each object in nodes and sources, each column object."""
    top = value if isinstance(value, dict) else {}
    meta = top.get("metadata")
    yield "m", [_leaf(f"metadata.{k}", v) for k, v in meta.items() if v is not None] if isinstance(meta, dict) else []
    for sec in ("nodes", "sources"):
        part = top.get(sec)
        for key, node in part.items() if isinstance(part, dict) else ():
            if not isinstance(node, dict):
                continue
            yield f"n/{sec}/{key}", _open("node", node, ("node.columns",))
            cols = node.get("columns")
            for ck, col in cols.items() if isinstance(cols, dict) else enumerate(cols) if isinstance(cols, list) else ():
                if isinstance(col, dict):
                    ident = col.get("name") if isinstance(col.get("name"), str) else ck
                    yield f"c/{sec}/{key}/{ident}", [_leaf(f"column.{k}", v) for k, v in col.items() if v is not None]


def _manifest_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["origin", "group_key", "step_no", "generated_at", "rec_key", "fields"]
    for pdf in batches:
        out = []
        for fid, group, at, payload in zip(pdf["file_id"], pdf["project_name"], pdf["generated_at"], pdf["payload"], strict=True):
            ok, value = load(payload)
            if ok:
                fid = None if fid is None else int(fid)
                out += [("manifest_files", group, fid, at, key, leaves) for key, leaves in manifest_records(value)]
            if len(out) > 5_000:
                yield pd.DataFrame(out, columns=cols)
                out = []
        if out:
            yield pd.DataFrame(out, columns=cols)


def _property_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["origin", "group_key", "step_no", "generated_at", "rec_key", "fields"]
    for pdf in batches:
        out = []
        for version, nid, text in zip(pdf["_version"], pdf["id"], pdf["properties"], strict=True):
            ok, value = load(text)
            if ok and isinstance(value, dict) and value.get("database") is not None:
                db = value["database"]
                out.append(("nodes", db if isinstance(db, str) else json.dumps(db, sort_keys=True), version, pd.NaT, nid, [_leaf(k, v) for k, v in value.items() if v is not None]))
        if out:
            yield pd.DataFrame(out, columns=cols).astype({"generated_at": "datetime64[us]"})


def manifest_leaves(files: DataFrame) -> DataFrame:
    """Records of readable manifests (file_id, project_name, generated_at, payload); a null project_name is ''."""
    return files.select(F.col("file_id").cast("string").alias("file_id"), F.coalesce("project_name", F.lit("")).alias("project_name"), "generated_at", "payload").mapInPandas(_manifest_rows, LEAVES)


def dataset_leaves(nodes: DataFrame) -> DataFrame:
    """Records of the valid Dataset rows; other rows take part in finding the valid row only, without their properties."""
    slim = nodes.filter(tables.filled("id")).select("_version", "_seq", "id", "type", F.when(F.col("type") == "Dataset", F.col("properties")).alias("properties"))
    valid = tables.last_wins(slim, ["_version", "id"], ["_seq"]).filter("type = 'Dataset'")
    return valid.select("_version", "id", "properties").mapInPandas(_property_rows, LEAVES)


def step_order(leaves: DataFrame) -> DataFrame:
    """origin, group_key, step_no and prev_no, the step that it is compared with (null: none)."""
    steps = leaves.groupBy("origin", "group_key", "step_no").agg(F.min("generated_at").alias("generated_at"))
    files = previous(steps.filter("origin = 'manifest_files'"), ["group_key"], ["generated_at", "step_no"], F.col("step_no"), "prev_no")
    versions = steps.filter("origin = 'nodes'")
    before = versions.select("origin", "group_key", (F.col("step_no") + 1).alias("step_no"), F.col("step_no").alias("prev_no"))
    versions = versions.join(before, ["origin", "group_key", "step_no"], "left")
    cols = ["origin", "group_key", "step_no", "prev_no"]
    return files.select(*cols).unionByName(versions.select(*cols))


ON = ["origin", "group_key", "step_no"]


def schemas(leaves: DataFrame) -> DataFrame:
    """origin, group_key, step_no, field, kinds: the fields of each step with the kinds of their values. Aggregated before any comparison, so a group with a third of
    the records costs one row per field and task."""
    return leaves.select(*ON, F.explode("fields").alias("f")).groupBy(*ON, F.col("f.field").alias("field")).agg(F.bit_or("f.kind").alias("kinds"))


def targets(schema: DataFrame, steps: DataFrame) -> DataFrame:
    """The target schema of each step that has a step before it, which is that step's schema: target, a map of kinds by field."""
    known = schema.withColumnRenamed("step_no", "prev_no").groupBy("origin", "group_key", "prev_no").agg(F.map_from_entries(F.collect_list(F.struct("field", "kinds"))).alias("target"))  # fields of one step
    return steps.filter("prev_no is not null").join(known, ["origin", "group_key", "prev_no"])


def enforce(leaves: DataFrame, target: DataFrame) -> DataFrame:
    """Rescue-column ingestion: each record of a step with its target schema enforced. `fields` keeps what the target knows and can hold, `_rescued` has the rest,
    each with its value as JSON; an unknown field has a null `was`, an uncastable one the kinds that the target holds."""
    kinds = lambda f: F.try_element_at(F.col("target"), f["field"])
    fits = lambda f: F.coalesce(kinds(f).bitwiseAND(f["kind"]) != 0, F.lit(False))
    kept = F.filter("fields", fits).alias("fields")
    rest = F.transform(F.filter("fields", lambda f: ~fits(f)), lambda f: F.struct(f["field"].alias("field"), f["kind"].alias("kind"), f["hash"].alias("hash"), f["json"].alias("json"), kinds(f).alias("was")))
    return leaves.join(target.select(*ON, "prev_no", "target"), ON).select(*ON, "prev_no", "rec_key", kept, rest.alias("_rescued"))


def verdicts(rescued: DataFrame, schema: DataFrame, target: DataFrame) -> DataFrame:
    """origin, group_key, step_no, prev_no, field, verdict: what the rescue columns of a step hold, 'unknown' or 'uncastable' fields, and which columns of its target
    no record fills, or none with all of its kinds: 'unfilled' and 'narrowed'."""
    held = rescued.select(*ON, "prev_no", F.explode("_rescued").alias("r")).groupBy(*ON, "prev_no", F.col("r.field").alias("field")).agg(F.max("r.was").alias("_was"))
    held = held.select(*ON, "prev_no", "field", F.when(F.col("_was").isNull(), "unknown").otherwise("uncastable").alias("verdict"))
    columns = target.select(*ON, "prev_no", F.explode("target").alias("field", "was")).join(schema, [*ON, "field"], "left")
    filled = F.when(F.col("kinds").isNull(), "unfilled").when(F.col("kinds").bitwiseAND(F.col("was")) != F.col("was"), "narrowed")
    return held.unionByName(columns.select(*ON, "prev_no", "field", filled.alias("verdict")).filter("verdict is not null"))


def replay(leaves: DataFrame, rescued: DataFrame, said: DataFrame, share: float = RENAME_SHARE) -> DataFrame:
    """Replays the rescued values of unknown fields into unfilled columns: origin, group_key, step_no, old_field, new_field of the renames.

    A pair is a rename if in at least `share` of the records that have the old field before and the new field now the values are equal. Of several
    fitting pairs the one with the larger share, then the more records, then the names in order wins; a field is part of one rename only. Only pairs with
    an equal value in some record are counted.
    """
    cand = said.groupBy(*ON, "prev_no").agg(F.collect_set(F.when(F.col("verdict") == "unfilled", F.col("field"))).alias("_gone"), F.max(F.col("verdict") == "unknown").alias("_come"))
    cand = stage(cand.filter("size(_gone) > 0 and _come").drop("_come"))
    slim = lambda c: F.transform(c, lambda f: F.struct(f["field"].alias("field"), f["hash"].alias("hash")))
    none = F.lit(None).cast("array<struct<field:string,hash:bigint>>")
    new = rescued.join(cand.select(*ON), ON, "left_semi").select(*ON, "rec_key", slim(F.filter("_rescued", lambda f: f["was"].isNull())).alias("_n"), none.alias("_o")).filter("size(_n) > 0")
    prev = leaves.withColumnRenamed("step_no", "prev_no").join(cand, ["origin", "group_key", "prev_no"])
    old = prev.select(*ON, "rec_key", none.alias("_n"), slim(F.filter("fields", lambda f: F.array_contains("_gone", f["field"]))).alias("_o")).filter("size(_o) > 0")
    # a repeated record (a column listed twice) counts once, by its first fields
    rec = stage(new.unionByName(old).groupBy(*ON, "rec_key").agg(F.min("_n").alias("_n"), F.min("_o").alias("_o")).filter("_n is not null and _o is not null"))
    equal = rec.select(*ON, F.explode("_o").alias("o"), "_n").select(*ON, F.col("o.field").alias("old_field"), F.explode(F.filter("_n", lambda n: n["hash"] == F.col("o.hash"))).alias("n"))
    same = equal.groupBy(*ON, "old_field", F.col("n.field").alias("new_field")).agg(F.count("*").alias("n_same"))
    wanted = same.groupBy(*ON).agg(F.collect_list(F.struct("old_field", "new_field", "n_same")).alias("_p"))  # pairs of fields
    has = lambda side, name: F.exists(side, lambda x: x["field"] == name)
    seen = rec.join(wanted, ON).select(*ON, F.explode(F.filter("_p", lambda p: has("_o", p["old_field"]) & has("_n", p["new_field"]))).alias("p"))
    score = seen.groupBy(*ON, "p").agg(F.count("*").alias("n_both")).select(*ON, "p.old_field", "p.new_field", "p.n_same", "n_both")
    fit = score.filter(F.col("n_same") >= F.col("n_both") * share)
    ranked = fit.groupBy(*ON).agg(F.array_sort(F.collect_list(F.struct((-F.col("n_same") / F.col("n_both")).alias("a"), (-F.col("n_both")).alias("b"), "old_field", "new_field"))).alias("p"))

    def take(acc: Column, x: Column) -> Column:
        free = ~F.exists(acc, lambda y: (y["old_field"] == x["old_field"]) | (y["new_field"] == x["new_field"]))
        return F.when(free, F.concat(acc, F.array(x))).otherwise(acc)

    chosen = ranked.select(*ON, F.explode(F.aggregate("p", F.slice("p", 1, 0), take)).alias("c"))
    return chosen.select(*ON, "c.old_field", "c.new_field")


def changes(leaves: DataFrame) -> DataFrame:
    """origin, group_key, step_no, change_kind, old_field, new_field: each change between a step and the one before, read from the rescue columns of an ingestion
    that enforces the schema of the step before, from the columns it leaves unfilled, and from the replay of the one into the other. Empty input gives no rows."""
    schema = stage(schemas(leaves))
    target = stage(targets(schema, step_order(leaves)))
    rescued = stage(enforce(leaves, target).filter("size(_rescued) > 0").drop("fields"))
    said = stage(verdicts(rescued, schema, target))
    renames = stage(replay(leaves, rescued, said))
    used = renames.select(*ON, F.explode(F.array(F.struct(F.lit("unfilled").alias("verdict"), F.col("old_field").alias("field")), F.struct(F.lit("unknown").alias("verdict"), F.col("new_field").alias("field")))).alias("u"))
    rest = said.join(used.select(*ON, "u.verdict", "u.field"), [*ON, "verdict", "field"], "left_anti")
    kind = F.when(F.col("verdict") == "unknown", "added").when(F.col("verdict") == "unfilled", "removed").otherwise("retyped")
    plain = rest.select(*ON, kind.alias("change_kind"), F.when(F.col("verdict") == "unknown", "").otherwise(F.col("field")).alias("old_field"), F.when(F.col("verdict") == "unfilled", "").otherwise(F.col("field")).alias("new_field")).distinct()
    return plain.unionByName(renames.select(*ON, F.lit("renamed").alias("change_kind"), "old_field", "new_field"))


#: Target columns of the consistent Dataset table, with their types.
TARGET = {"database": "string", "schema": "string", "table_type": "string", "owner": "string", "row_count": "bigint", "tags": "array<string>", "pii": "boolean", "cost_center": "string"}

#: Target columns of the records of manifests, by kind: metadata, objects of nodes and sources with their inner objects opened, column objects.
MANIFEST_TARGETS = {
    "metadata": {"dbt_version": "string", "project_name": "string", "generator": "string", "schema_url": "string"},
    "node": {
        "name": "string", "resource_type": "string", "database": "string", "schema": "string", "alias": "string", "description": "string", "owner": "string", "materialized": "string",
        "enabled": "boolean", "priority": "bigint", "tier": "bigint", "checksum": "string", "tags": "array<string>", "depends_on": "array<string>", "columns": "string",
    },
    "column": {"name": "string", "description": "string", "data_type": "string", "nullable": "boolean", "index": "bigint"},
}

#: Inner fields of manifest records that are target columns under a plain name.
INNER = {"node": {"meta.owner": "owner", "meta.tier": "tier", "depends_on.nodes": "depends_on"}}

RECORDS = "origin string, group_key string, step_no long, generated_at timestamp, rec_kind string, rec_key string, record string"


def ingest(records: DataFrame, text: str, target: dict[str, str], approved: dict[str, str] | Column | None = None) -> DataFrame:
    """The records with one typed column per target field and `_rescued`, the JSON of all members that are unknown or cannot be cast.

    records: any columns, JSON objects in the column `text`. approved: target fields by the other names that are promoted to them, for all records or as a map
    column, for each; where the target field has no value, the rescued value of the first such name that has one is replayed into the typed column and leaves the
    rescue column. Text that is no JSON object is rescued whole; null text gives nulls. A column of records with the name of a target field keeps its name, the
    target then has the prefix 'field_'.
    """
    taken = set(records.columns)
    names = F.create_map(*[F.lit(x) for pair in approved.items() for x in pair]) if isinstance(approved, dict) and approved else approved
    if names is None or isinstance(names, dict):
        names = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    df = records.withColumn("__names", F.array_sort(F.map_entries(names))).withColumn("__members", F.from_json(F.col(text), T.MapType(T.StringType(), T.VariantType())))
    bad = F.col(text).isNotNull() & (F.col("__members").isNull() | ~F.trim(F.col(text)).startswith("{"))
    used, out = [], []
    for t, kind in target.items():
        own = F.try_variant_get(F.col("__members")[t], "$", kind)
        fits = F.filter(F.col("__names"), lambda e: (e["value"] == t) & F.try_variant_get(F.try_element_at(F.col("__members"), e["key"]), "$", kind).isNotNull())  # noqa: B023
        other = F.try_element_at(fits, F.lit(1))["key"]
        used.append(F.when(own.isNotNull(), F.lit(t)).otherwise(other))
        out.append(F.coalesce(own, F.try_variant_get(F.try_element_at(F.col("__members"), other), "$", kind)).alias(f"field_{t}" if t in taken else t))
    gone = F.array_compact(F.array(*used))
    rescued = F.map_filter("__members", lambda k, v: v.isNotNull() & ~F.is_variant_null(v) & ~F.array_contains(gone, k))
    col = F.when(bad, F.to_json(F.struct(F.col(text).alias("_text")))).when(F.size(rescued) > 0, F.to_json(rescued)).alias("_rescued")
    return df.select(*records.columns, *out, col)


def _flat(obj: dict, whole: tuple[str, ...] = (), opened: bool = True) -> str:
    """An object as JSON with its inner objects opened, as _open does. Empty inner objects stay, a name that comes twice gets a number."""
    out: dict[str, object] = {}
    todo = [("", obj)]
    while todo:
        p, o = todo.pop()
        for k, v in o.items():
            name = p + k
            if opened and isinstance(v, dict) and v and name not in whole:
                todo.append((name + ".", v))
            elif v is not None:
                n = 1
                while (key := name if n == 1 else f"{name}#{n}") in out:
                    n += 1
                out[key] = v
    return json.dumps(out)


def manifest_texts(value: object) -> Iterator[tuple[str, str, str]]:
    """(kind, record key, JSON) of the records of one manifest: those of manifest_records."""
    top = value if isinstance(value, dict) else {}
    if isinstance(top.get("metadata"), dict):
        yield "metadata", "m", _flat(top["metadata"], opened=False)
    for sec in ("nodes", "sources"):
        part = top.get(sec)
        for key, node in part.items() if isinstance(part, dict) else ():
            if not isinstance(node, dict):
                continue
            yield "node", f"n/{sec}/{key}", _flat(node, ("columns",))
            cols = node.get("columns")
            for ck, col in cols.items() if isinstance(cols, dict) else enumerate(cols) if isinstance(cols, list) else ():
                if isinstance(col, dict):
                    ident = col.get("name") if isinstance(col.get("name"), str) else ck
                    yield "column", f"c/{sec}/{key}/{ident}", _flat(col, opened=False)


def _text_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["origin", "group_key", "step_no", "generated_at", "rec_kind", "rec_key", "record"]
    for pdf in batches:
        out = []
        for fid, group, at, payload in zip(pdf["file_id"], pdf["project_name"], pdf["generated_at"], pdf["payload"], strict=True):
            ok, value = load(payload)
            if ok:
                fid = None if fid is None else int(fid)
                out += [("manifest_files", group, fid, at, *r) for r in manifest_texts(value)]
            if len(out) > 5_000:
                yield pd.DataFrame(out, columns=cols)
                out = []
        if out:
            yield pd.DataFrame(out, columns=cols)


def manifest_table(files: DataFrame, report: DataFrame) -> DataFrame:
    """All records of readable manifests with the typed columns of their kind and `_rescued`; renamed fields are promoted as the report says."""
    slim = files.select(F.col("file_id").cast("string").alias("file_id"), F.coalesce("project_name", F.lit("")).alias("project_name"), "generated_at", "payload")
    records = stage(slim.mapInPandas(_text_rows, RECORDS))
    out: DataFrame | None = None
    for kind, target in MANIFEST_TARGETS.items():
        own = report.filter((F.col("origin") == "manifest_files") & F.col("old_field").startswith(f"{kind}.") & F.col("new_field").startswith(f"{kind}."))
        own = own.select("group_key", "change_kind", *[F.substring(c, len(kind) + 2, 1 << 30).alias(c) for c in ("old_field", "new_field")])
        part = promoted(records.filter(F.col("rec_kind") == kind), "record", target, own, INNER.get(kind)).drop("record")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def approved_names(pairs: list[tuple[str, str]], target: dict[str, str], known: dict[str, str] | None = None) -> dict[str, str]:
    """Names that renames lead to or from a target field, over several steps; known: names that are approved anyway."""
    found: dict[str, str] = dict(known or {})
    grew = True
    while grew:
        grew = False
        for a, b in sorted(pairs):
            for x, y in ((a, b), (b, a)):
                to = y if y in target else found.get(y)
                if to and x not in target and x not in found:
                    found[x], grew = to, True
    return found


def approvals(report: DataFrame, target: dict[str, str], known: dict[str, str] | None = None) -> DataFrame:
    """group_key and _approved (map): the names that the group's own renames approve. A group has as many rows here as its schema has renames."""

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        names = approved_names(list(zip(pdf["old_field"], pdf["new_field"], strict=True)), target, known)
        return pd.DataFrame({"group_key": [pdf["group_key"].iloc[0]], "names": [list(names)], "fields": [list(names.values())]})

    pairs = report.filter("change_kind = 'renamed'").select("group_key", "old_field", "new_field").distinct()
    made = pairs.groupBy("group_key").applyInPandas(of_group, "group_key string, names array<string>, fields array<string>")
    return made.select("group_key", F.map_from_arrays("names", "fields").alias("_approved"))


def promoted(records: DataFrame, text: str, target: dict[str, str], report: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """ingest() of records with a group_key, each group with the renames that the report has of it; a rename of one group says nothing of another's fields."""
    always = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    with_names = records.join(approvals(report, target, known), "group_key", "left").withColumn("_approved", F.coalesce("_approved", always))
    return ingest(with_names, text, target, F.col("_approved")).drop("_approved")


def _leaves(spark: SparkSession, base: str) -> DataFrame:
    return stage(manifest_leaves(tables.read(spark, base, "manifest_files")).unionByName(dataset_leaves(tables.read(spark, base, "nodes"))))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return changes(_leaves(spark, base))


def p4_table(spark: SparkSession, base: str) -> DataFrame:
    """All valid Dataset rows of all versions and all records of all readable manifests in one consistent table, rec_kind tells which; renamed fields are
    promoted as the report of changes says. A column that the kind does not have is null."""
    report = stage(changes(_leaves(spark, base)).filter("change_kind = 'renamed'"))
    valid = tables.nodes(spark, base).filter("type = 'Dataset'").select("_version", "id", "name", "properties")
    valid = valid.withColumn("group_key", F.get_json_object("properties", "$.database"))
    sets = promoted(valid, "properties", TARGET, report.filter("origin = 'nodes'")).drop("properties")
    sets = sets.select(F.lit("nodes").alias("origin"), "group_key", F.col("_version").cast("long").alias("step_no"), F.lit("dataset").alias("rec_kind"), F.col("id").alias("rec_key"), *[c for c in sets.columns if c != "group_key"])
    return sets.unionByName(manifest_table(tables.read(spark, base, "manifest_files"), report), allowMissingColumns=True)
