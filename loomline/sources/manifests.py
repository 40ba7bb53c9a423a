"""Transformation manifests and catalogs: datasets, their columns, and derivation edges. Payloads are JSON texts, one document per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Resource types that are datasets.
KEPT = ("model", "seed", "source")


def bare(payload: Column) -> Column:
    """The JSON text without white space and byte-order marks at its ends, one wrapping as a JSON string undone; null if it is no JSON."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^[\s﻿]+|[\s﻿]+$", "")
    once = trim(payload)
    inner = F.try_variant_get(F.try_parse_json(once), "$", "string")
    text = F.when(once.startswith('"'), trim(inner)).otherwise(once)
    return F.when(F.try_parse_json(text).isNotNull(), text)


def _members(text: Column, path: str) -> Column:
    """The members of an object as key and JSON text; empty for anything else."""
    part = F.get_json_object(text, path)
    return F.coalesce(F.map_entries(F.from_json(F.when(part.startswith("{"), part), "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))


def datasets(files: DataFrame, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """One row per dataset of each manifest: the nodes of the kept resource types, then all sources (section, id, name, schema, database, description,
    owner, columns as a list of keys, depends_on). Documents that are no JSON object give none; missing parts are null or empty lists; sources depend on
    nothing. keep: columns of files that come along."""
    keep = keep or []
    base = files.select(*keep, bare(F.col(payload)).alias("_d")).filter("_d is not null")
    parts = [base.select(*keep, F.lit(s).alias("section"), F.explode(_members(F.col("_d"), f"$.{s}")).alias("_m")) for s in ("nodes", "sources")]
    rows = parts[0].unionByName(parts[1]).select(*keep, "section", F.col("_m.key").alias("id"), F.col("_m.value").alias("_v"), F.to_json("_m.value").alias("_t"))
    get = lambda p: F.try_variant_get("_v", f"$.{p}", "string")
    keys = F.when(F.get_json_object("_t", "$.columns").startswith("{"), F.map_keys(F.from_json(F.get_json_object("_t", "$.columns"), "map<string,variant>")))
    listed = F.transform(F.from_json(F.when(F.get_json_object("_t", "$.columns").startswith("["), F.get_json_object("_t", "$.columns")), "array<struct<name:string>>"), lambda c: c["name"])
    none = F.array().cast("array<string>")
    deps = F.coalesce(F.from_json(F.get_json_object("_t", "$.depends_on.nodes"), "array<string>"), none)
    out = rows.filter(F.col("_t").startswith("{")).select(
        *keep, "section", "id", get("resource_type").alias("resource_type"), get("name").alias("name"), get("schema").alias("schema"), get("database").alias("database"),
        get("description").alias("description"), get("meta.owner").alias("owner"), F.coalesce(keys, listed, none).alias("columns"), F.when(F.col("section") == "nodes", deps).otherwise(none).alias("depends_on"),
    )
    return out.filter((F.col("section") == "sources") | F.col("resource_type").isin(*KEPT))


def derivations(sets: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """source_id (what is depended on), target_id, type of each dependency, as often as it is declared."""
    return sets.select(*(keep or []), F.explode("depends_on").alias("source_id"), F.col("id").alias("target_id"), F.lit("DERIVED_FROM").alias("type")).filter("source_id is not null")


def catalog(files: DataFrame, payload: str = "payload") -> DataFrame:
    """Physical tables of catalogs: id, type, database, schema, name, owner, columns (name, type, comment, index). Missing comments are ''."""
    base = files.select(bare(F.col(payload)).alias("_d")).filter("_d is not null").select(F.explode(_members(F.col("_d"), "$.nodes")).alias("_m"))
    rows = base.select(F.col("_m.key").alias("id"), F.to_json("_m.value").alias("_t"))
    cols = F.from_json(F.get_json_object("_t", "$.columns"), "map<string,struct<type:string,comment:string,index:int>>")
    listed = F.transform(F.map_entries(cols), lambda e: F.struct(e["key"].alias("name"), e["value"]["type"].alias("type"), F.coalesce(e["value"]["comment"], F.lit("")).alias("comment"), e["value"]["index"].alias("index")))
    return rows.select("id", *[F.get_json_object("_t", f"$.metadata.{p}").alias(p) for p in ("type", "database", "schema", "name", "owner")], F.coalesce(listed, F.array().cast("array<struct<name:string,type:string,comment:string,index:int>>")).alias("columns"))


def with_owner(sets: DataFrame, physical: DataFrame) -> DataFrame:
    """Datasets with the catalog's owner where the manifest names none."""
    return sets.join(physical.select("id", F.col("owner").alias("_o")), "id", "left").withColumn("owner", F.coalesce("owner", "_o")).drop("_o")
