"""Lineage run records: pipelines with what they read and write. Payloads are JSON texts of one record or an array of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import join_parts
from loomline.sources.manifests import bare


def _objects(text: Column) -> Column:
    """The object members of a JSON array with their positions; a single object counts as the only member."""
    arr = F.from_json(F.when(text.startswith("["), text), "array<variant>")
    one = F.when(text.startswith("{"), F.array(F.try_parse_json(text)))
    texts = F.transform(F.coalesce(arr, one, F.array().cast("array<variant>")), lambda v, i: F.struct(i.alias("pos"), F.to_json(v).alias("t")))
    return F.filter(texts, lambda x: x["t"].startswith("{"))


def _name(text: Column, path: str = "$") -> Column:
    part = lambda p: F.coalesce(F.get_json_object(text, f"{path}.{p}"), F.lit(""))
    return join_parts(part("namespace"), part("name"))


def records(files: DataFrame, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """One row per record: run_id, event_type, event_time, pipeline_id, inputs and outputs as lists of ids. Members that are no objects and empty ids are
    left out; unreadable payloads give none."""
    keep = keep or []
    ev = files.select(*keep, F.explode(_objects(F.coalesce(bare(F.col(payload)), F.lit("")))).alias("_e"))
    t = F.col("_e.t")
    ports = lambda p: F.filter(F.transform(_objects(F.coalesce(F.get_json_object(t, f"$.{p}"), F.lit(""))), lambda x: _name(x["t"])), lambda x: x != "")
    return ev.select(
        *keep, F.col("_e.pos").alias("pos"), F.get_json_object(t, "$.run.runId").alias("run_id"), F.get_json_object(t, "$.eventType").alias("event_type"), F.get_json_object(t, "$.eventTime").alias("event_time"),
        _name(t, "$.job").alias("pipeline_id"), ports("inputs").alias("inputs"), ports("outputs").alias("outputs"),
    )


def run_edges(recs: DataFrame) -> DataFrame:
    """CONSUMED_BY edges from inputs to the pipeline and PRODUCED_BY edges from the pipeline to outputs; records without a pipeline give none."""
    r = recs.filter("pipeline_id <> ''")
    read = r.select(F.explode("inputs").alias("source_id"), F.col("pipeline_id").alias("target_id"), F.lit("CONSUMED_BY").alias("type"))
    made = r.select(F.col("pipeline_id").alias("source_id"), F.explode("outputs").alias("target_id"), F.lit("PRODUCED_BY").alias("type"))
    return read.unionByName(made)
