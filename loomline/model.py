"""Data model: schemas of the stored tables, node and edge types, fixed names."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NODE_TYPES = ("Dataset", "Column", "Pipeline", "User", "Team", "BusinessTerm")
EDGE_TYPES = ("PRODUCED_BY", "CONSUMED_BY", "OWNED_BY", "DERIVED_FROM", "JOINS_WITH", "DISPLAYED_IN", "GOVERNED_BY", "BELONGS_TO")
CONTAINMENT = "BELONGS_TO"
DEFAULT_DIM = 384

NODES = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "type", "name", "description", "properties")])
EDGES = T.StructType([T.StructField(c, T.StringType()) for c in ("source_id", "target_id", "type", "properties")])
VECTORS = T.StructType([*[T.StructField(c, T.StringType()) for c in ("id", "name", "type")], T.StructField("vector", T.ArrayType(T.FloatType()))])
COMMITS = T.StructType([T.StructField("version", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("operation", T.StringType())])


class Graph(NamedTuple):
    """A property graph: nodes (id, type, name, description, properties) and edges (source_id, target_id, type, properties)."""

    nodes: DataFrame
    edges: DataFrame


def depth_in_range(depth: int) -> int:
    """Traversal depths are 1 to 10."""
    return max(1, min(int(depth), 10))
