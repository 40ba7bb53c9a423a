"""Search over nodes and vectors: by terms, by cosine, and both together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.embed import dot
from loomline.functions.text import search_terms

MAX_DISTANCE = 0.75

#: What a term scores for each field that contains it.
FIELD_SCORES = {"name": 5, "id": 4, "description": 2, "type": 1, "properties": 1}


def term_score(terms: Column) -> Column:
    """Sum over the terms of the scores of the fields that contain them."""
    low = {f: F.lower(F.coalesce(F.col(f), F.lit(""))) for f in FIELD_SCORES}

    def one(t: Column) -> Column:
        return sum((F.when(low[f].contains(t), s).otherwise(0) for f, s in FIELD_SCORES.items()), F.lit(0))

    return F.aggregate(terms, F.lit(0), lambda acc, t: acc + one(t))


def by_terms(nodes: DataFrame, query: str, top_k: int = 5) -> DataFrame:
    """The 2 * top_k nodes with the highest scores, ties by id. The terms are constants of the plan, so nodes are scanned once and nothing is joined."""
    terms = nodes.sparkSession.range(1).select(search_terms(F.lit(query)).alias("t")).first()[0]
    if not terms:
        return nodes.withColumn("score", F.lit(0)).limit(0)
    scored = nodes.withColumn("score", term_score(F.array(*[F.lit(t) for t in terms]))).filter("score > 0")
    return scored.orderBy(F.desc("score"), "id").limit(2 * top_k)


def within(vectors: DataFrame, query: list[float], max_distance: float = MAX_DISTANCE) -> DataFrame:
    """Vectors with their cosine distance to the query, where it is small enough. A zero query finds nothing; a zero vector has distance 1; a vector of
    another length raises an error."""
    if not any(query):
        return vectors.withColumn("distance", F.lit(0.0)).limit(0)
    length = math.sqrt(sum(float(x) ** 2 for x in query))
    q = F.array(*[F.lit(float(x) / length) for x in query])
    fits = F.when(F.size("vector") == len(query), F.col("vector")).otherwise(F.raise_error(F.lit("vector and query differ in length")))
    norm = F.sqrt(dot(F.col("vector"), F.col("vector")))
    d = vectors.filter("id is not null and vector is not null").withColumn("distance", F.when(norm > 0, 1 - dot(fits, q) / norm).otherwise(1.0))
    return d.filter(F.col("distance") <= max_distance)


def by_vector(vectors: DataFrame, query: list[float], top_k: int = 5, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """The top_k nearest vectors, ties by id."""
    return within(vectors, query, max_distance).orderBy("distance", "id").limit(top_k)


def by_ids(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """Nodes in the order of ids; repeated ids are repeated, unknown ones left out."""
    wanted = nodes.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "pos int, id string")
    return nodes.join(wanted, "id").orderBy("pos")


def parents(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that found nodes name as their dataset_id and that are not among them."""
    ids = found.select(F.get_json_object("properties", "$.dataset_id").alias("id")).filter("id is not null and id <> ''").distinct().join(found.select("id"), "id", "left_anti")
    return nodes.join(ids, "id", "left_semi")


def hybrid(nodes: DataFrame, vectors: DataFrame, query: str, vector: list[float], top_k: int = 5) -> DataFrame:
    """Nodes by vector, then by terms, then the datasets of the columns among them, each once: stage, pos and the node; 2 * top_k rows at most."""
    v = by_vector(vectors, vector, top_k).select("id", "distance")
    hits = nodes.join(F.broadcast(v), "id").withColumn("key1", F.col("distance")).drop("distance").withColumn("stage", F.lit(1))
    terms = by_terms(nodes, query, top_k).withColumn("key1", -F.col("score").cast("double")).drop("score").withColumn("stage", F.lit(2))
    both = hits.unionByName(terms)
    up = parents(both, nodes).withColumn("key1", F.lit(0.0)).withColumn("stage", F.lit(3))
    first = Window.partitionBy("id").orderBy("stage")
    every = both.unionByName(up).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    order = Window.orderBy("stage", "key1", "id")  # no more than 6 * top_k rows
    return every.orderBy("stage", "key1", "id").limit(2 * top_k).withColumn("pos", F.row_number().over(order)).drop("key1")
