"""The stored graph tables: nodes, edges, vectors, commits, and the rows that are valid in a version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order; ties go to the greatest remaining columns, so the result does not depend on the input's order.

    row_number() = 1 becomes a window group limit, which keeps one row per key before the shuffle: a key that holds a third of all rows costs no more
    than another.
    """
    rest = [c for c, t in df.dtypes if c not in keys + order and not t.startswith(("map", "variant"))]
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order + rest])
    return df.withColumn("__last", F.row_number().over(w)).filter("__last = 1").drop("__last")


def filled(*names: str) -> Column:
    """True where every named column is neither null nor empty."""
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).isNotNull() & (F.col(n) != "")
    return cond


def nodes(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """Valid node rows (highest _seq per _version and id); rows without an id are ignored."""
    df = read(spark, base, "nodes").filter(filled("id"))
    if version is not None:
        df = df.filter(F.col("_version") == version)
    return last_wins(df, ["_version", "id"], ["_seq"])


def edges(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """Valid edge rows (highest _seq per _version and key); rows with a null or empty endpoint are ignored."""
    df = read(spark, base, "edges").filter(filled("source_id", "target_id"))
    if version is not None:
        df = df.filter(F.col("_version") == version)
    return last_wins(df, ["_version", "source_id", "target_id", "type"], ["_seq"])


def edge_keys(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The distinct edge keys of each version. Validity only decides between properties, so no row order is needed."""
    df = read(spark, base, "edges").filter(filled("source_id", "target_id"))
    if version is not None:
        df = df.filter(F.col("_version") == version)
    return df.select("_version", "source_id", "target_id", "type").distinct()


def vectors(spark: SparkSession, base: str) -> DataFrame:
    """Valid vector rows: the highest (_version, _seq) of each id, null vectors included."""
    return last_wins(read(spark, base, "vectors").filter(filled("id")), ["id"], ["_version", "_seq"])


def with_reference(nodes_df: DataFrame, reference: DataFrame) -> DataFrame:
    """Nodes of one version together with the reference nodes, which exist in every version; a node of the version wins over a reference node."""
    cols = ["id", "type", "name", "description", "properties"]
    extra = reference.select(*cols).join(nodes_df.select("id"), "id", "left_anti")
    return nodes_df.select(*cols).unionByName(extra)
