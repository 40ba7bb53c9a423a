"""Query logs: who reads which table, and which columns are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import join_predicates, table_refs


def user_access(rows: DataFrame) -> DataFrame:
    """CONSUMED_BY edges from each table that a query names to 'user:<name>', once per query; a null user gives none."""
    r = rows.filter("user_name is not null").select("query_id", "user_name", "start_time", F.explode(table_refs(F.coalesce("query_text", F.lit("")))).alias("source_id"))
    return r.select("source_id", F.concat(F.lit("user:"), "user_name").alias("target_id"), F.lit("CONSUMED_BY").alias("type"), "query_id", F.col("start_time").alias("execution_time"))


def joins(rows: DataFrame) -> DataFrame:
    """JOINS_WITH edges between the columns that a query compares, as often as it does."""
    r = rows.select("query_id", F.explode(join_predicates(F.coalesce("query_text", F.lit("")))).alias("j"))
    return r.select(F.col("j.left").alias("source_id"), F.col("j.right").alias("target_id"), F.lit("JOINS_WITH").alias("type"), "query_id")
