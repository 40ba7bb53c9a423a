"""Information-schema listings: tables, columns and foreign keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import join_parts, strip_dots

_PARTS = ("table_catalog", "table_schema", "table_name")


def _id(prefix: str = "table") -> F.Column:
    """The three parts with dots between them, null counting as absent, without dots at the ends."""
    return strip_dots(F.concat_ws(".", *[F.coalesce(F.trim(p), F.lit("")) for p in _PARTS]))


def listed_tables(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """id, name, database, schema, table_type ('BASE TABLE' if none is given) of each row."""
    return rows.select(*(keep or []), _id().alias("id"), F.col("table_name").alias("name"), F.col("table_catalog").alias("database"), F.col("table_schema").alias("schema"), F.coalesce("table_type", F.lit("BASE TABLE")).alias("table_type"))


def listed_columns(rows: DataFrame) -> DataFrame:
    """id, dataset_id, name, data_type, is_nullable, ordinal_position of each row."""
    ds = _id()
    name = F.coalesce("column_name", F.lit(""))
    return rows.select(F.concat(ds, F.lit("."), name).alias("id"), ds.alias("dataset_id"), F.col("column_name").alias("name"), "data_type", F.coalesce(F.col("is_nullable") == "YES", F.lit(False)).alias("is_nullable"), "ordinal_position")


def foreign_keys(rows: DataFrame) -> DataFrame:
    """JOINS_WITH edges from the key column that refers to the one referred to; rows with an empty side are left out."""
    side = lambda p: join_parts(*[F.col(f"{p}_{x}") for x in ("catalog", "schema", "table", "column")])
    e = rows.select(side("fk").alias("source_id"), side("pk").alias("target_id"), F.lit("JOINS_WITH").alias("type"), F.col("constraint_name"))
    return e.filter("source_id <> '' and target_id <> ''")
