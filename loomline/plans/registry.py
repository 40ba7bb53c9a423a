"""The queries of the core, by name, and the SQL that a second engine can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.operators import drift, hierarchy, orphans, shred, snapshot_changes
from loomline.plans import lineage, oracles

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return lineage.QUERIES | {
        "p3_found": snapshot_changes.p3_found,
        "p4_found": drift.p4_found,
        "p4_table": drift.p4_table,
        "p5_found": hierarchy.p5_found,
        "p5_paths": hierarchy.p5_paths,
        "p5_descendants": hierarchy.p5_descendants,
        "p6_found": orphans.p6_found,
        "p6_report": orphans.p6_report,
        "p7_found": shred.p7_found,
        "p7_levels": shred.p7_levels,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
