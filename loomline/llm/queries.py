"""The queries of this subpackage, by name, and the SQL to check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import bpe, knn, linkage, packing, sentences


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": knn.p1_found,
        "p1_neighbours": knn.p1_neighbours,
        "p2_found": linkage.p2_found,
        "p2_links": linkage.p2_links,
        "p8_ids": bpe.p8_ids,
        "p9_bins": packing.p9_bins,
        "p9_fill": packing.p9_fill,
        "p10_found": sentences.p10_found,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """WITH vv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY _version DESC, _seq DESC) AS rn FROM vectors WHERE id <> '') WHERE rn = 1 AND vector IS NOT NULL AND len(list_filter(vector, lambda x: x <> 0)) > 0),
nb AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]) AS c FROM vv a JOIN vv b ON a.id <> b.id),
tk AS (SELECT a, b, c FROM nb QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 10)
SELECT x.a AS id_a, x.b AS id_b FROM tk x JOIN tk y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b AND x.c >= 0.9""",
    }
