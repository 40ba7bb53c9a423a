"""Token-hash embeddings: deterministic vectors from the digests of a text's tokens."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of a digest. Longer vectors repeat it, so cosines over these dimensions equal those over any multiple.
CORE = 32


#: Members of properties that are attributes of the node's type; the others are its base properties.
OWN = {
    "Dataset": {"database", "schema", "schema_name", "table_type", "owner"},
    "Column": {"dataset_id", "data_type", "is_nullable", "ordinal_position"},
    "Pipeline": {"resource_type", "owner"},
    "User": {"email"},
    "Team": {"email"},
    "BusinessTerm": {"definition", "domain"},
}


def _base(type_: str | None, text: str | None) -> dict[str, str]:
    try:
        value = json.loads(text or "")
    except (ValueError, RecursionError):
        return {}
    own = OWN.get(type_, set())
    return {k: str(v) for k, v in value.items() if v and k not in own} if isinstance(value, dict) else {}


def base_properties(type_: Column, properties: Column) -> Column:
    """The base properties of a node that are neither empty nor zero nor false, as a map of texts in their order. Python, because lists, numbers and inner
    objects are spelt as Python spells them; text that is no JSON object gives an empty map."""

    @F.pandas_udf("map<string,string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, p in batches:
            yield pd.Series([_base(a, b) for a, b in zip(t, p, strict=True)], dtype="object")

    return run(type_, properties)


def node_text(type_: Column, name: Column, description: Column, properties: Column | None = None) -> Column:
    """Type, name, description and properties as one text; empty parts are left out. properties: a map of texts, of base_properties."""
    parts = [F.concat(F.lit("Type: "), type_), F.concat(F.lit("Name: "), name), F.when(description != "", F.concat(F.lit("Description: "), description))]
    if properties is not None:
        kept = F.filter(F.map_entries(properties), lambda e: e["value"].isNotNull())
        parts.append(F.when(F.size(kept) > 0, F.concat(F.lit("Properties: "), F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "))))
    return F.concat_ws(" | ", *parts)


_PIECE = re.compile(r"[a-z0-9]+", re.IGNORECASE | re.ASCII)


def tokens(text: str) -> list[str]:
    """All alphanumeric pieces, with repetitions; then each piece between white space that is not among them yet; else the whole text."""
    pieces = list(map(str.lower, _PIECE.findall(text)))
    spaced = dict.fromkeys(text.lower().split())
    for known in pieces:
        spaced.pop(known, None)
    return [*pieces, *spaced] or [text.lower()]


def sums(text: str, known: dict[str, np.ndarray]) -> np.ndarray:
    total = np.zeros(CORE)
    for t in tokens(text):
        v = known.get(t)
        if v is None:
            if len(known) > 200_000:
                known.clear()
            known[t] = v = np.frombuffer(hashlib.sha256(t.encode("utf-8")).digest(), np.uint8) / 255.0 * 2 - 1
        total += v
    return total


def token_sums(text: Column) -> Column:
    """Sums of the token vectors, 32 values. Arrow batches; a digest is computed once per worker and token, where an expression would hash every
    occurrence byte by byte. Null gives null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, np.ndarray] = {}
        for s in batches:
            yield pd.Series([None if t is None else sums(t, known) for t in s], dtype="object")

    return run(text)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays. The length is bound once, not computed again for each element."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"), lambda s: F.transform(v, lambda x: F.when(s > 0, x.cast("double") / F.sqrt(s)).otherwise(x.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vectors_of(nodes: DataFrame) -> DataFrame:
    """id, name, type and vector (CORE values): token-hash embeddings of the nodes' texts."""
    text = node_text(F.col("type"), F.col("name"), F.col("description"), base_properties(F.col("type"), F.col("properties")))
    return nodes.select("id", "name", "type", token_sums(text).alias("_s")).select("id", "name", "type", unit(F.col("_s")).alias("vector"))


def spread(v: Column, dim: int) -> Column:
    """A core vector at another length: its values repeated and cut, over the new length."""
    times = -(-dim // CORE)
    return unit(F.slice(F.flatten(F.array_repeat(v, times)), 1, dim))


def embed(text: str, dim: int = CORE) -> list[float]:
    """The unit vector of a query text, on the driver."""
    v = np.resize(sums(text, {}), dim)
    n = float(np.linalg.norm(v))
    return (v / n if n else v).tolist()
