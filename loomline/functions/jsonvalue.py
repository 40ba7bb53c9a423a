"""JSON compared as values: order, spelling and null members do not matter."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers whose decimal exponent is larger keep their scientific spelling instead of being written out.
WRITTEN_OUT = 400


def _number(text: str) -> object:
    try:
        sign, digits, exponent = Decimal(text).as_tuple()
    except InvalidOperation:
        return ("\0number", text.lower())
    whole = "".join(map(str, digits)).lstrip("0")
    bare = whole.rstrip("0")
    exponent += len(whole) - len(bare)
    if not bare:
        return 0
    if exponent >= 0 and len(bare) + exponent <= WRITTEN_OUT:
        return (-1 if sign else 1) * int(bare) * 10**exponent
    return ("\0number", f"{'-' if sign else ''}{bare}e{exponent}")


def _bare(value: object) -> object:
    if isinstance(value, dict):
        return {k: _bare(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [_bare(v) for v in value]
    return value


def canonical(text: str | None) -> str:
    """One spelling per JSON value. None counts as JSON null; text that is no JSON stands for itself and equals no JSON value."""
    if text is None:
        return "null"
    try:
        value = json.loads(text, parse_float=_number, parse_constant=lambda s: ("\0number", s))
        return json.dumps(_bare(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return "\0text" + text


def fingerprint(text: str | None) -> int:
    h = xxhash.xxh3_64_intdigest(canonical(text).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h


def json_hash(col: Column) -> Column:
    """64-bit hash of the JSON value of a string column. Python, because nested null members and number spellings are out of reach of the built-in
    functions; Arrow batches, and each distinct text of a batch is parsed once."""

    @F.pandas_udf(T.LongType())
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            codes, texts = pd.factorize(s, use_na_sentinel=False)
            known = pd.array([fingerprint(None if t is None or t != t else t) for t in texts], dtype="int64")
            yield pd.Series(known.take(codes) if len(codes) else known)

    return hashes(col)
