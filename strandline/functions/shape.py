"""Fingerprint of the shape of a JSON document."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels of a document; deeper ones have no fingerprint.
DEPTH = 256
# What JSON writers for the web escape in keys.
_ESCAPED = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}


class _Pairs(list):
    """Members of an object in order, repeated keys included."""


def _no_constant(text: str):
    raise ValueError(text)


def quoted(key: str) -> str:
    """A key as a JSON string."""
    out = json.dumps(key, ensure_ascii=False)
    for c, escape in _ESCAPED.items():
        out = out.replace(c, escape)
    return out


def paths(value) -> set[str] | None:
    """Typed paths of a parsed document; the elements of an array share one path, containers are listed too; None if it is too deep."""
    out, left = set(), [("$", value, 0)]
    while left:
        at, v, depth = left.pop()
        if depth > DEPTH:
            return None
        kind = "object" if isinstance(v, _Pairs) else {list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}[type(v)]
        out.add(f"{at}:{kind}")
        if kind == "object":
            left += [(f"{at}.{quoted(k)}", x, depth + 1) for k, x in v]
        elif kind == "array":
            left += [(f"{at}[]", x, depth + 1) for x in v]
    return out


def shape(text: str | None) -> str | None:
    try:
        found = paths(json.loads(text, object_pairs_hook=_Pairs, parse_constant=_no_constant)) if text is not None else None
    except (ValueError, RecursionError):
        return None
    return None if found is None else "v1:" + hashlib.sha256("\n".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()


@F.pandas_udf(T.StringType())
def shape_fingerprint(texts: pd.Series) -> pd.Series:
    """``v1:`` and the SHA-256 of the sorted distinct typed paths; null for null, invalid or too deep JSON."""
    return texts.map(shape, na_action=None)
