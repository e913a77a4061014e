"""What JSON text needs beyond Spark's built-ins: deep containment and setting a path. Arrow-batched."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def holds(outer: Any, inner: Any) -> bool:
    """Deep containment: objects by key, arrays as sets, a scalar in an array at the top only."""
    if isinstance(inner, dict):
        return isinstance(outer, dict) and all(k in outer and holds(outer[k], v) for k, v in inner.items())
    if isinstance(inner, list):
        return isinstance(outer, list) and all(any(holds(o, v) for o in outer) for v in inner)
    return type(outer) is type(inner) and outer == inner or (isinstance(outer, (int, float)) and isinstance(inner, (int, float)) and not isinstance(outer, bool) and not isinstance(inner, bool) and outer == inner)


def contains(c: Column, value: Any) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        def one(text: Any) -> Any:
            if text is None:
                return None
            try:
                outer = json.loads(text)
            except ValueError:
                return None
            return holds(outer, value) or (isinstance(outer, list) and not isinstance(value, (dict, list)) and any(holds(o, value) for o in outer))

        return s.map(one).astype("object")

    return run(c)


def place(doc: Any, path: list, value: Any) -> Any:
    """The document with the value at the path; the last key is made, a missing parent leaves it as it was."""
    if not path:
        return value
    key, rest = path[0], path[1:]
    if isinstance(doc, dict) and isinstance(key, str) and (key in doc or not rest):
        return doc | {key: place(doc.get(key), rest, value)}
    if isinstance(doc, list) and isinstance(key, int):
        k = key + len(doc) if key < 0 else key
        if 0 <= k < len(doc):
            return [*doc[:k], place(doc[k], rest, value), *doc[k + 1 :]]
        if not rest and k >= len(doc):
            return [*doc, value]
    return doc


def put(c: Column, path: list, value: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series, v: pd.Series) -> pd.Series:
        def one(text: Any, new: Any) -> Any:
            if text is None:
                return None
            try:
                return json.dumps(place(json.loads(text), path, None if new is None else json.loads(new)), separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return pd.Series([one(a, b) for a, b in zip(s, v, strict=True)], dtype="object")

    return run(c, value)


def minified(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(text: Any) -> Any:
            try:
                return None if text is None else json.dumps(json.loads(text), separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return s.map(one).astype("object")

    return run(c)


def dollar(path: list) -> str:
    """['a', 0] as '$.a[0]'."""
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)


def as_json(c: Column) -> Column:
    """A scalar column as JSON text."""
    return F.when(c.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[|\]$", ""))
