"""JSON as rows: one level, the whole tree, or typed rows."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur import types as t
from larkspur.errors import InvalidArguments
from larkspur.expr import Expr, lift
from larkspur.table import TableDef, TableFunction
from larkspur.types import ColType

COLUMNS = {"key": t.nullable(t.text), "value": t.nullable(t.text), "type": t.text, "atom": t.nullable(t.text), "id": t.integer, "parent": t.nullable(t.integer), "fullkey": t.text, "path": t.text}
ROWS = T.ArrayType(T.StructType([T.StructField(n, k.spark) for n, k in COLUMNS.items()]))


def _kind(v: Any) -> str:
    return {dict: "object", list: "array", str: "text", bool: "true" if v is True else "false", int: "integer", float: "real", type(None): "null"}[type(v)]


def _text(v: Any) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def _children(v: Any) -> list[tuple[Any, Any]]:
    return list(v.items()) if isinstance(v, dict) else list(enumerate(v)) if isinstance(v, list) else []


def walk(doc: Any, deep: bool) -> list[tuple]:
    """Rows in document order; ids are the order of visit."""
    rows: list[tuple] = []

    def add(key: Any, v: Any, parent: int | None, path: str, fullkey: str) -> int:
        at = len(rows)
        nested = isinstance(v, (dict, list))
        rows.append((None if key is None else str(key), _text(v), _kind(v), None if nested else _text(v), at, parent, fullkey, path))
        return at

    def step(key: Any) -> str:
        return f"[{key}]" if isinstance(key, int) else f".{key}" if str(key).isidentifier() else f'."{key}"'

    if not deep:
        for key, v in _children(doc) or [(None, doc)] * (not isinstance(doc, (dict, list))):
            add(key, v, None, "$", "$" if key is None else "$" + step(key))
        return rows
    stack: list[tuple] = [(None, doc, None, "$", "$")]
    while stack:  # no recursion: depth is the document's, not the stack's
        key, v, parent, path, full = stack.pop()
        at = add(key, v, parent, path, full)
        stack += [(k, c, at, full, full + step(k)) for k, c in reversed(_children(v))]
    return rows


def _rows_udf(deep: bool) -> Any:
    @F.udf(ROWS, useArrow=True)
    def rows(text: str | None) -> Any:
        if text is None:
            return []
        try:
            return walk(json.loads(text), deep)
        except ValueError:
            return []

    return rows


def _function(name: str, x: Any, deep: bool) -> TableFunction:
    e: Expr = lift(x)
    udf = _rows_udf(deep)

    def rows(c: Column) -> Column:
        return udf(c)

    def frame(spark: SparkSession) -> Any:
        from larkspur.plans.lower import Context

        return spark.range(1).select(F.explode(rows(e.build(Context(spark)))).alias("r")).select("r.*")

    return TableFunction(name, COLUMNS, e, rows, frame=frame)


def json_each(x: Any) -> TableFunction:
    """A row per member of a JSON object or array; a scalar is one row."""
    return _function("json_each", x, False)


def json_tree(x: Any) -> TableFunction:
    """A row per value at any depth, the document first."""
    return _function("json_tree", x, True)


def json_rows(rows: list[dict] | str, columns: dict[str, ColType]) -> TableDef:
    """Typed rows from Python records or from JSON text."""
    data = json.loads(rows) if isinstance(rows, str) else rows
    if not isinstance(data, list):
        raise InvalidArguments("rows are a list of records")
    made = [tuple(k.literal(r.get(n)) for n, k in columns.items()) for r in data]
    schema = T.StructType([k.field(n) for n, k in columns.items()])
    return TableDef("json_rows", columns, external=True, source=lambda spark: spark.createDataFrame(made, schema))
