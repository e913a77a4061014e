"""The server set."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur import types as t
from larkspur.errors import InvalidArguments, QueryBuilderDefect
from larkspur.expr import Condition, Expr, as_boolean, call, condition, lift, typed_value
from larkspur.functions import json_text, olap, window
from larkspur.functions.registry import agg, chosen, first_typed, null, register, type_of
from larkspur.types import ColType

SET = "pg"
UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")


def _named(*names: str):
    return register(SET, *names)


@_named()
def count() -> Expr:
    return olap.count()


@_named("countIf")
def count_if(cond: Condition) -> Expr:
    return olap.count_if(cond)


@_named("countDistinct")
def count_distinct(x: Any) -> Expr:
    return agg("countDistinct", x, lambda c: F.count_distinct(c), t.int8)


@_named()
def sum(x: Any) -> Expr:
    """Null over nothing."""
    return agg("sum", x, F.sum, null(type_of(x)))


@_named("sumIf")
def sum_if(x: Any, cond: Condition) -> Expr:
    return agg("sumIf", x, lambda c, k: F.sum(chosen(c, k)), null(type_of(x)), cond)


@_named()
def avg(x: Any) -> Expr:
    return agg("avg", x, F.avg, t.nullable(t.float8))


@_named("min")
def min_(x: Any) -> Expr:
    return agg("min", x, F.min, null(type_of(x)))


@_named("max")
def max_(x: Any) -> Expr:
    return agg("max", x, F.max, null(type_of(x)))


@_named("percentileCont")
def percentile_cont(fraction: float, x: Any) -> Expr:
    if not 0 <= fraction <= 1:
        raise InvalidArguments("a fraction is between 0 and 1")
    return agg(f"percentileCont[{fraction}]", x, lambda c: F.percentile(c, F.lit(fraction)), t.nullable(t.float8))


@_named("arrayAgg")
def array_agg(x: Any) -> Expr:
    """Null over no rows; nulls are kept."""
    kind = type_of(x)
    return agg("arrayAgg", x, lambda c: F.when(F.count(F.lit(1)) > 0, F.transform(F.collect_list(F.struct(c.alias("x"))), lambda s: s["x"])), t.nullable(t.array(null(kind) or t.untyped())))


@_named("dateTrunc")
def date_trunc(unit: str, x: Any) -> Expr:
    if unit not in UNITS:
        raise InvalidArguments(f"units are {UNITS}")
    return call(f"dateTrunc[{unit}]", (x,), lambda c: F.date_trunc(unit, c).cast("timestamp_ntz"), type_of(x) or t.date_time64)


@_named("dateBin")
def date_bin(seconds: int, x: Any) -> Expr:
    return olap.to_start_of_interval(x, seconds)


@_named()
def now() -> Expr:
    return call("now", (), lambda: F.current_timestamp(), t.timestamptz)


@_named()
def lower(x: Any) -> Expr:
    return olap.lower(x)


@_named()
def upper(x: Any) -> Expr:
    return olap.upper(x)


@_named()
def length(x: Any) -> Expr:
    """Characters."""
    return call("length", (x,), lambda c: F.char_length(c).cast("long"), t.int8)


@_named()
def coalesce(*xs: Any) -> Expr:
    return olap.coalesce(*xs)


@_named("jsonText")
def json_text_(x: Any, key: str) -> Expr:
    return call(f"jsonText[{key}]", (x,), lambda c: F.get_json_object(c, json_text.dollar([key])), t.nullable(t.text))


def _path_type(kind: ColType | None, path: tuple) -> T.DataType | None:
    meta = dict(kind.metadata) if kind else {}
    if "json" not in meta:
        return None
    at: Any = T._parse_datatype_json_string(meta["json"])
    for p in path:
        if isinstance(p, int) and isinstance(at, T.ArrayType):
            at = at.elementType
        elif isinstance(p, str) and isinstance(at, T.StructType) and p in at.names:
            at = at[p].dataType
        elif isinstance(p, str) and isinstance(at, T.MapType):
            at = at.valueType
        else:
            raise QueryBuilderDefect(f"the JSON has no path {list(path)}")
    return at


@_named("jsonPath")
def json_path(x: Any, *path: Any) -> Expr:
    """A typed part of a JSON column that declares its schema; an unknown path is refused."""
    kind = _path_type(type_of(x), path)
    if kind is None:
        return call(f"jsonPath{list(path)}", (x,), lambda c: F.get_json_object(c, json_text.dollar(list(path))), None)
    nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))

    def build(c: Column) -> Column:
        part = F.get_json_object(c, json_text.dollar(list(path)))
        return F.from_json(part, kind) if nested else part.try_cast(kind)

    return call(f"jsonPath{list(path)}", (x,), build, t.of_spark(kind))


@_named("jsonPathText")
def json_path_text(x: Any, *path: Any) -> Expr:
    _path_type(type_of(x), path)
    return call(f"jsonPathText{list(path)}", (x,), lambda c: F.get_json_object(c, json_text.dollar(list(path))), t.nullable(t.text))


@_named("jsonContains")
def json_contains(x: Any, value: Any) -> Condition:
    json.dumps(value)
    return condition(f"jsonContains({lift(x).text}, {value!r})", (lift(x),), lambda c: json_text.contains(c, value))


@_named("jsonSet")
def json_set(x: Any, path: list, value: Any) -> Expr:
    return call(f"jsonSet{path}", (x, value), lambda c, v: json_text.put(c, path, json_text.as_json(v)), type_of(x))


@_named()
def least(*xs: Any) -> Expr:
    return olap.least(*xs)


@_named()
def greatest(*xs: Any) -> Expr:
    return olap.greatest(*xs)


@_named("caseWhen")
def case_when(branches: list[tuple[Condition, Any]], otherwise: Any = None) -> Expr:
    flat = [lift(x) for pair in branches for x in pair]

    def build(*cs: Column) -> Column:
        out = cs[-1] if otherwise is not None else F.lit(None)
        for k in range((len(branches) - 1) * 2, -1, -2):
            out = F.when(cs[k], cs[k + 1]).otherwise(out)
        return out

    kind = first_typed(*flat[1::2], *([otherwise] if otherwise is not None else []))
    return call("caseWhen", (*flat, *([otherwise] if otherwise is not None else [])), build, kind if otherwise is not None else null(kind))


register(SET, "asBoolean")(as_boolean)
register(SET, "typedValue")(typed_value)
for _n, _f in (("over", window.over), ("windowSpec", window.window_spec), ("lead", window.lead), ("lag", window.lag), ("rowNumber", window.row_number), ("rank", window.rank), ("denseRank", window.dense_rank), ("firstValue", window.first_value), ("lastValue", window.last_value), ("rowsBetween", window.rows_between), ("rangeBetween", window.range_between)):
    register(SET, _n)(_f)
