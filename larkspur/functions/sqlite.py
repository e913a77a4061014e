"""The file-database set."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur import types as t
from larkspur.errors import InvalidArguments
from larkspur.expr import Expr, call, lift
from larkspur.functions import json_text, olap, pg, window
from larkspur.functions.registry import agg, first_typed, null, register, type_of
from larkspur.types import ColType

SET = "sqlite"


def _named(*names: str):
    return register(SET, *names)


for _n, _f in (("count", pg.count), ("countIf", pg.count_if), ("countDistinct", pg.count_distinct), ("sum", pg.sum), ("avg", pg.avg), ("min", pg.min_), ("max", pg.max_), ("lower", pg.lower), ("upper", pg.upper), ("length", pg.length), ("coalesce", pg.coalesce), ("ifnull", olap.if_null), ("nullif", olap.null_if), ("iif", olap.if_), ("caseWhen", pg.case_when), ("asBoolean", pg.as_boolean), ("typedValue", pg.typed_value)):
    register(SET, _n)(_f)
count, count_if, count_distinct, sum, avg, min_, max_, lower, upper, length, coalesce, ifnull, nullif, iif, case_when = pg.count, pg.count_if, pg.count_distinct, pg.sum, pg.avg, pg.min_, pg.max_, pg.lower, pg.upper, pg.length, pg.coalesce, olap.if_null, olap.null_if, olap.if_, pg.case_when


@_named("jsonGroupArray")
def json_group_array(x: Any, type: ColType | None = None) -> Expr:
    kind = type or type_of(x)
    if type is not None:
        return agg("jsonGroupArray", x, lambda c: F.transform(F.collect_list(F.struct(c.alias("x"))), lambda s: s["x"]), t.array(null(kind)))
    return agg("jsonGroupArray", x, lambda c: F.to_json(F.transform(F.collect_list(F.struct(c.alias("x"))), lambda s: s["x"]), {"ignoreNullFields": "false"}), t.string)


@_named("jsonGroupObject")
def json_group_object(key: Any, value: Any, type: ColType | None = None) -> Expr:
    """Of a key that comes twice the last in value order counts."""

    def build(k: Column, v: Column) -> Column:
        entries = F.array_sort(F.collect_list(F.struct(k.alias("key"), v.alias("value"))))
        last = F.filter(entries, lambda e, i: (i == F.size(entries) - 1) | (e["key"] != F.try_element_at(entries, i + 2)["key"]))
        return F.map_from_entries(last)

    if type is not None:
        return agg("jsonGroupObject", key, build, t.map_(t.string, null(type)), value)
    return agg("jsonGroupObject", key, lambda k, v: F.to_json(build(k, v)), t.string, value)


@_named()
def concat(*xs: Any) -> Expr:
    """Null if any part is."""
    return call("concat", xs, lambda *cs: F.concat(*[c.cast("string") for c in cs]), t.nullable(t.text))


def _none_null(cs: tuple[Column, ...], made: Column) -> Column:
    some = cs[0].isNull()
    for c in cs[1:]:
        some = some | c.isNull()
    return F.when(some, None).otherwise(made)


@_named()
def least(*xs: Any) -> Expr:
    """Null if any is."""
    return call("least", xs, lambda *cs: _none_null(cs, F.least(*cs)), null(first_typed(*xs)))


@_named()
def greatest(*xs: Any) -> Expr:
    return call("greatest", xs, lambda *cs: _none_null(cs, F.greatest(*cs)), null(first_typed(*xs)))


@_named()
def cast(x: Any, type: ColType) -> Expr:
    return call(f"cast[{type.name}]", (x,), lambda c: c.try_cast(type.spark), null(type))


@_named()
def substr(x: Any, start: Any, n: Any = None) -> Expr:
    parts = (x, start) if n is None else (x, start, n)
    return call("substr", parts, lambda c, a, k=None: F.substr(c, a, k) if k is not None else F.substr(c, a), t.text)


def _trim(name: str, fn: Any):
    def make(x: Any, chars: str | None = None) -> Expr:
        return call(f"{name}[{chars}]", (x,), (lambda c: fn(c)) if chars is None else (lambda c: fn(c, F.lit(chars))), t.text)

    register(SET, name)(make)
    return make


trim, ltrim, rtrim = _trim("trim", F.trim), _trim("ltrim", F.ltrim), _trim("rtrim", F.rtrim)


@_named()
def replace(x: Any, what: Any, by: Any) -> Expr:
    return call("replace", (x, what, by), lambda c, a, b: F.replace(c, a, b), t.text)


@_named()
def instr(x: Any, needle: Any) -> Expr:
    return call("instr", (x, needle), lambda c, n: F.call_function("instr", c, n).cast("long"), t.integer)


@_named()
def abs(x: Any) -> Expr:
    return call("abs", (x,), F.abs, type_of(x))


@_named("round")
def round_(x: Any, digits: int = 0) -> Expr:
    """Halves go away from zero."""
    return call(f"round[{digits}]", (x,), lambda c: F.round(c, digits), t.real)


@_named("jsonExtract")
def json_extract(x: Any, path: str, type: ColType) -> Expr:
    return call(f"jsonExtract[{path}]", (x,), lambda c: F.get_json_object(c, path).try_cast(type.spark), null(type))


@_named("json")
def json_(x: Any) -> Expr:
    """Minified; null where it is no JSON."""
    return call("json", (x,), json_text.minified, t.nullable(t.text))


@_named("jsonSet")
def json_set(x: Any, path: str, value: Any) -> Expr:
    parts: list = [int(m[2]) if m[2] else (m[1] or m[3]) for m in re.finditer(r"\.(\w+)|\[(-?\d+)\]|\.\"([^\"]+)\"", path)]
    if not path.startswith("$"):
        raise InvalidArguments("a path begins with $")
    return call(f"jsonSet[{path}]", (x, value), lambda c, v: json_text.put(c, parts, json_text.as_json(v)), type_of(x))


# Dates: text, numbers of seconds or moments in; modifiers as text.
_MODIFIER = re.compile(r"([+-]?\d+(?:\.\d+)?) (second|minute|hour|day|month|year)s?$|start of (day|month|year)$|(unixepoch|utc|localtime)$")


def _moment(x: Any, modifiers: tuple[str, ...]) -> tuple[Expr, Any]:
    e = lift(x)
    found = [_MODIFIER.match(m) for m in modifiers]
    if not all(found):
        raise InvalidArguments(f"no such modifier: {modifiers}")
    number = e.type is not None and e.type.spark.typeName() in ("long", "integer", "double", "short")

    def build(c: Column) -> Column:
        at = F.timestamp_seconds(c) if number else F.current_timestamp() if e.text == "'now'" else c.try_cast("timestamp")
        for m in found:
            if m[3]:
                at = F.date_trunc(m[3], at)
            elif m[1] and m[2] in ("month", "year"):
                n = int(float(m[1])) * (12 if m[2] == "year" else 1)
                at = at + F.make_ym_interval(F.lit(0), F.lit(n))
            elif m[1]:
                scale = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[m[2]]
                at = F.timestamp_micros(F.unix_micros(at) + F.lit(int(float(m[1]) * scale * 1_000_000)))
        return at

    return e, build


@_named()
def julianday(x: Any, *modifiers: str) -> Expr:
    e, build = _moment(x, modifiers)
    return call(f"julianday{modifiers}", (e,), lambda c: F.unix_millis(build(c)) / F.lit(86_400_000.0) + F.lit(2440587.5), t.nullable(t.real))


@_named()
def date(x: Any, *modifiers: str) -> Expr:
    e, build = _moment(x, modifiers)
    return call(f"date{modifiers}", (e,), lambda c: F.date_format(build(c), "yyyy-MM-dd"), t.nullable(t.text))


@_named()
def datetime(x: Any, *modifiers: str) -> Expr:
    e, build = _moment(x, modifiers)
    return call(f"datetime{modifiers}", (e,), lambda c: F.date_format(build(c), "yyyy-MM-dd HH:mm:ss"), t.nullable(t.text))


@_named()
def strftime(fmt: str, x: Any, *modifiers: str) -> Expr:
    e, build = _moment(x, modifiers)
    if fmt == "%s":
        return call("strftime[%s]", (e,), lambda c: F.unix_seconds(build(c)).cast("string"), t.nullable(t.text))
    pattern = olap.date_pattern(fmt)
    return call(f"strftime[{fmt}]{modifiers}", (e,), lambda c: F.date_format(build(c), pattern), t.nullable(t.text))


@_named()
def unixepoch(x: Any, *modifiers: str) -> Expr:
    e, build = _moment(x, modifiers)
    return call(f"unixepoch{modifiers}", (e,), lambda c: F.unix_seconds(build(c)), t.nullable(t.integer))


for _n, _f in (("over", window.over), ("windowSpec", window.window_spec), ("lead", window.lead), ("lag", window.lag), ("rowNumber", window.row_number), ("rank", window.rank), ("denseRank", window.dense_rank), ("firstValue", window.first_value), ("lastValue", window.last_value)):
    register(SET, _n)(_f)
