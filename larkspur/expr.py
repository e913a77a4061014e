"""Expressions and conditions: symbolic until a plan is lowered.

An ``Expr`` knows its type, the columns it reads, whether it aggregates, and how to become a
Spark ``Column`` in a lowering context. Arithmetic chains keep their terms, so that
``a.sub(1).div(2)`` means ``a - 1 / 2``: a chain reads as it would be written without
parentheses, and an argument that is a chain of its own keeps its parentheses.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur import types as t
from larkspur.errors import InvalidArguments, InvalidLiteral, QueryBuilderDefect
from larkspur.types import ColType

#: (source alias, column)
Ref = tuple[str, str]


@dataclass(frozen=True, eq=False)
class Expr:
    text: str
    build: Callable[[Any], Column]
    type: ColType | None = None
    uses: frozenset[Ref] = frozenset()
    agg: bool = False
    window: bool = False
    params: frozenset[str] = frozenset()
    terms: tuple = field(default=())
    opaque: bool = False

    # Comparisons.
    def eq(self, other: Any) -> Condition:
        return compare(self, "=", other)

    def neq(self, other: Any) -> Condition:
        return compare(self, "<>", other)

    def gt(self, other: Any) -> Condition:
        return compare(self, ">", other)

    def gte(self, other: Any) -> Condition:
        return compare(self, ">=", other)

    def lt(self, other: Any) -> Condition:
        return compare(self, "<", other)

    def lte(self, other: Any) -> Condition:
        return compare(self, "<=", other)

    def is_null(self) -> Condition:
        return condition(f"{self.text} IS NULL", (self,), lambda c: c.isNull())

    def is_not_null(self) -> Condition:
        return condition(f"{self.text} IS NOT NULL", (self,), lambda c: c.isNotNull(), known=self.uses if self.is_ref() else frozenset())

    def between(self, lo: Any, hi: Any) -> Condition:
        a, b = self.operand(lo), self.operand(hi)
        return condition(f"{self.text} BETWEEN {a.text} AND {b.text}", (self, a, b), lambda c, x, y: c.between(x, y), known=self.uses if self.is_ref() else frozenset())

    def not_between(self, lo: Any, hi: Any) -> Condition:
        return not_(self.between(lo, hi))

    def like(self, pattern: str) -> Condition:
        return condition(f"{self.text} LIKE {pattern!r}", (self,), lambda c: c.like(pattern))

    def not_like(self, pattern: str) -> Condition:
        return not_(self.like(pattern))

    def ilike(self, pattern: str) -> Condition:
        return condition(f"{self.text} ILIKE {pattern!r}", (self,), lambda c: c.ilike(pattern))

    def not_ilike(self, pattern: str) -> Condition:
        return not_(self.ilike(pattern))

    def contains(self, value: str, insensitive: bool = False) -> Condition:
        return _literal_match(self, value, insensitive, "contains")

    def starts_with(self, value: str, insensitive: bool = False) -> Condition:
        return _literal_match(self, value, insensitive, "startswith")

    def ends_with(self, value: str, insensitive: bool = False) -> Condition:
        return _literal_match(self, value, insensitive, "endswith")

    def in_(self, values: Iterable[Any]) -> Condition:
        """Membership; of an empty list it is false, for null too."""
        items = [self.operand(v) for v in values]
        if not items:
            return condition("FALSE", (), lambda: F.lit(False))
        bound = self._binding(items[0]) if len(items) == 1 else frozenset()
        return condition(f"{self.text} IN ({', '.join(i.text for i in items)})", (self, *items), lambda c, *xs: c.isin(*xs), bound=bound, known=self.uses if self.is_ref() else frozenset())

    def not_in(self, values: Iterable[Any]) -> Condition:
        values = list(values)
        return not_(self.in_(values)) if values else condition("TRUE", (), lambda: F.lit(True))

    # Arithmetic.
    def add(self, other: Any) -> Expr:
        return _chain(self, "+", other)

    def sub(self, other: Any) -> Expr:
        return _chain(self, "-", other)

    def mul(self, other: Any) -> Expr:
        return _chain(self, "*", other)

    def div(self, other: Any) -> Expr:
        return _chain(self, "/", other)

    def mod(self, other: Any) -> Expr:
        return _chain(self, "%", other)

    # Maps and parts.
    def get(self, key: str) -> Expr:
        """A map's value, or the value type's zero where the key is missing."""
        element = self.type.element if self.type and self.type.element else t.string
        return call("get", (self, lit(key)), lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(default_of(element))), element)

    def field(self, name: str) -> Expr:
        return call(f"field[{name}]", (self,), lambda c: c.getField(name))

    def alias(self, name: str) -> Expr:
        return self

    def is_ref(self) -> bool:
        return len(self.uses) == 1 and not self.terms and self.text == ".".join(next(iter(self.uses)))

    def operand(self, value: Any) -> Expr:
        """What this expression is compared with, encoded by its type."""
        if isinstance(value, Expr):
            return value
        if value is None:
            raise QueryBuilderDefect("compare with null by is_null() or is_not_null()")
        if self.type is None:
            return lit(value)
        if isinstance(value, float) and self.type.spark.typeName() in ("byte", "short", "integer", "long"):
            return lit(value)  # a fraction compares numerically with whole numbers
        encoded = self.type.literal(value)
        return typed_value(self.type, value) if encoded is not None else lit(None)

    def _binding(self, other: Expr) -> frozenset:
        if self.is_ref() and not other.uses and not other.agg and not other.opaque:
            return frozenset({(next(iter(self.uses)), other.text)})
        return frozenset()


@dataclass(frozen=True, eq=False)
class Condition(Expr):
    """A truth value. bound: columns it fixes to a value; same: columns it equates; known: columns it keeps from null."""

    bound: frozenset = frozenset()
    same: frozenset = frozenset()
    known: frozenset = frozenset()

    def and_(self, *others: Condition | None) -> Condition:
        return and_(self, *others)

    def or_(self, *others: Condition | None) -> Condition:
        return or_(self, *others)


def _merged(parts: Iterable[Expr]) -> dict:
    parts = list(parts)
    return {
        "uses": frozenset().union(*(p.uses for p in parts)),
        "agg": any(p.agg for p in parts),
        "window": any(p.window for p in parts),
        "params": frozenset().union(*(p.params for p in parts)),
        "opaque": any(p.opaque for p in parts),
    }


def condition(text: str, parts: tuple[Expr, ...], build: Callable[..., Column], bound=frozenset(), same=frozenset(), known=frozenset()) -> Condition:
    return Condition(text, lambda ctx: build(*(p.build(ctx) for p in parts)), t.boolean, **_merged(parts), bound=bound, same=same, known=known)


def call(name: str, parts: tuple[Any, ...], build: Callable[..., Column], type: ColType | None = None, agg: bool = False) -> Expr:
    """A function of expressions and literals."""
    parts = tuple(lift(p) for p in parts)
    if agg and any(p.agg for p in parts):
        raise QueryBuilderDefect(f"{name} of an aggregate")
    merged = _merged(parts)
    return Expr(f"{name}({', '.join(p.text for p in parts)})", lambda ctx: build(*(p.build(ctx) for p in parts)), type, **(merged | {"agg": agg or merged["agg"]}))


def lift(value: Any) -> Expr:
    return value if isinstance(value, Expr) else lit(value)


def lit(value: Any) -> Expr:
    """A plain value: text, number, truth value, moment or null."""
    if isinstance(value, Expr):
        return value
    kinds = ((bool, t.boolean), (int, t.int64), (float, t.float64), (str, t.string), (Decimal, t.numeric), (dt.datetime, t.date_time64), (dt.date, t.date), (bytes, t.blob))
    if value is None:
        return Expr("NULL", lambda ctx: F.lit(None), t.untyped())
    for kind, of in kinds:
        if isinstance(value, kind):
            if isinstance(value, dt.datetime):
                value = of.literal(value)
            small = isinstance(value, int) and -(2**31) <= value < 2**31
            return Expr(repr(value), lambda ctx: F.lit(value), t.int32 if small and not isinstance(value, bool) else of)
    raise InvalidLiteral(f"{value!r} has no type of its own")


def typed_value(type: ColType, value: Any) -> Expr:
    encoded = type.literal(value)
    return Expr(repr(value), lambda ctx: F.lit(encoded).cast(type.spark) if not isinstance(encoded, (list, dict)) else F.lit(encoded), type)


def column(alias: str, name: str, type: ColType | None) -> Expr:
    return Expr(f"{alias}.{name}", lambda ctx: ctx.column(alias, name), type, frozenset({(alias, name)}))


def outer_ref(path: str, type: ColType | None = None) -> Expr:
    """A column of the query around a subquery, as 'alias.column'."""
    alias, name = path.split(".", 1)
    return Expr(f"outer {path}", lambda ctx: F.col(f"`{alias}`.`{name}`").outer(), type)


def outer(ref: Expr) -> Expr:
    return outer_ref(ref.text, ref.type)


def compare(a: Expr, op: str, value: Any) -> Condition:
    b = a.operand(value)
    ops = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y}
    bound = same = frozenset()
    if op == "=":
        bound = a._binding(b) | b._binding(a)
        if a.is_ref() and b.is_ref():
            same = frozenset({frozenset({*a.uses, *b.uses})})
    known = frozenset().union(*(x.uses for x in (a, b) if x.is_ref()))
    return condition(f"{a.text} {op} {b.text}", (a, b), ops[op], bound, same, known)


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def _literal_match(e: Expr, value: str, insensitive: bool, how: str) -> Condition:
    if not isinstance(value, str):
        raise InvalidLiteral(f"{value!r} is no text")
    def build(c: Column) -> Column:
        a, b = (F.lower(c), F.lower(F.lit(value))) if insensitive else (c, F.lit(value))
        return getattr(F, how)(a, b)
    return condition(f"{how}({e.text}, {value!r}{', insensitive' if insensitive else ''})", (e,), build)


def _conditions(parts: Iterable[Condition | None]) -> list[Condition]:
    return [p for p in parts if p is not None]


def and_(*parts: Condition | None) -> Condition | None:
    some = _conditions(parts)
    if len(some) < 2:
        return some[0] if some else None
    union = lambda name: frozenset().union(*(getattr(p, name) for p in some))
    return condition("(" + " AND ".join(p.text for p in some) + ")", tuple(some), lambda *cs: reduce(lambda a, b: a & b, cs), union("bound"), union("same"), union("known"))


def or_(*parts: Condition | None) -> Condition | None:
    some = _conditions(parts)
    if len(some) < 2:
        return some[0] if some else None
    known = frozenset.intersection(*(p.known for p in some))
    return condition("(" + " OR ".join(p.text for p in some) + ")", tuple(some), lambda *cs: reduce(lambda a, b: a | b, cs), known=known)


def not_(part: Condition) -> Condition:
    return condition(f"NOT ({part.text})", (part,), lambda c: ~c)


def when(value: Any, make: Callable[[Any], Condition]) -> Condition | None:
    """An optional predicate: nothing where the value is None."""
    return None if value is None else make(value)


def when_true(flag: bool, make: Callable[[], Condition]) -> Condition | None:
    return make() if flag else None


def in_list(e: Expr, values: Iterable[Any]) -> Condition:
    return e.in_(values)


def not_in_list(e: Expr, values: Iterable[Any]) -> Condition:
    return e.not_in(values)


def in_expr_list(e: Expr, exprs: Iterable[Expr]) -> Condition:
    return e.in_(exprs)


def as_boolean(part: Condition) -> Expr:
    return Expr(part.text, part.build, t.boolean, part.uses, part.agg, part.window, part.params, opaque=part.opaque)


def raw_expr(sql: str, type: ColType) -> Expr:
    return Expr(sql, lambda ctx: F.expr(sql).cast(type.spark), type, opaque=True)


def untyped_expr(sql: str) -> Expr:
    return Expr(sql, lambda ctx: F.expr(sql), None, opaque=True)


def raw_cond(sql: str) -> Condition:
    return Condition(sql, lambda ctx: F.expr(sql), t.boolean, opaque=True)


def dynamic_column(name: str, type: ColType | None = None) -> Expr:
    """A column by a name known only at run time."""
    alias, _, last = name.rpartition(".")
    return Expr(name, lambda ctx: F.col(f"`{alias}`.`{last}`" if alias else f"`{last}`"), type, opaque=True)


def undecoded(e: Expr) -> Expr:
    """The column as it is stored, past its type's decoding."""
    return Expr(e.text, e.build, t.untyped(spark=e.type.spark) if e.type else None, e.uses, e.agg, e.window, e.params)


def aliased(e: Expr, alias: str) -> Expr:
    return Expr(e.text, lambda ctx: e.build(ctx).alias(alias), e.type, e.uses, e.agg, e.window, e.params, opaque=e.opaque)


def make_expr(build: Callable[..., Column], parts: tuple[Any, ...] = (), type: ColType | None = None, params: Iterable[str] = ()) -> Expr:
    """A custom expression over any Column; params it reads have to be among its parts or declared."""
    e = call("custom", parts, build, type)
    undeclared = set(params) - e.params
    if undeclared:
        raise QueryBuilderDefect(f"undeclared params: {sorted(undeclared)}")
    return e


def make_cond(build: Callable[..., Column], parts: tuple[Any, ...] = ()) -> Condition:
    return condition("custom", tuple(lift(p) for p in parts), build)


class sql:
    """SQL text with named holes: sql('{a} + {b}', a=expr, b=1)."""

    def __new__(cls, text: str, type: ColType | None = None, **holes: Any) -> Expr:
        parts = {k: lift(v) for k, v in holes.items()}
        pieces = _split_holes(text, parts)

        def build(ctx: Any) -> Column:
            out = []
            for piece in pieces:
                out.append(piece if isinstance(piece, str) else ctx.text_of(piece))
            made = F.expr("".join(out))
            return made.cast(type.spark) if type else made

        return Expr(text, build, type, **(_merged(parts.values()) | {"opaque": True}))

    @staticmethod
    def cond(text: str, **holes: Any) -> Condition:
        e = sql(text, **holes)
        return Condition(e.text, e.build, t.boolean, e.uses, e.agg, e.window, e.params, opaque=True)

    @staticmethod
    def ident(*path: str) -> str:
        return ".".join("`" + p.replace("`", "``") + "`" for p in path)

    @staticmethod
    def join(parts: list[str], by: str = ", ") -> str:
        if not parts:
            raise InvalidArguments("nothing to join")
        return by.join(parts)

    @staticmethod
    def raw(text: str) -> str:
        return text


def _split_holes(text: str, parts: dict[str, Expr]) -> list:
    import re

    out, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", text):
        if m[1] not in parts:
            raise InvalidArguments(f"no value for {{{m[1]}}}")
        out += [text[at : m.start()], parts[m[1]]]
        at = m.end()
    return [*out, text[at:]]


def default_of(type: ColType) -> Any:
    kind = type.spark.typeName()
    if kind == "string":
        return ""
    if kind in ("double", "float"):
        return 0.0
    if kind == "boolean":
        return False
    return 0 if kind in ("byte", "short", "integer", "long", "decimal") else None


_RANK = {"*": 2, "/": 2, "%": 2, "+": 1, "-": 1}
_APPLY = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    "%": lambda a, b: F.try_mod(a, b),
}


def _chain(a: Expr, op: str, value: Any) -> Expr:
    b = value if isinstance(value, Expr) else lit(value)
    terms = (*(a.terms or ((None, a),)), (op, b))
    text = " ".join((f"{o} " if o else "") + (f"({e.text})" if o and e.terms else e.text) for o, e in terms)

    def build(ctx: Any) -> Column:
        values, ops = [terms[0][1].build(ctx)], []

        def fold() -> None:
            right, left = values.pop(), values.pop()
            values.append(_APPLY[ops.pop()](left, right))

        for o, e in terms[1:]:
            while ops and _RANK[ops[-1]] >= _RANK[o]:
                fold()
            ops.append(o)
            values.append(e.build(ctx))
        while ops:
            fold()
        return values[0]

    whole = all(e.type and e.type.spark.typeName() in ("byte", "short", "integer", "long") for _, e in terms) and not any(o == "/" for o, _ in terms)
    return Expr(text, build, t.nullable(t.int64 if whole else t.float64), **_merged(e for _, e in terms), terms=terms)


class param:
    """Typed placeholders, bound by name when a query runs."""

    @staticmethod
    def of(name: str, type: ColType) -> Expr:
        return Expr(f":{name}", lambda ctx: ctx.param(name, type), type, params=frozenset({name}))

    @staticmethod
    def string(name: str) -> Expr:
        return param.of(name, t.string)

    @staticmethod
    def int(name: str) -> Expr:
        return param.of(name, t.int64)

    @staticmethod
    def float(name: str) -> Expr:
        return param.of(name, t.float64)

    @staticmethod
    def bool(name: str) -> Expr:
        return param.of(name, t.boolean)

    @staticmethod
    def date_time(name: str) -> Expr:
        return param.of(name, t.date_time64)

    @staticmethod
    def date_time_string(name: str) -> Expr:
        return param.of(name, t.date_time_string)

    @staticmethod
    def date_time_seconds(name: str) -> Expr:
        return param.of(name, t.date_time)
