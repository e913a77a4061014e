"""Window specifications and functions, shared by the sets that have them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur import types as t
from larkspur.errors import InvalidArguments, QueryBuilderDefect
from larkspur.expr import Expr, lift
from larkspur.functions.registry import null

current_row = 0
unbounded_preceding = W.unboundedPreceding
unbounded_following = W.unboundedFollowing


def preceding(n: int) -> int:
    return -_bound(n)


def following(n: int) -> int:
    return _bound(n)


def _bound(n: Any) -> int:
    if isinstance(n, Expr):
        import ast

        try:
            n = ast.literal_eval(n.text) if not n.terms else eval(n.text, {"__builtins__": {}})  # noqa: S307  constant arithmetic only
        except Exception as error:
            raise QueryBuilderDefect("a frame's bound depends on no row") from error
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise InvalidArguments("a frame's bound is a whole number from 0")
    return n


@dataclass(frozen=True)
class Frame:
    kind: str
    lo: int
    hi: int


def rows_between(lo: int, hi: int) -> Frame:
    return Frame("rows", lo, hi)


def range_between(lo: int, hi: int) -> Frame:
    return Frame("range", lo, hi)


@dataclass(frozen=True)
class Spec:
    partition: tuple[Expr, ...]
    order: tuple[tuple[Expr, str], ...]
    frame: Frame | None

    def build(self, ctx: Any, framed: bool = True) -> Any:
        w = W.partitionBy(*[e.build(ctx) for e in self.partition])
        if self.order:
            w = w.orderBy(*[e.build(ctx).asc() if d == "asc" else e.build(ctx).desc() for e, d in self.order])
        if self.frame and framed:
            w = (w.rowsBetween if self.frame.kind == "rows" else w.rangeBetween)(self.frame.lo, self.frame.hi)
        return w


def window_spec(partition_by: Iterable[Any] = (), order_by: Iterable[Any] = (), frame: Frame | None = None) -> Spec:
    partition = tuple(map(lift, partition_by))
    order = tuple((o, "asc") if isinstance(o, Expr) else (o[0], o[1]) for o in order_by)
    if not partition and not order and frame is None:
        raise QueryBuilderDefect("an empty window specification")
    return Spec(partition, order, frame)


def _windowed(name: str, parts: tuple[Expr, ...], spec: Spec, make: Any, type: Any) -> Expr:
    everything = (*parts, *spec.partition, *(e for e, _ in spec.order))
    uses = frozenset().union(*(p.uses for p in everything)) if everything else frozenset()
    params = frozenset().union(*(p.params for p in everything)) if everything else frozenset()
    text = f"{name}({', '.join(p.text for p in parts)}) OVER ({spec.partition and [p.text for p in spec.partition]} {[(e.text, d) for e, d in spec.order]} {spec.frame})"
    return Expr(text, make, type, uses, agg=False, window=True, params=params)


def over(e: Expr, spec: Spec) -> Expr:
    """Any aggregate over a window; it is no grouping aggregate then."""
    return _windowed("over", (e,), spec, lambda ctx: e.build(ctx).over(spec.build(ctx)), null(e.type))


def row_number(spec: Spec) -> Expr:
    return _windowed("row_number", (), spec, lambda ctx: F.row_number().over(spec.build(ctx, False)).cast("long"), t.int64)


def rank(spec: Spec) -> Expr:
    return _windowed("rank", (), spec, lambda ctx: F.rank().over(spec.build(ctx, False)).cast("long"), t.int64)


def dense_rank(spec: Spec) -> Expr:
    return _windowed("dense_rank", (), spec, lambda ctx: F.dense_rank().over(spec.build(ctx, False)).cast("long"), t.int64)


def first_value(x: Any, spec: Spec) -> Expr:
    e = lift(x)
    return _windowed("first_value", (e,), spec, lambda ctx: F.first_value(e.build(ctx)).over(spec.build(ctx)), null(e.type))


def last_value(x: Any, spec: Spec) -> Expr:
    e = lift(x)
    return _windowed("last_value", (e,), spec, lambda ctx: F.last_value(e.build(ctx)).over(spec.build(ctx)), null(e.type))


def _shift(name: str, x: Any, spec: Spec, offset: int, fallback: Any) -> Expr:
    e = lift(x)
    if isinstance(offset, bool) or not isinstance(offset, int) or offset < 0:
        raise InvalidArguments(f"{name}'s offset is a whole number from 0")
    other = None if fallback is None else lift(fallback)

    def make(ctx: Any) -> Column:
        fn = F.lag if name == "lag" else F.lead
        shifted = fn(e.build(ctx), offset).over(spec.build(ctx, False))
        if other is None:
            return shifted
        # A fallback may read the row; whether the edge was passed is a shift of a constant.
        inside = fn(F.lit(1), offset).over(spec.build(ctx, False))
        return F.when(inside.isNull(), other.build(ctx)).otherwise(shifted)

    return _windowed(f"{name}[{offset}]", (e, *([other] if other else [])), spec, make, null(e.type) if other is None else e.type)


def lag(x: Any, spec: Spec, offset: int = 1, fallback: Any = None) -> Expr:
    return _shift("lag", x, spec, offset, fallback)


def lead(x: Any, spec: Spec, offset: int = 1, fallback: Any = None) -> Expr:
    return _shift("lead", x, spec, offset, fallback)


def lag_in_frame(x: Any, spec: Spec, offset: int = 1, default: Any = None) -> Expr:
    """The row ``offset`` back if the frame reaches it, else the default (the type's zero where none is given)."""
    e = lift(x)
    from larkspur.expr import default_of, lit

    if default is None and e.type is not None:
        default = default_of(e.type)
    other = lit(default)
    reach = spec.frame is None or (spec.frame.kind == "rows" and spec.frame.lo <= -offset <= spec.frame.hi) or (spec.frame.kind == "range" and spec.frame.lo == W.unboundedPreceding)
    if not reach:
        return _windowed("lag_in_frame", (e, other), spec, lambda ctx: other.build(ctx), e.type)
    return _shift("lag", e, spec, offset, other)
