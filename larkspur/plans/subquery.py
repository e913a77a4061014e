"""Queries inside expressions: scalar values, membership and existence."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column

from larkspur import types as t
from larkspur.errors import QueryBuilderDefect
from larkspur.expr import Condition, Expr
from larkspur.plans.lower import Context, _sources, lower
from larkspur.plans.query import Query, Union
from larkspur.types import ColType


def _one_column(q: Query | Union) -> tuple[str, Expr]:
    outputs = q.outputs()
    if len(outputs) != 1:
        raise QueryBuilderDefect("a subquery value has one column")
    return next(iter(outputs.items()))


def scalar(q: Query) -> Expr:
    """The one value of a query, null where it has no row. May refer outward by ``outer``."""
    name, e = _one_column(q)
    kind = t.nullable(e.type) if e.type else None
    if e.agg and not q.groups and not q.havings:
        # Spark resolves outer references below a select of aggregates, not below a grouping.
        def build(ctx: Context) -> Column:
            inner = Context(ctx.spark, ctx.params, ctx.ctes, ctx.semantics, ctx.resolve)
            df = _sources(q, inner)
            filters = [c.build(inner) for c in q.filters()]
            if filters:
                df = df.where(reduce(lambda a, b: a & b, filters))
            return df.select(e.build(inner).alias(name)).scalar()

        return Expr(f"scalar({name})", build, kind)
    return Expr(f"scalar({name})", lambda ctx: lower(q, ctx).scalar(), kind)


def exists(q: Query) -> Condition:
    return Condition("EXISTS (...)", lambda ctx: lower(q, ctx).exists(), t.boolean)


def in_subquery(e: Expr, q: Query) -> Condition:
    _one_column(q)
    return Condition(f"{e.text} IN (...)", lambda ctx: e.build(ctx).isin(lower(q, ctx)), t.boolean, e.uses)


def not_in_subquery(e: Expr, q: Query) -> Condition:
    """False for every row once the subquery holds a null."""
    _one_column(q)
    return Condition(f"{e.text} NOT IN (...)", lambda ctx: ~e.build(ctx).isin(lower(q, ctx)), t.boolean, e.uses)


def subquery_expr(q: Query, type: ColType | None, wrap: Callable[[Column], Column] = lambda c: c) -> Expr:
    inner = scalar(q)
    return Expr(inner.text, lambda ctx: wrap(inner.build(ctx)), type)


def untyped_subquery_expr(q: Query, wrap: Callable[[Column], Column] = lambda c: c) -> Expr:
    return subquery_expr(q, None, wrap)


def subquery_cond(q: Query, wrap: Callable[[Any], Column]) -> Condition:
    """``wrap`` gets the inner DataFrame and gives a condition on it."""
    return Condition("subquery", lambda ctx: wrap(lower(q, ctx)), t.boolean, opaque=True)
