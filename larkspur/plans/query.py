"""Queries as immutable records. Every method returns a new one; nothing touches Spark before ``lower``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from larkspur.errors import InvalidArguments, QueryBuilderDefect
from larkspur.expr import Condition, Expr, column
from larkspur.table import TableDef, TableFunction
from larkspur.types import ColType


class Accessor:
    """What callbacks get: ``t.column`` of the first source, ``t.alias.column`` of joined ones."""

    def __init__(self, main: dict[str, Expr], others: dict[str, dict[str, Expr]] | None = None):
        self._main, self._others = main, others or {}

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Any:
        if name in self._main:
            return self._main[name]
        if name in self._others:
            return Accessor(self._others[name])
        raise QueryBuilderDefect(f"no column or source {name}")


@dataclass(frozen=True)
class Source:
    of: Any  # TableDef, TableFunction, Query or Union
    alias: str
    kind: str = "from"  # from, inner, left, cross
    on: Callable | None = None

    def columns(self) -> dict[str, ColType | None]:
        if isinstance(self.of, (TableDef, TableFunction)):
            return dict(self.of.columns)
        return {n: e.type for n, e in self.of.outputs().items()}

    def refs(self) -> dict[str, Expr]:
        return {n: column(self.alias, n, k) for n, k in self.columns().items()}


@dataclass(frozen=True)
class Query:
    source: Source | None
    joins: tuple[Source, ...] = ()
    selection: Any = None
    wheres: tuple[Callable, ...] = ()
    groups: tuple[str, ...] = ()
    havings: tuple[Callable, ...] = ()
    orders: tuple = ()
    order_fn: Callable | None = None
    limit_n: int | None = None
    offset_n: int | None = None
    is_distinct: bool = False
    distinct_keys: tuple[str, ...] = ()
    ctes: tuple[tuple[str, Any, str | None], ...] = ()
    lock: str | None = None
    format_name: str | None = None
    route_name: str | None = None
    is_cross_tenant: bool = False
    #: how many wheres came before select; only those narrow what is selected
    wheres_before_select: int = 0

    # Building.
    def select(self, *what: Any) -> Query:
        chosen: Any = what[0] if len(what) == 1 and not isinstance(what[0], str) else tuple(what)
        return replace(self, selection=chosen, wheres_before_select=len(self.wheres))

    def where(self, make: Callable[[Any], Any]) -> Query:
        return replace(self, wheres=(*self.wheres, make))

    def group_by(self, *aliases: str) -> Query:
        return replace(self, groups=(*self.groups, *aliases))

    def having(self, make: Callable[[Any], Any]) -> Query:
        return replace(self, havings=(*self.havings, make))

    def order_by(self, *orders: Any) -> Query:
        """Pairs of an alias and 'asc' or 'desc', or a callback that gives pairs of expressions."""
        if len(orders) == 1 and callable(orders[0]):
            return replace(self, order_fn=orders[0], orders=())
        pairs = tuple((o, "asc") if isinstance(o, str) else tuple(o) for o in orders)
        return replace(self, orders=pairs, order_fn=None)

    def limit(self, n: int) -> Query:
        return replace(self, limit_n=_whole(n, "limit"))

    def offset(self, n: int) -> Query:
        return replace(self, offset_n=_whole(n, "offset"))

    def distinct(self) -> Query:
        return replace(self, is_distinct=True)

    def distinct_on(self, *aliases: str) -> Query:
        return replace(self, distinct_keys=aliases)

    def inner_join(self, of: Any, alias: str, on: Callable) -> Query:
        return self._join(of, alias, "inner", on)

    def left_join(self, of: Any, alias: str, on: Callable) -> Query:
        return self._join(of, alias, "left", on)

    def cross_join(self, of: Any, alias: str) -> Query:
        return self._join(of, alias, "cross", None)

    inner_join_query, left_join_query, cross_join_query = inner_join, left_join, cross_join

    def _join(self, of: Any, alias: str, kind: str, on: Callable | None) -> Query:
        return replace(self, joins=(*self.joins, Source(of, alias, kind, on)))

    def with_cte(self, name: str, of: Any, tenant_scope: str | None = None) -> Query:
        return replace(self, ctes=(*self.ctes, (name, of, tenant_scope)))

    def format(self, name: str) -> Query:
        if name not in ("JSON", "JSONEachRow"):
            raise InvalidArguments(f"format {name}")
        return replace(self, format_name=name)

    def route(self, name: str) -> Query:
        return replace(self, route_name=name)

    def cross_tenant(self) -> Query:
        return replace(self, is_cross_tenant=True)

    def for_update(self, **options: Any) -> Query:
        return replace(self, lock="update")

    def for_share(self, **options: Any) -> Query:
        return replace(self, lock="share")

    for_no_key_update, for_key_share = for_update, for_share

    def pipe(self, *steps: Callable[[Query], Query]) -> Query:
        """Data-last form: query.pipe(where(f), limit(3))."""
        out = self
        for step in steps:
            out = step(out)
        return out

    # Reading the plan.
    def sources(self) -> list[Source]:
        return ([self.source] if self.source else []) + list(self.joins)

    def accessor(self, upto: int | None = None) -> Accessor:
        joins = self.joins if upto is None else self.joins[:upto]
        return Accessor(self.source.refs() if self.source else {}, {s.alias: s.refs() for s in ([self.source] if self.source else []) + list(joins)})

    def outputs(self) -> dict[str, Expr]:
        t = self.accessor()
        chosen = self.selection
        if chosen is None or chosen == ():
            if self.source is None:
                raise QueryBuilderDefect("nothing is selected")
            return {n: e for n, e in self.source.refs().items()}
        if isinstance(chosen, tuple):
            return {n: t[n] for n in chosen}
        record = chosen(t) if callable(chosen) else chosen
        bad = [k for k, v in record.items() if not isinstance(v, Expr)]
        if bad:
            raise QueryBuilderDefect(f"{bad[0]} is no expression")
        return dict(record)

    def filters(self) -> list[Condition]:
        t = self.accessor()
        return _flat(make(t) for make in self.wheres)

    def having_conditions(self) -> list[Condition]:
        t = Accessor(self.outputs(), self.accessor()._others) if self.source is None else self.accessor()
        return _flat(make(t) for make in self.havings)

    def order_pairs(self) -> list[tuple[Expr | str, str]]:
        if self.order_fn:
            found = self.order_fn(self.accessor())
            return [(e, "asc") if isinstance(e, Expr) else tuple(e) for e in found]
        return list(self.orders)


@dataclass(frozen=True)
class Union:
    branches: tuple[Query, ...]
    orders: tuple = ()
    limit_n: int | None = None
    offset_n: int | None = None
    format_name: str | None = None
    is_cross_tenant: bool = False
    ctes: tuple = field(default=())
    route_name: str | None = None

    def order_by(self, *orders: Any) -> Union:
        return replace(self, orders=tuple((o, "asc") if isinstance(o, str) else tuple(o) for o in orders))

    def limit(self, n: int) -> Union:
        return replace(self, limit_n=_whole(n, "limit"))

    def offset(self, n: int) -> Union:
        return replace(self, offset_n=_whole(n, "offset"))

    def format(self, name: str) -> Union:
        if name not in ("JSON", "JSONEachRow"):
            raise InvalidArguments(f"format {name}")
        return replace(self, format_name=name)

    def cross_tenant(self) -> Union:
        return replace(self, is_cross_tenant=True)

    def outputs(self) -> dict[str, Expr]:
        return self.branches[0].outputs()


def _flat(found: Any) -> list[Condition]:
    out = []
    for item in found:
        out += [c for c in (item if isinstance(item, (list, tuple)) else [item]) if c is not None]
    return out


def _whole(n: Any, what: str) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0 or n > 2**53 - 1:
        raise InvalidArguments(f"{what} has to be a whole number from 0: {n!r}")
    return n


def from_(of: TableDef | TableFunction, alias: str | None = None) -> Query:
    return Query(Source(of, alias or of.name.split(".")[-1]))


def from_query(query: Query, alias: str) -> Query:
    return Query(Source(query, alias))


def from_union(union: Union, alias: str) -> Query:
    return Query(Source(union, alias))


def select_no_from(make: Callable[[], dict[str, Expr]]) -> Query:
    return Query(None, selection=lambda t: make())


def union_all(*branches: Query) -> Union:
    if not branches:
        raise QueryBuilderDefect("a union of nothing")
    return Union(tuple(branches))


# Data-last forms of every method.
def _late(name: str) -> Callable:
    def make(*args: Any, **options: Any) -> Callable[[Any], Any]:
        return lambda query: getattr(query, name)(*args, **options)

    make.__name__ = name
    return make


select, where, group_by, having, order_by, limit, offset, distinct, distinct_on, inner_join, left_join, cross_join, with_cte, format_, route, cross_tenant = (
    _late(n) for n in ("select", "where", "group_by", "having", "order_by", "limit", "offset", "distinct", "distinct_on", "inner_join", "left_join", "cross_join", "with_cte", "format", "route", "cross_tenant")
)
