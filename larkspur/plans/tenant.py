"""Tenant-scope analysis: is a query bound to one tenant, to several, or to none?

Evidence is an equality of a tenant column with a value, directly or over columns that the query
equates. ``or`` and ``not`` give none; a left join's condition binds its right side only; having
never counts. Opaque SQL makes a query cross-tenant unless its caller declares a scope.
"""

from __future__ import annotations

from typing import Any

from larkspur.plans.query import Query, Source, Union
from larkspur.table import TableDef, TableFunction

SINGLE, CROSS, NONE = "single-tenant", "cross-tenant", "untenanted"


def scope_of(q: Query | Union, ctes: dict[str, tuple[str, Any]] | None = None) -> str:
    return analyse(q, ctes or {})[0]


def analyse(q: Query | Union, ctes: dict[str, tuple[str, Any]]) -> tuple[str, Any]:
    """The scope and, where it is single, the value."""
    if q.is_cross_tenant:
        return CROSS, None
    if isinstance(q, Union):
        found = [analyse(b, ctes) for b in q.branches]
        kinds = {k for k, _ in found}
        if kinds == {NONE}:
            return NONE, None
        values = {v for k, v in found if k == SINGLE}
        return (SINGLE, values.pop()) if kinds <= {SINGLE, NONE} and len(values) == 1 else (CROSS, None)
    ctes = dict(ctes)
    for name, of, declared in q.ctes:
        ctes[name] = analyse(of, ctes) if not isinstance(of, str) else (declared or CROSS, None)
    tenants: dict[tuple[str, str], str] = {}
    values: dict[tuple[str, str], set] = {}
    worst, inner = NONE, set()
    for s in q.sources():
        kind, value = _source(s, ctes)
        if kind == "column":
            tenants[(s.alias, value)] = s.alias
        elif kind == SINGLE:
            inner.add(value)
        elif kind == CROSS:
            worst = CROSS
    bound, same = set(), set()
    for c in q.filters():
        bound |= c.bound
        same |= {(frozenset(p), None) for p in c.same}
    for k, s in enumerate(q.joins):
        on = s.on(q.accessor(k), _right(s)) if s.on else None
        for c in on if isinstance(on, (list, tuple)) else [on]:
            if c is None:
                continue
            only = s.alias if s.kind == "left" else None
            bound |= {(ref, v) for ref, v in c.bound if only in (None, ref[0])}
            same |= {(frozenset(p), only) for p in c.same}
    for ref, v in bound:
        values.setdefault(ref, set()).add(v)
    moving = True
    while moving:
        moving = False
        for pair, only in same:
            for a in pair:
                for b in pair - {a}:
                    if only is not None and b[0] != only:
                        continue
                    new = values.get(a, set()) - values.get(b, set())
                    if new:
                        values.setdefault(b, set()).update(new)
                        moving = True
    if worst == CROSS:
        return CROSS, None
    every = set(inner)
    for ref in tenants:
        if not values.get(ref):
            return CROSS, None
        every |= values[ref]
    if not tenants and not inner:
        return NONE, None
    return (SINGLE, every.pop()) if len(every) == 1 else (CROSS, None)


def _right(s: Source):
    from larkspur.plans.query import Accessor

    return Accessor(s.refs())


def _source(s: Source, ctes: dict) -> tuple[str, Any]:
    if isinstance(s.of, (TableDef, TableFunction)):
        if isinstance(s.of, TableDef) and s.of.name in ctes:
            kind, value = ctes[s.of.name]
            return kind, value
        return ("column", s.of.tenant) if s.of.tenant else (NONE, None)
    return analyse(s.of, ctes)
