"""What a plan must not do, found before Spark sees it."""

from __future__ import annotations

from larkspur.errors import QueryBuilderDefect
from larkspur.expr import Condition, Expr
from larkspur.plans.query import Query, Union


def check_names(q: Query, scope: set[str]) -> None:
    seen: set[str] = set()
    columns = set(q.source.columns()) if q.source else set()
    for s in q.sources():
        if s.alias in seen:
            raise QueryBuilderDefect(f"the alias {s.alias} is used twice")
        if s is not q.source and s.alias in columns:
            raise QueryBuilderDefect(f"the alias {s.alias} is also a column of {q.source.alias}")
        seen.add(s.alias)
    names = [n for n, _, _ in q.ctes]
    if len(set(names)) < len(names):
        raise QueryBuilderDefect("two CTEs have one name")


def row_filter(where: str, conditions: list[Condition]) -> None:
    for c in conditions:
        if c.agg:
            raise QueryBuilderDefect(f"an aggregate in {where}: {c.text}")
        if c.window:
            raise QueryBuilderDefect(f"a window function in {where}: {c.text}")


def check_grouping(q: Query, outputs: dict[str, Expr], havings: list[Condition]) -> bool:
    """Whether the query aggregates; every column outside an aggregate has to be a key."""
    for key in q.groups:
        if key not in outputs:
            raise QueryBuilderDefect(f"the grouping key {key} is not selected")
        if outputs[key].agg:
            raise QueryBuilderDefect(f"the grouping key {key} is an aggregate")
    grouped = bool(q.groups) or any(e.agg for e in outputs.values()) or any(h.agg for h in havings)
    if not grouped:
        if havings:
            raise QueryBuilderDefect("having without grouping")
        return False
    keys = {outputs[k].text for k in q.groups}
    uses = frozenset().union(*(outputs[k].uses for k in q.groups if outputs[k].is_ref())) if q.groups else frozenset()
    for name, e in outputs.items():
        if name in q.groups or e.agg or e.opaque or e.text in keys or not e.uses or e.uses <= uses:
            continue
        raise QueryBuilderDefect(f"{name} is neither grouped nor aggregated")
    for h in havings:
        if not h.agg and not h.opaque and h.uses and not h.uses <= frozenset().union(*(outputs[k].uses for k in q.groups)):
            raise QueryBuilderDefect(f"having reads an ungrouped column: {h.text}")
    return True


def check_clauses(q: Query, outputs: dict[str, Expr], grouped: bool) -> None:
    for name, _ in q.orders:
        if name not in outputs:
            raise QueryBuilderDefect(f"{name} is ordered by but not selected")
    for key in q.distinct_keys:
        if key not in outputs:
            raise QueryBuilderDefect(f"{key} is a distinct key but not selected")
    if q.lock:
        raise QueryBuilderDefect("row locks have no meaning on files")
    if q.is_distinct and q.order_fn:
        texts = {e.text for e in outputs.values()}
        for e, _ in q.order_pairs():
            if e.text not in texts:
                raise QueryBuilderDefect("a distinct query is ordered by what it selects only")


def check_union(u: Union) -> None:
    first = list(u.branches[0].outputs())
    for b in u.branches:
        if set(b.outputs()) != set(first):
            raise QueryBuilderDefect(f"union branches differ in aliases: {sorted(set(b.outputs()) ^ set(first))}")
        if b.lock:
            raise QueryBuilderDefect("a row lock in a union branch")
    for name, _ in u.orders:
        if name not in first:
            raise QueryBuilderDefect(f"{name} is ordered by but not selected")
