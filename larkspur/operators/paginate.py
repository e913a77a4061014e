"""Keyset pages: the next rows after a cursor, without an offset."""

from __future__ import annotations

import base64
import datetime as dt
import json
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import SparkSession

from larkspur.errors import InvalidArguments, QueryBuilderDefect
from larkspur.expr import Condition, Expr, and_, or_
from larkspur.plans.lower import compile_query
from larkspur.plans.query import Query


@dataclass(frozen=True)
class Page:
    rows: list[dict]
    next_cursor: str | None


def _check(q: Query, order_by: list[tuple[str, str]]) -> dict[str, Expr]:
    if q.offset_n or q.groups or q.havings or q.distinct_keys or q.orders or q.order_fn or q.limit_n is not None:
        raise QueryBuilderDefect("a paged query has no order, limit, offset, grouping or distinct keys of its own")
    outputs = q.outputs()
    names = [n for n, _ in order_by]
    if not names or len(set(names)) < len(names):
        raise QueryBuilderDefect("a page is ordered by distinct keys")
    for n, d in order_by:
        if n not in outputs:
            raise QueryBuilderDefect(f"{n} is not selected")
        if outputs[n].agg or outputs[n].window:
            raise QueryBuilderDefect(f"{n} is no key of a row")
        if outputs[n].type is not None and outputs[n].type.is_nullable:
            raise QueryBuilderDefect(f"{n} may be null")
        if d not in ("asc", "desc"):
            raise QueryBuilderDefect(f"order {d}")
    return outputs


def seek(outputs: dict[str, Expr], order_by: list[tuple[str, str]], values: list[Any]) -> Condition:
    """Rows after the given key. The leading key's bound stands alone too, so that files can be skipped by it."""
    steps = []
    for k, (n, d) in enumerate(order_by):
        same = [outputs[m].eq(values[j]) for j, (m, _) in enumerate(order_by[:k])]
        past = outputs[n].gt(values[k]) if d == "asc" else outputs[n].lt(values[k])
        steps.append(and_(*same, past))
    lead, d = order_by[0]
    bound = outputs[lead].gte(values[0]) if d == "asc" else outputs[lead].lte(values[0])
    return and_(bound, or_(*steps)) if len(steps) > 1 else steps[0]


def encode_cursor(order_by: list[tuple[str, str]], row: dict) -> str:
    def plain(v: Any) -> Any:
        return {"t": v.isoformat()} if isinstance(v, (dt.datetime, dt.date)) else v

    return base64.urlsafe_b64encode(json.dumps([[list(o) for o in order_by], [plain(row[n]) for n, _ in order_by]]).encode()).decode().rstrip("=")


def decode_cursor(order_by: list[tuple[str, str]], cursor: str) -> list[Any]:
    try:
        order, values = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except Exception as error:
        raise InvalidArguments("no cursor") from error
    if [tuple(o) for o in order] != list(order_by):
        raise InvalidArguments("the cursor is of another order")
    return [v["t"] if isinstance(v, dict) else v for v in values]


def page_query(q: Query, order_by: list[tuple[str, str]], after: str | list | None, limit: int) -> Query:
    outputs = _check(q, order_by)
    if after is not None:
        values = decode_cursor(order_by, after) if isinstance(after, str) else list(after)
        q = replace(q, wheres=(*q.wheres, lambda _: seek(outputs, order_by, values)))
    return q.order_by(*order_by).limit(limit + 1)


def paginate(q: Query, spark: SparkSession, order_by: list[tuple[str, str]], limit: int, after: str | None = None, params: dict | None = None, resolve: Any = None) -> Page:
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise InvalidArguments("a page has at least one row")
    made = compile_query(page_query(q, order_by, after, limit), spark, params, resolve=resolve)
    rows = made.decode_rows(made.df.collect())  # limit + 1 rows at most
    return Page(rows[:limit], encode_cursor(order_by, rows[limit - 1]) if len(rows) > limit else None)
