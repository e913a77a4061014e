"""Relations between tables: nested reads in one plan, and filters on related rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.errors import QueryBuilderDefect
from larkspur.expr import Condition, Expr, column, not_, outer
from larkspur.functions import olap
from larkspur.plans.lower import _sort, Context, lower
from larkspur.plans.query import Query, from_
from larkspur.plans.subquery import exists, scalar
from larkspur.table import TableDef


@dataclass(frozen=True)
class Relation:
    kind: str  # one or many
    target: TableDef
    near: str
    far: str


def one(target: TableDef, near: str, far: str) -> Relation:
    return Relation("one", target, near, far)


def many(target: TableDef, near: str, far: str) -> Relation:
    return Relation("many", target, near, far)


@dataclass(frozen=True)
class Related:
    """A relation seen from a row of its parent."""

    relation: Relation
    parent: Expr
    alias: str

    def _inner(self, make: Callable | None, wrap: Callable[[Condition], Condition] = lambda c: c) -> Query:
        q = from_(self.relation.target, self.alias).select(self.relation.far)
        return q.where(lambda r: [r[self.relation.far].eq(outer(self.parent)), wrap(make(r)) if make else None])

    def some(self, make: Callable | None = None) -> Condition:
        return exists(self._inner(make))

    def none(self, make: Callable | None = None) -> Condition:
        return not_(self.some(make))

    def every(self, make: Callable) -> Condition:
        """No related row fails; one that is neither true nor false does not fail."""
        return not_(exists(self._inner(make, not_)))

    def count(self, make: Callable | None = None) -> Expr:
        q = from_(self.relation.target, self.alias).select(lambda r: {"n": olap.count()})
        q = q.where(lambda r: [r[self.relation.far].eq(outer(self.parent)), make(r) if make else None])
        return olap.coalesce(scalar(q), 0)


@dataclass(frozen=True)
class Read:
    """What to read of a level: filter, order, limit, nested relations and counts."""

    where: Callable | None = None
    #: Names, pairs of a name and 'asc' or 'desc', or a callback that gives pairs of expressions.
    order_by: tuple | Callable = ()
    limit: int | None = None
    offset: int | None = None
    with_: dict[str, Any] = field(default_factory=dict)
    counts: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    #: Declares that this level and those below it read across tenants.
    cross_tenant: bool = False


class Relations:
    def __init__(self, edges: dict[str, dict[str, Relation]]):
        self.edges = edges
        for table, own in edges.items():
            for name, r in own.items():
                if r.far not in r.target.columns:
                    raise QueryBuilderDefect(f"{r.target.name} has no column {r.far} for {table}.{name}")

    def of(self, table: TableDef, name: str, alias: str | None = None, parent: str | None = None) -> Related:
        r = self._edge(table, name)
        return Related(r, column(parent or table.name, r.near, table.columns[r.near]), alias or f"{name}_")

    def _edge(self, table: TableDef, name: str) -> Relation:
        try:
            return self.edges[table.name][name]
        except KeyError:
            raise QueryBuilderDefect(f"{table.name} has no relation {name}") from None

    def find_many(self, spark: SparkSession, table: TableDef, read: Read | None = None, params: dict | None = None, resolve: Any = None) -> DataFrame:
        """One plan: children are grouped by their key and joined, level by level from below.

        Rows and children keep their level's order; a 'one' is a struct or null, a 'many' an array,
        empty where there is none. A limit or an offset is for the top level only.
        """
        return self._read(spark, table, read or Read(), params, resolve)

    def _read(self, spark: SparkSession, table: TableDef, read: Read, params: dict | None, resolve: Any, below: bool = False) -> DataFrame:
        """The rows of a level; one below another also gives the expressions it is ordered by."""
        if any(isinstance(n, Read) and (n.limit is not None or n.offset) for n in read.with_.values()):
            raise QueryBuilderDefect("a limit or an offset inside a relation: only the top level has one")
        keys, made = _keys(table, read)
        needed = {self._edge(table, n).near for n in (*read.with_, *read.counts)} | set(read.columns or table.columns) | {n for n, _ in keys}
        q = from_(table, table.name).select(lambda x: {n: x[n] for n in table.columns if n in needed} | made)
        if read.where:
            q = q.where(read.where)
        if keys:
            q = q.order_by(*keys)
        if read.offset:
            q = q.offset(read.offset)
        if read.limit is not None:
            q = q.limit(read.limit)
        ctx = Context(spark, params or {}, resolve=resolve)
        df = lower(q, ctx)
        # Names of relations may differ from columns by case alone; they get their own until the end.
        out = [F.col(f"`{n}`") for n in (read.columns or table.columns)]
        for name, nested in read.with_.items():
            r = self._edge(table, name)
            nested = nested if isinstance(nested, Read) else Read()
            level, hidden = _keys(r.target, nested)
            named = [n for n, _ in level if n not in hidden]
            child = self._read(spark, r.target, Read(nested.where, nested.order_by, nested.limit, nested.offset, nested.with_, nested.counts, tuple({*nested.columns, r.far, *named}) if nested.columns else ()), params, resolve, below=True)
            shown = list(nested.columns or r.target.columns) + list(nested.with_) + [f"{c}_count" for c in nested.counts]
            place = F.row_number().over(_level(ctx, r.far, level))
            item = F.struct(place.alias("__at"), F.struct(*[child[f"`{c}`"] for c in shown]).alias("row"))
            grouped = child.select(F.col(r.far).alias("__key"), item.alias("__item")).where(F.col("__key").isNotNull())
            grouped = grouped.groupBy("__key").agg(F.transform(F.array_sort(F.collect_list("__item")), lambda x: x["row"]).alias(f"__of_{name}"))
            df = df.join(grouped, df[r.near] == grouped["__key"], "left").drop("__key")
            found = F.col(f"__of_{name}")
            out.append((F.try_element_at(found, F.lit(1)) if r.kind == "one" else F.coalesce(found, F.array().cast(grouped.schema[f"__of_{name}"].dataType))).alias(name))
        for name in read.counts:
            r = self._edge(table, name)
            counted = lower(from_(r.target, r.target.name).select(lambda x, r=r: {"__key": x[r.far], f"{name}_count": olap.count()}).group_by("__key"), Context(spark, params or {}, resolve=resolve))
            df = df.join(counted, df[r.near] == counted["__key"], "left").drop("__key").withColumn(f"{name}_count", F.coalesce(F.col(f"{name}_count"), F.lit(0)).cast("long"))
            out.append(F.col(f"{name}_count"))
        if keys and (read.with_ or read.counts):  # the joins have moved the rows
            df = df.orderBy(*[_sort(ctx, n, d) for n, d in keys])
        return df.select(*out, *([F.col(f"`{n}`") for n in made] if below else []))

    def queries(self, table: TableDef, read: Read | None = None, declared: bool = False) -> list[tuple[Query, bool]]:
        """The query of each level and of each count, and whether it may cross tenants."""
        read = read or Read()
        declared = declared or read.cross_tenant
        q = from_(table, table.name).select(*table.columns)
        out = [(q.where(read.where) if read.where else q, declared)]
        for name, nested in read.with_.items():
            out += self.queries(self._edge(table, name).target, nested if isinstance(nested, Read) else None, declared)
        for name in read.counts:
            out += self.queries(self._edge(table, name).target, None, declared)
        return out


def _keys(table: TableDef, read: Read) -> tuple[list[tuple[str, str]], dict[str, Expr]]:
    """What a level is ordered by as names and directions, and the expressions among them by name."""
    if not callable(read.order_by):
        return [o if isinstance(o, tuple) else (o, "asc") for o in read.order_by], {}
    keys, made = [], {}
    for k, (e, direction) in enumerate(from_(table, table.name).order_by(read.order_by).order_pairs()):
        name = next(iter(e.uses))[1] if e.is_ref() else f"__order{k}"
        if not e.is_ref():
            made[name] = e
        keys.append((name, direction))
    return keys, made


def _level(ctx: Context, far: str, keys: list[tuple[str, str]]) -> Any:
    from pyspark.sql import Window as W

    return W.partitionBy(far).orderBy(*([_sort(ctx, n, d) for n, d in keys] or [F.lit(1)]))


def find_all_by(spark: SparkSession, table: TableDef, name: str, keys: list[Any], params: dict | None = None, resolve: Any = None, where: Callable | None = None) -> DataFrame:
    """Many lookups as one: rows whose column is any of the keys, and that ``where`` lets pass."""
    q = from_(table, table.name).select().where(lambda r: r[name].in_(list(dict.fromkeys(keys))))
    return lower(q.where(where) if where else q, Context(spark, params or {}, resolve=resolve))
