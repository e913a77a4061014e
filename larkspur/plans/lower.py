"""From plans to DataFrames: the only place where queries meet Spark."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur import types as t
from larkspur.errors import QueryBuilderDefect, RowDecodeError, UnresolvedParam
from larkspur.expr import Condition, Expr, default_of
from larkspur.plans import tenant, validate
from larkspur.plans.query import Accessor, Query, Source, Union
from larkspur.table import TableDef, TableFunction
from larkspur.types import ColType


@dataclass(frozen=True)
class Semantics:
    """Where databases differ. The defaults are those of standard SQL on Spark."""

    #: 'null', or 'default' for '' and 0 in place of a left join's missing columns
    missing_join: str = "null"
    #: 'first' (nulls are least), 'last' (always last) or 'greatest'
    null_order: str = "first"


@dataclass
class Context:
    spark: SparkSession
    params: dict[str, Any] = field(default_factory=dict)
    ctes: dict[str, DataFrame] = field(default_factory=dict)
    semantics: Semantics = field(default_factory=Semantics)
    resolve: Any = None

    def column(self, alias: str, name: str) -> Column:
        return F.col(f"`{alias}`.`{name.replace('`', '``')}`")

    def param(self, name: str, type: ColType) -> Column:
        if name not in self.params:
            raise UnresolvedParam(f"no value for {name}")
        value = type.literal(self.params[name])
        return F.lit(value).cast(type.spark) if not isinstance(value, (list, dict)) else F.lit(value)

    def text_of(self, e: Expr) -> str:
        """An expression inside SQL text: a column's own name, else a literal."""
        if e.is_ref():
            alias, name = next(iter(e.uses))
            return f"`{alias}`.`{name}`"
        value = e.build(self)
        return f"({value._jc.toString()})" if hasattr(value, "_jc") and not _is_text(e) else "'" + str(self._value(e)).replace("\\", "\\\\").replace("'", "\\'") + "'"

    def _value(self, e: Expr) -> Any:
        if e.params:
            return self.params[next(iter(e.params))]
        import ast

        return ast.literal_eval(e.text)

    def frame(self, table: TableDef) -> DataFrame:
        if table.name in self.ctes:
            return self.ctes[table.name]
        if table.source is not None:
            return table.source(self.spark)
        if self.resolve is not None:
            return self.resolve(table)
        return self.spark.table(table.name)


def _is_text(e: Expr) -> bool:
    return e.type is not None and e.type.spark.typeName() == "string"


@dataclass
class CompiledQuery:
    """A lowered query with what is known about it."""

    df: DataFrame
    columns: dict[str, ColType | None]
    tenant_scope: str
    route: str | None = None
    format: str | None = None
    kind: str = "select"

    @property
    def untyped_columns(self) -> list[str]:
        return [n for n, k in self.columns.items() if k is None]

    @property
    def row_schema_source(self) -> str:
        return "none" if self.untyped_columns else "derived"

    def json_lines(self) -> DataFrame:
        """The rows as JSON texts, one a row: what a format of JSON lines writes."""
        return self.df.select(F.to_json(F.struct(*[F.col(f"`{n}`") for n in self.columns]), {"ignoreNullFields": "false"}).alias("value"))

    def decode_rows(self, rows: list) -> list[dict]:
        return [self._decode(k, r) for k, r in enumerate(rows)]

    def decode_first_row(self, rows: list) -> dict | None:
        return self._decode(0, rows[0]) if rows else None

    def encode_rows(self, rows: list[dict]) -> list[dict]:
        return [{n: (k.literal(r.get(n)) if k else r.get(n)) for n, k in self.columns.items()} for r in rows]

    def _decode(self, index: int, row: Any) -> dict:
        row = row.asDict() if hasattr(row, "asDict") else dict(row)
        out = {}
        for name, kind in self.columns.items():
            try:
                out[name] = kind.read(row[name]) if kind else row[name]
            except Exception as error:
                raise RowDecodeError(index, name, str(error)) from error
        return out


def compile_query(q: Query | Union, spark: SparkSession, params: dict[str, Any] | None = None, semantics: Semantics | None = None, resolve: Any = None) -> CompiledQuery:
    ctx = Context(spark, params or {}, {}, semantics or Semantics(), resolve)
    df = lower(q, ctx)
    outputs = q.outputs()
    return CompiledQuery(df, output_types(q) if isinstance(q, Query) else {n: _common([b.outputs()[n].type for b in q.branches]) for n in outputs}, tenant.scope_of(q), q.route_name, q.format_name)


def raw_compiled_query(spark: SparkSession, sql: str, columns: dict[str, ColType | None], reason: str, tenant_scope: str = "cross-tenant", params: dict[str, Any] | None = None) -> CompiledQuery:
    """Handwritten SQL with a declared row schema. The reason is part of the record, and is asked for."""
    if not reason.strip():
        raise QueryBuilderDefect("handwritten SQL states its reason")
    return CompiledQuery(spark.sql(sql, args=params or {}), columns, tenant_scope, kind=f"raw: {reason}")


def output_types(q: Query) -> dict[str, ColType | None]:
    """Types of the selected columns; a left join makes its columns nullable unless a filter before select keeps nulls out."""
    loose = {s.alias for s in q.joins if s.kind == "left"}
    conditions = q.filters() if q.wheres_before_select == len(q.wheres) else _some_filters(q, q.wheres_before_select)
    kept = {ref for c in conditions for ref in c.known}
    out = {}
    for name, e in q.outputs().items():
        kind = e.type
        if kind is not None and not e.agg and any(a in loose and (a, n) not in kept for a, n in e.uses):
            kind = t.nullable(kind)
        elif kind is not None and e.is_ref() and next(iter(e.uses)) in kept and kind.is_nullable:
            from dataclasses import replace

            kind = replace(kind, is_nullable=False)
        out[name] = kind
    return out


def _some_filters(q: Query, n: int) -> list[Condition]:
    from dataclasses import replace

    return replace(q, wheres=q.wheres[:n]).filters()


WIDTHS = {"byte": 1, "short": 2, "integer": 3, "long": 4, "float": 5, "double": 6}


def _common(kinds: list[ColType | None]) -> ColType | None:
    if any(k is None for k in kinds):
        return None
    nullable = any(k.is_nullable for k in kinds)
    # Of numbers the widest, whatever the order of the branches.
    first = max(kinds, key=lambda k: WIDTHS[k.spark.typeName()]) if all(k.spark.typeName() in WIDTHS for k in kinds) else kinds[0]
    return t.nullable(first) if nullable else first


def lower(q: Query | Union, ctx: Context) -> DataFrame:
    return _union(q, ctx) if isinstance(q, Union) else _query(q, ctx)


def _frame(s: Source, ctx: Context) -> DataFrame:
    if isinstance(s.of, TableDef):
        return ctx.frame(s.of)
    if isinstance(s.of, TableFunction):
        return s.of.frame(ctx.spark)
    return lower(s.of, ctx)


def _query(q: Query, ctx: Context) -> DataFrame:
    ctx = Context(ctx.spark, ctx.params, dict(ctx.ctes), ctx.semantics, ctx.resolve)
    validate.check_names(q, set(ctx.ctes))
    for name, of, _ in q.ctes:
        ctx.ctes[name] = ctx.spark.sql(of) if isinstance(of, str) else lower(of, ctx)
    df = _sources(q, ctx)
    filters = q.filters()
    validate.row_filter("where", filters)
    if filters:
        df = df.where(reduce(lambda a, b: a & b, [c.build(ctx) for c in filters]))
    outputs, havings = q.outputs(), q.having_conditions()
    grouped = validate.check_grouping(q, outputs, havings)
    validate.check_clauses(q, outputs, grouped)
    orders, hidden = [], {}
    for k, (e, direction) in enumerate(q.order_pairs()):
        if isinstance(e, Expr):
            same = next((n for n, o in outputs.items() if o.text == e.text), None)
            if same is None:
                hidden[f"__order{k}"] = e
            orders.append((same or f"__order{k}", direction))
        else:
            orders.append((e, direction))
    df = _grouped(q, ctx, df, outputs, havings, hidden) if grouped else df.select(*[_build(e, ctx).alias(n) for n, e in (outputs | hidden).items()])
    if q.is_distinct:
        df = df.distinct()
    if q.distinct_keys:
        w = W.partitionBy(*q.distinct_keys).orderBy(*(_sort(ctx, n, d) for n, d in orders)) if orders else W.partitionBy(*q.distinct_keys).orderBy(*q.distinct_keys)
        df = df.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")
    return _finish(ctx, df, orders, q.offset_n, q.limit_n, list(outputs) if hidden else None)


def _build(e: Expr, ctx: Context) -> Column:
    made = e.build(ctx)
    if ctx.semantics.missing_join == "default" and e.is_ref() and e.type is not None and not e.type.is_nullable and default_of(e.type) is not None:
        return F.coalesce(made, F.lit(default_of(e.type)).cast(e.type.spark))
    return made


def _sources(q: Query, ctx: Context) -> DataFrame:
    if q.source is None:
        return ctx.spark.range(1)
    df = _frame(q.source, ctx).alias(q.source.alias)
    for k, s in enumerate(q.joins):
        if isinstance(s.of, TableFunction) and s.of.argument.uses:
            df = _lateral(df, s, ctx)
            continue
        right = _frame(s, ctx).alias(s.alias)
        if s.kind == "cross":
            df = df.crossJoin(right)
            continue
        on = s.on(q.accessor(k), Accessor(s.refs()))
        conditions = [c for c in (on if isinstance(on, (list, tuple)) else [on]) if c is not None]
        validate.row_filter("a join's condition", conditions)
        df = df.join(right, reduce(lambda a, b: a & b, [c.build(ctx) for c in conditions]), s.kind)
    return df


def _lateral(df: DataFrame, s: Source, ctx: Context) -> DataFrame:
    """A table function over columns of earlier sources: its rows multiply theirs."""
    rows = s.of.rows(s.of.argument.build(ctx))
    exploded = F.explode_outer(rows) if s.kind == "left" else F.explode(rows)
    # A struct named like the source makes `alias`.`column` the way to its fields.
    fields = F.struct(*[F.col("__row").getField(n).alias(n) for n in s.of.columns])
    return df.select("*", exploded.alias("__row")).withColumn(s.alias, fields).drop("__row")


def _grouped(q: Query, ctx: Context, df: DataFrame, outputs: dict[str, Expr], havings: list[Condition], hidden: dict[str, Expr]) -> DataFrame:
    keys = {n: outputs[n] for n in q.groups}
    made = {e.text: n for n, e in keys.items()}
    rest = {n: e for n, e in (outputs | hidden).items() if n not in keys}
    windows = {n: e for n, e in rest.items() if e.window}
    if windows:
        raise QueryBuilderDefect("a window over groups needs a query around the grouping: from_query")
    copies = {n: made[e.text] for n, e in rest.items() if not e.agg and e.text in made}
    plain = {n: e for n, e in rest.items() if n not in copies and not e.agg and not e.uses}
    sums = {n: _build(e, ctx) for n, e in rest.items() if n not in copies and n not in plain}
    for k, h in enumerate(havings):
        sums[f"__having{k}"] = h.build(ctx)
    key_columns = [e.build(ctx).alias(n) for n, e in keys.items()]
    if sums:
        df = df.groupBy(*key_columns).agg(*[c.alias(n) for n, c in sums.items()])
    else:
        df = df.select(*key_columns).distinct()
    for k in range(len(havings)):
        df = df.where(F.col(f"__having{k}"))
    return df.select(*[(F.col(f"`{copies[n]}`") if n in copies else e.build(ctx) if n in plain else F.col(f"`{n}`")).alias(n) for n, e in (outputs | hidden).items()])


def _sort(ctx: Context, name: str, direction: str) -> Column:
    c = F.col(f"`{name}`")
    if direction not in ("asc", "desc"):
        raise QueryBuilderDefect(f"order {direction}")
    order = ctx.semantics.null_order
    if direction == "asc":
        return c.asc() if order == "first" else c.asc_nulls_last()
    return c.desc_nulls_first() if order == "greatest" else c.desc_nulls_last()


def _finish(ctx: Context, df: DataFrame, orders: list, offset: int | None, limit: int | None, names: list[str] | None) -> DataFrame:
    """names: what to keep, where hidden sort columns came along. A correlated query has no schema yet, so none is asked for."""
    if orders:
        df = df.orderBy(*[_sort(ctx, n, d) for n, d in orders])
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*[F.col(f"`{n}`") for n in names]) if names else df


def _union(u: Union, ctx: Context) -> DataFrame:
    validate.check_union(u)
    names = list(u.branches[0].outputs())
    df = reduce(lambda a, b: a.unionByName(b), [lower(b, ctx).select(*[F.col(f"`{n}`") for n in names]) for b in u.branches])
    return _finish(ctx, df, list(u.orders), u.offset_n, u.limit_n, None)
