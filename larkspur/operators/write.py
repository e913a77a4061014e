"""Inserts, upserts, updates and deletes: immutable plans over versioned tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.errors import ConstraintError, InvalidArguments, QueryBuilderDefect
from larkspur.expr import Condition, Expr, column, lift, typed_value
from larkspur.operators.store import Store
from larkspur.plans import tenant
from larkspur.plans.lower import Context, lower
from larkspur.plans.query import Accessor, Query, Source, Union
from larkspur.table import TableDef

DEFAULT = object()


def excluded(*names: str) -> dict[str, str]:
    """Set these columns to the incoming row's values."""
    return {n: "excluded" for n in names}


def excluded_all(table: TableDef, *but: str) -> dict[str, str]:
    return excluded(*[n for n in table.columns if n not in but and n not in table.computed])


def _check(table: TableDef, names: Any) -> None:
    for n in names:
        if n not in table.columns:
            raise QueryBuilderDefect(f"{table.name} has no column {n}")
        if n in table.computed:
            raise QueryBuilderDefect(f"{n} is computed")


def _returned(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.select(*names) if names else df


def _refs(table: TableDef, alias: str) -> Accessor:
    return Accessor({n: column(alias, n, k) for n, k in table.columns.items()})


@dataclass(frozen=True)
class Insert:
    table: TableDef
    rows: tuple[dict, ...] = ()
    query: Query | Union | None = None
    conflict: str | None = None
    target: tuple[str, ...] = ()
    sets: Any = None
    conflict_where: Callable | None = None
    returns: tuple[str, ...] | None = None
    options: tuple = ()

    def values(self, *rows: Any) -> Insert:
        rows = tuple(rows[0]) if len(rows) == 1 and isinstance(rows[0], (list, tuple)) else rows
        if not rows:
            raise QueryBuilderDefect("an insert of nothing")
        for r in rows:
            _check(self.table, r)
        return replace(self, rows=tuple(rows), query=None)

    def select(self, query: Query | Union) -> Insert:
        _check(self.table, query.outputs())
        return replace(self, query=query, rows=())

    def on_conflict_do_nothing(self, target: tuple[str, ...] | list[str] = ()) -> Insert:
        _check(self.table, target)
        return replace(self, conflict="nothing", target=tuple(target) or self.table.primary_key)

    def on_conflict_do_update(self, target: tuple[str, ...] | list[str], set: Any, where: Callable | None = None) -> Insert:
        _check(self.table, target)
        if not target:
            raise QueryBuilderDefect("an upsert has a target")
        return replace(self, conflict="update", target=tuple(target), sets=set, conflict_where=where)

    def returning(self, *names: str) -> Insert:
        return replace(self, returns=names)

    def settings(self, **options: Any) -> Insert:
        return replace(self, options=tuple(options.items()))

    def tenant_scope(self) -> str:
        if not self.table.tenant:
            return tenant.NONE
        if self.conflict == "update" and self.table.tenant not in self.target:
            return tenant.CROSS  # the row that it meets may be another tenant's
        if self.query is not None:
            return tenant.scope_of(self.query)
        found = {r.get(self.table.tenant) for r in self.rows}
        return tenant.SINGLE if len(found) == 1 and None not in found else tenant.CROSS

    def incoming(self, store: Store, params: dict | None = None) -> DataFrame:
        t, spark = self.table, store.spark
        if self.query is not None:
            df = lower(self.query, Context(spark, params or {}, resolve=store.frame))
            for n, k in t.columns.items():
                if n not in df.columns and n not in t.computed:
                    df = df.withColumn(n, F.lit(_default(t, n)).cast(k.spark))
        else:
            names = [n for n in t.columns if n not in t.computed]
            made = []
            for r in self.rows:
                cells = []
                for n in names:
                    value = r[n] if n in r and r[n] is not DEFAULT else _default(t, n)
                    if value is None and not t.columns[n].is_nullable:
                        raise ConstraintError("not null", t.name, (n,))
                    cells.append(None if value is None else t.columns[n].literal(value))
                made.append(tuple(cells))
            from pyspark.sql import types as T

            df = spark.createDataFrame(made, T.StructType([T.StructField(n, t.columns[n].spark, True) for n in names]))
        for n, text in t.computed.items():
            df = df.withColumn(n, F.expr(text).cast(t.columns[n].spark))
        return df.select(*[F.col(f"`{n}`").cast(k.spark).alias(n) for n, k in t.columns.items()])

    def result(self, store: Store, params: dict | None = None) -> tuple[DataFrame, DataFrame, bool]:
        """Rows to write, rows affected, and whether the rows replace the table."""
        new, t = self.incoming(store, params), self.table
        if self.conflict is None:
            return new, new, False
        # Of incoming rows with one target, the first by all columns stands for all.
        order = [F.col(f"`{n}`") for n in t.columns]
        w = W.partitionBy(*self.target).orderBy(*order)
        solid = reduce(lambda a, b: a & b, [F.col(f"`{n}`").isNotNull() for n in self.target])
        new = new.withColumn("__k", F.row_number().over(w)).where((F.col("__k") == 1) | ~solid).drop("__k")
        old = store.frame(t)
        if self.conflict == "nothing":
            fresh = new.alias("n").join(old.select(*self.target).alias("o"), list(self.target), "left_anti").select(*t.columns)
            return fresh, fresh, False
        on = reduce(lambda a, b: a & b, [F.col(f"o.{n}") == F.col(f"n.{n}") for n in self.target])
        both = old.alias("o").withColumn("__old", F.lit(True)).alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), on, "full")
        ctx = Context(store.spark, params or {})
        there, came = F.col("o.__old").isNotNull(), F.col("n.__new").isNotNull()
        touched = there & came
        if self.conflict_where is not None:
            touched = touched & F.coalesce(self.conflict_where(_refs(t, "o"), _refs(t, "n")).build(ctx), F.lit(False))
        sets = self.sets(_refs(t, "o"), _refs(t, "n")) if callable(self.sets) else self.sets
        _check(t, sets)
        columns = []
        for n, k in t.columns.items():
            old_c, new_c = F.col(f"o.`{n}`"), F.col(f"n.`{n}`")
            if n in sets:
                v = sets[n]
                changed = new_c if isinstance(v, str) and v == "excluded" else (v if isinstance(v, Expr) else typed_value(k, v)).build(ctx).cast(k.spark)
            else:
                changed = old_c
            columns.append(F.when(touched, changed).when(there, old_c).otherwise(new_c).alias(n))
        out = both.select(*columns, (touched | ~there).alias("__affected"))
        for n, text in t.computed.items():
            out = out.withColumn(n, F.expr(text).cast(t.columns[n].spark))
        return out.drop("__affected"), out.where("__affected").drop("__affected"), True

    def run(self, store: Store, params: dict | None = None) -> DataFrame:
        rows, affected, whole = self.result(store, params)
        check_constraints(self.table, store, rows, whole)
        affected = _held(affected)
        (store.overwrite if whole else store.append)(self.table, rows)
        return _returned(affected, self.returns or ())


def _default(t: TableDef, name: str) -> Any:
    value = t.defaults.get(name)
    return value() if callable(value) else value


def _held(df: DataFrame) -> DataFrame:
    """Affected rows as they were written: read before the table moves on."""
    return df.cache()


@dataclass(frozen=True)
class Update:
    table: TableDef
    record: Any = None
    wheres: tuple = ()
    every: bool = False
    source: Source | None = None
    returns: tuple[str, ...] | None = None

    def set(self, record: Any) -> Update:
        return replace(self, record=record)

    def where(self, make: Callable) -> Update:
        return replace(self, wheres=(*self.wheres, make))

    def all_rows(self) -> Update:
        return replace(self, every=True)

    def from_(self, of: Any, alias: str) -> Update:
        return replace(self, source=Source(of, alias, "inner"))

    def returning(self, *names: str) -> Update:
        return replace(self, returns=names)

    def _accessor(self) -> Accessor:
        own = {n: column(self.table.name, n, k) for n, k in self.table.columns.items()}
        return Accessor(own, {self.source.alias: self.source.refs()} if self.source else {})

    def conditions(self) -> list[Condition]:
        return _conditions(self.wheres, self._accessor(), self.every)

    def tenant_scope(self) -> str:
        return _write_scope(self.table, self.conditions())

    def result(self, store: Store, params: dict | None = None) -> tuple[DataFrame, DataFrame]:
        t, ctx = self.table, Context(store.spark, params or {}, resolve=store.frame)
        found = self.record(self._accessor()) if callable(self.record) else dict(self.record or {})
        if not found:
            raise QueryBuilderDefect("an update of nothing")
        _check(t, found)
        for n, make in t.on_update.items():
            found.setdefault(n, make())
        conditions = self.conditions()
        hit = reduce(lambda a, b: a & b, [c.build(ctx) for c in conditions]) if conditions else F.lit(True)
        df = store.frame(t).withColumn("__id", F.monotonically_increasing_id()).alias(t.name)
        if self.source is not None:
            from larkspur.plans.lower import _frame

            matched = df.join(_frame(self.source, ctx).alias(self.source.alias), hit, "inner")
            new = matched.select(F.col(f"{t.name}.__id").alias("__id"), *[_value(t, n, v).build(ctx).cast(t.columns[n].spark).alias(f"__{n}") for n, v in found.items()])
            # A row that several source rows match takes one of them.
            new = new.dropDuplicates(["__id"]).withColumn("__hit", F.lit(True))
            out = df.join(new, "__id", "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
            out = out.select(*[(F.when(F.col("__hit"), F.col(f"__{n}")).otherwise(F.col(f"`{n}`")) if n in found else F.col(f"`{n}`")).alias(n) for n in t.columns], "__hit")
        else:
            hit = F.coalesce(hit, F.lit(False))
            out = df.select(*[(F.when(hit, _value(t, n, found[n]).build(ctx).cast(k.spark)).otherwise(F.col(f"`{t.name}`.`{n}`")) if n in found else F.col(f"`{t.name}`.`{n}`")).alias(n) for n, k in t.columns.items()], hit.alias("__hit"))
        for n, text in t.computed.items():
            out = out.withColumn(n, F.expr(text).cast(t.columns[n].spark))
        return out.drop("__hit"), out.where("__hit").drop("__hit")

    def run(self, store: Store, params: dict | None = None) -> DataFrame:
        rows, affected = self.result(store, params)
        check_constraints(self.table, store, rows, True)
        affected = _held(affected)
        store.overwrite(self.table, rows)
        return _returned(affected, self.returns or ())


@dataclass(frozen=True)
class Delete:
    table: TableDef
    wheres: tuple = ()
    every: bool = False
    returns: tuple[str, ...] | None = None

    def where(self, make: Callable) -> Delete:
        return replace(self, wheres=(*self.wheres, make))

    def all_rows(self) -> Delete:
        return replace(self, every=True)

    def returning(self, *names: str) -> Delete:
        return replace(self, returns=names)

    def conditions(self) -> list[Condition]:
        return _conditions(self.wheres, _refs(self.table, self.table.name), self.every)

    def tenant_scope(self) -> str:
        return _write_scope(self.table, self.conditions())

    def result(self, store: Store, params: dict | None = None) -> tuple[DataFrame, DataFrame]:
        ctx = Context(store.spark, params or {}, resolve=store.frame)
        conditions = self.conditions()
        hit = F.coalesce(reduce(lambda a, b: a & b, [c.build(ctx) for c in conditions]), F.lit(False)) if conditions else F.lit(True)
        df = store.frame(self.table).alias(self.table.name)
        return df.where(~hit), df.where(hit)

    def run(self, store: Store, params: dict | None = None) -> DataFrame:
        rows, affected = self.result(store, params)
        affected = _held(affected)
        store.overwrite(self.table, rows)
        return _returned(affected, self.returns or ())


def _value(t: TableDef, name: str, value: Any) -> Expr:
    return value if isinstance(value, Expr) else lift(None) if value is None and t.columns[name].is_nullable else typed_value(t.columns[name], value)


def _conditions(wheres: tuple, accessor: Accessor, every: bool) -> list[Condition]:
    found = []
    for make in wheres:
        made = make(accessor)
        found += [c for c in (made if isinstance(made, (list, tuple)) else [made]) if c is not None]
    if not found and not every:
        raise QueryBuilderDefect("a write to all rows has to say so: all_rows()")
    for c in found:
        if c.agg:
            raise QueryBuilderDefect("an aggregate in a write's condition")
    return found


def _write_scope(t: TableDef, conditions: list[Condition]) -> str:
    if not t.tenant:
        return tenant.NONE
    found = {v for c in conditions for ref, v in c.bound if ref == (t.name, t.tenant)}
    return tenant.SINGLE if len(found) == 1 else tenant.CROSS


def check_constraints(t: TableDef, store: Store, rows: DataFrame, whole: bool) -> None:
    """Not-null, check, unique and foreign-key constraints of the rows about to be written."""
    for n, k in t.columns.items():
        if not k.is_nullable and n not in t.computed and _any(rows, F.col(f"`{n}`").isNull()):
            raise ConstraintError("not null", t.name, (n,))
    for text in t.checks.values():
        if _any(rows, ~F.coalesce(F.expr(text), F.lit(True))):
            raise ConstraintError("check", t.name, (text,))
    for key in ((t.primary_key,) if t.primary_key else ()) + t.unique:
        everything = rows.select(*key) if whole else store.frame(t).select(*key).unionByName(rows.select(*key))
        solid = everything.where(reduce(lambda a, b: a & b, [F.col(f"`{n}`").isNotNull() for n in key]))
        if solid.groupBy(*key).count().where("count > 1").limit(1).count():
            raise ConstraintError("unique", t.name, key)
    for n, (other, far) in t.foreign_keys.items():
        target = store.frame(TableDef(other, {far: t.columns[n]}))
        if rows.where(F.col(f"`{n}`").isNotNull()).join(target, F.col(f"`{n}`") == target[far], "left_anti").limit(1).count():
            raise ConstraintError("foreign key", t.name, (n,))


def _any(df: DataFrame, cond: Column) -> bool:
    return df.where(cond).limit(1).count() > 0


def insert_into(table: TableDef) -> Insert:
    _writable(table)
    return Insert(table)


def update(table: TableDef) -> Update:
    _writable(table)
    return Update(table)


def delete_from(table: TableDef) -> Delete:
    _writable(table)
    return Delete(table)


def _writable(table: TableDef) -> None:
    if table.external:
        raise InvalidArguments(f"{table.name} is external")
