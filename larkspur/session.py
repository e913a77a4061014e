"""Running queries: rows, cardinality checks, streams, batches, transactions, repositories, observation."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from larkspur.errors import CardinalityError, ConflictError, QueryBuilderDefect, TenantScopeError
from larkspur.operators.paginate import Page, paginate
from larkspur.operators.relations import Read, Relations, find_all_by
from larkspur.operators.store import Store
from larkspur.operators.write import Delete, Insert, Update, delete_from, insert_into, update
from larkspur.plans import tenant
from larkspur.plans.lower import CompiledQuery, Semantics, compile_query
from larkspur.plans.query import Query, Union, from_
from larkspur.table import TableDef


@dataclass
class Observation:
    operation: str
    table: str | None
    rows: int
    seconds: float
    scope: str


@dataclass
class Session:
    spark: SparkSession
    root: str | None = None
    relations: Relations | None = None
    semantics: Semantics = field(default_factory=Semantics)
    require_tenant_scope: bool = False
    observers: list[Callable[[Observation], None]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.root) if self.root else None
        self._after: list[Callable[[], None]] | None = None

    # Reading.
    def compile(self, q: Query | Union, params: dict | None = None) -> CompiledQuery:
        made = compile_query(q, self.spark, params, self.semantics, self._resolve())
        self._guard(made.tenant_scope, q.is_cross_tenant)
        return made

    def _resolve(self) -> Any:
        return self.store.frame if self.store else None

    def _guard(self, scope: str, declared: bool) -> None:
        if self.require_tenant_scope and scope == tenant.CROSS and not declared:
            raise TenantScopeError("the query is not bound to one tenant")

    def _observed(self, operation: str, table: str | None, scope: str, work: Callable[[], list]) -> list:
        began = time.perf_counter()
        self.spark.sparkContext.setJobDescription(f"{operation} {table or ''}")
        try:
            rows = work()
        finally:
            self.spark.sparkContext.setJobDescription(None)
        for tell in self.observers:
            tell(Observation(operation, table, len(rows), time.perf_counter() - began, scope))
        return rows

    def run(self, q: Query | Union, params: dict | None = None) -> list[dict]:
        made = self.compile(q, params)
        name = q.source.alias if isinstance(q, Query) and q.source else None
        return self._observed("select", name, made.tenant_scope, lambda: made.decode_rows(made.df.collect()))

    def run_one(self, q: Query | Union, params: dict | None = None) -> dict:
        rows = self._two(q, params)
        if len(rows) != 1:
            raise CardinalityError(f"one row was expected, {'none' if not rows else 'more'} came")
        return rows[0]

    def run_option(self, q: Query | Union, params: dict | None = None) -> dict | None:
        rows = self._two(q, params)
        if len(rows) > 1:
            raise CardinalityError("at most one row was expected")
        return rows[0] if rows else None

    def run_non_empty(self, q: Query | Union, params: dict | None = None) -> list[dict]:
        rows = self.run(q, params)
        if not rows:
            raise CardinalityError("rows were expected")
        return rows

    def _two(self, q: Query | Union, params: dict | None) -> list[dict]:
        made = self.compile(q, params)
        return made.decode_rows(made.df.limit(2).collect())

    def stream(self, q: Query | Union, params: dict | None = None) -> Iterator[dict]:
        """Rows one at a time; the driver holds a partition or two."""
        made = self.compile(q, params)
        for k, row in enumerate(made.df.toLocalIterator(prefetchPartitions=True)):
            yield made._decode(k, row)

    def query(self, text: str, params: dict | None = None, **frames: DataFrame) -> list[dict]:
        return [r.asDict() for r in self.spark.sql(text, args=params, **frames).collect()]

    def paginate(self, q: Query, order_by: list[tuple[str, str]], limit: int, after: str | None = None, params: dict | None = None) -> Page:
        scope = tenant.scope_of(q)
        self._guard(scope, q.is_cross_tenant)
        pages: list[Page] = []

        def work() -> list:
            pages.append(paginate(q, self.spark, order_by, limit, after, params, self._resolve()))
            return pages[0].rows

        self._observed("page", q.source.alias if q.source else None, scope, work)
        return pages[0]

    def find_many(self, table: TableDef, read: Read | None = None, params: dict | None = None) -> list[dict]:
        """Every level has to be bound to one tenant, or to say that it crosses them."""
        relations = self.relations or Relations({})
        scopes = [(tenant.scope_of(q), declared) for q, declared in relations.queries(table, read)]
        for scope, declared in scopes:
            self._guard(scope, declared)
        df = relations.find_many(self.spark, table, read, params, self._resolve())
        return self._observed("find many", table.name, scopes[0][0], lambda: [r.asDict(recursive=True) for r in df.collect()])

    def find_by_ids(self, table: TableDef, column: str, keys: list[Any], where: Callable | None = None, cross_tenant: bool = False) -> list[list[dict]]:
        """For each key its rows, by one query; ``where`` binds the tenant."""
        q = from_(table, table.name).select(*table.columns)
        scope = tenant.scope_of(q.where(where) if where else q)
        self._guard(scope, cross_tenant)
        found: dict[Any, list[dict]] = {}
        df = find_all_by(self.spark, table, column, keys, resolve=self._resolve(), where=where)
        for r in self._observed("find by ids", table.name, scope, df.collect):
            found.setdefault(r[column], []).append(r.asDict())
        return [found.get(k, []) for k in keys]

    # Writing.
    def execute(self, write: Insert | Update | Delete, params: dict | None = None) -> list[dict]:
        scope = write.tenant_scope()
        self._guard(scope, False)
        kind = type(write).__name__.lower()

        def work() -> list:
            affected = write.run(self._need(), params)
            rows = affected.collect() if write.returns is not None else []
            affected.unpersist()
            return rows

        return [r.asDict() for r in self._observed(kind, write.table.name, scope, work)]

    def _need(self) -> Store:
        if self.store is None:
            raise ValueError("a session without a root folder cannot write")
        return self.store

    def batch(self, *writes: Insert | Update | Delete) -> list[list[dict]]:
        """All or nothing."""
        return self.transaction(lambda: [self.execute(w) for w in writes])

    def transaction(self, work: Callable[[], Any], retries: int = 3, wait: float = 0.05, isolation: str | None = None, access: str | None = None) -> Any:
        """Nested calls are savepoints. A conflict is tried again, with growing waits."""
        if isolation is not None or access is not None:
            raise QueryBuilderDefect("files have no isolation levels or access modes")
        nested = self._after is not None
        for attempt in range(1 if nested else retries + 1):
            self._after = self._after if nested else []
            try:
                out = self._need().transaction(work)
            except ConflictError:
                if nested or attempt == retries:
                    raise
                time.sleep(wait * 2**attempt)
                continue
            finally:
                after, self._after = self._after, (self._after if nested else None)
            if not nested:
                for call in after or []:
                    call()
            return out
        return None

    def after_commit(self, call: Callable[[], None]) -> None:
        if self._after is None:
            call()
        else:
            self._after.append(call)

    def require_transaction(self) -> None:
        if self._after is None:
            raise ValueError("this needs a transaction")

    def repository(self, table: TableDef, tenant_value: Any = None) -> Repository:
        return Repository(self, table, tenant_value)


@dataclass
class Repository:
    """Rows by primary key; with a tenant value, of that tenant only."""

    session: Session
    table: TableDef
    tenant_value: Any = None

    def _mine(self, r: Any) -> list:
        return [r[self.table.tenant].eq(self.tenant_value)] if self.table.tenant and self.tenant_value is not None else []

    def _key(self, r: Any, key: Any) -> list:
        keys = key if isinstance(key, tuple) else (key,)
        return [r[n].eq(v) for n, v in zip(self.table.primary_key, keys, strict=True)] + self._mine(r)

    def find_by_id(self, key: Any) -> dict | None:
        return self.session.run_option(from_(self.table).select().where(lambda r: self._key(r, key)))

    def find_all(self) -> list[dict]:
        return self.session.run(from_(self.table).select().where(self._mine))

    def insert(self, *rows: dict) -> list[dict]:
        own = {self.table.tenant: self.tenant_value} if self.table.tenant and self.tenant_value is not None else {}
        return self.session.execute(insert_into(self.table).values([r | own for r in rows]).returning(*self.table.columns))

    def update(self, key: Any, changes: dict) -> list[dict]:
        return self.session.execute(update(self.table).set(changes).where(lambda r: self._key(r, key)).returning(*self.table.columns))

    def delete(self, key: Any) -> int:
        return len(self.session.execute(delete_from(self.table).where(lambda r: self._key(r, key)).returning(*self.table.primary_key)))


@dataclass
class Recorder:
    """A test double: plans are recorded, rows are what the test gives."""

    rows: list[list[dict]] = field(default_factory=list)
    seen: list[Any] = field(default_factory=list)

    def run(self, q: Any, params: dict | None = None) -> list[dict]:
        self.seen.append((q, params))
        return self.rows.pop(0) if self.rows else []
