"""Table definitions: named columns, tenant column, defaults and constraints."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larkspur import types as t
from larkspur.expr import Expr
from larkspur.types import ColType


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: dict[str, ColType]
    tenant: str | None = None
    external: bool = False
    #: column -> value or callable, run once per row on insert
    defaults: dict[str, Any] = field(default_factory=dict)
    #: column -> callable, run once per update
    on_update: dict[str, Callable[[], Any]] = field(default_factory=dict)
    #: column -> Spark SQL over the row's other columns; may not be written
    computed: dict[str, str] = field(default_factory=dict)
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    #: column -> (table, column)
    foreign_keys: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: name -> Spark SQL condition
    checks: dict[str, str] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()
    engine: str = "plain"
    ttl: str | None = None
    indexes: tuple[str, ...] = ()
    source: Callable[[SparkSession], DataFrame] | None = field(default=None, compare=False)

    def schema(self) -> T.StructType:
        return T.StructType([c.field(n) for n, c in self.columns.items()])

    def select_schema(self) -> T.StructType:
        return self.schema()

    def insert_schema(self) -> T.StructType:
        """Computed columns are left out; those with defaults may be missing."""
        return T.StructType([T.StructField(n, c.spark, c.is_nullable or n in self.defaults) for n, c in self.columns.items() if n not in self.computed])

    def update_schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, c.spark, True) for n, c in self.columns.items() if n not in self.computed])


@dataclass(frozen=True)
class TableFunction:
    """A row source made from the columns of earlier sources: ``rows`` gives an array<struct> Column of its columns."""

    name: str
    columns: dict[str, ColType]
    argument: Expr
    rows: Callable[[Any], Any]
    tenant: str | None = None
    #: without a correlated argument: a DataFrame of its own
    frame: Callable[[SparkSession], DataFrame] | None = None


def table(name: str, columns: dict[str, ColType], **options: Any) -> TableDef:
    bad = [c for c in (options.get("tenant"), *options.get("primary_key", ()), *options.get("computed", {}), *options.get("defaults", {})) if c and c not in columns]
    if bad:
        from larkspur.errors import QueryBuilderDefect

        raise QueryBuilderDefect(f"{name} has no column {bad[0]}")
    return TableDef(name, columns, **options)


def parquet_table(name: str, path: str, columns: dict[str, ColType], **options: Any) -> TableDef:
    """An external table over parquet files; csv, json and orc by the path's reader in ``file_table``."""
    return TableDef(name, columns, external=True, source=lambda spark: spark.read.parquet(path), **options)


def file_table(name: str, path: str, columns: dict[str, ColType], format: str, **reader: str) -> TableDef:
    schema = T.StructType([c.field(n) for n, c in columns.items()])
    return TableDef(name, columns, external=True, source=lambda spark: spark.read.format(format).schema(schema).options(**reader).load(path))


def frame_table(name: str, df: DataFrame, columns: dict[str, ColType] | None = None, tenant: str | None = None) -> TableDef:
    """An existing DataFrame as a table; types follow its schema where they are not given."""
    columns = columns or {f.name: t.of_spark(f.dataType) for f in df.schema.fields}
    return TableDef(name, columns, external=True, tenant=tenant, source=lambda spark: df)
