"""Deterministic rows for table definitions, made where they are stored."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.errors import QueryBuilderDefect
from larkspur.table import TableDef


def pick(*values: Any) -> Callable[[Column], Column]:
    """One of the values, by the row's own chance."""
    return lambda h: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(h, F.lit(len(values))) + 1).cast("int"))


def seed(spark: SparkSession, table: TableDef, n: int, overrides: dict[str, Any] | None = None, number: int = 1, tenant_value: Any = None) -> DataFrame:
    """n rows; the same number gives the same rows, however they are partitioned.

    overrides: column -> value, or a function of the row's 64-bit chance. Unique columns count up.
    """
    overrides = dict(overrides or {})
    if table.tenant and tenant_value is not None:
        overrides[table.tenant] = tenant_value
    unknown = set(overrides) - set(table.columns)
    if unknown:
        raise QueryBuilderDefect(f"{table.name} has no column {sorted(unknown)[0]}")
    unique = {c for key in (table.primary_key, *table.unique) if len(key) == 1 for c in key}
    base = spark.range(n)
    columns = []
    for name, kind in table.columns.items():
        h = F.xxhash64(F.col("id"), F.lit(name), F.lit(number))
        if name in table.computed:
            continue
        if name in overrides:
            made = overrides[name](h) if callable(overrides[name]) else F.lit(kind.literal(overrides[name]))
        else:
            made = _value(kind.spark.typeName(), h, name in unique)
            if kind.is_nullable:
                made = F.when(F.pmod(h, F.lit(10)) == 0, None).otherwise(made)
        columns.append(made.cast(kind.spark).alias(name))
    out = base.select(*columns)
    for name, text in table.computed.items():
        out = out.withColumn(name, F.expr(text).cast(table.columns[name].spark))
    return out.select(*table.columns)


def _value(kind: str, h: Column, unique: bool) -> Column:
    if unique:
        return F.concat(F.lit("u"), F.col("id")) if kind == "string" else F.col("id") + 1
    if kind == "string":
        return F.concat(F.lit("s"), F.pmod(h, F.lit(1000)))
    if kind in ("double", "float", "decimal"):
        return F.pmod(h, F.lit(100_000)) / 100
    if kind == "boolean":
        return F.pmod(h, F.lit(2)) == 0
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(h, F.lit(30_000_000)))
    if kind == "binary":
        return F.unhex(F.substring(F.md5(h.cast("string")), 1, 16))
    if kind == "array":
        return F.array()
    if kind == "map":
        return F.create_map()
    return F.pmod(h, F.lit(100))
