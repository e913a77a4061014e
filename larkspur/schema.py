"""Schema snapshots, differences, statements and a migration runner with a ledger."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.errors import ConflictError, QueryBuilderDefect
from larkspur.operators.store import Store
from larkspur.table import TableDef

ENGINES = ("plain", "summing", "replacing", "aggregating")


def snapshot(tables: list[TableDef]) -> dict:
    """A canonical record of the tables that are managed; external ones are left out."""
    out = {}
    for t in sorted((t for t in tables if not t.external), key=lambda t: t.name):
        if t.engine not in ENGINES:
            raise QueryBuilderDefect(f"no engine {t.engine}")
        out[t.name] = {
            "columns": {n: {"type": c.name, "spark": c.spark.simpleString(), "nullable": c.is_nullable, "merge": c.merge} for n, c in t.columns.items()},
            "primary_key": list(t.primary_key), "unique": [list(u) for u in t.unique], "foreign_keys": {k: list(v) for k, v in t.foreign_keys.items()}, "checks": t.checks,
            "partition_by": list(t.partition_by), "order_by": list(t.order_by), "engine": t.engine, "ttl": t.ttl, "computed": t.computed, "indexes": list(t.indexes),
        }
    return out


def canonical(snap: dict) -> str:
    return json.dumps(snap, sort_keys=True, separators=(",", ":"))


def digest(snap: dict) -> str:
    return hashlib.sha256(canonical(snap).encode()).hexdigest()


@dataclass(frozen=True)
class Op:
    kind: str
    table: str
    detail: dict = field(default_factory=dict)


def diff(before: dict, after: dict, renames: dict[str, str] | None = None) -> list[Op]:
    """Steps from one snapshot to the other. renames: 'old' -> 'new' for tables, 'table.old' -> 'new' for columns."""
    renames, ops, names = renames or {}, [], {}
    for old in before:
        new = renames.get(old, old)
        names[new] = old
        if new not in after:
            ops.append(Op("drop_table", old))
        elif new != old:
            ops.append(Op("rename_table", old, {"to": new}))
    for name, t in after.items():
        if names.get(name) is None:
            ops.append(Op("create_table", name, t))
            continue
        old = before[names[name]]
        moved = {renames.get(f"{name}.{c}", c): c for c in old["columns"]}
        for c, was in moved.items():
            if c not in t["columns"]:
                ops.append(Op("drop_column", name, {"column": was}))
            elif c != was:
                ops.append(Op("rename_column", name, {"column": was, "to": c}))
        for c, spec in t["columns"].items():
            if c not in moved:
                ops.append(Op("add_column", name, {"column": c, **spec}))
            elif old["columns"][moved[c]] != spec:
                ops.append(Op("modify_column", name, {"column": c, "from": old["columns"][moved[c]], **spec}))
        for part in ("engine", "order_by", "partition_by"):
            if old[part] != t[part]:
                raise QueryBuilderDefect(f"{name}: {part} cannot change in place; make a new table")
        for part in ("primary_key", "unique", "foreign_keys", "checks", "ttl", "computed", "indexes"):
            if old[part] != t[part]:
                ops.append(Op("set_" + part, name, {"value": t[part]}))
    return ops


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def render(op: Op) -> str | None:
    """Spark SQL for a step, where a catalog can do it; constraints live in the writer."""
    t, d = _ident(op.table), op.detail
    if op.kind == "create_table":
        columns = ", ".join(f"{_ident(n)} {c['spark']}" + ("" if c["nullable"] else " NOT NULL") for n, c in d["columns"].items())
        by = f" PARTITIONED BY ({', '.join(map(_ident, d['partition_by']))})" if d["partition_by"] else ""
        return f"CREATE TABLE {t} ({columns}) USING parquet{by}"
    return {
        "drop_table": lambda: f"DROP TABLE {t}",
        "rename_table": lambda: f"ALTER TABLE {t} RENAME TO {_ident(d['to'])}",
        "add_column": lambda: f"ALTER TABLE {t} ADD COLUMNS ({_ident(d['column'])} {d['spark']})",
        "drop_column": lambda: f"ALTER TABLE {t} DROP COLUMN {_ident(d['column'])}",
        "rename_column": lambda: f"ALTER TABLE {t} RENAME COLUMN {_ident(d['column'])} TO {_ident(d['to'])}",
        "modify_column": lambda: f"ALTER TABLE {t} ALTER COLUMN {_ident(d['column'])} TYPE {d['spark']}",
    }.get(op.kind, lambda: None)()


def rewrite(df: DataFrame, op: Op) -> DataFrame:
    """A step on a versioned table's rows."""
    d = op.detail
    if op.kind == "add_column":
        return df.withColumn(d["column"], F.lit(None).cast(d["spark"]))
    if op.kind == "drop_column":
        return df.drop(d["column"])
    if op.kind == "rename_column":
        return df.withColumnRenamed(d["column"], d["to"])
    if op.kind == "modify_column":
        return df.withColumn(d["column"], F.col(_ident(d["column"])).try_cast(d["spark"]))
    return df


def expired(df: DataFrame, ttl: str) -> DataFrame:
    """Rows that a table's time-to-live condition (Spark SQL, true: keep) leaves."""
    return df.where(F.coalesce(F.expr(ttl), F.lit(True)))


@dataclass(frozen=True)
class Migration:
    id: str
    steps: tuple[Any, ...]  # callables of a store, or SQL text
    checksum: str = ""

    def digest(self) -> str:
        return self.checksum or hashlib.sha256(repr([s if isinstance(s, str) else s.__name__ for s in self.steps]).encode()).hexdigest()


class Runner:
    """Runs migrations once each. A step is journalled before it starts and after it ends; one that
    began and did not end is uncertain and is never run again by itself."""

    def __init__(self, store: Store, lease_s: float = 600):
        self.store, self.lease_s, self.path = store, lease_s, f"{store.root}/_migrations"

    def ledger(self) -> dict:
        return json.loads(self.store._read(self.path) or '{"done": {}, "journal": {}, "lease": null}')

    def _save(self, ledger: dict) -> None:
        self.store._write(self.path, json.dumps(ledger, sort_keys=True))

    def status(self, migrations: list[Migration]) -> dict[str, str]:
        ledger = self.ledger()
        return {m.id: "changed" if m.id in ledger["done"] and ledger["done"][m.id] != m.digest() else "done" if m.id in ledger["done"] else "uncertain" if ledger["journal"].get(m.id, {}).get("state") == "running" else "pending" for m in migrations}

    def run(self, migrations: list[Migration], owner: str = "runner") -> list[str]:
        ledger = self.ledger()
        lease = ledger["lease"]
        if lease and lease["owner"] != owner and lease["until"] > time.time():
            raise ConflictError(f"{lease['owner']} is migrating")
        ledger["lease"] = {"owner": owner, "until": time.time() + self.lease_s}
        self._save(ledger)
        ran = []
        try:
            for m in migrations:
                state = self.status([m])[m.id]
                if state == "done":
                    continue
                if state != "pending":
                    raise ConflictError(f"migration {m.id} is {state}")
                first = ledger["journal"].get(m.id, {}).get("next", 0)
                for k in range(first, len(m.steps)):
                    ledger["journal"][m.id] = {"state": "running", "next": k}
                    self._save(ledger)
                    step = m.steps[k]
                    self.store.spark.sql(step) if isinstance(step, str) else step(self.store)
                    ledger["journal"][m.id] = {"state": "between", "next": k + 1}
                    self._save(ledger)
                ledger["done"][m.id] = m.digest()
                self._save(ledger)
                ran.append(m.id)
        finally:
            ledger["lease"] = None
            self._save(ledger)
        return ran

    def resolve(self, id: str, applied: bool) -> None:
        """Say whether an uncertain step took effect."""
        ledger = self.ledger()
        entry = ledger["journal"][id]
        ledger["journal"][id] = {"state": "between", "next": entry["next"] + int(applied)}
        self._save(ledger)

    def baseline(self, migrations: list[Migration]) -> None:
        ledger = self.ledger()
        ledger["done"].update({m.id: m.digest() for m in migrations})
        self._save(ledger)


def verify(store: Store, tables: list[TableDef]) -> list[str]:
    """Where stored files differ from the definitions."""
    out = []
    for t in tables:
        if t.external:
            continue
        parts = store.parts(t)
        if not parts:
            out.append(f"{t.name}: no data")
            continue
        found = {f.name: f.dataType for f in store.spark.read.parquet(*[f"{store.root}/{t.name}/{p}" for p in parts]).schema.fields}
        out += [f"{t.name}.{n}: missing" for n in t.columns if n not in found]
        out += [f"{t.name}.{n}: {found[n].simpleString()} instead of {c.spark.simpleString()}" for n, c in t.columns.items() if n in found and found[n] != c.spark]
        out += [f"{t.name}.{n}: unknown" for n in found if n not in t.columns]
    return out


def introspect(df: DataFrame, name: str) -> str:
    """Python source of a table definition for a DataFrame's schema."""
    from larkspur.types import of_spark

    known = {"String": "string", "Int64": "int64", "Int32": "int32", "Float64": "float64", "Bool": "boolean", "DateTime64": "date_time64", "date": "date", "blob": "blob", "timestamptz": "timestamptz", "tinyint": "tinyint", "int2": "int2", "float4": "float4"}
    lines = [f'    "{f.name}": ' + (f"t.nullable(t.{known[of_spark(f.dataType).name]})" if of_spark(f.dataType).name in known else f't.custom("{f.dataType.simpleString()}", T._parse_datatype_string("{f.dataType.simpleString()}"))') + "," for f in df.schema.fields]
    return f'{name} = table("{name}", {{\n' + "\n".join(lines) + "\n})\n"
