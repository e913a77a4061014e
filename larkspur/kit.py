"""Command line: generate, pull, check, status, migrate, verify, baseline, resolve.

python -m larkspur.kit COMMAND MODULE [ROOT]: MODULE has TABLES (definitions) and MIGRATIONS.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from larkspur import schema
from larkspur.operators.store import Store


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="larkspur.kit", description=__doc__)
    parser.add_argument("command", choices=["generate", "pull", "check", "status", "migrate", "verify", "baseline", "resolve"])
    parser.add_argument("module")
    parser.add_argument("root", nargs="?", default=".")
    parser.add_argument("--snapshot", help="file of the last snapshot")
    parser.add_argument("--id")
    parser.add_argument("--applied", action="store_true")
    made = parser.parse_args(args)
    if made.command == "pull":
        from pyspark.sql import SparkSession

        print(schema.introspect(SparkSession.builder.getOrCreate().read.parquet(made.module), made.module.rstrip("/").split("/")[-1].removesuffix(".parquet")))
        return 0
    module = importlib.import_module(made.module)
    if made.command in ("generate", "check"):
        before = json.load(open(made.snapshot)) if made.snapshot else {}
        ops = schema.diff(before, schema.snapshot(module.TABLES), getattr(module, "RENAMES", None))
        for op in ops:
            print(schema.render(op) or json.dumps([op.kind, op.table, op.detail]))
        return int(bool(ops)) if made.command == "check" else 0
    from pyspark.sql import SparkSession

    store = Store(SparkSession.builder.getOrCreate(), made.root)
    runner = schema.Runner(store)
    if made.command == "status":
        print(json.dumps(runner.status(module.MIGRATIONS), indent=1))
    elif made.command == "migrate":
        print(json.dumps(runner.run(module.MIGRATIONS)))
    elif made.command == "baseline":
        runner.baseline(module.MIGRATIONS)
    elif made.command == "resolve":
        runner.resolve(made.id, made.applied)
    else:
        found = schema.verify(store, module.TABLES)
        print("\n".join(found))
        return int(bool(found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
