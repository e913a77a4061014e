"""A harness for query benchmarks: runs, statistics, comparisons and budgets."""

from __future__ import annotations

import hashlib
import math
import re
import statistics
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

PASS, REGRESSION, INVALID, INCONCLUSIVE = 0, 1, 2, 3


@dataclass(frozen=True)
class Case:
    id: str
    make: Callable[[SparkSession], DataFrame]
    ordered: bool = False
    check_result: bool = True


@dataclass
class Result:
    id: str
    wall_ms: list[float] = field(default_factory=list)
    rows: int = 0
    result_hash: str | None = None
    fingerprint: str = ""
    error: str | None = None

    def stats(self) -> dict[str, float]:
        xs = sorted(self.wall_ms)
        rank = lambda q: xs[max(0, math.ceil(q * len(xs)) - 1)]
        return {"p50_wall_ms": rank(0.5), "p95_wall_ms": rank(0.95), "p99_wall_ms": rank(0.99), "stddev_ms": statistics.stdev(xs) if len(xs) > 1 else 0.0}


def fingerprint(text: str) -> str:
    """A statement's shape: literals, blanks and expression ids do not count."""
    text = re.sub(r"'(?:[^']|'')*'", "?", text)
    text = re.sub(r"#\d+L?", "", text)
    text = re.sub(r"\b\d+(?:\.\d+)?\b", "?", text)
    return hashlib.sha256(re.sub(r"\s+", " ", text).strip().lower().encode()).hexdigest()[:16]


def explain(df: DataFrame, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def result_hash(rows: list, ordered: bool) -> str:
    texts = [repr(tuple(r)) for r in rows]
    return hashlib.sha256("\n".join(texts if ordered else sorted(texts)).encode()).hexdigest()


def run_suite(spark: SparkSession, cases: list[Case], runs: int = 20, warmup: int = 2, timeout_s: float = 30) -> list[Result]:
    """Serial runs in rotating order; warm-ups do not count. A case that fails or takes too long stops."""
    if not 1 <= runs <= 1000 or not 0 <= warmup <= 100 or not 1 <= timeout_s <= 3600:
        raise ValueError("1 to 1000 runs, 0 to 100 warm-ups and 1 to 3600 seconds")
    results = {c.id: Result(c.id) for c in cases}
    for k in range(warmup + runs):
        turn = k % len(cases)
        for case in [*cases[turn:], *cases[:turn]]:
            r = results[case.id]
            if r.error:
                continue
            try:
                df = case.make(spark)
                began = time.perf_counter()
                rows = df.collect()
                took = time.perf_counter() - began
            except Exception as error:
                r.error = str(error)[:300]
                continue
            if took > timeout_s:
                r.error = f"it took {took:.1f} s"
            if k >= warmup:
                r.wall_ms.append(took * 1000)
            if not r.fingerprint:
                r.fingerprint, r.rows = fingerprint(explain(df, "simple")), len(rows)
                r.result_hash = result_hash(rows, case.ordered) if case.check_result else None
    return list(results.values())


def compare_runs(before: list[Result], after: list[Result], metric: str = "p95_wall_ms", threshold: float = 0.10, min_delta: float = 0.0) -> dict[str, Any]:
    """A regression is worse by more than the threshold and the least difference."""
    old, out, code = {r.id: r for r in before}, [], PASS
    for r in after:
        if r.id not in old or r.error or old[r.id].error or not r.wall_ms or not old[r.id].wall_ms:
            out.append({"id": r.id, "verdict": "inconclusive"})
            code = max(code, INCONCLUSIVE) if code != INVALID else code
            continue
        o = old[r.id]
        if r.result_hash != o.result_hash:
            out.append({"id": r.id, "verdict": "invalid", "why": "results differ"})
            code = INVALID
            continue
        a, b = o.stats()[metric], r.stats()[metric]
        worse = b - a > min_delta and b > a * (1 + threshold)
        noisy = min(len(r.wall_ms), len(o.wall_ms)) < 20 and metric in ("p95_wall_ms", "p99_wall_ms")
        out.append({"id": r.id, "verdict": "regression" if worse else "pass", "before": a, "after": b, "noisy": noisy})
        if worse and code == PASS:
            code = REGRESSION
    return {"cases": out, "exit_code": code}


def compare_budgets(results: list[Result], budgets: dict[str, dict[str, float]]) -> dict[str, Any]:
    """budgets: case -> metric -> most."""
    over = [{"id": r.id, "metric": m, "value": r.stats()[m], "most": most} for r in results if r.wall_ms for m, most in budgets.get(r.id, {}).items() if r.stats()[m] > most]
    return {"over": over, "exit_code": REGRESSION if over else PASS}


def as_json(results: list[Result]) -> list[dict]:
    return [asdict(r) | (r.stats() if r.wall_ms else {}) for r in results]


def main(args: list[str] | None = None) -> int:
    """python -m larkspur.harness run MODULE [--runs N] > FILE, or compare FILE FILE: MODULE has CASES."""
    import argparse
    import importlib
    import json
    import sys

    parser = argparse.ArgumentParser(prog="larkspur.harness")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("module")
    run.add_argument("--runs", type=int, default=20)
    run.add_argument("--warmup", type=int, default=2)
    run.add_argument("--timeout", type=float, default=30)
    compare = commands.add_parser("compare")
    compare.add_argument("before")
    compare.add_argument("after")
    compare.add_argument("--metric", default="p95_wall_ms")
    compare.add_argument("--threshold", type=float, default=0.10)
    compare.add_argument("--min-delta", type=float, default=0.0)
    made = parser.parse_args(args)
    if made.command == "run":
        results = run_suite(SparkSession.builder.getOrCreate(), importlib.import_module(made.module).CASES, made.runs, made.warmup, made.timeout)
        json.dump(as_json(results), sys.stdout, indent=1)
        return INVALID if any(r.error for r in results) else PASS
    load = lambda path: [Result(**{k: r[k] for k in ("id", "wall_ms", "rows", "result_hash", "fingerprint", "error")}) for r in json.load(open(path))]
    found = compare_runs(load(made.before), load(made.after), made.metric, made.threshold, made.min_delta)
    json.dump(found, sys.stdout, indent=1)
    return found["exit_code"]


if __name__ == "__main__":
    raise SystemExit(main())
