"""The function catalog: set and name -> builder. A coverage test reads it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur import types as t
from larkspur.errors import QueryBuilderDefect
from larkspur.expr import Condition, Expr, call, condition, lift
from larkspur.types import ColType

REGISTRY: dict[tuple[str, str], Callable] = {}


def register(set_name: str, *names: str) -> Callable[[Callable], Callable]:
    def add(fn: Callable) -> Callable:
        for name in names or (fn.__name__,):
            REGISTRY[(set_name, name)] = fn
        return fn

    return add


def null(kind: ColType | None) -> ColType | None:
    return t.nullable(kind) if kind else None


def type_of(x: Any) -> ColType | None:
    return lift(x).type


def first_typed(*xs: Any) -> ColType | None:
    return next((e.type for e in map(lift, xs) if e.type is not None and e.type.name != "untyped"), None)


def agg(name: str, x: Any, build: Callable[[Column], Column], type: ColType | None, *more: Any) -> Expr:
    return call(name, (x, *more), build, type, agg=True)


def chosen(c: Column, cond: Column) -> Column:
    return F.when(cond, c)


# Rules for functions that a caller defines.
def same_as(k: int) -> Callable[..., ColType | None]:
    return lambda *args: lift(args[k]).type


def element_of(k: int) -> Callable[..., ColType | None]:
    return lambda *args: lift(args[k]).type.element


def array_of_arg(k: int) -> Callable[..., ColType | None]:
    return lambda *args: t.array(lift(args[k]).type)


def define_fn(name: str, rule: ColType | Callable[..., ColType | None], aggregate: bool = False) -> Callable[..., Expr]:
    """A function that Spark knows by name (built in or registered), with a rule for its result type."""
    return lambda *args: call(name, args, lambda *cs: F.call_function(name, *cs), rule if isinstance(rule, ColType) else rule(*args), agg=aggregate)


def define_cond_fn(name: str) -> Callable[..., Condition]:
    return lambda *args: condition(f"{name}(...)", tuple(map(lift, args)), lambda *cs: F.call_function(name, *cs))


def define_untyped_fn(name: str) -> Callable[..., Expr]:
    return lambda *args: call(name, args, lambda *cs: F.call_function(name, *cs))


def assert_set(set_name: str, *exprs: Any) -> None:
    """Strict mode: refuse a function of another set by the prefix that its module gives its text."""
    for e in exprs:
        text = lift(e).text
        for (owner, name) in REGISTRY:
            if owner != set_name and text.startswith(f"{name}(") and (set_name, name) not in REGISTRY:
                raise QueryBuilderDefect(f"{name} belongs to {owner}, not to {set_name}")
