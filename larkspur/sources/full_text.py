"""Full-text search over a table's text columns: match, highlight, snippet and BM25 ranking."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur import types
from larkspur.errors import InvalidArguments, QueryBuilderDefect
from larkspur.expr import Condition, Expr, call, condition
from larkspur.table import TableDef

K1, B = 1.2, 0.75
SPLIT = r"[^\p{L}\p{N}]+"


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(c), SPLIT), lambda x: x != "")


# A small query language: words, "phrases", prefix*, AND (also implicit), OR, NOT, parentheses.
_TOKEN = re.compile(r'\s*(?:(\()|(\))|"([^"]*)"(\*)?|([^\s()"]+))')


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]
    prefix: bool


@dataclass(frozen=True)
class Op:
    name: str
    parts: tuple


def parse(query: str) -> Term | Op:
    items, at = [], 0
    query = query.strip()
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise InvalidArguments(f"no full-text query: {query!r}")
        at = m.end()
        if m[1] or m[2]:
            items.append(m[1] or m[2])
        elif m[5] in ("AND", "OR", "NOT"):
            items.append(m[5])
        else:
            raw = m[3] if m[3] is not None else m[5]
            prefix = bool(m[4]) or (m[5] is not None and raw.endswith("*"))
            words = tuple(w for w in re.split(r"[^\w]+|_", raw.lower()) if w)
            if words:
                items.append(Term(words, prefix))
    out, rest = _or(items)
    if rest:
        raise InvalidArguments(f"no full-text query: {query!r}")
    return out


def _or(items: list) -> tuple:
    left, rest = _and(items)
    parts = [left]
    while rest and rest[0] == "OR":
        more, rest = _and(rest[1:])
        parts.append(more)
    return (parts[0] if len(parts) == 1 else Op("OR", tuple(parts))), rest


def _and(items: list) -> tuple:
    left, rest = _one(items)
    while rest and rest[0] not in ("OR", ")"):
        if rest[0] == "NOT":
            right, rest = _one(rest[1:])
            left = Op("NOT", (left, right))
            continue
        right, rest = _one(rest[1:] if rest[0] == "AND" else rest)
        left = Op("AND", (left, right))
    return left, rest


def _one(items: list) -> tuple:
    if not items or items[0] in ("AND", "OR", "NOT", ")"):
        raise InvalidArguments("a full-text query ends too early")
    if items[0] == "(":
        inner, rest = _or(items[1:])
        if not rest or rest[0] != ")":
            raise InvalidArguments("an open parenthesis")
        return inner, rest[1:]
    return items[0], items[1:]


def terms(node: Term | Op) -> list[Term]:
    if isinstance(node, Term):
        return [node]
    parts = node.parts[:1] if node.name == "NOT" else node.parts
    return [t for p in parts for t in terms(p)]


def test(node: Term | Op, words: Column) -> Column:
    """Whether a document's words satisfy the query. A phrase is a run of equal words."""
    if isinstance(node, Op):
        if node.name == "NOT":
            return test(node.parts[0], words) & ~test(node.parts[1], words)
        return reduce((lambda a, b: a & b) if node.name == "AND" else (lambda a, b: a | b), [test(p, words) for p in node.parts])
    if len(node.words) == 1 and not node.prefix:
        return F.array_contains(words, node.words[0])
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.contains(text, F.lit(" " + " ".join(node.words) + ("" if node.prefix else " ")))


def fts_match(x: Expr, query: str) -> Condition:
    node = parse(query)
    return condition(f"match({x.text}, {query!r})", (x,), lambda c: F.coalesce(test(node, tokens(c)), F.lit(False)))


def _pattern(node: Term | Op) -> str:
    each = [r"[^\p{L}\p{N}]+".join(re.escape(w) for w in t.words) + ("" if not t.prefix else r"[\p{L}\p{N}]*") for t in terms(node)]
    return r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(sorted(each, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"


def highlight(x: Expr, query: str, start: str = "<b>", end: str = "</b>") -> Expr:
    """The text with its matches marked; null for null."""
    safe = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return call(f"highlight[{query}]", (x,), lambda c: F.regexp_replace(c, _pattern(parse(query)), f"{safe(start)}$1{safe(end)}"), x.type)


def snippet(x: Expr, query: str, start: str = "<b>", end: str = "</b>", gap: str = "...", n: int = 16) -> Expr:
    """At most n words around the first match, marked; from the beginning where nothing matches."""
    if not 1 <= n <= 64:
        raise InvalidArguments("a snippet has 1 to 64 words")
    node = parse(query)
    wanted = terms(node)

    def build(c: Column) -> Column:
        words = F.split(F.trim(c), r"\s+")
        bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", ""))
        hit = lambda w: reduce(lambda a, b: a | b, [w.startswith(t.words[0]) if t.prefix else w == t.words[0] for t in wanted])
        at = F.array_position(F.transform(bare, hit), True)
        begin = F.greatest(F.lit(1), F.least(at - n // 2, F.size(words) - n + 1)).cast("int")
        part = F.array_join(F.slice(words, begin, n), " ")
        safe = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
        marked = F.regexp_replace(part, _pattern(node), f"{safe(start)}$1{safe(end)}")
        return F.concat(F.when(begin > 1, gap).otherwise(""), marked, F.when(begin + n <= F.size(words), gap).otherwise(""))

    return call(f"snippet[{query},{n}]", (x,), build, x.type)


def bm25(docs: DataFrame, query: str, text_cols: list[str], weights: list[float] | None = None, id_col: str = "id") -> DataFrame:
    """id and rank (lower is better) of the documents that match.

    Lengths and document frequencies come from one pass over all documents; only the query's own
    few counts meet the matching rows, so nothing is exploded.
    """
    node, weights = parse(query), weights or [1.0] * len(text_cols)
    wanted = terms(node)
    words = [tokens(F.coalesce(F.col(c), F.lit(""))) for c in text_cols]
    held = docs.select(F.col(id_col).alias("id"), *[w.alias(f"w{k}") for k, w in enumerate(words)])
    count = lambda t, k: F.size(F.filter(F.col(f"w{k}"), lambda x: x.startswith(t.words[0]) if t.prefix else x == t.words[0])) if len(t.words) == 1 else _phrase_count(t, F.col(f"w{k}"))
    everything = reduce(F.concat, [F.col(f"w{k}") for k in range(len(text_cols))])
    held = held.select("id", F.size(everything).alias("size"), test(node, everything).alias("hit"), *[reduce(lambda a, b: a + b, [count(t, k) * F.lit(float(weights[k])) for k in range(len(text_cols))]).alias(f"tf{j}") for j, t in enumerate(wanted)])
    stats = held.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"tf{j}") > 0).alias(f"df{j}") for j in range(len(wanted))]).first()
    n, mean = stats["n"], stats["mean"] or 1.0
    score = F.lit(0.0)
    for j in range(len(wanted)):
        import math

        idf = max(1e-6, math.log((n - stats[f"df{j}"] + 0.5) / (stats[f"df{j}"] + 0.5)))
        tf = F.col(f"tf{j}")
        score = score - F.lit(idf) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("size") / F.lit(mean)))
    return held.where("hit").select("id", score.alias("rank"))


@dataclass(frozen=True)
class FullTextTable:
    """A table searched over several text columns at once."""

    table: TableDef
    columns: tuple[str, ...]

    def _all(self, row: Any) -> Expr:
        parts = [row[c] for c in self.columns]
        return call("text", tuple(parts), lambda *cs: F.concat_ws("\n", *cs), types.string)

    def match(self, row: Any, query: str) -> Condition:
        """Whether the row's text columns together satisfy the query."""
        return fts_match(self._all(row), query)

    def highlight(self, row: Any, column: str, query: str, start: str = "<b>", end: str = "</b>") -> Expr:
        return highlight(row[column], query, start, end)

    def snippet(self, row: Any, column: str, query: str, **options: Any) -> Expr:
        return snippet(row[column], query, **options)

    def ranked(self, df: DataFrame, query: str, weights: list[float] | None = None, id_col: str = "id") -> DataFrame:
        return bm25(df, query, list(self.columns), weights, id_col)


def full_text_table(table: TableDef, *columns: str) -> FullTextTable:
    unknown = [c for c in columns if c not in table.columns]
    if unknown or not columns:
        raise QueryBuilderDefect(f"{table.name} has no text column {unknown[:1] or ''}")
    return FullTextTable(table, columns)


def _phrase_count(t: Term, words: Column) -> Column:
    n = len(t.words)
    wanted = F.array(*[F.lit(w) for w in t.words])
    return F.size(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.slice(words, i, n) == wanted), lambda x: x))
