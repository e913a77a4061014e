"""The columnar set: aggregates, strings, numbers, dates, arrays, maps, JSON."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur import types as t
from larkspur.errors import InvalidArguments
from larkspur.expr import Condition, Expr, call, condition, default_of, lift
from larkspur.functions import window
from larkspur.functions.registry import agg, chosen, first_typed, null, register, type_of

SET = "olap"
olap = register(SET)


def _named(*names: str):
    return register(SET, *names)


# Aggregates.
@olap
def count() -> Expr:
    return call("count", (), lambda: F.count(F.lit(1)), t.int64, agg=True)


@_named("countIf")
def count_if(cond: Condition) -> Expr:
    return agg("countIf", cond, lambda c: F.count_if(c), t.int64)


@olap
def sum(x: Any) -> Expr:
    """0 over nothing."""
    return agg("sum", x, lambda c: F.coalesce(F.sum(c), F.lit(0)), type_of(x))


@_named("sumIf")
def sum_if(x: Any, cond: Condition) -> Expr:
    return agg("sumIf", x, lambda c, k: F.coalesce(F.sum(chosen(c, k)), F.lit(0)), type_of(x), cond)


@olap
def avg(x: Any) -> Expr:
    return agg("avg", x, lambda c: F.avg(c), t.nullable(t.float64))


@_named("avgIf")
def avg_if(x: Any, cond: Condition) -> Expr:
    return agg("avgIf", x, lambda c, k: F.avg(chosen(c, k)), t.nullable(t.float64), cond)


@_named("min")
def min_(x: Any) -> Expr:
    return agg("min", x, F.min, null(type_of(x)))


@_named("max")
def max_(x: Any) -> Expr:
    return agg("max", x, F.max, null(type_of(x)))


@_named("minIf")
def min_if(x: Any, cond: Condition) -> Expr:
    return agg("minIf", x, lambda c, k: F.min(chosen(c, k)), null(type_of(x)), cond)


@_named("maxIf")
def max_if(x: Any, cond: Condition) -> Expr:
    return agg("maxIf", x, lambda c, k: F.max(chosen(c, k)), null(type_of(x)), cond)


@_named("any")
def any_(x: Any) -> Expr:
    return agg("any", x, lambda c: F.any_value(c, ignoreNulls=F.lit(True)), null(type_of(x)))


@_named("anyIf")
def any_if(x: Any, cond: Condition) -> Expr:
    return agg("anyIf", x, lambda c, k: F.any_value(chosen(c, k), ignoreNulls=F.lit(True)), null(type_of(x)), cond)


@olap
def uniq(x: Any) -> Expr:
    """An estimate."""
    return agg("uniq", x, lambda c: F.approx_count_distinct(c), t.int64)


@_named("uniqIf")
def uniq_if(x: Any, cond: Condition) -> Expr:
    return agg("uniqIf", x, lambda c, k: F.approx_count_distinct(chosen(c, k)), t.int64, cond)


@_named("uniqExact")
def uniq_exact(x: Any) -> Expr:
    return agg("uniqExact", x, lambda c: F.count_distinct(c), t.int64)


@olap
def quantile(q: float):
    """quantile(0.5)(x): exact, interpolated."""
    if not 0 <= q <= 1:
        raise InvalidArguments("a quantile is between 0 and 1")
    return lambda x: agg(f"quantile[{q}]", x, lambda c: F.percentile(c, F.lit(q)), t.nullable(t.float64))


@_named("groupUniqArray")
def group_uniq_array(x: Any) -> Expr:
    return agg("groupUniqArray", x, lambda c: F.sort_array(F.collect_set(c)), t.array(type_of(x) or t.untyped()))


@_named("groupUniqArrayArray")
def group_uniq_array_array(x: Any) -> Expr:
    return agg("groupUniqArrayArray", x, lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_set(c)))), type_of(x))


@_named("groupUniqArrayIf")
def group_uniq_array_if(n: int):
    return lambda x, cond: agg(f"groupUniqArrayIf[{n}]", x, lambda c, k: F.slice(F.sort_array(F.collect_set(chosen(c, k))), 1, n), t.array(type_of(x) or t.untyped()), cond)


@_named("argMin")
def arg_min(value: Any, by: Any) -> Expr:
    return agg("argMin", value, lambda v, b: F.min_by(v, b), null(type_of(value)), by)


@_named("argMax")
def arg_max(value: Any, by: Any) -> Expr:
    return agg("argMax", value, lambda v, b: F.max_by(v, b), null(type_of(value)), by)


@_named("argMaxState")
def arg_max_state(value: Any, by: Any) -> Expr:
    """A partial argMax that further rows can be merged into."""
    return agg("argMaxState", value, lambda v, b: F.max(F.struct(b.alias("by"), v.alias("value"))), t.aggregate_state("argMax", type_of(by), type_of(value)), by)


@_named("argMaxMerge")
def arg_max_merge(state: Any) -> Expr:
    kind = type_of(state)
    return agg("argMaxMerge", state, lambda s: F.max(s)["value"], null(kind.element) if kind and kind.element else None)


MODES = ("strict_order", "strict_deduplication", "strict_increase")


@_named("windowFunnel")
def window_funnel(seconds: int, *modes: str):
    """windowFunnel(w)(ts, c1, ..., cn): the longest chain of steps, in order, within w seconds of its first.

    For each step the fold keeps the latest start of a chain that has reached it, so one pass over
    a user's events suffices. strict_increase asks for growing times; strict_deduplication ends
    at a step that comes again; strict_order ends at an event that is none of the next steps.
    """
    if any(m not in MODES for m in modes):
        raise InvalidArguments(f"modes are {MODES}")

    def make(ts: Any, *conds: Condition) -> Expr:
        if not conds:
            raise InvalidArguments("a funnel has steps")
        n = len(conds)

        def build(at: Column, *steps: Column) -> Column:
            return _funnel(at, steps, seconds, modes, n)

        return agg(f"windowFunnel[{seconds},{modes}]", ts, build, t.uint8, *conds)

    return make


def _funnel(at: Column, steps: tuple[Column, ...], seconds: int, modes: tuple[str, ...], n: int) -> Column:
    hit = F.concat(*[F.when(s, F.lit("1")).otherwise(F.lit("0")) for s in steps])
    stamp = at.cast("timestamp").cast("double")
    events = F.array_sort(F.collect_list(F.when(at.isNotNull() & ((hit.contains("1")) | F.lit("strict_order" in modes)), F.struct(stamp.alias("at"), hit.alias("hit")))))
    start = F.struct(
        F.array(*[F.lit(None).cast("double") for _ in range(n)]).alias("began"),
        F.array(*[F.lit(None).cast("double") for _ in range(n)]).alias("last"),
        F.lit(False).alias("over"),
        F.lit(0).alias("best"),
    )

    def step(state: Column, event: Column) -> Column:
        began, last = [], []
        grows = "strict_increase" in modes
        for k in range(n):
            on = F.substring(event["hit"], k + 1, 1) == "1"
            own, seen = state["began"][k], state["last"][k]
            if k == 0:
                began.append(F.when(on, event["at"]).otherwise(own))
                last.append(F.when(on, event["at"]).otherwise(seen))
                continue
            before, when = state["began"][k - 1], state["last"][k - 1]
            ok = on & before.isNotNull() & (event["at"] <= before + F.lit(float(seconds)))
            if grows:
                ok = ok & (event["at"] > when)
            began.append(F.when(ok, F.greatest(before, own)).otherwise(own))
            last.append(F.when(ok, event["at"]).otherwise(seen))
        reached = F.lit(0)
        for k in range(n):
            reached = F.when(began[k].isNotNull(), F.lit(k + 1)).otherwise(reached)
        over = state["over"]
        if "strict_order" in modes:
            # In a chain, an event that is neither its first step again nor the next one breaks it.
            expected = F.substring(event["hit"], state["best"] + 1, 1) == "1"
            over = over | ((state["best"] > 0) & (state["best"] < n) & ~expected & ~(F.substring(event["hit"], 1, 1) == "1"))
        if "strict_deduplication" in modes:
            again = F.lit(False)
            for k in range(n):
                again = again | ((F.substring(event["hit"], k + 1, 1) == "1") & (state["best"] > k) & ~(F.substring(event["hit"], state["best"] + 1, 1) == "1"))
            over = over | again
        now = F.struct(F.array(*began).alias("began"), F.array(*last).alias("last"), over.alias("over"), F.greatest(state["best"], reached).alias("best"))
        kept = F.struct(state["began"].alias("began"), state["last"].alias("last"), F.lit(True).alias("over"), state["best"].alias("best"))
        return F.when(over, kept).otherwise(now)

    return F.coalesce(F.aggregate(events, start, step)["best"], F.lit(0)).cast("short")


_TOKEN = re.compile(r"\(\?(\d+)\)|\.\*|\.|\(\?t(<=|>=|<|>|==)(\d+)\)")


@_named("sequenceMatch")
def sequence_match(pattern: str):
    """sequenceMatch(pattern)(ts, c1, ..., cn): 1 if the events in time order match, else 0.

    Events become characters that stand for the set of conditions they meet, and the pattern a
    regular expression over them. Time conditions need the events themselves and are folded.
    """
    at, tokens = 0, []
    while at < len(pattern):
        m = _TOKEN.match(pattern, at)
        if not m:
            raise InvalidArguments(f"a sequence pattern has (?N), ., .* and (?t op seconds): {pattern!r}")
        tokens.append(m)
        at = m.end()

    def make(ts: Any, *conds: Condition) -> Expr:
        n = len(conds)
        if not n or any(m[1] and not 1 <= int(m[1]) <= n for m in tokens):
            raise InvalidArguments("the pattern names a condition that is not there")

        def build(stamp: Column, *cs: Column) -> Column:
            mask = F.lit(0)
            for k, c in enumerate(cs):
                mask = mask + F.when(c, F.lit(1 << k)).otherwise(F.lit(0))
            if n > 12:
                raise InvalidArguments("a sequence has 12 conditions at most")
            # Characters from U+4E00 on: one for each set of conditions.
            event = F.struct(stamp.alias("at"), F.decode(F.unhex(F.lpad(F.hex(mask + F.lit(0x4E00)), 4, "0")), "UTF-16BE").alias("c"), stamp.cast("timestamp").cast("double").alias("s"))
            events = F.array_sort(F.collect_list(F.when(stamp.isNotNull() & (mask > 0), event)))
            if any(m[2] for m in tokens):
                return _timed(events, tokens, n)
            regex = "".join(_chars(int(m[1]), n) if m[1] else m[0] for m in tokens)
            return F.array_join(F.transform(events, lambda e: e["c"]), "").rlike("(?s)" + regex).cast("short")

        return agg(f"sequenceMatch[{pattern}]", ts, build, t.uint8, *conds)

    return make


def _chars(k: int, n: int) -> str:
    return "[" + "".join(chr(0x4E00 + mask) for mask in range(1, 1 << n) if mask >> (k - 1) & 1) + "]"


_OPS = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "==": lambda a, b: a == b}


def _within(event: Column, op: str, seconds: int) -> Any:
    return lambda x: (x < 0) | _OPS[op](event["s"] - x, F.lit(float(seconds)))


def _timed(events: Column, tokens: list, n: int) -> Column:
    """A nondeterministic automaton: after each event, for each place in the pattern, the times of the last matched event."""
    places: list[tuple[str, Any]] = []
    for m in tokens:
        if m[2]:
            if not places:
                raise InvalidArguments("a time condition follows a condition")
            places.append(("t", (m[2], int(m[3]))))
        elif m[1]:
            places.append(("c", int(m[1])))
        else:
            places.append((m[0], None))
    end = len(places)
    none = F.array().cast("array<double>")

    def closed(states: list[Column], fresh: bool = False) -> list[Column]:
        """Skip .* and nothing else; time conditions are tested with the next event."""
        for k in range(end):
            if places[k][0] == ".*":
                states[k + 1] = F.array_distinct(F.concat(states[k + 1], states[k]))
        return states

    start = closed([F.array(F.lit(-1.0)).cast("array<double>"), *[none for _ in range(end)]])

    def step(state: Column, event: Column) -> Column:
        old = [state[f"p{k}"] for k in range(end + 1)]
        new = [F.array(F.lit(-1.0)).cast("array<double>"), *[none for _ in range(end)]]
        new[end] = old[end]  # once matched, matched
        for k in range(end):
            kind, what = places[k]
            if kind == "t":
                continue
            times, after = old[k], k
            if kind == ".*":
                new[k] = F.array_distinct(F.concat(new[k], times))
                continue
            while after > 0 and places[after - 1][0] == "t":
                op, seconds = places[after - 1][1]
                after -= 1
                times = F.filter(old[after], _within(event, op, seconds))
            on = F.lit(True) if kind == "." else F.instr(F.lit("".join(chr(0x4E00 + m) for m in range(1, 1 << n) if m >> (what - 1) & 1)), event["c"]) > 0
            new[k + 1] = F.array_distinct(F.concat(new[k + 1], F.when(on & (F.size(times) > 0), F.array(event["s"])).otherwise(none)))
        new = closed(new)
        return F.struct(*[c.alias(f"p{k}") for k, c in enumerate(new)])

    done = F.aggregate(events, F.struct(*[c.alias(f"p{k}") for k, c in enumerate(start)]), step)
    last = end
    while last > 0 and places[last - 1][0] == "t":
        last -= 1
    return (F.size(done[f"p{last}"]) > 0).cast("short")


# Numbers.
@olap
def round(x: Any, digits: int = 0) -> Expr:
    """Halves go to the even neighbour."""
    return call(f"round[{digits}]", (x,), lambda c: F.bround(c, digits), type_of(x))


@_named("intDiv")
def int_div(a: Any, b: Any) -> Expr:
    return call("intDiv", (a, b), lambda x, y: F.when(y == 0, None).otherwise(F.call_function("try_divide", x - F.try_mod(x, y), y)).cast("long"), t.int64)


@_named("toFloat64OrZero")
def to_float64_or_zero(x: Any) -> Expr:
    return call("toFloat64OrZero", (x,), lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0)), t.float64)


@_named("toFloat64")
def to_float64(x: Any) -> Expr:
    return call("toFloat64", (x,), lambda c: c.cast("double"), t.float64)


@_named("toUInt16OrZero")
def to_uint16_or_zero(x: Any) -> Expr:
    return call("toUInt16OrZero", (x,), lambda c: F.when(c.try_cast("int").between(0, 65535), c.try_cast("int")).otherwise(0), t.uint16)


@_named("toUInt64")
def to_uint64(x: Any) -> Expr:
    return call("toUInt64", (x,), lambda c: c.cast("long"), t.uint64)


@_named("toInt64")
def to_int64(x: Any) -> Expr:
    return call("toInt64", (x,), lambda c: c.cast("long"), t.int64)


@olap
def least(*xs: Any) -> Expr:
    return call("least", xs, lambda *cs: F.least(*cs), first_typed(*xs))


@olap
def greatest(*xs: Any) -> Expr:
    return call("greatest", xs, lambda *cs: F.greatest(*cs), first_typed(*xs))


@_named("cityHash64")
def city_hash64(*xs: Any) -> Expr:
    """A stable 64-bit hash. Its values are xxHash64's, not CityHash's."""
    return call("cityHash64", xs, lambda *cs: F.xxhash64(*cs), t.int64)


# Strings.
@_named("toString")
def to_string(x: Any) -> Expr:
    return call("toString", (x,), lambda c: c.cast("string"), t.string)


@olap
def length(x: Any) -> Expr:
    """Bytes of a text, elements of an array."""
    kind = type_of(x)
    return call("length", (x,), (lambda c: F.size(c).cast("long")) if kind and kind.spark.typeName() == "array" else (lambda c: F.octet_length(c).cast("long")), t.int64)


@olap
def lower(x: Any) -> Expr:
    return call("lower", (x,), F.lower, t.string)


@olap
def upper(x: Any) -> Expr:
    return call("upper", (x,), F.upper, t.string)


@olap
def position(haystack: Any, needle: Any) -> Expr:
    return call("position", (haystack, needle), lambda h, n: F.call_function("instr", h, n).cast("long"), t.int64)


@_named("positionCaseInsensitive")
def position_case_insensitive(haystack: Any, needle: Any) -> Expr:
    return call("positionCaseInsensitive", (haystack, needle), lambda h, n: F.call_function("instr", F.lower(h), F.lower(n)).cast("long"), t.int64)


@olap
def left(x: Any, n: Any) -> Expr:
    return call("left", (x, n), F.left, t.string)


@_named("replaceOne")
def replace_one(x: Any, what: Any, by: Any) -> Expr:
    return call("replaceOne", (x, what, by), lambda c, a, b: F.when(F.call_function("instr", c, a) > 0, F.overlay(c, b, F.call_function("instr", c, a), F.char_length(a))).otherwise(c), t.string)


@olap
def concat(*xs: Any) -> Expr:
    return call("concat", xs, lambda *cs: F.concat(*[c.cast("string") for c in cs]), t.string)


@olap
def extract(x: Any, regex: str) -> Expr:
    """The first group, or the whole match of a pattern without groups; '' where nothing matches."""
    group = 1 if re.compile(regex).groups else 0
    return call(f"extract[{regex}]", (x,), lambda c: F.regexp_extract(c, regex, group), t.string)


@olap
def match(x: Any, regex: str) -> Expr:
    return call(f"match[{regex}]", (x,), lambda c: c.rlike(regex).cast("short"), t.uint8)


@_named("matchCond")
def match_cond(x: Any, regex: str) -> Condition:
    return condition(f"match[{regex}]({lift(x).text})", (lift(x),), lambda c: c.rlike(regex))


@_named("multiSearchAnyCaseInsensitive")
def multi_search_any_case_insensitive(x: Any, needles: list[str]) -> Condition:
    """One pass over the text for all needles."""
    regex = "(?iu)" + "|".join(re.escape(n) for n in needles) if needles else "(?!)"
    return condition(f"multiSearch{needles}({lift(x).text})", (lift(x),), lambda c: c.rlike(regex))


def _tokens(c: Column) -> Column:
    return F.split(c, r"[^A-Za-z0-9\u0080-￿]+")


@_named("hasToken")
def has_token(x: Any, token: str) -> Condition:
    return condition(f"hasToken({lift(x).text}, {token!r})", (lift(x),), lambda c: F.array_contains(_tokens(c), token))


@_named("hasAllTokens")
def has_all_tokens(x: Any, tokens: list[str]) -> Condition:
    return condition(f"hasAllTokens({lift(x).text}, {tokens})", (lift(x),), lambda c: F.size(F.array_except(F.array(*[F.lit(k) for k in tokens]).cast("array<string>"), _tokens(c))) == 0)


@olap
def hex(x: Any) -> Expr:
    return call("hex", (x,), F.hex, t.string)


@olap
def domain(x: Any) -> Expr:
    return call("domain", (x,), lambda c: F.coalesce(F.regexp_replace(F.try_parse_url(c, F.lit("HOST")), r"^.*@", ""), F.lit("")), t.string)


@olap
def path(x: Any) -> Expr:
    return call("path", (x,), lambda c: F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), t.string)


@_named("cutQueryString")
def cut_query_string(x: Any) -> Expr:
    return call("cutQueryString", (x,), lambda c: F.regexp_replace(c, r"\?[^#]*", ""), t.string)


# Conditions.
@_named("if")
def if_(cond: Condition, a: Any, b: Any) -> Expr:
    return call("if", (cond, a, b), lambda c, x, y: F.when(c, x).otherwise(y), first_typed(a, b))


@_named("multiIf")
def multi_if(branches: list[tuple[Condition, Any]], otherwise: Any) -> Expr:
    flat = [lift(x) for pair in branches for x in pair]

    def build(*cs: Column) -> Column:
        out = cs[-1]
        for k in range(len(cs) - 3, -1, -2):
            out = F.when(cs[k], cs[k + 1]).otherwise(out)
        return out

    return call("multiIf", (*flat, otherwise), build, first_typed(*flat[1::2], otherwise))


@olap
def coalesce(*xs: Any) -> Expr:
    return call("coalesce", xs, lambda *cs: F.coalesce(*cs), _coalesced(xs))


def _coalesced(xs: tuple) -> Any:
    kind = first_typed(*xs)
    from dataclasses import replace

    solid = any(lift(x).type is not None and not lift(x).type.is_nullable for x in xs)
    return replace(kind, is_nullable=False) if kind and solid else null(kind)


@_named("ifNull")
def if_null(a: Any, b: Any) -> Expr:
    return call("ifNull", (a, b), F.ifnull, _coalesced((a, b)))


@_named("nullIf")
def null_if(a: Any, b: Any) -> Expr:
    return call("nullIf", (a, b), F.nullif, null(type_of(a)))


@_named("ifNotFinite")
def if_not_finite(x: Any, other: Any) -> Expr:
    """Null passes."""
    return call("ifNotFinite", (x, other), lambda c, o: F.when(F.isnan(c) | (F.abs(c) == float("inf")), o).otherwise(c), t.float64)


# Dates.
def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def moment(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


@_named("toStartOfInterval")
def to_start_of_interval(x: Any, seconds: int) -> Expr:
    """Buckets counted from 1970."""
    if not isinstance(seconds, int) or seconds < 1:
        raise InvalidArguments("an interval is a whole number of seconds from 1")
    us = seconds * 1_000_000
    return call(f"toStartOfInterval[{seconds}]", (x,), lambda c: moment(micros(c) - F.pmod(micros(c), F.lit(us))), t.date_time64)


@_named("toStartOfHour")
def to_start_of_hour(x: Any) -> Expr:
    return call("toStartOfHour", (x,), lambda c: F.date_trunc("hour", c).cast("timestamp_ntz"), t.date_time)


@_named("toStartOfMinute")
def to_start_of_minute(x: Any) -> Expr:
    return call("toStartOfMinute", (x,), lambda c: F.date_trunc("minute", c).cast("timestamp_ntz"), t.date_time)


@_named("toHour")
def to_hour(x: Any) -> Expr:
    return call("toHour", (x,), F.hour, t.int32)


@_named("toUnixTimestamp")
def to_unix_timestamp(x: Any) -> Expr:
    return call("toUnixTimestamp", (x,), lambda c: F.unix_seconds(c.cast("timestamp")), t.int64)


@_named("toUnixTimestamp64Nano")
def to_unix_timestamp64_nano(x: Any) -> Expr:
    return call("toUnixTimestamp64Nano", (x,), lambda c: micros(c) * 1000, t.int64)


@_named("intervalAdd")
def interval_add(x: Any, seconds: Any) -> Expr:
    return call("intervalAdd", (x, seconds), lambda c, s: moment(micros(c) + (s * F.lit(1_000_000).cast("long")).cast("long")), t.date_time64)


@_named("intervalSub")
def interval_sub(x: Any, seconds: Any) -> Expr:
    return call("intervalSub", (x, seconds), lambda c, s: moment(micros(c) - (s * F.lit(1_000_000).cast("long")).cast("long")), t.date_time64)


#: Strftime marks and their date patterns.
MARKS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "i": "mm", "S": "ss", "s": "ss", "y": "yy", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "f": "SSSSSS", "b": "MMM", "a": "EEE", "p": "a", "I": "hh", "e": "d", "W": "EEEE", "n": "'\n'", "%": "'%'"}


def date_pattern(fmt: str) -> str:
    def plain(text: str) -> str:
        return "'" + text.replace("'", "''") + "'" if re.search("[A-Za-z']", text) else text

    out, at = [], 0
    for m in re.finditer(r"%(.)", fmt):
        if m[1] not in MARKS:
            raise InvalidArguments(f"no such mark: %{m[1]}")
        out += [plain(fmt[at : m.start()]) if at < m.start() else "", MARKS[m[1]]]
        at = m.end()
    return "".join([*out, plain(fmt[at:]) if at < len(fmt) else ""])


@_named("formatDateTime")
def format_date_time(x: Any, fmt: str) -> Expr:
    pattern = date_pattern(fmt)
    return call(f"formatDateTime[{fmt}]", (x,), lambda c: F.date_format(c, pattern), t.string)


@_named("toDateTime")
def to_date_time(x: Any) -> Expr:
    kind = type_of(x)
    number = kind is not None and kind.spark.typeName() in ("long", "integer", "short", "byte")
    return call("toDateTime", (x,), lambda c: (F.timestamp_seconds(c) if number else c.cast("timestamp")).cast("timestamp_ntz"), t.date_time)


# Arrays.
@_named("arrayOf", "array")
def array_of(*xs: Any) -> Expr:
    return call("array", xs, lambda *cs: F.array(*cs), t.array(first_typed(*xs) or t.untyped()))


@_named("arrayStringConcat")
def array_string_concat(x: Any, by: str = "") -> Expr:
    return call(f"arrayStringConcat[{by}]", (x,), lambda c: F.array_join(c, by), t.string)


@_named("arrayFilter")
def array_filter(fn: str, x: Any) -> Expr:
    """fn: 'x -> ...' in SQL."""
    name, _, body = fn.partition("->")
    if not body:
        raise InvalidArguments("a filter is 'x -> condition'")

    if not name.strip().isidentifier():
        raise InvalidArguments("a filter names one variable")
    e = lift(x)

    def build(ctx: Any) -> Column:
        # The lambda stays SQL text; its array is a column of the row or a literal.
        return F.expr(f"filter({ctx.text_of(e)}, {name.strip()} -> {body.strip()})")

    return Expr(f"arrayFilter[{fn}]({e.text})", build, e.type, e.uses, e.agg, e.window, e.params)


@_named("arrayJoin")
def array_join(x: Any) -> Expr:
    kind = type_of(x)
    return call("arrayJoin", (x,), F.explode, kind.element if kind else None)


@_named("arraySort")
def array_sort(x: Any) -> Expr:
    return call("arraySort", (x,), lambda c: F.array_sort(c), type_of(x))


@_named("arrayReverseSort")
def array_reverse_sort(x: Any) -> Expr:
    return call("arrayReverseSort", (x,), lambda c: F.sort_array(c, asc=False), type_of(x))


@_named("arrayDistinct")
def array_distinct(x: Any) -> Expr:
    return call("arrayDistinct", (x,), F.array_distinct, type_of(x))


@_named("arrayPushFront")
def array_push_front(x: Any, value: Any) -> Expr:
    return call("arrayPushFront", (x, value), F.array_prepend, type_of(x))


@_named("arrayElement")
def array_element(x: Any, n: Any) -> Expr:
    kind = type_of(x)
    element = kind.element if kind and kind.element else t.untyped()
    return call("arrayElement", (x, n), lambda c, k: F.coalesce(F.try_element_at(c, k), F.lit(default_of(element))), element)


@olap
def has(x: Any, value: Any) -> Condition:
    return condition(f"has({lift(x).text}, {lift(value).text})", (lift(x), lift(value)), lambda c, v: F.array_contains(c, v))


# Maps and JSON.
@_named("mapContains")
def map_contains(x: Any, key: Any) -> Condition:
    return condition(f"mapContains({lift(x).text}, {lift(key).text})", (lift(x), lift(key)), lambda m, k: F.map_contains_key(m, k))


@_named("mapGet")
def map_get(x: Any, key: str) -> Expr:
    return call("mapGet", (x, key), lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit("")), t.string)


@_named("mapKeys")
def map_keys(x: Any) -> Expr:
    return call("mapKeys", (x,), F.map_keys, t.array(t.string))


@_named("mapValues")
def map_values(x: Any) -> Expr:
    kind = type_of(x)
    return call("mapValues", (x,), F.map_values, t.array(kind.element) if kind and kind.element else None)


@_named("mapLiteral")
def map_literal(*pairs: tuple[Any, Any]) -> Expr:
    flat = tuple(x for p in pairs for x in p)
    return call("mapLiteral", flat, lambda *cs: F.create_map(*cs), t.map_(t.string, first_typed(*flat[1::2]) or t.untyped()))


@_named("toJSONString")
def to_json_string(x: Any) -> Expr:
    kind = type_of(x)
    if kind and kind.spark.typeName() in ("array", "map", "struct"):
        return call("toJSONString", (x,), lambda c: F.to_json(c), t.string)
    # A scalar is the only element of an array's text.
    return call("toJSONString", (x,), lambda c: F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[|\]$", ""), t.string)


for _n, _f in (("over", window.over), ("windowSpec", window.window_spec), ("lagInFrame", window.lag_in_frame), ("rowsBetween", window.rows_between), ("rangeBetween", window.range_between)):
    register(SET, _n)(_f)
