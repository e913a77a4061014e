"""Known values of the function catalog, on small fixed inputs."""

import datetime as dt

import pytest

from larkspur import types as t
from larkspur.expr import lit, param
from larkspur.errors import InvalidArguments
from larkspur.functions import mysql, olap, pg, registry, sqlite
from larkspur.functions import window as w
from larkspur.plans.lower import compile_query
from larkspur.plans.query import from_, from_query, select_no_from
from larkspur.table import frame_table

AT = dt.datetime(2026, 1, 2, 3, 4, 5)


def value(spark, e):
    return compile_query(select_no_from(lambda: {"v": e}), spark).df.collect()[0]["v"]


@pytest.fixture(scope="module")
def numbers(spark):
    return frame_table("numbers", spark.createDataFrame([(1,), (2,), (3,)], "n int"), {"n": t.int32})


SCALARS = [
    (lambda: olap.to_string(42), "42"), (lambda: olap.length("hello"), 5), (lambda: olap.length("héé"), 5), (lambda: pg.length("héé"), 3), (lambda: olap.position("hello", "ll"), 3), (lambda: olap.position("hello", "x"), 0),
    (lambda: olap.position_case_insensitive("Hello", "EL"), 2), (lambda: olap.left("hello", 2), "he"), (lambda: olap.replace_one("banana", "na", "NO"), "baNOna"), (lambda: olap.extract("item42", "[0-9]+"), "42"),
    (lambda: olap.extract("item42", "m([0-9])"), "4"), (lambda: olap.extract("item", "[0-9]+"), ""), (lambda: olap.match("item42", "[0-9]"), 1), (lambda: olap.concat("a", "'", "b"), "a'b"), (lambda: olap.hex("AB"), "4142"),
    (lambda: olap.domain("https://user@example.com:80/a?b#c"), "example.com"), (lambda: olap.path("https://example.com/a?b=c"), "/a"), (lambda: olap.cut_query_string("https://example.com/a?b=c"), "https://example.com/a"), (lambda: olap.domain("not a url"), ""),
    (lambda: olap.lower("ABC"), "abc"), (lambda: olap.upper("abc"), "ABC"),
    (lambda: olap.round(1.234, 2), 1.23), (lambda: olap.round(2.5), 2.0), (lambda: sqlite.round_(2.5), 3.0), (lambda: olap.int_div(7, 2), 3), (lambda: olap.int_div(-7, 2), -3), (lambda: olap.int_div(7, 0), None),
    (lambda: olap.to_float64_or_zero("bad"), 0.0), (lambda: olap.to_float64_or_zero("1.5"), 1.5), (lambda: olap.to_float64("2"), 2.0), (lambda: olap.to_uint16_or_zero("bad"), 0), (lambda: olap.to_uint16_or_zero("70000"), 0), (lambda: olap.to_uint16_or_zero("42"), 42),
    (lambda: olap.to_uint64("7"), 7), (lambda: olap.to_int64("-7"), -7), (lambda: olap.least(3, 2), 2), (lambda: olap.greatest(3, 2), 3), (lambda: olap.least(lit(None), 2), 2), (lambda: olap.greatest(lit(None), 2), 2),
    (lambda: sqlite.least(lit(None), 2), None), (lambda: sqlite.greatest(1, 2), 2), (lambda: lit(10).add(2).mul(3).sub(6).div(2).mod(4), 13.0), (lambda: lit(1).div(0), None), (lambda: lit(-7).mod(3), -1),
    (lambda: lit(10).sub(lit(1).add(2)).mul(2), 4), (lambda: olap.if_(lit(1).lt(2), "a", "b"), "a"), (lambda: olap.multi_if([(lit(1).gt(2), "x"), (lit(1).lt(2), "y")], "z"), "y"), (lambda: pg.case_when([(lit(1).gt(2), "x")]), None),
    (lambda: pg.case_when([(lit(1).gt(2), "x")], "o"), "o"), (lambda: sqlite.iif(lit(True).eq(True), 1, 2), 1), (lambda: olap.coalesce(lit(None), 3), 3), (lambda: olap.if_null(lit(None), 4), 4), (lambda: olap.null_if(4, 4), None),
    (lambda: olap.if_not_finite(lit(float("inf")), 7.0), 7.0), (lambda: olap.if_not_finite(lit(float("nan")), 7.0), 7.0), (lambda: olap.if_not_finite(lit(1.5), 7.0), 1.5),
    (lambda: olap.to_start_of_interval(lit(AT), 300), dt.datetime(2026, 1, 2, 3)), (lambda: olap.to_start_of_minute(lit(AT)), dt.datetime(2026, 1, 2, 3, 4)), (lambda: olap.to_start_of_hour(lit(AT)), dt.datetime(2026, 1, 2, 3)), (lambda: olap.to_hour(lit(AT)), 3),
    (lambda: olap.interval_add(lit(AT), 60), dt.datetime(2026, 1, 2, 3, 5, 5)), (lambda: olap.interval_sub(lit(AT), 60), dt.datetime(2026, 1, 2, 3, 3, 5)), (lambda: olap.to_unix_timestamp64_nano(lit(dt.datetime(1970, 1, 1, 0, 0, 1, 123000))), 1_123_000_000),
    (lambda: olap.to_unix_timestamp(lit(dt.datetime(1970, 1, 1, 0, 0, 9))), 9), (lambda: olap.format_date_time(lit(AT), "%Y-%m-%d at %H:%M:%S"), "2026-01-02 at 03:04:05"), (lambda: olap.to_date_time("2026-01-02 03:04:05"), AT), (lambda: olap.to_date_time(lit(0)), dt.datetime(1970, 1, 1)),
    (lambda: pg.date_trunc("day", lit(AT)), dt.datetime(2026, 1, 2)), (lambda: pg.date_bin(1200, lit(AT)), dt.datetime(2026, 1, 2, 3)), (lambda: sqlite.julianday(lit(dt.datetime(2000, 1, 1, 12))), 2451545.0), (lambda: sqlite.date(lit(AT), "+1 month", "start of month"), "2026-02-01"),
    (lambda: sqlite.datetime(lit(AT), "-1 hour"), "2026-01-02 02:04:05"), (lambda: sqlite.strftime("%Y/%m", lit(AT)), "2026/01"), (lambda: sqlite.strftime("%s", lit(dt.datetime(1970, 1, 2))), "86400"), (lambda: sqlite.unixepoch(lit(dt.datetime(1970, 1, 1, 0, 1))), 60),
    (lambda: sqlite.substr("hello", 2), "ello"), (lambda: sqlite.substr("hello", 2, 3), "ell"), (lambda: sqlite.trim("  a "), "a"), (lambda: sqlite.ltrim("xxa", "x"), "a"), (lambda: sqlite.rtrim("axx", "x"), "a"), (lambda: sqlite.replace("aba", "a", "c"), "cbc"), (lambda: sqlite.instr("abc", "c"), 3),
    (lambda: sqlite.abs(-3), 3), (lambda: sqlite.cast("12", t.int64), 12), (lambda: sqlite.cast("x", t.int64), None), (lambda: sqlite.concat("a", lit(None)), None), (lambda: sqlite.ifnull(lit(None), 1), 1), (lambda: sqlite.nullif(1, 1), None),
    (lambda: olap.array_of(3, 1, 3), [3, 1, 3]), (lambda: olap.array_string_concat(olap.array_of("a", "b"), "-"), "a-b"), (lambda: olap.array_sort(olap.array_of(3, 1, 3)), [1, 3, 3]), (lambda: olap.array_reverse_sort(olap.array_of(3, 1, 3)), [3, 3, 1]),
    (lambda: olap.array_distinct(olap.array_of(3, 1, 3)), [3, 1]), (lambda: olap.array_filter("x -> x > 1", olap.array_of(3, 1, 3)), [3, 3]), (lambda: olap.array_push_front(olap.array_of(3, 1, 3), 0), [0, 3, 1, 3]), (lambda: olap.array_element(olap.array_of(3, 1, 3), 1), 3),
    (lambda: olap.array_element(olap.array_of(3, 1, 3), 9), 0), (lambda: olap.has(olap.array_of(3, 1), 1), True), (lambda: olap.map_get(olap.map_literal(("key", "value")), "key"), "value"), (lambda: olap.map_get(olap.map_literal(("key", "value")), "no"), ""),
    (lambda: olap.map_contains(olap.map_literal(("key", "value")), "key"), True), (lambda: olap.map_keys(olap.map_literal(("key", "value"))), ["key"]), (lambda: olap.map_values(olap.map_literal(("key", "value"))), ["value"]), (lambda: olap.map_literal(("a", 1)).get("b"), 0),
    (lambda: olap.to_json_string(olap.array_of(1, 2)), "[1,2]"), (lambda: olap.to_json_string("a\"b"), '"a\\"b"'), (lambda: pg.json_text_('{"a": {"b": 1}, "c": "x"}', "c"), "x"), (lambda: pg.json_path_text('{"a": [5, {"b": 1}]}', "a", 1, "b"), "1"),
    (lambda: pg.json_contains(lit('{"a": {"b": 1, "c": 2}, "d": [1, 2]}'), {"a": {"b": 1}, "d": [2]}), True), (lambda: pg.json_contains(lit('{"a": 1}'), {"a": 2}), False), (lambda: pg.json_set('{"a": {"b": 1}}', ["a", "c"], 5), '{"a":{"b":1,"c":5}}'), (lambda: pg.json_set('{"a": 1}', ["x", "y"], 5), '{"a":1}'),
    (lambda: sqlite.json_set('{"a": [1, 2]}', "$.a[1]", "z"), '{"a":[1,"z"]}'), (lambda: sqlite.json_extract('{"a": {"b": 3}}', "$.a.b", t.int64), 3), (lambda: sqlite.json_(lit(' {"a" : 1} ')), '{"a":1}'), (lambda: sqlite.json_(lit("{")), None),
    (lambda: olap.multi_search_any_case_insensitive("Hello", ["LL", "x"]), True), (lambda: olap.has_token("a-b c", "b"), True), (lambda: olap.has_token("abc", "b"), False), (lambda: olap.has_all_tokens("a-b c", ["a", "c"]), True), (lambda: olap.has_all_tokens("a-b c", ["a", "d"]), False), (lambda: olap.match_cond("ab", "^a"), True),
    (lambda: pg.typed_value(t.int64, "5"), 5), (lambda: pg.as_boolean(lit(1).eq(1)), True), (lambda: lit("50% off").contains("0%"), True), (lambda: lit("500 off").contains("0%"), False), (lambda: lit("a_b").starts_with("A_", insensitive=True), True), (lambda: lit("aXb").like(r"a\_b"), False),
    (lambda: mysql.lower("A"), "a"), (lambda: pg.upper("a"), "A"), (lambda: registry.define_fn("reverse", t.string)("abc"), "cba"), (lambda: registry.define_untyped_fn("ascii")("a"), 97), (lambda: registry.define_cond_fn("isnull")(lit(None)), True), (lambda: olap.city_hash64("a"), None),
]


def test_scalars(spark):
    made = {f"v{k}": make() for k, (make, _) in enumerate(SCALARS)}
    row = compile_query(select_no_from(lambda: made), spark).df.collect()[0]
    for k, (_, want) in enumerate(SCALARS):
        if want is None and made[f"v{k}"].text.startswith("cityHash64"):
            assert isinstance(row[f"v{k}"], int)
        else:
            assert row[f"v{k}"] == want, made[f"v{k}"].text


def rows(spark, q, params=None):
    made = compile_query(q, spark, params)
    return made.decode_rows(made.df.collect())


def test_aggregates(spark, numbers):
    def record(x):
        big = x.n.gt(1)
        return {
            "count": olap.count(), "count_if": olap.count_if(big), "sum": olap.sum(x.n), "sum_if": olap.sum_if(x.n, big), "avg": olap.avg(x.n), "avg_if": olap.avg_if(x.n, big), "min": olap.min_(x.n), "max": olap.max_(x.n), "min_if": olap.min_if(x.n, big), "max_if": olap.max_if(x.n, x.n.lt(3)),
            "any": olap.any_(lit("k")), "any_if": olap.any_if(x.n, x.n.eq(2)), "uniq": olap.uniq(x.n), "uniq_if": olap.uniq_if(x.n, big), "uniq_exact": olap.uniq_exact(x.n), "median": olap.quantile(0.5)(x.n), "set": olap.group_uniq_array(x.n), "some": olap.group_uniq_array_if(1)(x.n, big),
            "flat": olap.group_uniq_array_array(olap.array_of(x.n, 1)), "arg_min": olap.arg_min(x.n, lit(0).sub(x.n)), "arg_max": olap.arg_max(x.n, lit(0).sub(x.n)), "distinct": pg.count_distinct(x.n), "pg_sum_if": pg.sum_if(x.n, big), "pc": pg.percentile_cont(0.25, x.n), "all": pg.array_agg(x.n),
            "json": sqlite.json_group_array(x.n), "object": sqlite.json_group_object(olap.to_string(x.n.mod(2)), x.n),
        }

    got = rows(spark, from_(numbers).select(record))[0]
    want = {"count": 3, "count_if": 2, "sum": 6, "sum_if": 5, "avg": 2.0, "avg_if": 2.5, "min": 1, "max": 3, "min_if": 2, "max_if": 2, "any": "k", "any_if": 2, "uniq": 3, "uniq_if": 2, "uniq_exact": 3, "median": 2.0, "set": [1, 2, 3], "some": [2], "flat": [1, 2, 3], "arg_min": 3, "arg_max": 1, "distinct": 3, "pg_sum_if": 5, "pc": 1.5, "json": "[1,2,3]", "object": '{"0":2,"1":3}'}
    assert sorted(got.pop("all")) == [1, 2, 3]
    assert got == want


def test_aggregates_of_nothing(spark, numbers):
    q = from_(numbers).select(lambda x: {"count": olap.count(), "sum": olap.sum(x.n), "avg": olap.avg(x.n), "quantile": olap.quantile(0.5)(x.n), "set": olap.group_uniq_array(x.n), "pg_sum": pg.sum(x.n), "min": pg.min_(x.n), "all": pg.array_agg(x.n)}).where(lambda x: x.n.gt(9))
    assert rows(spark, q) == [{"count": 0, "sum": 0, "avg": None, "quantile": None, "set": [], "pg_sum": None, "min": None, "all": None}]


def test_arg_max_state_merges(spark, numbers):
    partial = from_(numbers).select(lambda x: {"odd": x.n.mod(2), "s": olap.arg_max_state(x.n, x.n)}).group_by("odd")
    assert rows(spark, from_query(partial, "p").select(lambda p: {"v": olap.arg_max_merge(p.s)})) == [{"v": 3}]


def funnel(spark, events, window, *modes, steps=("a", "b", "c")):
    table = frame_table("e", spark.createDataFrame(events, "at int, kind string"), {"at": t.int32, "kind": t.string})
    return rows(spark, from_(table, "e").select(lambda e: {"v": olap.window_funnel(window, *modes)(e.at, *[e.kind.eq(s) for s in steps])}))[0]["v"]


def test_funnel_pinned(spark, numbers):
    steps = lambda x: (x.n.eq(1), x.n.eq(3))
    got = rows(spark, from_(numbers).select(lambda x: {"plain": olap.window_funnel(10)(x.n, *steps(x)), "strict": olap.window_funnel(10, "strict_order")(x.n, *steps(x)), "match": olap.sequence_match("(?1).*(?2)")(x.n, *steps(x))}))[0]
    assert got == {"plain": 2, "strict": 1, "match": 1}


def test_funnel_rules(spark):
    assert funnel(spark, [(1, "a"), (5, "b"), (9, "c")], 8) == 3
    assert funnel(spark, [(1, "a"), (5, "b"), (10, "c")], 8) == 2  # the window counts from the first step
    assert funnel(spark, [(1, "a"), (5, "b"), (6, "a"), (7, "b"), (12, "c")], 8) == 3  # a later start may reach further
    assert funnel(spark, [(1, "b"), (2, "c")], 8) == 0
    assert funnel(spark, [(1, "a"), (1, "b")], 8, "strict_increase") == 1
    assert funnel(spark, [(1, "a"), (2, "b"), (3, "b"), (4, "c")], 8, "strict_deduplication") == 2
    with pytest.raises(InvalidArguments):
        olap.window_funnel(5, "loose")
    with pytest.raises(InvalidArguments):
        olap.window_funnel(5)(lit(1))


def sequence(spark, pattern, events):
    table = frame_table("e", spark.createDataFrame(events, "at int, kind string"), {"at": t.int32, "kind": t.string})
    return rows(spark, from_(table, "e").select(lambda e: {"v": olap.sequence_match(pattern)(e.at, e.kind.eq("a"), e.kind.eq("b"))}))[0]["v"]


@pytest.mark.parametrize(
    ("pattern", "events", "want"),
    [
        ("(?1)(?2)", [(1, "a"), (2, "b")], 1), ("(?2)(?1)", [(1, "a"), (2, "b")], 0), ("(?1)(?1)(?2)", [(1, "a"), (2, "b")], 0), ("(?1).(?2)", [(1, "a"), (2, "a"), (3, "b")], 1), ("(?1)(?t<=5)(?2)", [(1, "a"), (9, "b")], 0),
        ("(?1)(?t<=5)(?2)", [(1, "a"), (4, "a"), (9, "b")], 1), ("(?1)(?t>5)(?2)", [(1, "a"), (9, "b")], 1), ("(?1).*(?2)", [(1, "a"), (2, "a"), (3, "a"), (4, "b")], 1), ("(?1).*(?1)(?t==1)(?2)", [(1, "a"), (3, "a"), (4, "b")], 1), ("(?1)(?t>=3)(?2)", [(1, "a"), (2, "b")], 0),
    ],
)
def test_sequences(spark, pattern, events, want):
    assert sequence(spark, pattern, events) == want


def test_sequence_refusals():
    for bad in ("(?1)'", "(?1)\\", "(?x)", "(?t<5)x"):
        with pytest.raises(InvalidArguments):
            olap.sequence_match(bad)
    with pytest.raises(InvalidArguments):
        olap.sequence_match("(?3)")(lit(1), lit(1).eq(1))


def test_windows(spark, numbers):
    spec = lambda x, f=None: w.window_spec([], [(x.n, "asc")], f)
    running = w.rows_between(w.unbounded_preceding, w.current_row)

    def record(x):
        return {
            "n": x.n, "running": w.over(pg.sum(x.n), spec(x, running)), "lag_frame": w.lag_in_frame(x.n, spec(x, running), 1, 0), "whole": w.over(pg.sum(x.n), spec(x, w.rows_between(w.unbounded_preceding, w.unbounded_following))), "lag": w.lag(x.n, spec(x)), "lead": w.lead(x.n, spec(x), 1, lit(9)),
            "rn": w.row_number(spec(x)), "first": w.first_value(x.n, spec(x)), "last": w.last_value(x.n, spec(x, w.rows_between(w.current_row, w.following(lit(1).add(0))))), "cut": w.lag_in_frame(x.n, spec(x, w.rows_between(w.current_row, w.current_row)), 1, 7),
        }

    got = rows(spark, from_(numbers).select(record).order_by("n"))
    assert [r["running"] for r in got] == [1, 3, 6] and [r["lag_frame"] for r in got] == [0, 1, 2] and [r["whole"] for r in got] == [6, 6, 6] and [r["lag"] for r in got] == [None, 1, 2] and [r["lead"] for r in got] == [2, 3, 9]
    assert [r["rn"] for r in got] == [1, 2, 3] and [r["first"] for r in got] == [1, 1, 1] and [r["last"] for r in got] == [2, 3, 3] and [r["cut"] for r in got] == [7, 7, 7]


def test_range_peers(spark, numbers):
    q = from_(numbers).select(lambda x: {"n": x.n, "s": w.over(pg.sum(x.n), w.window_spec([], [(olap.if_(x.n.gt(1), 2, 1), "asc")], w.range_between(w.unbounded_preceding, w.current_row))), "r": w.rank(w.window_spec([], [(olap.if_(x.n.gt(1), 2, 1), "asc")])), "d": w.dense_rank(w.window_spec([], [(x.n, "desc")]))}).order_by("n")
    got = rows(spark, q)
    assert [r["s"] for r in got] == [1, 6, 6] and [r["r"] for r in got] == [1, 2, 2] and [r["d"] for r in got] == [3, 2, 1]


def test_every_function_is_registered_once_per_set_and_callable():
    assert {s for s, _ in registry.REGISTRY} == {"olap", "pg", "sqlite", "mysql"}
    assert len(registry.REGISTRY) > 180 and all(callable(f) for f in registry.REGISTRY.values())


def test_params_in_functions(spark):
    q = select_no_from(lambda: {"v": olap.concat(param.string("a"), param.int("b"))})
    assert rows(spark, q, {"a": "' OR 1=1 --", "b": 3}) == [{"v": "' OR 1=1 --3"}]
