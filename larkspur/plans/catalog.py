"""The registered queries of the builder, each next to its DuckDB twin.

Every query runs over its whole tables. Doubles are rounded on both sides before they are
compared; counts are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur import types as t
from larkspur.expr import lit, not_, or_, outer, param, raw_expr, sql, untyped_expr, when, when_true
from larkspur.functions import olap, pg, sqlite
from larkspur.functions import window as w
from larkspur.plans.lower import compile_query
from larkspur.plans.query import from_, from_query, from_union, select_no_from, union_all
from larkspur.plans.subquery import exists, in_subquery, not_in_subquery, scalar, subquery_expr
from larkspur.sources.driver import tables

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made = fn(spark, tables(sf_dir))
            if isinstance(made, DataFrame):
                return made
            q, params = made if isinstance(made, tuple) else (made, {})
            return compile_query(q, spark, params).df

        _QUERIES[name] = run
        if oracle:
            _ORACLES[name] = oracle
        return fn

    return add


def queries() -> dict[str, Callable]:
    from larkspur.plans import catalog_more, catalog_values  # noqa: F401  register the rest

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLES)


@_query(
    "q_bucket_events",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n, count_if(value > 100)::BIGINT AS n_large, round(quantile_cont(value, 0.95), 6) AS p95
    FROM events WHERE event_type IN ('click', 'purchase', 'view') AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20'
    GROUP BY ALL HAVING count(*) > 1""",
)
def _bucket_events(spark, s):
    q = (
        from_(s.events)
        .select(lambda e: {"bucket": olap.to_start_of_interval(e.ts, 3600), "event_type": e.event_type, "n": olap.count(), "n_large": olap.count_if(e.value.gt(100)), "p95": sqlite.round_(olap.quantile(0.95)(e.value), 6)})
        .where(lambda e: [e.event_type.in_(["click", "purchase", "view"]), e.ts.gte(param.date_time("since")), e.ts.lt(param.date_time("until"))])
        .group_by("bucket", "event_type")
        .having(lambda e: olap.count().gt(1))
        .order_by(("bucket", "asc"), ("event_type", "asc"))
    )
    return q, {"since": "2024-01-02 00:00:00", "until": "2024-01-20 00:00:00"}


@_query(
    "q_filter_predicates",
    r"""SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 30 AND NOT (p_size BETWEEN 10 AND 12) AND p_brand <> 'Brand#11' AND (p_name LIKE '%a%' ESCAPE '\' OR p_type ILIKE '%steel%')
    AND NOT (p_name LIKE '%\_%' ESCAPE '\') AND p_size NOT IN (7, 8) AND contains(lower(p_type), lower('E')) AND p_retailprice >= 900.5 AND p_name IS NOT NULL AND NOT (p_type LIKE 'ZZ%')""",
)
def _filter_predicates(spark, s):
    return (
        from_(s.part)
        .select("p_partkey", "p_name")
        .where(
            lambda p: [
                p.p_size.between(5, 30), p.p_size.not_between(10, 12), p.p_brand.neq("Brand#11"), or_(p.p_name.like("%a%"), p.p_type.ilike("%steel%")), p.p_name.not_like(r"%\_%"), p.p_size.not_in([7, 8]),
                p.p_type.contains("E", insensitive=True), p.p_retailprice.gte(900.5), p.p_name.is_not_null(), not_(p.p_type.starts_with("ZZ")), when(None, p.p_name.eq), when_true(False, lambda: p.p_size.eq(1)), p.p_size.not_in([]),
            ]
        )
    )


@_query("q_literal_match", """SELECT count_if(contains(url, '?'))::BIGINT AS marks, count_if(starts_with(url, 'https'))::BIGINT AS secure, count_if(suffix(url, '/'))::BIGINT AS slash, count_if(contains(lower(url), 'blog'))::BIGINT AS blog, count_if(contains(url, '%'))::BIGINT AS percent, count(*) AS n FROM pages""")
def _literal_match(spark, s):
    return from_(s.pages).select(lambda p: {"marks": olap.count_if(p.url.contains("?")), "secure": olap.count_if(p.url.starts_with("https")), "slash": olap.count_if(p.url.ends_with("/")), "blog": olap.count_if(p.url.contains("BLOG", insensitive=True)), "percent": olap.count_if(p.url.contains("%")), "n": olap.count()})


@_query("q_arith_precedence", """SELECT l_orderkey, l_linenumber, round(l_quantity + l_extendedprice * 2 - l_tax / 2, 6) AS a, round(l_quantity - 1.0 / 2, 6) AS b, round((l_quantity - 1.0) / 2, 6) AS c, CAST(l_orderkey % 7 AS BIGINT) AS m, round(l_quantity / nullif(l_discount, 0), 6) AS d FROM lineitem""")
def _arith(spark, s):
    r = lambda e: sqlite.round_(e, 6)
    return from_(s.lineitem).select(
        lambda l: {
            "l_orderkey": l.l_orderkey, "l_linenumber": l.l_linenumber, "a": r(l.l_quantity.add(l.l_extendedprice).mul(2).sub(l.l_tax).div(2)), "b": r(l.l_quantity.sub(1.0).div(2)),
            "c": r(lit(1.0).mul(l.l_quantity.sub(1.0)).div(2)), "m": l.l_orderkey.mod(7), "d": r(l.l_quantity.div(l.l_discount)),
        }
    )


@_query(
    "q_join_star",
    """SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY ALL""",
)
def _join_star(spark, s):
    return (
        from_(s.lineitem, "l")
        .inner_join(s.orders, "o", lambda l, o: l.l_orderkey.eq(o.o_orderkey))
        .inner_join(s.customer, "c", lambda l, c: l.o.o_custkey.eq(c.c_custkey))
        .inner_join(s.nation, "n", lambda l, n: l.c.c_nationkey.eq(n.n_nationkey))
        .inner_join(s.region, "r", lambda l, r: l.n.n_regionkey.eq(r.r_regionkey))
        .select(lambda l: {"r_name": l.r.r_name, "n_name": l.n.n_name, "n": olap.count(), "revenue": sqlite.round_(pg.sum(l.l_extendedprice.mul(lit(1).sub(l.l_discount))), 2)})
        .where(lambda l: l.o.o_orderdate.gte("1995-01-01"))
        .group_by("r_name", "n_name")
        .cross_tenant()
    )


@_query(
    "q_left_join_nulls",
    """SELECT c_custkey, o_orderkey, coalesce(o_orderstatus, 'none') AS status FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' AND o_totalprice > 100000""",
)
def _left_join(spark, s):
    return from_(s.customer, "c").left_join(s.orders, "o", lambda c, o: [c.c_custkey.eq(o.o_custkey), o.o_orderstatus.eq("P"), o.o_totalprice.gt(100000)]).select(lambda c: {"c_custkey": c.c_custkey, "o_orderkey": c.o.o_orderkey, "status": olap.coalesce(c.o.o_orderstatus, "none")})


@_query("q_cross_scalar", """SELECT n_name, r_name, n_regionkey = r_regionkey AS inside FROM nation CROSS JOIN region""")
def _cross(spark, s):
    return from_(s.nation, "n").cross_join(s.region, "r").select(lambda n: {"n_name": n.n_name, "r_name": n.r.r_name, "inside": pg.as_boolean(n.n_regionkey.eq(n.r.r_regionkey))})


@_query(
    "q_theta_join",
    """SELECT s_nationkey, CAST(count(*) AS BIGINT) AS pairs FROM supplier JOIN nation ON s_nationkey >= n_nationkey AND s_acctbal > n_regionkey * 2000 GROUP BY ALL""",
)
def _theta(spark, s):
    return from_(s.supplier, "s").inner_join(s.nation, "n", lambda s_, n: [s_.s_nationkey.gte(n.n_nationkey), s_.s_acctbal.gt(n.n_regionkey.mul(2000))]).select(lambda s_: {"s_nationkey": s_.s_nationkey, "pairs": olap.count()}).group_by("s_nationkey")


@_query("q_semi", """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def _semi(spark, s):
    return from_(s.customer, "c").select("c_custkey").where(lambda c: exists(from_(s.orders, "o").select("o_orderkey").where(lambda o: [o.o_custkey.eq(outer(c.c_custkey)), o.o_totalprice.gt(300000)])))


@_query("q_anti", """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def _anti(spark, s):
    return from_(s.customer, "c").select("c_custkey").where(lambda c: not_(exists(from_(s.orders, "o").select("o_orderkey").where(lambda o: [o.o_custkey.eq(outer(c.c_custkey)), o.o_totalprice.gt(300000)]))))


@_query("q_in_subquery", """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def _in(spark, s):
    return from_(s.orders, "o").select("o_orderkey").where(lambda o: in_subquery(o.o_custkey, from_(s.customer, "c").select("c_custkey").where(lambda c: c.c_acctbal.lt(0))))


@_query("q_not_in", """SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)""")
def _not_in(spark, s):
    return from_(s.orders, "o").select("o_orderkey").where(lambda o: not_in_subquery(o.o_custkey, from_(s.customer, "c").select("c_custkey").where(lambda c: c.c_acctbal.lt(5000))))


@_query("q_scalar_correlated", """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS done, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS top FROM customer""")
def _scalar(spark, s):
    def of(c, value, status):
        return scalar(from_(s.orders, "o").select(lambda o: {"v": value(o)}).where(lambda o: [o.o_custkey.eq(outer(c.c_custkey)), o.o_orderstatus.eq(status)]))

    return from_(s.customer, "c").select(lambda c: {"c_custkey": c.c_custkey, "done": olap.coalesce(of(c, lambda o: olap.count(), "F"), 0), "top": of(c, lambda o: olap.max_(o.o_totalprice), "P")})


@_query("q_scalar_global", """SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 2) AS apart FROM orders""")
def _scalar_global(spark, s):
    return from_(s.orders, "o").select(lambda o: {"o_orderkey": o.o_orderkey, "apart": sqlite.round_(o.o_totalprice.sub(subquery_expr(from_(s.orders, "p").select(lambda p: {"v": olap.avg(p.o_totalprice)}), t.float64)), 2)})


@_query("q_group_having", """SELECT c_mktsegment, c_nationkey, count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY ALL HAVING count(*) > 1 AND max(c_acctbal) > 100""")
def _group_having(spark, s):
    return (
        from_(s.customer)
        .select(lambda c: {"c_mktsegment": c.c_mktsegment, "c_nationkey": c.c_nationkey, "n": olap.count(), "lo": olap.min_(c.c_acctbal), "hi": olap.max_(c.c_acctbal), "mean": sqlite.round_(olap.avg(c.c_acctbal), 6)})
        .group_by("c_mktsegment", "c_nationkey")
        .having(lambda c: [olap.count().gt(1), olap.max_(c.c_acctbal).gt(100)])
    )


@_query("q_global_agg", """SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity, min(l_shipdate) AS first, max(l_shipdate) AS last, count(DISTINCT l_suppkey) AS suppliers FROM lineitem""")
def _global(spark, s):
    return from_(s.lineitem).select(lambda l: {"n": olap.count(), "quantity": sqlite.round_(pg.sum(l.l_quantity), 2), "first": olap.min_(l.l_shipdate), "last": olap.max_(l.l_shipdate), "suppliers": olap.uniq_exact(l.l_suppkey)})


@_query(
    "q_cond_agg",
    """SELECT event_type, count_if(value > 50)::BIGINT AS n, round(coalesce(sum(value) FILTER (value > 50), 0), 4) AS s, round(avg(value) FILTER (value > 50), 6) AS a, min(value) FILTER (value > 50) AS lo, max(value) FILTER (value <= 50) AS hi,
    count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY ALL""",
)
def _cond_agg(spark, s):
    def record(e):
        big = e.value.gt(50)
        r = lambda x, n: sqlite.round_(x, n)
        return {"event_type": e.event_type, "n": olap.count_if(big), "s": r(olap.sum_if(e.value, big), 4), "a": r(olap.avg_if(e.value, big), 6), "lo": olap.min_if(e.value, big), "hi": olap.max_if(e.value, not_(big)), "users": pg.count_distinct(e.user_id), "median": r(pg.percentile_cont(0.5, e.value), 6)}

    return from_(s.events).select(record).group_by("event_type").cross_tenant()


@_query("q_argmax", """SELECT o_custkey, arg_max(o_orderkey, o_totalprice * 1e7 + o_orderkey) AS top, arg_min(o_orderkey, o_totalprice * 1e7 + o_orderkey) AS low FROM orders GROUP BY ALL""")
def _argmax(spark, s):
    by = lambda o: o.o_totalprice.mul(1e7).add(o.o_orderkey)
    return from_(s.orders).select(lambda o: {"o_custkey": o.o_custkey, "top": olap.arg_max(o.o_orderkey, by(o)), "low": olap.arg_min(o.o_orderkey, by(o))}).group_by("o_custkey").cross_tenant()


@_query("q_argmax_state", """SELECT event_type, arg_max(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS last_id FROM events GROUP BY ALL""")
def _argmax_state(spark, s):
    by = lambda e: olap.concat(olap.format_date_time(e.ts, "%F %T.%f"), raw_expr("lpad(cast(event_id as string), 12, '0')", t.string))
    partial = from_(s.events).select(lambda e: {"event_type": e.event_type, "user_id": e.user_id, "state": olap.arg_max_state(e.event_id, by(e))}).group_by("event_type", "user_id")
    return from_query(partial, "p").select(lambda p: {"event_type": p.event_type, "last_id": olap.arg_max_merge(p.state)}).group_by("event_type")


@_query("q_group_arrays", """SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types, array_to_string(list_sort(list(DISTINCT event_type) FILTER (value > 80))[1:2], ',') AS two FROM events GROUP BY ALL""")
def _group_arrays(spark, s):
    inner = from_(s.events).select(lambda e: {"user_id": e.user_id, "types": olap.group_uniq_array(e.event_type), "two": olap.group_uniq_array_if(2)(e.event_type, e.value.gt(80))}).group_by("user_id")
    two = lambda g: olap.if_(olap.length(g.two).eq(0), lit(None), olap.array_string_concat(g.two, ","))
    return from_query(inner, "g").select(lambda g: {"user_id": g.user_id, "types": olap.array_string_concat(g.types, ","), "two": two(g)})


@_query("q_distinct", """SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem""")
def _distinct(spark, s):
    return from_(s.lineitem).select("l_returnflag", "l_linestatus").distinct()


@_query("q_distinct_on", """SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC""")
def _distinct_on(spark, s):
    return from_(s.events).select(lambda e: {"user_id": e.user_id, "event_id": e.event_id, "event_type": e.event_type}).order_by(lambda e: [(e.user_id, "asc"), (e.ts, "desc"), (e.event_id, "desc")]).distinct_on("user_id").cross_tenant()


_BY_USER = "PARTITION BY user_id ORDER BY ts, event_id"


def _spec(e, frame=None, desc=False):
    return w.window_spec([e.user_id], [(e.ts, "asc"), (e.event_id, "asc")], frame)


@_query("q_window_running", f"""SELECT event_id, round(sum(value) OVER ({_BY_USER} ROWS UNBOUNDED PRECEDING), 4) AS running, count(*) OVER ({_BY_USER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3, max(value) OVER ({_BY_USER} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS ahead FROM events""")
def _running(spark, s):
    f = w.rows_between
    return from_(s.events).select(
        lambda e: {
            "event_id": e.event_id, "running": sqlite.round_(w.over(pg.sum(e.value), _spec(e, f(w.unbounded_preceding, w.current_row))), 4), "last3": w.over(olap.count(), _spec(e, f(w.preceding(2), w.current_row))),
            "ahead": w.over(olap.max_(e.value), _spec(e, f(w.following(1), w.following(2)))),
        }
    )


@_query("q_window_rank", """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS dr FROM orders""")
def _rank(spark, s):
    ranked = lambda o: w.window_spec([o.o_orderpriority], [(o.o_orderstatus, "asc")])
    return from_(s.orders).select(lambda o: {"o_orderkey": o.o_orderkey, "rn": w.row_number(w.window_spec([o.o_orderpriority], [(o.o_totalprice, "desc"), (o.o_orderkey, "asc")])), "rk": w.rank(ranked(o)), "dr": w.dense_rank(ranked(o))})


@_query("q_lag_lead", f"""SELECT event_id, lag(value) OVER ({_BY_USER}) AS before, lead(event_type, 2) OVER ({_BY_USER}) AS after2, coalesce(lead(event_id, 1) OVER ({_BY_USER}), -event_id) AS next_or_own FROM events""")
def _lag_lead(spark, s):
    return from_(s.events).select(lambda e: {"event_id": e.event_id, "before": w.lag(e.value, _spec(e)), "after2": w.lead(e.event_type, _spec(e), 2), "next_or_own": w.lead(e.event_id, _spec(e), 1, lit(0).sub(e.event_id))})


@_query("q_first_last", f"""SELECT event_id, first_value(event_type) OVER ({_BY_USER}) AS first, last_value(value) OVER ({_BY_USER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last FROM events""")
def _first_last(spark, s):
    return from_(s.events).select(lambda e: {"event_id": e.event_id, "first": w.first_value(e.event_type, _spec(e)), "last": w.last_value(e.value, _spec(e, w.rows_between(w.current_row, w.unbounded_following)))})


@_query("q_range_peers", """SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, round(sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 2) AS near FROM orders""")
def _peers(spark, s):
    spec = lambda o, a, b: w.window_spec([o.o_orderpriority], [(o.o_custkey, "asc")], w.range_between(a, b))
    return from_(s.orders).select(lambda o: {"o_orderkey": o.o_orderkey, "upto": w.over(olap.count(), spec(o, w.unbounded_preceding, w.current_row)), "near": sqlite.round_(w.over(pg.sum(o.o_totalprice), spec(o, w.preceding(2), w.following(2))), 2)})


@_query("q_lag_in_frame", f"""SELECT event_id, coalesce(lag(value, 2) OVER ({_BY_USER}), 0.0) AS reached, 0.0::DOUBLE AS beyond FROM events""")
def _lag_in_frame(spark, s):
    return from_(s.events).select(lambda e: {"event_id": e.event_id, "reached": w.lag_in_frame(e.value, _spec(e, w.rows_between(w.preceding(2), w.current_row)), 2), "beyond": w.lag_in_frame(e.value, _spec(e, w.rows_between(w.preceding(1), w.current_row)), 2)})


@_query("q_union_all", """SELECT 'c' AS kind, c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal > 9000 UNION ALL BY NAME SELECT s_acctbal AS balance, 's' AS kind, s_name AS name FROM supplier WHERE s_acctbal > 5000""")
def _union(spark, s):
    return union_all(
        from_(s.customer).select(lambda c: {"kind": lit("c"), "name": c.c_name, "balance": c.c_acctbal}).where(lambda c: c.c_acctbal.gt(9000)),
        from_(s.supplier).select(lambda p: {"balance": p.s_acctbal, "kind": lit("s"), "name": p.s_name}).where(lambda p: p.s_acctbal.gt(5000)),
    ).order_by(("balance", "desc"), ("name", "asc"))


@_query("q_from_union", """SELECT kind, count(*) AS n, round(max(balance), 2) AS top FROM (SELECT 'c' AS kind, c_acctbal AS balance FROM customer UNION ALL SELECT 's', s_acctbal FROM supplier) GROUP BY ALL""")
def _from_union(spark, s):
    u = union_all(from_(s.customer).select(lambda c: {"kind": lit("c"), "balance": c.c_acctbal}), from_(s.supplier).select(lambda p: {"kind": lit("s"), "balance": p.s_acctbal}))
    return from_union(u, "u").select(lambda u_: {"kind": u_.kind, "n": olap.count(), "top": sqlite.round_(olap.max_(u_.balance), 2)}).group_by("kind")


@_query(
    "q_cte_chain",
    """WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM big GROUP BY ALL) SELECT o_custkey, n, total FROM per WHERE n >= 2""",
)
def _cte(spark, s):
    from larkspur.table import table

    big = table("big", {"o_custkey": t.int64, "o_totalprice": t.float64}, external=True)
    per = table("per", {"o_custkey": t.int64, "n": t.int64, "total": t.float64}, external=True)
    return (
        from_(per)
        .with_cte("big", from_(s.orders).select("o_custkey", "o_totalprice").where(lambda o: o.o_totalprice.gt(100000)))
        .with_cte("per", from_(big).select(lambda b: {"o_custkey": b.o_custkey, "n": olap.count(), "total": sqlite.round_(pg.sum(b.o_totalprice), 2)}).group_by("o_custkey"))
        .select()
        .where(lambda p: p.n.gte(2))
    )


@_query("q_from_query", """SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) GROUP BY ALL""")
def _from_query(spark, s):
    inner = from_(s.orders).select(lambda o: {"o_custkey": o.o_custkey, "n": olap.count()}).group_by("o_custkey")
    return from_query(inner, "per").select(lambda p: {"n": p.n, "customers": olap.count()}).group_by("n")


@_query("q_select_no_from", """SELECT CAST(13 AS DOUBLE) AS chain, 'a''b' AS text, TRUE AS yes""")
def _no_from(spark, s):
    return select_no_from(lambda: {"chain": sqlite.round_(lit(10).add(2).mul(3).sub(6).div(2).mod(4), 6), "text": lit("a'b"), "yes": pg.as_boolean(lit(1).lt(2))})


@_query("q_limit_offset", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20""")
def _limit_offset(spark, s):
    return from_(s.orders).select("o_orderkey", "o_totalprice").order_by(("o_totalprice", "desc"), ("o_orderkey", "asc")).limit(50).offset(20)


@_query("q_case_filters", """SELECT event_id, CASE WHEN value > 80 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS band, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad, coalesce(nullif(event_type, 'view'), 'seen') AS kind, CASE WHEN value > 50 THEN value END AS some FROM events""")
def _case(spark, s):
    return from_(s.events).select(
        lambda e: {
            "event_id": e.event_id, "band": olap.multi_if([(e.value.gt(80), "high"), (e.value.gt(20), "mid")], "low"), "bad": olap.if_(e.event_type.eq("error"), 1, 0),
            "kind": olap.if_null(olap.null_if(e.event_type, "view"), "seen"), "some": pg.case_when([(e.value.gt(50), e.value)]),
        }
    )


@_query("q_bind_params", """SELECT event_id FROM events WHERE user_id = 7 AND value >= 10.5 AND event_type = 'click' AND ts < TIMESTAMP '2024-01-25'""")
def _params(spark, s):
    q = from_(s.events).select("event_id").where(lambda e: [e.user_id.eq(param.int("user")), e.value.gte(param.float("least")), e.event_type.eq(param.string("kind")), e.ts.lt(param.date_time_seconds("until"))])
    return q, {"user": 7, "least": 10.5, "kind": "click", "until": "2024-01-25 00:00:00", "unused": 1}


@_query("q_tenant_scoped", """SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey = 11""")
def _tenant(spark, s):
    q = from_(s.orders, "o").inner_join(s.customer, "c", lambda o, c: o.o_custkey.eq(c.c_custkey)).select(lambda o: {"o_orderkey": o.o_orderkey, "c_name": o.c.c_name}).where(lambda o: o.o_custkey.eq(11))
    made = compile_query(q, spark)
    if made.tenant_scope != "single-tenant":
        raise AssertionError(made.tenant_scope)
    return made.df


@_query("q_sql_template", """SELECT o_orderkey, o_totalprice * 2 + 1 AS twice FROM orders WHERE o_orderstatus = 'F' AND length(o_orderpriority) > 3""")
def _template(spark, s):
    return from_(s.orders, "o").select(lambda o: {"o_orderkey": o.o_orderkey, "twice": sql("{a} * {b} + 1", t.float64, a=o.o_totalprice, b=2)}).where(lambda o: [sql.cond("{s} = {v}", s=o.o_orderstatus, v="F"), untyped_expr("length(o_orderpriority)").gt(3)])
