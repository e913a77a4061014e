"""Registered queries for the rest of the value functions, aggregates and clauses."""

from __future__ import annotations

from larkspur import types as t
from larkspur.expr import aliased, dynamic_column, escape_like, in_list, lit, not_in_list, typed_value, undecoded
from larkspur.functions import olap, pg, sqlite
from larkspur.operators.write import delete_from, insert_into, update
from larkspur.plans.catalog import _query
from larkspur.plans.catalog_more import _ref, _scratch
from larkspur.plans.lower import Semantics, compile_query
from larkspur.plans.query import from_, from_query
from larkspur.sources import json_tables


@_query(
    "q_json_tree",
    """SELECT event_id, '$' AS fullkey, 'object' AS type, NULL::VARCHAR AS atom FROM events WHERE props IS NOT NULL
    UNION ALL SELECT event_id, '$.k', 'integer', json_extract_string(props, '$.k') FROM events WHERE json_extract(props, '$.k') IS NOT NULL""",
)
def _json_tree(spark, s):
    return from_(s.events, "e").inner_join(json_tables.json_tree(_ref("e", "props")), "j", lambda e, j: None).select(lambda e: {"event_id": e.event_id, "fullkey": e.j.fullkey, "type": e.j.type, "atom": e.j.atom})


@_query("q_array_agg", """SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY ALL""")
def _array_agg(spark, s):
    inner = from_(s.orders).select(lambda o: {"o_custkey": o.o_custkey, "keys": pg.array_agg(o.o_orderkey)}).group_by("o_custkey")
    return from_query(inner, "g").select(lambda g: {"o_custkey": g.o_custkey, "keys": olap.array_string_concat(olap.array_sort(g.keys), ",")})


@_query("q_json_object", """SELECT n_regionkey, '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS nations FROM nation GROUP BY ALL""")
def _json_object(spark, s):
    return from_(s.nation).select(lambda n: {"n_regionkey": n.n_regionkey, "nations": sqlite.json_group_object(n.n_name, n.n_nationkey)}).group_by("n_regionkey")


@_query("q_any", """SELECT c_nationkey, c_mktsegment AS one, CASE WHEN bool_or(c_acctbal < 0) THEN c_mktsegment END AS indebted FROM customer GROUP BY c_nationkey, c_mktsegment""")
def _any(spark, s):
    inner = from_(s.customer).select(lambda c: {"c_nationkey": c.c_nationkey, "segment": c.c_mktsegment, "one": olap.any_(c.c_mktsegment), "indebted": olap.any_if(c.c_mktsegment, c.c_acctbal.lt(0))}).group_by("c_nationkey", "segment")
    return from_query(inner, "g").select("c_nationkey", "one", "indebted")


@_query("q_array_union", """SELECT o_custkey, string_agg(part, ',' ORDER BY part) AS parts FROM (SELECT DISTINCT o_custkey, unnest([o_orderstatus, o_orderpriority]) AS part FROM orders) GROUP BY ALL""")
def _array_union(spark, s):
    inner = from_(s.orders).select(lambda o: {"o_custkey": o.o_custkey, "parts": olap.group_uniq_array_array(olap.array_of(o.o_orderstatus, o.o_orderpriority))}).group_by("o_custkey")
    return from_query(inner, "g").select(lambda g: {"o_custkey": g.o_custkey, "parts": olap.array_string_concat(g.parts, ",")})


@_query(
    "q_null_scalars",
    """SELECT p_partkey, CASE WHEN p_size <> 10 THEN least(p_size, 20) END AS lo, CASE WHEN p_size <> 10 THEN greatest(p_size, 20) END AS hi, least(p_size, 20) AS lo_skip,
    CAST(trunc(p_retailprice) AS BIGINT) AS whole, NULL::BIGINT AS no_number, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind FROM part""",
)
def _null_scalars(spark, s):
    return from_(s.part).select(
        lambda p: {
            "p_partkey": p.p_partkey, "lo": sqlite.least(sqlite.nullif(p.p_size, 10), 20), "hi": sqlite.greatest(sqlite.nullif(p.p_size, 10), 20), "lo_skip": olap.least(p.p_size, 20),
            "whole": sqlite.cast(p.p_retailprice, t.integer), "no_number": sqlite.cast(p.p_name, t.integer), "kind": sqlite.iif(p.p_size.gt(25), "big", "small"),
        }
    )


@_query(
    "q_conversions",
    """SELECT o_orderkey, o_orderkey::DOUBLE AS real, CASE WHEN o_orderkey BETWEEN 0 AND 65535 THEN o_orderkey ELSE 0 END::INTEGER AS small, CASE WHEN o_orderstatus = 'F' THEN -1.0 ELSE o_orderkey END::DOUBLE AS finite,
    make_timestamp(o_orderkey * 1000000) AS moment, epoch(o_orderdate)::BIGINT AS seconds FROM orders""",
)
def _conversions(spark, s):
    return from_(s.orders).select(
        lambda o: {
            "o_orderkey": o.o_orderkey, "real": olap.to_float64(o.o_orderkey), "small": olap.to_uint16_or_zero(o.o_orderkey), "finite": olap.if_not_finite(olap.to_float64(olap.if_(o.o_orderstatus.eq("F"), "Infinity", olap.to_string(o.o_orderkey))), -1.0),
            "moment": olap.to_date_time(o.o_orderkey), "seconds": sqlite.unixepoch(o.o_orderdate),
        }
    )


@_query("q_json_texts", """SELECT event_id, json_extract_string(props, '$.k') AS k_text, replace(props, ' ', '') AS tight FROM events""")
def _json_texts(spark, s):
    return from_(s.events).select(lambda e: {"event_id": e.event_id, "k_text": pg.json_path_text(e.props, "k"), "tight": sqlite.json_(e.props)})


@_query("q_lists", """SELECT o_orderkey, 7::INTEGER AS seven, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT') AND contains(o_orderpriority, '-') AND NOT contains(o_orderpriority, '_')""")
def _lists(spark, s):
    return (
        from_(s.orders)
        .select(lambda o: {"o_orderkey": o.o_orderkey, "seven": typed_value(t.int32, 7), "status": aliased(o.o_orderstatus, "status"), "priority": dynamic_column("o_orderpriority", t.string), "price": undecoded(o.o_totalprice)})
        .where(lambda o: [in_list(o.o_orderstatus, ["F", "O"]), not_in_list(o.o_orderpriority, ["1-URGENT"]), o.o_orderpriority.like("%-%"), o.o_orderpriority.not_like(f"%{escape_like('_')}%")])
    )


def _ordered(null_order):
    def fn(spark, s):
        joined = from_(s.customer, "c").left_join(s.orders, "o", lambda c, o: [c.c_custkey.eq(o.o_custkey), o.o_totalprice.gt(250000)])
        q = joined.select(lambda c: {"c_custkey": c.c_custkey, "o_orderkey": c.o.o_orderkey}).order_by(("o_orderkey", "asc"), ("c_custkey", "asc")).limit(40)
        return compile_query(q, spark, None, Semantics(null_order=null_order)).df

    return fn


for _name, _order in (("first", "FIRST"), ("last", "LAST")):
    _query(f"q_nulls_{_name}", f"""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000 ORDER BY o_orderkey ASC NULLS {_order}, c_custkey LIMIT 40""")(_ordered(_name))


@_query("q_insert_returning", """SELECT o_orderkey, 'late' AS note FROM orders WHERE o_orderkey % 3 = 0""")
def _insert_returning(spark, s):
    store, mine = _scratch(spark, s)
    late = from_(s.orders).select(lambda o: {"o_orderkey": o.o_orderkey, "o_orderstatus": o.o_orderstatus, "o_totalprice": o.o_totalprice, "note": lit("late")}).where(lambda o: o.o_orderkey.mod(3).eq(0))
    return insert_into(mine).select(late).returning("o_orderkey", "note").run(store)


@_query("q_update_returning", """SELECT o_orderkey, 'open' AS note FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus = 'P'""")
def _update_returning(spark, s):
    store, mine = _scratch(spark, s)
    return update(mine).set({"note": "open"}).where(lambda r: r.o_orderstatus.eq("P")).returning("o_orderkey", "note").run(store)


@_query("q_delete_returning", """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 AND o_totalprice < 50000""")
def _delete_returning(spark, s):
    store, mine = _scratch(spark, s)
    return delete_from(mine).where(lambda r: r.o_totalprice.lt(50000)).returning("o_orderkey", "o_orderstatus").run(store)
