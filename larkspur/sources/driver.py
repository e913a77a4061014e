"""Definitions of the driver's tables over a folder of parquet files."""

from __future__ import annotations

from types import SimpleNamespace

from larkspur import types as t
from larkspur.table import TableDef, parquet_table

COLUMNS = {
    "region": {"r_regionkey": t.int32, "r_name": t.string},
    "nation": {"n_nationkey": t.int32, "n_name": t.string, "n_regionkey": t.int32},
    "customer": {"c_custkey": t.int64, "c_name": t.string, "c_nationkey": t.int32, "c_acctbal": t.float64, "c_mktsegment": t.string},
    "supplier": {"s_suppkey": t.int64, "s_name": t.string, "s_nationkey": t.int32, "s_acctbal": t.float64},
    "part": {"p_partkey": t.int64, "p_name": t.string, "p_brand": t.string, "p_type": t.string, "p_size": t.int32, "p_retailprice": t.float64},
    "orders": {"o_orderkey": t.int64, "o_custkey": t.int64, "o_orderstatus": t.string, "o_totalprice": t.float64, "o_orderdate": t.date_time64, "o_orderpriority": t.string},
    "lineitem": {"l_orderkey": t.int64, "l_partkey": t.int64, "l_suppkey": t.int64, "l_linenumber": t.int32, "l_quantity": t.float64, "l_extendedprice": t.float64, "l_discount": t.float64, "l_tax": t.float64, "l_returnflag": t.string, "l_linestatus": t.string, "l_shipdate": t.date_time64},
    "events": {"event_id": t.int64, "ts": t.date_time64, "user_id": t.int64, "event_type": t.string, "value": t.float64, "props": t.string},
    "documents": {"doc_id": t.int64, "text": t.string, "lang": t.string, "source": t.string, "n_chars": t.int64},
    "embeddings": {"vec_id": t.int64, "embedding": t.array(t.float4), "label": t.int32},
    "pages": {"page_id": t.int64, "url": t.string, "html": t.string},
    "benchmark": {"item_id": t.int64, "text": t.string},
    "labels": {"doc_id": t.int64, "quality": t.int32, "toxic": t.int32},
    "conversations": {"conv_id": t.int64, "turn": t.int64, "role": t.string, "text": t.string},
}


def tables(sf_dir: str) -> SimpleNamespace:
    """Every driver table; orders belong to the tenant o_custkey, events to user_id."""
    tenants = {"orders": "o_custkey", "events": "user_id"}
    made: dict[str, TableDef] = {n: parquet_table(n, f"{sf_dir.rstrip('/')}/{n}.parquet", c, tenant=tenants.get(n)) for n, c in COLUMNS.items()}
    return SimpleNamespace(**made)
