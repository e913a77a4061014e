"""Queries over relations against their SQL twins, on few rows that the generated tables do not have."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from larkspur.plans import catalog


@pytest.fixture
def twin(spark, tmp_path):
    """Writes the tables; gives a function that runs a query and its SQL, both as sorted rows."""

    def both(name, **tables):
        con = duckdb.connect()
        for table, columns in tables.items():
            pq.write_table(pa.table(columns), tmp_path / f"{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        made = catalog.queries()[name](spark, str(tmp_path))
        columns = ", ".join(f'"{c}"' for c in made.columns)
        result = con.execute(f"SELECT {columns} FROM ({catalog.oracle_sql()[name]})")
        return sorted(repr(tuple(r)) for r in made.collect()), sorted(map(repr, result.fetchall()))

    return both


def customers(keys, nations):
    n = len(keys)
    return {"c_custkey": pa.array(keys, pa.int64()), "c_name": ["x"] * n, "c_nationkey": pa.array(nations, pa.int32()), "c_acctbal": [1.0] * n, "c_mktsegment": ["m"] * n}


def orders(keys, custkeys, prices, statuses=None):
    n = len(keys)
    return {
        "o_orderkey": pa.array(keys, pa.int64()), "o_custkey": pa.array(custkeys, pa.int64()), "o_orderstatus": pa.array(statuses or ["F"] * n, pa.string()), "o_totalprice": pa.array(prices, pa.float64()),
        "o_orderdate": pa.array([0] * n, pa.timestamp("us")), "o_orderpriority": ["1"] * n,
    }


def test_some_none_every_leaves_out_odd_customers_without_orders(twin):
    got, want = twin(
        "q_relation_some_none_every", customer=customers([1, 2, 3, 4, 5, 5, 6, None], [0] * 8),
        orders=orders([1, 2, 3, 4, 5, 6], [3, 3, 4, 5, 6, None], [400000.0, 100.0, None, 9000.0, 300000.5, 1.0], ["F", "P", "F", "O", None, "F"]),
    )
    assert got == want and len(got) == 6


def test_nested_takes_the_order_of_the_sql_and_no_customer_without_a_nation(twin):
    got, want = twin(
        "q_relation_nested", nation={"n_nationkey": pa.array([0, 1], pa.int32()), "n_name": ["A", "B"], "n_regionkey": pa.array([0, 0], pa.int32())}, customer=customers([1, 2, 3, 4, 5], [0, 1, 7, None, 1]),
        orders=orders([1, 9_000_000, 5, 6, 7, 8, None], [1, 1, 2, 2, 3, 4, 2], [300000.01, 300000.0, 250000.0, 250000.0, 300000.0, 300000.0, 400000.0]),
    )
    assert got == want and got == ["(1, 'A', 2, 9000000)", "(2, 'B', 3, 6)", "(5, 'B', 0, None)"]


def test_a_level_is_ordered_by_expressions(spark, tmp_path):
    import larkspur.types as t
    from larkspur.operators.relations import Read, Relations, many
    from larkspur.table import parquet_table

    pq.write_table(pa.table({"k": [1, 2]}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"k": [1, 1, 1, 2], "x": [3, 1, 2, 9]}), tmp_path / "b.parquet")
    a, b = (parquet_table(n, f"{tmp_path}/{n}.parquet", {c: t.int64 for c in columns}) for n, columns in (("a", ["k"]), ("b", ["k", "x"])))
    level = Read(order_by=lambda r: [(r.x.mod(3), "desc"), (r.x, "asc")], columns=("x",))
    got = Relations({"a": {"bs": many(b, "k", "k")}}).find_many(spark, a, Read(order_by=lambda r: [(r.k.mul(-1), "asc")], with_={"bs": level}))
    assert got.columns == ["k", "bs"]
    assert [(r["k"], [x.asDict() for x in r["bs"]]) for r in got.collect()] == [(2, [{"x": 9}]), (1, [{"x": 2}, {"x": 1}, {"x": 3}])]
