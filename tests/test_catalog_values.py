"""Each query of the module against its SQL twin, row by row, types included."""

import duckdb
import pytest

from larkspur.plans import catalog, catalog_values

SF = "/root/testdata/sf0.001"
NAMES = ("q_json_tree", "q_array_agg", "q_json_object", "q_any", "q_array_union", "q_null_scalars", "q_conversions", "q_json_texts", "q_lists", "q_nulls_first", "q_nulls_last", "q_insert_returning", "q_update_returning", "q_delete_returning")


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for name in ("nation", "customer", "part", "orders", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equals_its_twin(spark, twin, name):
    assert catalog_values
    made = catalog.queries()[name](spark, SF)
    columns = sorted(made.columns)
    result = twin.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})")
    want = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(r)) for r in made.select(*columns).collect()) == want and want
