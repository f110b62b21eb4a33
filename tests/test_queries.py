"""Some queries of each family against their SQL, on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from xmlframe import queries

SF = "/root/testdata/sf0.001"
SOME = ("rd_sequence", "rd_array_native", "rd_repeated_all", "rd_choice", "rd_substitution_repeat", "rd_xsi_type", "rd_union", "rd_any_element", "rd_nil_native", "rd_default_minimal_native", "rd_recursive", "rt_orders_nested", "ty_double", "ty_base64", "fx_total_fraction", "wr_array", "wr_array_python", "wr_nil", "js_orders", "ut_add_duration", "cat_index")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for x in os.listdir(SF):
        if x.endswith(".parquet"):
            c.execute(f"create view {x[:-8]} as select * from read_parquet('{SF}/{x}')")
    return c


def plain(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    sql = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in sql.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in sql.fetchall())
    assert got == want and got


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(queries.queries()) > 150 and len(queries.oracle_sql()) > 150


def test_native_plans_push_columns_down(spark):
    df = queries.queries()["rt_lineitem"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    scan = re.search(r"FileScan parquet \[([^\]]*)\]", plan)[1]  # the schema itself is cut off when it is long
    assert "l_tax" not in scan and "l_shipdate" not in scan and "l_orderkey" in scan
