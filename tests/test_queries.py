import duckdb
import pytest

from ledgerline.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_plans(spark):
    """Filters and columns reach the scans, and pages become a top-k."""
    from ledgerline.queries import FLAGSHIP, _database

    plan = _database(spark, SF, "orders", "lineitem").query(FLAGSHIP).dataframe._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(o_orderstatus,F)" in plan and "StringStartsWith(l_returnflag,R)" in plan
    assert "o_totalprice" not in plan and "l_extendedprice" not in plan
    for name, pushed in (("filter_date_order", "GreaterThanOrEqual(o_orderdate,1995-01-01"), ("and_or_precedence", "And(EqualTo(l_returnflag,A),LessThanOrEqual(l_quantity,11.0))")):
        assert pushed in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["o_orderkey", "l_linenumber", "l_partkey"]
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
