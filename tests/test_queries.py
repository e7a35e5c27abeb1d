import pytest

import __spark_entry__
from spillway import queries
from tests.oracle import DATA, connect, same


@pytest.fixture(scope="module")
def con():
    return connect("sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_duckdb(spark, con, name):
    same(queries.QUERIES[name](spark, f"{DATA}/sf0.001"), con, queries.ORACLES[name])


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["pos", "value"] and df.count() == 6000
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_random_generator(spark):
    got = queries.random_generator(spark, f"{DATA}/sf0.001").toPandas()["value"]
    assert len(got) == 1500 and got.between(0, 2**32 - 1).all() and got.nunique() > 1490


def test_position_needs_no_single_task(spark):
    from spillway.operators.sort import global_sort

    keys = queries._keys(spark, f"{DATA}/sf0.001")
    plan = global_sort(keys, "value", spread=True)._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan and "SinglePartition" not in plan
