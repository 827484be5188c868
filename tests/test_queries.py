"""Every registered query against its SQL at the smallest scale."""

import pytest
from oracle import connect, differences

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
# at the smallest scale some users lack an event type, and closed forms need complete tables
COMPLETE = "/root/testdata/sf0.01"
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return {f: connect(f) for f in (FOLDER, COMPLETE)}


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, con, name):
    folder = COMPLETE if name.startswith(("lmm", "lrt", "emmeans")) else FOLDER
    got = contract.queries()[name](spark, folder).toPandas()
    if name in SQL:
        assert differences(got, con[folder].execute(SQL[name]).fetchdf()) is None
    else:
        assert len(got) > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 5
