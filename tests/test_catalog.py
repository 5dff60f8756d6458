"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__
from oxyframe.plans import catalog

from .helpers import agree

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SMALL)
    if name in catalog.oracle_sql():
        agree(df, catalog.oracle_sql()[name], SMALL)
    else:
        assert df.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


def test_windows_share_one_exchange(spark):
    plan = catalog.clean_smooth_rescale(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
