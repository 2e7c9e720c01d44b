"""Every query runs on the smallest tables, and equals its SQL."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quillon.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _rows(df, cols):
    def plain(x):
        if x is None or x is pd.NA or x != x:
            return None
        return int(x) if not isinstance(x, bool | str) and hasattr(x, "__int__") and x == int(x) else x

    return sorted(str(tuple(map(plain, r))) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in registry.ORACLE_SQL:
        c = duckdb.connect()
        for f in glob.glob(f"{SF}/*.parquet"):
            c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        want = c.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got, sorted(got.columns)) == _rows(want, sorted(got.columns))
