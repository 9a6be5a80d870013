"""Queries against their SQL in DuckDB."""

import duckdb
import pytest

from gazette.plans import catalog as registry
from verify_sql import TABLES, canonical

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.SQL))
def test_same_rows(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_bootstrap_holds_the_mean(spark):
    rows = registry.QUERIES["bootstrap_auc"](spark, SF).collect()
    assert rows and all(r.ci_low <= r.mean <= r.ci_high for r in rows)
