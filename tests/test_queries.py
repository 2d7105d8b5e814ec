"""Registered queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

from plumbline.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
FAST = ["ols_multi", "ols_constrained", "ols_cluster_boot_se", "ols_enum_boot_region", "fe_oneway", "panel_diff2", "iv_2sls", "iv_sargan", "moment_cov_multiway", "es_att_gt", "es_supt_band", "rct_ipw_att", "moran_panel", "gls_pw_twostep", "haversine"]


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).fetchdf()
    key = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
