"""Registered queries against SQL on the smallest tables.

A sample runs by default; STATEWELL_ALL_ORACLES=1 runs every pair.
"""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, canonical

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "s7_verify_manifest", "p8_attach_violations", "p14_matched_pairs", "p23_stored_order", "v7_sample_map", "v20_input_digest",
    "d4_scores", "d16_response_regression", "d18_projector_distance", "k3_plugin_bandwidth", "k8_k10_critical_points",
    "g2_rank_ordered_lines", "b7_paired_differences", "b8_paired_bootstrap_interval", "quantiles_grouped",
)
NAMES = tuple(oracle_sql()) if os.environ.get("STATEWELL_ALL_ORACLES") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cur = duck.execute(oracle_sql()[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(
        [d[0] for d in cur.description], cur.fetchall()
    )


def test_every_oracle_has_its_query():
    assert set(oracle_sql()) <= set(queries())


def test_flagship(spark):
    assert entry(spark).columns == ["layer", "kind", "x", "ordinal"]
