"""All registered queries of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statewell.plans import (  # noqa: F401
    association_queries, contract_queries, evaluate_queries, evidence_queries, landscape_queries, prep_queries, stage1_queries,
)
from statewell.plans.registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["k14_critical_points_svd"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
