"""All registered queries of the entity-matching part."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairlab.plans import basics, measures, modelling  # noqa: F401  their queries register on import
from pairlab.plans.fixtures import Tables
from pairlab.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir)) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
