"""name -> (query over Tables, SQL or None). Doubles are rounded to six decimals on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.plans.fixtures import Tables, with_views

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under name, with SQL over the views where it can be expressed."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def r(expr: str, name: str) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}"  # + 0.0 turns a negative zero into zero


def big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def ap_sql(source: str, by: str, weight: str = "1") -> str:
    """A subquery (by, n_rows, positives, ap) by blocks of equal scores; source has target and predict."""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""(SELECT {lead}SUM(n) AS n_rows, MAX(pos) AS positives, SUM(CASE WHEN pos > 0 THEN CAST(tp AS DOUBLE) / pos * ctp / cn END) AS ap FROM (
SELECT *, SUM(tp) OVER ({part} ORDER BY predict DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctp,
SUM(n) OVER ({part} ORDER BY predict DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn, SUM(tp) OVER ({part}) AS pos
FROM (SELECT {lead}predict, SUM({weight} * target) AS tp, SUM({weight}) AS n FROM {source} GROUP BY {lead}predict)) {group})"""
