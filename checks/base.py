"""Registry of checked queries and shared pieces of their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say it, the equivalent statement."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 4, skip: tuple[str, ...] = (), **special: int) -> DataFrame:
    """Round every double column; sums run in a different order in the two engines."""
    return df.select(
        *[
            F.round(c, special.get(c, digits)).alias(c) if t == "double" and c not in skip else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def R(expr: str, digits: int = 4) -> str:
    """Decimal half-up rounding of the shortest text of a double, as Spark's ``round`` does."""
    return f"cast(round(cast(cast(({expr}) as varchar) as decimal(38,15)), {digits}) as double)"


def _panel(name: str, series: str, ts: str, value: str, source: str, freq: str = "month") -> str:
    period = f"date_trunc('{freq}', {ts})"
    period = period if freq == "hour" else f"cast({period} as date)"
    return (
        f"{name} AS (SELECT cast({series} as varchar) AS series_id, {period} AS ts, "
        f"cast(sum(cast({value} as decimal(24,6))) as double) / count({value}) AS y, max({value}) AS peak "
        f"FROM {source} GROUP BY 1, 2)"
    )


PRI = _panel("p", "o_orderpriority", "o_orderdate", "o_totalprice", "orders")
NAT = _panel("p", "c_nationkey", "o_orderdate", "o_totalprice", "orders JOIN customer ON o_custkey = c_custkey")
BRA = _panel("p", "p_brand", "l_shipdate", "l_extendedprice", "lineitem JOIN part ON l_partkey = p_partkey")
DAY = _panel("p", "event_type", "ts", "value", "events", "day")
HOUR = _panel("p", "event_type", "ts", "value", "events", "hour")

POS = (
    "q AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS pos, "
    "count(*) OVER (PARTITION BY series_id) AS n FROM p)"
)
SPLIT = (
    "sp AS (SELECT *, CASE WHEN pos > n - 12 THEN 'test' WHEN pos > n - 24 THEN 'val' ELSE 'train' END AS split "
    "FROM q WHERE n >= 25)"
)


def W(cte: str, *more: str) -> str:
    return "WITH " + ", ".join([cte, *more]) + " "
