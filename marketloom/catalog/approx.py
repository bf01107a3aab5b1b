"""Sketch queries.  An estimate is checked by its true rank and relative error against the exact path, both in the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col
from ..operators import sketches as sk
from ..operators.timeseries import join_on
from .base import query

PROBS = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
_cols = "n:i days:i users:i p05:d p50:d p95:d quantiles_within:b users_within:b"
_exact = """count(price) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT user_id) AS users, quantile_cont(price, 0.05) AS p05,
    quantile_cont(price, 0.5) AS p50, quantile_cont(price, 0.95) AS p95, true AS quantiles_within, true AS users_within"""


def against_exact(rows: DataFrame, merged: DataFrame, keys) -> DataFrame:
    """Exact percentiles and distinct users, and whether the sketches are within their stated errors."""
    parts = [sk.percentiles(rows, keys, "price", PROBS), sk.distinct_count(rows, keys, "user_id", out="users"),
             sk.sketch_distinct(merged, keys, "estimate"),
             sk.rank_errors(rows, sk.sketch_percentiles(merged, keys, PROBS), keys, "price", PROBS)]
    d = reduce(lambda a, b: join_on(a, b, list(keys)), parts, merged.select(*keys, "n", "days"))
    return d.withColumns({"quantiles_within": col("rank_error") <= sk.RANK_ERROR,
                          "users_within": F.abs(col("estimate") - col("users")) <= sk.DISTINCT_ERROR * col("users")})


@query("approx_day_sketches", "symbol " + _cols, f"SELECT symbol, {_exact} FROM ticks GROUP BY 1")
def _days(m):
    rows = m.ticks()
    return against_exact(rows, sk.merge_sketches(sk.day_sketches(rows, ["symbol"], "ts", "price", "user_id"), ["symbol"]), ["symbol"])


@query("approx_day_range", "symbol " + _cols, f"""SELECT symbol, {_exact} FROM ticks WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND
    DATE '2024-01-14' GROUP BY 1""")
def _range(m):
    """A week is read from its day sketches alone."""
    day = F.to_date("ts")
    week = m.ticks().filter(day.between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-14").cast("date")))
    days = sk.day_sketches(m.ticks(), ["symbol"], "ts", "price", "user_id")
    return against_exact(week, sk.merge_sketches(days, ["symbol"], "2024-01-08", "2024-01-14"), ["symbol"])
