"""Time bars from ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import div

# Accepted bar sizes and their spellings.
TIMEFRAMES = {
    "1m": "1 minute", "1min": "1 minute", "5m": "5 minutes", "5min": "5 minutes", "15m": "15 minutes",
    "15min": "15 minutes", "1h": "1 hour", "1hour": "1 hour", "1d": "1 day", "1day": "1 day",
}


def ohlcv_bars(ticks: DataFrame, freq: str, keys=("symbol",), tie: str = "event_id") -> DataFrame:
    """Open/high/low/close/volume/vwap/count per bucket; every aggregate combines map-side, so hot symbols are fine."""
    if freq not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {freq!r}; use one of {sorted(TIMEFRAMES)}")
    at = F.struct("ts", tie)
    g = ticks.groupBy(*keys, F.window("ts", TIMEFRAMES[freq]).alias("_w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("qty").alias("volume"),
        F.sum(F.col("price") * F.col("qty")).alias("_pv"), F.count(F.lit(1)).alias("trades"))
    return g.select(*keys, F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume",
                    div("_pv", "volume").alias("vwap"), "trades")
