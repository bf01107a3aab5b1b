"""Signals, gates, order sizing and rule-trade statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col, div

# Indicators and sources a signal may be required to show.
INDICATORS = ("rsi", "macd", "bollinger")
SOURCES = ("reddit", "news")


def make_signals(predictions: DataFrame) -> DataFrame:
    p = col("prediction")
    return predictions.withColumns({"side": F.when(p > 0, "BUY").when(p < 0, "SELL").otherwise("HOLD"),
                                    "strength": F.least(F.abs(p), F.lit(1.0))})


def gate_signals(s: DataFrame, positions: DataFrame, mode: str, as_of, max_positions: int = 10, max_age_min: int = 10,
                 min_strength: float = 0.6, boost: float = 0.1, confluence: int = 2, min_score: float = 0.7,
                 high_confidence: float = 0.8) -> DataFrame:
    """s (symbol, ts, strength, confidence, indicators[], sentiment_score, sources[]) filtered by the mode's rules.

    Symbols already held are removed by an anti join, and only the free slots are filled, best confidence first.
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    d = s.filter((col("ts") <= at) & (col("ts") >= at - F.expr(f"interval {max_age_min} minutes")))
    d = d.join(positions.select("symbol").distinct(), "symbol", "left_anti")
    tech, sent = F.size("indicators") > 0, col("sentiment_score").isNotNull()
    if mode == "adaptive":
        d = d.filter(col("strength") >= min_strength).withColumn("confidence", F.when(
            tech & sent, F.least(F.lit(1.0), col("confidence") + boost)).otherwise(col("confidence")))
    elif mode == "technical_only":
        need = F.array(*[F.lit(i) for i in INDICATORS])
        shown = F.filter(need, lambda n: F.exists("indicators", lambda i: F.contains(F.lower(i), n)))
        d = d.filter(tech & (F.size(shown) >= confluence))
    elif mode == "sentiment_only":
        hit = F.size(F.array_intersect("sources", F.array(*[F.lit(x) for x in SOURCES]))) > 0
        d = d.filter(sent & (F.abs("sentiment_score") >= min_score) & hit)
    elif mode == "conservative":
        d = d.filter((col("confidence") >= high_confidence) & tech & sent)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    held = positions.agg(F.countDistinct("symbol")).scalar()
    ranked = d.orderBy(col("confidence").desc(), "symbol", "ts").limit(max_positions)
    n = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(col("confidence").desc(), "symbol", "ts"))
    return ranked.withColumn("slot", n).filter(col("slot") <= max_positions - held)


def sentiment_signals(s: DataFrame, score: float = 0.7, confidence: float = 0.6, mentions: float = 50) -> DataFrame:
    d = s.filter((F.abs("score") >= score) & (col("confidence") >= confidence) & (col("mentions") >= mentions))
    return d.withColumn("side", F.when(col("score") > 0, "BUY").otherwise("SELL"))


def size_orders(s: DataFrame, risk: float = 0.02) -> DataFrame:
    return s.withColumn("qty", F.floor(F.coalesce(div(col("equity") * risk, "mid"), F.lit(0.0))))


def time_exit(p: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return p.filter(col("entry_ts") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {hours} hours"))


def trade_stats(trades: DataFrame, capital: float = 10000.0, keys: Sequence[str] = ("symbol", "param_id")) -> DataFrame:
    """The n-th exit pairs with the n-th entry of its series."""
    keys = list(keys)
    w = Window.partitionBy(*keys, "action").orderBy("ts")
    d = trades.withColumn("k", F.row_number().over(w))
    b = d.filter("action = 'buy'").select(*keys, "k", col("close").alias("px_in"))
    x = d.filter("action = 'sell'").select(*keys, "k", col("close").alias("px_out"), "ts", "cash")
    j = x.join(b, [*keys, "k"]).withColumn("_r", col("px_out") / col("px_in") - 1)
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), (F.count_if(col("_r") > 0) / F.count(F.lit(1))).alias("win_rate"), F.avg("_r").alias(
            "mean_return"), F.max_by("cash", "ts").alias("final_value"), (F.max_by("cash", "ts") / capital - 1).alias("total_return"))


def fixed_risk_size(s: DataFrame, account: float = 10000.0, risk: float = 0.02) -> DataFrame:
    per = F.abs(col("entry") - col("stop"))
    d = s.withColumn("shares", F.coalesce(F.floor(div(F.lit(account * risk), per)), F.lit(0)))
    return d.withColumns({"position_value": col("shares") * col("entry"),
                          "reward_risk": div(F.abs(col("target") - col("entry")), per)})
