"""Feature plan: ticks -> bars -> technical features -> cleaned newest row per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import technical as tech
from ..operators.timeseries import latest
from ..session import cut_lineage
from ..sources.adapters import Market

FLAGSHIP = (tech.returns, tech.sma, tech.bollinger, tech.hist_vol)


def latest_features(spark: SparkSession, folder: str, groups=FLAGSHIP) -> DataFrame:
    bars = Market(spark, folder).bars()
    return latest(tech.with_technical(bars, groups=groups), "symbol", "ts")


def feature_table(bars: DataFrame, sentiment: DataFrame, groups=tech.WINDOW_FEATURES + tech.RECURRENT_FEATURES,
                  at_once: int = 8) -> DataFrame:
    """All technical groups and the calendar of every bar, with the mean sentiment (score, confidence) of its hour.

    Bars are written once; ``at_once`` groups make one plan, because a plan of all of them is too deep to analyse.
    """
    bars = cut_lineage(bars)
    out = tech.calendar_features(bars)
    for i in range(0, len(groups), at_once):
        part = tech.with_technical(bars, groups=groups[i : i + at_once])
        new = [c for c in part.columns if c not in out.columns]
        out = out.join(cut_lineage(part.select("symbol", "ts", *new)), ["symbol", "ts"])
    mood = sentiment.groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.avg("score").alias("sent_score"), F.avg("confidence").alias("sent_confidence"))
    return out.join(mood, ["symbol", "ts"], "left")
