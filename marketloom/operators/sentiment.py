"""Sentiment features per symbol at an explicit as-of time, and multi-source fusion.

Features are conditional aggregates: one pass over the look-back rows, combined map-side.  Only exact medians and
row-order splits need more, and those use the cell and block helpers of ``timeseries``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, col, div, flag, weighted_mean
from .mentions import literal_map
from .news import hours_before
from .timeseries import exact_percentiles, index_rows, join_on

# Windows, decay and source weights of the features; weights of the fusion.
WINDOWS = (1, 4, 12, 24, 48)
DECAY_RATE = 0.05
SOURCE_WEIGHTS = {"reddit": 0.4, "news": 0.25, "twitter": 0.2, "unusual_whales": 0.15}
OTHER_WEIGHT = 0.25
FUSION_WEIGHTS = {"reddit": 0.35, "news": 0.30, "unusual_whales": 0.20, "twitter": 0.15}


def since(df: DataFrame, as_of, hours: float) -> DataFrame:
    at = F.lit(as_of).cast("timestamp_ntz")
    return df.filter((col("ts") >= at - F.expr(f"interval {int(hours * 60)} minutes")) & (col("ts") <= at))


def basic_24h(df: DataFrame, as_of, keys=("symbol",)) -> DataFrame:
    keys = list(keys)
    d = since(df, as_of, 24)
    s, c = col("score"), col("confidence")
    n = F.count(F.lit(1))
    g = d.groupBy(*keys).agg(
        weighted_mean(s, c).alias("sentiment_conf_24h"), F.avg(s).alias("sentiment_raw_24h"),
        F.stddev_pop(s).alias("sentiment_std_24h"), F.avg(c).alias("confidence_avg_24h"),
        F.min(c).alias("confidence_min_24h"), F.max(c).alias("confidence_max_24h"),
        F.sum("mentions").alias("mention_sum_24h"), F.avg("mentions").alias("mention_avg_24h"),
        F.max("mentions").alias("mention_max_24h"), (F.count_if(s > 0.1) / n).alias("bullish_ratio_24h"),
        (F.count_if(s < -0.1) / n).alias("bearish_ratio_24h"),
        (F.count_if(s.between(-0.1, 0.1)) / n).alias("neutral_ratio_24h"),
        F.sum("bullish").alias("bullish_signals_24h"), F.sum("bearish").alias("bearish_signals_24h"))
    g = g.withColumn("signal_ratio_24h", div(col("bullish_signals_24h") - col("bearish_signals_24h"),
                                             col("bullish_signals_24h") + col("bearish_signals_24h")))
    return join_on(g, exact_percentiles(d, keys, "score", {"sentiment_median_24h": 0.5}), keys, "left")


def windowed(df: DataFrame, as_of, windows: Sequence[int] = WINDOWS, rate: float = DECAY_RATE) -> DataFrame:
    """Decay-weighted means for every horizon in one pass over the longest one."""
    age = hours_before(as_of)
    d = since(df, as_of, max(windows)).withColumn("_age", age).withColumn(
        "_w", F.exp(-rate * col("_age")) * col("confidence"))
    aggs = []
    for h in windows:
        inside = col("_age") <= h
        w = F.when(inside, col("_w"))
        aggs += [div(F.sum(col("score") * w), F.sum(w)).alias(f"sentiment_decay_{h}h"),
                 F.count_if(inside).alias(f"count_{h}h"),
                 F.stddev_pop(F.when(inside, col("score"))).alias(f"volatility_{h}h")]
    g = d.groupBy("symbol").agg(*aggs)
    lo, hi = min(windows), max(windows)
    return g.withColumn("momentum_windows", col(f"sentiment_decay_{lo}h") - col(f"sentiment_decay_{hi}h"))


def per_source_24h(df: DataFrame, as_of, by: str = "group") -> DataFrame:
    """(symbol, source) measures; ``by='cube'`` adds the symbol, source and overall marginals."""
    d = since(df, as_of, 24)
    g = d.cube("symbol", "source") if by == "cube" else d.groupBy("symbol", "source")
    out = g.agg(weighted_mean("score", "confidence").alias("sentiment"), F.sum("mentions").alias("mentions"),
                F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("reliability", F.coalesce(literal_map(SOURCE_WEIGHTS)[col("source")], F.lit(OTHER_WEIGHT)))


def source_wide_24h(df: DataFrame, as_of, sources: Sequence[str] = tuple(SOURCE_WEIGHTS)) -> DataFrame:
    d = since(df, as_of, 24)
    aggs = []
    for s in sources:
        own = col("source") == s
        w = F.when(own, col("confidence"))
        aggs += [F.coalesce(div(F.sum(col("score") * w), F.sum(w)), F.lit(0.0)).alias(f"{s}_sentiment"),
                 F.coalesce(F.sum(F.when(own, col("mentions"))), F.lit(0.0)).alias(f"{s}_mentions")]
    g = d.groupBy("symbol").agg(*aggs, (F.countDistinct("source") / len(sources)).alias("source_diversity"))
    means = d.groupBy("symbol", "source").agg(F.avg("score").alias("m"))
    agree = means.groupBy("symbol").agg(F.when(F.count(F.lit(1)) > 1, 1 - F.stddev_pop("m")).alias("source_agreement"))
    return g.join(agree, "symbol")


def momentum(df: DataFrame, as_of, hours: Sequence[int] = (1, 4, 12, 24)) -> DataFrame:
    age = hours_before(as_of)
    d = since(df, as_of, max(hours)).withColumn("_age", age)
    aggs, outs = [], []
    for h in hours:
        for name, cond in (("new", col("_age") <= h / 2), ("old", col("_age").between(h / 2, h))):
            w = F.when(cond, col("confidence"))
            aggs.append(div(F.sum(col("score") * w), F.sum(w)).alias(f"_{name}{h}"))
        change = col(f"_new{h}") - col(f"_old{h}")
        outs += [change.alias(f"change_{h}h"), (change / (F.abs(f"_old{h}") + 1e-6)).alias(f"momentum_{h}h")]
    return d.groupBy("symbol").agg(*aggs).select("symbol", *outs)


def velocity(df: DataFrame, size: int = 5, tie: str = "event_id") -> DataFrame:
    """End slope and curvature of the centred rolling mean; only the newest size+2 rows of a symbol matter."""
    w = Window.partitionBy("symbol").orderBy(col("ts").desc(), col(tie).desc())
    d = df.select("symbol", "ts", tie, "score").withColumn("_r", F.row_number().over(w)).filter(col("_r") <= size + 2)
    r = [F.avg(F.when(col("_r").between(k + 1, k + size), col("score"))) for k in range(3)]
    g = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), *[x.alias(f"_m{k}") for k, x in enumerate(r)])
    v = col("_m0") - col("_m1")
    return g.filter(col("_n") == size + 2).select(
        "symbol", v.alias("velocity"), (v - (col("_m0") - col("_m2")) / 2).alias("acceleration_gradient"))


def engagement_quality(df: DataFrame, as_of) -> DataFrame:
    """Sums and extremes of engagement, keyword variety, mean emotions (keywords array, emotions map)."""
    d = since(df, as_of, 24)
    g = d.groupBy("symbol").agg(F.sum("engagement").alias("engagement_sum"), F.avg("engagement").alias("engagement_avg"),
                                F.max("engagement").alias("engagement_max"), F.avg("quality").alias("quality_avg"),
                                F.min("quality").alias("quality_min"))
    k = d.select("symbol", F.explode("keywords").alias("k")).groupBy("symbol").agg(
        F.countDistinct("k").alias("keyword_diversity"), F.count("k").alias("keyword_total"))
    e = d.select("symbol", F.explode("emotions").alias("emotion", "v")).groupBy("symbol").pivot(
        "emotion", ["fear", "greed"]).agg(F.avg("v"))
    return g.join(k, "symbol", "left").join(e, "symbol", "left")


def anomaly_7d(df: DataFrame, as_of, tie: str = "event_id") -> DataFrame:
    at = F.lit(as_of).cast("timestamp_ntz")
    week = at - F.expr("interval 7 days")
    d = df.filter(col("ts") <= at)
    new = col("ts") > week
    s, m = col("score"), col("mentions")
    g = d.groupBy("symbol").agg(
        F.avg(F.when(~new, s)).alias("_hm"), F.stddev_samp(F.when(~new, s)).alias("_hs"),
        F.avg(F.when(new, s)).alias("_rm"), F.count_if(new).alias("_n"), F.avg(F.when(~new, m)).alias("_mm"),
        F.stddev_samp(F.when(~new, m)).alias("_ms"), F.sum(F.when(new, m)).alias("_mr"), F.count(F.lit(1)).alias("_all"))
    z = div(col("_rm") - col("_hm"), "_hs")
    mz = div(col("_mr") - col("_mm") * col("_n"), col("_ms") * F.sqrt("_n"))
    g = g.filter("_all >= 10").select("symbol", "_n", z.alias("sentiment_z"), flag(F.abs(z) > 2).alias("spike"),
                                      mz.alias("mention_z"), flag(mz > 3).alias("viral"))
    idx = index_rows(d.filter(new).select("symbol", "ts", tie, "score"), "symbol", ["ts", tie],
                     F.date_trunc("day", "ts"))
    half = idx.join(g.select("symbol", "_n"), "symbol")
    first = col("_i") <= F.floor(col("_n") / 2)
    h = half.groupBy("symbol").agg((F.avg(F.when(~first, col("score"))) - F.avg(F.when(first, col("score"))))
                                   .alias("_sh"))
    g = g.join(h, "symbol", "left").withColumn("shift", F.when(col("_n") >= 6, col("_sh")))
    return g.withColumn("major_shift", flag(F.abs("shift") > 0.3)).drop("_n", "_sh")


def consensus(df: DataFrame, as_of) -> DataFrame:
    m = since(df, as_of, 24).groupBy("symbol", "source").agg(F.avg("score").alias("m"))
    w = F.coalesce(literal_map(SOURCE_WEIGHTS)[col("source")], F.lit(OTHER_WEIGHT))
    n = F.count(F.lit(1))
    g = m.groupBy("symbol").agg(
        (1 / (1 + F.stddev_samp("m"))).alias("consensus_strength"), (F.count_if(col("m") > 0.1) / n)
        .alias("bullish_consensus"), (F.count_if(col("m") < -0.1) / n).alias("bearish_consensus"),
        F.stddev_samp("m").alias("polarization"), div(F.sum(col("m") * w), F.sum(w)).alias("weighted_consensus"),
        n.alias("_n"))
    return g.filter("_n > 1").drop("_n")


def political_7d(df: DataFrame, as_of, party: str = "party") -> DataFrame:
    d = since(df.filter("source = 'unusual_whales'"), as_of, 168)
    rep, dem = F.count_if(col(party) == "republican"), F.count_if(col(party) == "democrat")
    return d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("political_activity"), F.avg("score").alias("insider_sentiment"),
        F.avg("confidence").alias("insider_confidence"), F.sum("mentions").alias("congress_interest"),
        div(rep, rep + dem).alias("republican_ratio"), div(dem, rep + dem).alias("democrat_ratio"),
        div(F.least(rep, dem), F.greatest(rep, dem)).alias("bipartisan_interest"))


def zero_fill_features(symbols: DataFrame, features: DataFrame) -> DataFrame:
    cols = [c for c in features.columns if c != "symbol"]
    return symbols.select("symbol").distinct().join(features, "symbol", "left").fillna(0, cols)


# ------------------------------------------------------------------ fusion

def source_inputs(df: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Newest-first summary per (symbol, source) feeding the fusion."""
    return since(df, as_of, hours).groupBy("symbol", "source").agg(
        weighted_mean("score", "confidence").alias("score"), F.avg("confidence").alias("confidence"),
        F.sum("mentions").alias("mentions"), F.sum("engagement").alias("engagement"), F.max("ts").alias("ts"))


def fuse_sentiment(inputs: DataFrame, as_of, floor: float = 0.1) -> DataFrame:
    """Weighted consensus over the valid sources of each symbol with confidence, agreement, anomaly and a signal.

    The rows of one symbol are its sources (a handful by construction), so pair agreement is evaluated inside the
    row over the collected source scores.
    """
    s, c, m = col("score"), col("confidence"), col("mentions")
    d = inputs.filter(s.between(-1, 1) & c.between(0, 1) & (c >= floor))
    base = F.coalesce(literal_map(FUSION_WEIGHTS)[col("source")], F.lit(0.1))
    q = (F.when(m == 0, 0.5).when(m < 5, 0.8).otherwise(1.0)
         * F.when(col("engagement") > 0, 1 + F.least(F.log1p("engagement") / 10, F.lit(0.5))).otherwise(1.0))
    d = d.withColumn("w", base * F.sqrt(c) * F.greatest(F.exp(-hours_before(as_of) / 12), F.lit(0.1)) * q)
    n = F.count(F.lit(1))
    lead = base * c * F.log1p(m)
    g = d.groupBy("symbol").agg(
        n.alias("sources"), div(F.sum(s * col("w")), F.sum("w")).alias("fused"), F.stddev_pop(s).alias("_sd"),
        F.avg(c).alias("_c"), F.sum(m).alias("total_mentions"), F.avg(s).alias("_mean"), F.min(s).alias("_lo"),
        F.max(s).alias("_hi"), F.max_by("source", F.struct(lead, "source")).alias("dominant"),
        F.sort_array(F.collect_list(s)).alias("_scores"), F.sum("w").alias("_w"))
    conf = (col("_c") * F.least(0.7 + 0.1 * (col("sources") - 1), F.lit(1.0)) * F.greatest(1 - col("_sd") / 2, F.lit(0.0))
            * (0.5 + 0.5 * F.least(F.log1p("total_mentions") / 10, F.lit(1.0))))
    xs = col("_scores")
    same = 0.7
    pairs = F.flatten(F.transform(xs, lambda a, i: F.transform(F.slice(xs, i + 2, F.size(xs)), lambda b: F.when(
        a * b >= 0, same).otherwise(0.0) + 0.3 * F.greatest(1 - F.abs(a - b) / 2, F.lit(0.0)))))
    agreement = F.when(col("sources") < 2, 1.0).otherwise(
        F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(pairs), F.lit(0)))
    anomaly = F.when(col("sources") >= 3, F.coalesce(div(F.greatest(col("_hi") - col("_mean"), col("_mean") - col("_lo")),
                                                         "_sd"), F.lit(0.0))).otherwise(0.0)
    at = F.lit(as_of).cast("timestamp_ntz")
    boost = F.when((F.weekday(at) < 5) & F.hour(at).between(14, 20), 1.2).otherwise(1.0)
    g = g.withColumns({"confidence": F.least(conf, F.lit(1.0)), "agreement": agreement, "anomaly": anomaly})
    g = g.withColumn("calibrated", clip(col("fused") * boost * (0.5 + 0.5 * col("confidence")), -1, 1))
    strength = F.least(F.abs("calibrated") * col("confidence") * col("agreement")
                       * F.greatest(1 - col("anomaly") / 10, F.lit(0.1)), F.lit(1.0))
    g = g.withColumns({"strength": strength, "is_anomaly": col("anomaly") > 3})
    side = F.when(col("calibrated") > 0, "BUY").otherwise("SELL")
    weak = (col("confidence") < 0.3) | (col("strength") < 0.2) | (F.abs("calibrated") < 0.1)
    level = F.when(col("strength") >= 0.6, "STRONG").when(col("strength") >= 0.3, "MODERATE").otherwise("WEAK")
    return g.withColumns({
        "signal": F.when(weak, "HOLD").otherwise(F.concat_ws("_", level, side)),
        "direction": F.when(col("calibrated") > 0.05, "bullish").when(col("calibrated") < -0.05, "bearish")
        .otherwise("neutral")}).drop("_sd", "_c", "_mean", "_lo", "_hi", "_scores", "_w")


def contributions(inputs: DataFrame, as_of) -> DataFrame:
    """Share of each source in the fused weight, and its age."""
    base = F.coalesce(literal_map(FUSION_WEIGHTS)[col("source")], F.lit(0.1))
    d = inputs.withColumn("_w", base * col("confidence"))
    return d.select("symbol", "source", (col("_w") / F.sum("_w").over(Window.partitionBy("symbol"))).alias("share"),
                    hours_before(as_of).alias("age_hours"))


def sentiment_trend(df: DataFrame, as_of, hours: int = 24) -> DataFrame:
    d = since(df, as_of, hours).withColumn("_x", -hours_before(as_of))
    g = d.groupBy("symbol").agg(F.regr_slope("score", "_x").alias("slope"), F.stddev_pop("score").alias("volatility"))
    return g.withColumn("trend", F.when(col("slope") > 0.01, "improving").when(
        col("slope") < -0.01, "deteriorating").otherwise("stable"))


def multi_source_quick(df: DataFrame) -> DataFrame:
    w = col("confidence") * col("mentions")
    return df.groupBy("symbol").agg(
        F.coalesce(div(F.sum(col("score") * w), F.sum(w)), F.lit(0.0)).alias("sentiment"),
        F.least(F.sum(w) / 100, F.lit(1.0)).alias("confidence"), F.sum("mentions").alias("mentions"))
