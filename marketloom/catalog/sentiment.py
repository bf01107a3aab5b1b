"""Sentiment feature and fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import col
from ..operators import sentiment as st
from .base import add_base, query

AS_OF = "2024-01-30 15:00:00"
AT = f"TIMESTAMP '{AS_OF}'"
AGE = f"(epoch({AT} - ts) / 3600)"
WREL = "CASE source WHEN 'reddit' THEN 0.4 WHEN 'news' THEN 0.25 WHEN 'twitter' THEN 0.2 ELSE 0.15 END"
add_base("day", f"SELECT *, {AGE} AS age FROM sent WHERE ts BETWEEN {AT} - INTERVAL 24 HOUR AND {AT}")
add_base("two_days", f"SELECT *, {AGE} AS age FROM sent WHERE ts BETWEEN {AT} - INTERVAL 48 HOUR AND {AT}")


def wm(cond="true"):
    return f"sum(score * confidence) FILTER ({cond}) / sum(confidence) FILTER ({cond})"


_basic = ("sentiment_conf_24h sentiment_raw_24h sentiment_std_24h sentiment_median_24h confidence_avg_24h "
          "confidence_min_24h confidence_max_24h mention_sum_24h mention_avg_24h mention_max_24h bullish_ratio_24h "
          "bearish_ratio_24h neutral_ratio_24h bullish_signals_24h bearish_signals_24h signal_ratio_24h").split()


@query("sentiment_basic_24h", "symbol " + " ".join(f"{c}:d" for c in _basic), f"""SELECT symbol,
    {wm()} AS sentiment_conf_24h, avg(score) AS sentiment_raw_24h, stddev_pop(score) AS sentiment_std_24h,
    median(score) AS sentiment_median_24h, avg(confidence) AS confidence_avg_24h, min(confidence) AS confidence_min_24h,
    max(confidence) AS confidence_max_24h, sum(mentions) AS mention_sum_24h, avg(mentions) AS mention_avg_24h,
    max(mentions) AS mention_max_24h, count(*) FILTER (score > 0.1) / count(*) AS bullish_ratio_24h,
    count(*) FILTER (score < -0.1) / count(*) AS bearish_ratio_24h,
    count(*) FILTER (score BETWEEN -0.1 AND 0.1) / count(*) AS neutral_ratio_24h, sum(bullish) AS bullish_signals_24h,
    sum(bearish) AS bearish_signals_24h, (sum(bullish) - sum(bearish)) / (sum(bullish) + sum(bearish)) AS signal_ratio_24h
    FROM day GROUP BY 1""")
def _basic24(m):
    return st.basic_24h(m.sentiment(), AS_OF)


def _win(h):
    w = f"(exp(-0.05 * age) * confidence)"
    return (f"sum(score * {w}) FILTER (age <= {h}) / sum({w}) FILTER (age <= {h}) AS sentiment_decay_{h}h, "
            f"count(*) FILTER (age <= {h}) AS count_{h}h, stddev_pop(score) FILTER (age <= {h}) AS volatility_{h}h")


@query("sentiment_windowed", "symbol " + " ".join(
    f"sentiment_decay_{h}h:d count_{h}h:i volatility_{h}h:d" for h in st.WINDOWS) + " momentum_windows:d",
    f"""SELECT *, sentiment_decay_1h - sentiment_decay_48h AS momentum_windows FROM (SELECT symbol,
    {', '.join(_win(h) for h in st.WINDOWS)} FROM two_days GROUP BY 1)""")
def _windowed(m):
    return st.windowed(m.sentiment(), AS_OF)


_src = f"{wm()} AS sentiment, sum(mentions) AS mentions, avg(confidence) AS confidence, count(*) AS n"
_src_cols = "symbol source sentiment:d mentions:d confidence:d n:i"


@query("sentiment_per_source_24h", _src_cols + " reliability:d",
       f"SELECT symbol, source, {_src}, {WREL} AS reliability FROM day GROUP BY 1, 2")
def _per_source(m):
    return st.per_source_24h(m.sentiment(), AS_OF)


@query("sentiment_per_source_cube", _src_cols, f"SELECT symbol, source, {_src} FROM day GROUP BY CUBE (symbol, source)")
def _cube(m):
    return st.per_source_24h(m.sentiment(), AS_OF, "cube")


@query("sentiment_source_wide", "symbol " + " ".join(f"{s}_sentiment:d {s}_mentions:d" for s in st.SOURCE_WEIGHTS) +
       " source_diversity:d source_agreement:d", "SELECT * FROM (SELECT symbol, " + ", ".join(
           f"coalesce({wm(f'source = {chr(39)}{s}{chr(39)}')}, 0) AS {s}_sentiment, coalesce(sum(mentions) FILTER "
           f"(source = '{s}'), 0) AS {s}_mentions" for s in st.SOURCE_WEIGHTS) + """,
    count(DISTINCT source) / 4 AS source_diversity FROM day GROUP BY 1) JOIN (SELECT symbol, 1 - stddev_pop(m) AS
    source_agreement FROM (SELECT symbol, source, avg(score) AS m FROM day GROUP BY 1, 2) GROUP BY 1) USING (symbol)""")
def _wide(m):
    return st.source_wide_24h(m.sentiment(), AS_OF)


@query("sentiment_momentum", "symbol " + " ".join(f"change_{h}h:d momentum_{h}h:d2" for h in (4, 12, 24)),
       "SELECT symbol, " + ", ".join(f"n{h} - o{h} AS change_{h}h, (n{h} - o{h}) / (abs(o{h}) + 1e-6) AS momentum_{h}h"
                                     for h in (4, 12, 24)) + " FROM (SELECT symbol, " + ", ".join(
           f"{wm(f'age <= {h / 2}')} AS n{h}, {wm(f'age BETWEEN {h / 2} AND {h}')} AS o{h}" for h in (4, 12, 24)) +
       " FROM two_days GROUP BY 1)")
def _momentum(m):
    return st.momentum(m.sentiment(), AS_OF)


@query("sentiment_velocity", "symbol velocity:d acceleration_gradient:d", """SELECT symbol, a - b AS velocity,
    (a - b) - (a - c) / 2 AS acceleration_gradient FROM (SELECT symbol, avg(score) FILTER (r <= 5) AS a,
    avg(score) FILTER (r BETWEEN 2 AND 6) AS b, avg(score) FILTER (r BETWEEN 3 AND 7) AS c FROM (SELECT *, row_number()
    OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS r FROM sent) GROUP BY 1)""")
def _velocity(m):
    return st.velocity(m.sentiment())


@query("sentiment_engagement_quality", "symbol engagement_sum:d2 engagement_avg:d engagement_max:d quality_avg:d "
       "quality_min:d keyword_diversity:i keyword_total:i fear:d greed:d", """SELECT symbol, sum(engagement) AS
    engagement_sum, avg(engagement) AS engagement_avg, max(engagement) AS engagement_max, avg(confidence * 0.9) AS
    quality_avg, min(confidence * 0.9) AS quality_min, count(DISTINCT 'k' || CAST(mentions % 13 AS INT)) + 1 AS
    keyword_diversity, 2 * count(*) AS keyword_total, avg(bearish / 4) AS fear, avg(bullish / 6) AS greed
    FROM day GROUP BY 1""")
def _quality(m):
    s = m.sentiment().withColumns({
        "quality": col("confidence") * 0.9,
        "keywords": F.array(F.concat(F.lit("k"), (col("mentions") % 13).cast("int").cast("string")), col("symbol")),
        "emotions": F.create_map(F.lit("fear"), col("bearish") / 4, F.lit("greed"), col("bullish") / 6)})
    return st.engagement_quality(s, AS_OF)


@query("sentiment_anomaly_7d", "symbol sentiment_z:d spike:d mention_z:d viral:d shift:d major_shift:d", f"""
    SELECT symbol, sentiment_z, CAST(abs(sentiment_z) > 2 AS INT) AS spike, mention_z, CAST(mention_z > 3 AS INT) AS viral,
    shift, CAST(abs(shift) > 0.3 AS INT) AS major_shift FROM (SELECT symbol,
      (avg(score) FILTER (neu) - avg(score) FILTER (NOT neu)) / stddev_samp(score) FILTER (NOT neu) AS sentiment_z,
      (sum(mentions) FILTER (neu) - avg(mentions) FILTER (NOT neu) * count(*) FILTER (neu)) /
        (stddev_samp(mentions) FILTER (NOT neu) * sqrt(count(*) FILTER (neu))) AS mention_z,
      avg(score) FILTER (neu AND r > n // 2) - avg(score) FILTER (neu AND r <= n // 2) AS shift
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol, neu ORDER BY ts, event_id) AS r,
      count(*) OVER (PARTITION BY symbol, neu) AS n FROM (SELECT *, ts > {AT} - INTERVAL 7 DAY AS neu FROM sent
      WHERE ts <= {AT})) GROUP BY 1)""")
def _anomaly(m):
    return st.anomaly_7d(m.sentiment(), AS_OF)


@query("sentiment_consensus", "symbol consensus_strength:d bullish_consensus:d bearish_consensus:d polarization:d "
       "weighted_consensus:d", f"""SELECT symbol, 1 / (1 + stddev_samp(m)) AS consensus_strength,
    count(*) FILTER (m > 0.1) / count(*) AS bullish_consensus, count(*) FILTER (m < -0.1) / count(*) AS bearish_consensus,
    stddev_samp(m) AS polarization, sum(m * {WREL}) / sum({WREL}) AS weighted_consensus FROM (SELECT symbol, source,
    avg(score) AS m FROM day GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1""")
def _consensus(m):
    return st.consensus(m.sentiment(), AS_OF)


@query("sentiment_political_7d", "symbol political_activity:i insider_sentiment:d congress_interest:d "
       "republican_ratio:d bipartisan_interest:d", f"""SELECT symbol, n AS political_activity, s AS insider_sentiment,
    k AS congress_interest, r / (r + d) AS republican_ratio, least(r, d) / greatest(r, d) AS bipartisan_interest FROM (
    SELECT symbol, count(*) AS n, avg(score) AS s, sum(mentions) AS k, count(*) FILTER (user_id % 3 = 0) AS r,
    count(*) FILTER (user_id % 3 = 1) AS d FROM sent WHERE source = 'unusual_whales' AND ts BETWEEN
    {AT} - INTERVAL 7 DAY AND {AT} GROUP BY 1)""")
def _political(m):
    party = F.when(col("user_id") % 3 == 0, "republican").when(col("user_id") % 3 == 1, "democrat")
    return st.political_7d(m.sentiment().withColumn("party", party), AS_OF)


@query("sentiment_zero_fill", "symbol consensus_strength:d weighted_consensus:d", f"""SELECT upper(symbol) AS symbol,
    coalesce(c, 0) AS consensus_strength, coalesce(w, 0) AS weighted_consensus FROM (SELECT DISTINCT symbol FROM sent UNION
    SELECT n_name FROM nation) LEFT JOIN (SELECT symbol, 1 / (1 + stddev_samp(m)) AS c, sum(m * {WREL}) / sum({WREL}) AS w
    FROM (SELECT symbol, source, avg(score) AS m FROM day GROUP BY 1, 2) GROUP BY 1) USING (symbol)""")
def _zero(m):
    s = m.sentiment()
    syms = s.select("symbol").union(m.raw("nation").select(col("n_name").alias("symbol")))
    return st.zero_fill_features(syms, st.consensus(s, AS_OF))


_base = "CASE source WHEN 'reddit' THEN 0.35 WHEN 'news' THEN 0.30 WHEN 'unusual_whales' THEN 0.20 ELSE 0.15 END"
add_base("src_in", f"""SELECT symbol, source, {wm()} AS score, avg(confidence) AS confidence, sum(mentions) AS mentions,
    sum(engagement) AS engagement, max(ts) AS ts FROM day GROUP BY 1, 2""")
add_base("src_w", f"""SELECT *, {_base} * sqrt(confidence) * greatest(exp(-{AGE} / 12), 0.1) * (CASE WHEN mentions = 0 THEN
    0.5 WHEN mentions < 5 THEN 0.8 ELSE 1 END) * (CASE WHEN engagement > 0 THEN 1 + least(ln(1 + engagement) / 10, 0.5)
    ELSE 1 END) AS w, {_base} * confidence * ln(1 + mentions) AS lead_score FROM src_in WHERE confidence >= 0.1""")
_fcols = ("symbol sources:i fused:d confidence:d agreement:d anomaly:d calibrated:d strength:d is_anomaly:b signal "
          "direction dominant total_mentions:i")


@query("sentiment_fusion", _fcols, f"""WITH agg AS (SELECT symbol, count(*) AS sources, sum(score * w) / sum(w) AS fused,
      stddev_pop(score) AS sd, avg(confidence) AS c, sum(mentions) AS total_mentions, avg(score) AS mu,
      arg_max(source, lead_score) AS dominant, max(abs(score - m)) / stddev_pop(score) AS z FROM (SELECT *, avg(score) OVER
      (PARTITION BY symbol) AS m FROM src_w) GROUP BY 1),
    agree AS (SELECT a.symbol, avg(0.7 * CAST(a.score * b.score >= 0 AS INT) + 0.3 * greatest(1 - abs(a.score - b.score)
      / 2, 0)) AS agreement FROM src_w a JOIN src_w b ON a.symbol = b.symbol AND a.source < b.source GROUP BY 1),
    f AS (SELECT *, least(c * least(0.7 + 0.1 * (sources - 1), 1) * greatest(1 - sd / 2, 0) * (0.5 + 0.5 *
      least(ln(1 + total_mentions) / 10, 1)), 1) AS confidence, CASE WHEN sources >= 3 THEN z ELSE 0 END AS anomaly
      FROM agg JOIN agree USING (symbol)),
    g AS (SELECT *, least(greatest(fused * 1.2 * (0.5 + 0.5 * confidence), -1), 1) AS calibrated FROM f),
    h AS (SELECT *, least(abs(calibrated) * confidence * agreement * greatest(1 - anomaly / 10, 0.1), 1) AS strength FROM g)
    SELECT *, anomaly > 3 AS is_anomaly, CASE WHEN confidence < 0.3 OR strength < 0.2 OR abs(calibrated) < 0.1 THEN 'HOLD'
      ELSE (CASE WHEN strength >= 0.6 THEN 'STRONG_' WHEN strength >= 0.3 THEN 'MODERATE_' ELSE 'WEAK_' END) ||
      (CASE WHEN calibrated > 0 THEN 'BUY' ELSE 'SELL' END) END AS signal, CASE WHEN calibrated > 0.05 THEN 'bullish' WHEN
      calibrated < -0.05 THEN 'bearish' ELSE 'neutral' END AS direction FROM h""")
def _fusion(m):
    return st.fuse_sentiment(st.source_inputs(m.sentiment(), AS_OF), AS_OF)


@query("sentiment_fusion_contributions", "symbol source share:d age_hours:d", f"""SELECT symbol, source, w / sum(w) OVER
    (PARTITION BY symbol) AS share, {AGE} AS age_hours FROM (SELECT *, {_base} * confidence AS w FROM src_in)""")
def _contrib(m):
    return st.contributions(st.source_inputs(m.sentiment(), AS_OF), AS_OF)


@query("sentiment_trend", "symbol slope:d volatility:d trend", """SELECT *, CASE WHEN slope > 0.01 THEN 'improving' WHEN
    slope < -0.01 THEN 'deteriorating' ELSE 'stable' END AS trend FROM (SELECT symbol, regr_slope(score, -age) AS slope,
    stddev_pop(score) AS volatility FROM day GROUP BY 1)""")
def _trend(m):
    return st.sentiment_trend(m.sentiment(), AS_OF)


@query("sentiment_multi_source_quick", "symbol sentiment:d confidence:d mentions:i", """SELECT symbol,
    sum(score * confidence * mentions) / sum(confidence * mentions) AS sentiment, least(sum(confidence * mentions) / 100, 1)
    AS confidence, sum(mentions) AS mentions FROM sent GROUP BY 1""")
def _quick(m):
    return st.multi_source_quick(m.sentiment())
