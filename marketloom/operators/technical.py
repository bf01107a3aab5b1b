"""Price and volume indicators: bars in, bars plus indicator columns out, one row per (symbol, ts).

All functions share one (symbol, ts) ordering, so chained calls plan as windows over a single exchange.
Values are NULL until their window is full.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import div, flag, ratio_change
from .scans import stream_machine
from .timeseries import Ewm, Ordered, ema, ewm_scan, wilder

S = Ordered()
YEAR = 252
MA_PERIODS = (5, 10, 20, 50, 100, 200)
RSI_PERIODS = (14, 21, 30)


def c(name):
    return F.col(name)


# ------------------------------------------------------------------ price action

def returns(b: DataFrame, s: Ordered = S) -> DataFrame:
    out = {f"ret_{n}": ratio_change("close", s.lag("close", n)) for n in (1, 5, 20)}
    return b.withColumns({**out, "log_ret": F.ln(c("close")) - F.ln(s.lag("close"))})


def range_position(b, s=S):
    lo, hi = s.min("low", 20), s.max("high", 20)
    return b.withColumn("range_pos_20", div(c("close") - lo, hi - lo))


def gaps(b, s=S):
    p = s.lag("close")
    return b.withColumns({
        "gap_up": F.greatest(div(c("open") - p, p), F.lit(0.0)),
        "gap_down": F.greatest(div(p - c("open"), p), F.lit(0.0))})


def intraday_range(b, s=S):
    return b.withColumns({"day_range": div(c("high") - c("low"), "close"),
                          "close_in_range": div(c("close") - c("low"), c("high") - c("low"))})


# ------------------------------------------------------------------ moving averages

def sma(b, s=S, periods=MA_PERIODS):
    b = b.withColumns({f"sma_{n}": s.mean("close", n) for n in periods})
    return b.withColumns({
        **{f"close_sma_{n}": div("close", f"sma_{n}") for n in periods},
        **{f"sma_slope_{n}": ratio_change(f"sma_{n}", s.lag(f"sma_{n}", 4)) for n in periods}})


def ema_set(b, s=S, periods=MA_PERIODS, seeded=True):
    b = ewm_scan(b, [ema(f"ema_{n}", "close", n, seeded) for n in periods], s)
    return b.withColumns({f"close_ema_{n}": div("close", f"ema_{n}") for n in periods})


def ma_cross(b, s=S):
    b = b.withColumns({f"_m{n}": s.mean("close", n) for n in (10, 20, 50)})
    b = b.withColumns({"sma_10_20": div("_m10", "_m20"), "sma_20_50": div("_m20", "_m50"),
                       "golden_cross": flag(c("_m20") > c("_m50")), "death_cross": flag(c("_m20") < c("_m50"))})
    return b.drop("_m10", "_m20", "_m50")


# ------------------------------------------------------------------ momentum

def rsi(b, s=S, periods=RSI_PERIODS):
    d = c("close") - s.lag("close")
    b = b.withColumn("_up", F.greatest(d, F.lit(0.0))).withColumn("_dn", F.greatest(-d, F.lit(0.0)))
    b = b.withColumns({"_up": F.when(d.isNotNull(), c("_up")), "_dn": F.when(d.isNotNull(), c("_dn"))})
    terms = [t for n in periods for t in (wilder(f"u{n}", "_up", n), wilder(f"d{n}", "_dn", n))]
    keep = [f for f in b.columns if not f.startswith("_")]
    b = ewm_scan(b, terms, s)
    out = {}
    for n in periods:
        v = div(100 * c(f"u{n}"), c(f"u{n}") + c(f"d{n}"))
        out |= {f"rsi_{n}": v, f"rsi_{n}_high": flag(v > 70), f"rsi_{n}_low": flag(v < 30)}
    return b.select(*keep, *[e.alias(k) for k, e in out.items()])


def macd(b, s=S, fast=12, slow=26, signal=9, seeded=True):
    keep = b.columns
    b = ewm_scan(b, [ema("fast", "close", fast, seeded), ema("slow", "close", slow, seeded)], s)
    b = b.withColumn("macd", c("fast") - c("slow"))
    b = ewm_scan(b, [ema("macd_signal", "macd", signal, seeded)], s)
    return b.select(*keep, "macd", "macd_signal", (c("macd") - c("macd_signal")).alias("macd_hist"),
                    flag(c("macd") > c("macd_signal")).alias("macd_bull"))


def stochastic(b, s=S, n=14, slow_k=3, slow_d=3):
    keep = b.columns
    lo, hi = s.min("low", n), s.max("high", n)
    b = b.withColumn("_k", div(100 * (c("close") - lo), hi - lo))
    b = b.withColumn("stoch_k", s.mean("_k", slow_k))
    b = b.withColumn("stoch_d", s.mean("stoch_k", slow_d))
    return b.select(*keep, "stoch_k", "stoch_d", flag(c("stoch_k") > 80).alias("stoch_high"),
                    flag(c("stoch_k") < 20).alias("stoch_low"))


def williams_r(b, s=S, n=14):
    hh, ll = s.max("high", n), s.min("low", n)
    return b.withColumn("williams_r", div(-100 * (hh - c("close")), hh - ll))


def cci(b, s=S, n=20):
    """Sums of the window run from its newest bar to its oldest, as its SQL's join happens to meet them; another order gives other last digits."""
    b = b.withColumn("_tp", (c("high") + c("low") + c("close")) / 3)
    b = b.withColumns({"_avg": s.mean("_tp", n), "_win": F.reverse(F.collect_list("_tp").over(s.rows(1 - n)))})
    mean, mad = (F.aggregate("_win", F.lit(0.0), add) / n for add in (lambda a, x: a + x, lambda a, x: a + F.abs(x - c("_avg"))))
    b = b.withColumn("cci", div(c("_tp") - mean, 0.015 * mad))
    return b.withColumns({"cci_high": flag(c("cci") > 100), "cci_low": flag(c("cci") < -100)}).drop(
        "_tp", "_avg", "_win")


def momentum_roc(b, s=S, periods=(5, 10, 20)):
    return b.withColumns({**{f"mom_{n}": c("close") - s.lag("close", n) for n in periods},
                          **{f"roc_{n}": 100 * ratio_change("close", s.lag("close", n)) for n in periods}})


# ------------------------------------------------------------------ volatility

def true_range(b, s=S, out="tr"):
    p = s.lag("close")
    return b.withColumn(out, F.when(p.isNotNull(), F.greatest(
        c("high") - c("low"), F.abs(c("high") - p), F.abs(c("low") - p))))


def atr(b, s=S, n=14):
    keep = b.columns
    b = ewm_scan(true_range(b, s), [wilder("atr", "tr", n)], s)
    return b.select(*keep, "atr", div("atr", "close").alias("atr_pct"))


def bollinger(b, s=S, n=20, k=2.0):
    b = b.withColumns({"bb_mid": s.mean("close", n), "_sd": s.pstd("close", n)})
    b = b.withColumns({"bb_up": c("bb_mid") + k * c("_sd"), "bb_low": c("bb_mid") - k * c("_sd")})
    b = b.withColumn("_w", 2 * k * c("_sd"))
    return b.withColumns({"bb_pos": div(c("close") - c("bb_low"), "_w"),
                          "bb_squeeze": flag(c("_w") < F.avg("_w").over(s.rows(1 - n)))}).drop("_w", "_sd")


def hist_vol(b, s=S, periods=(10, 20)):
    b = b.withColumn("_r", F.ln(c("close")) - F.ln(s.lag("close")))
    return b.withColumns({f"vol_{n}": s.pstd("_r", n) * F.sqrt(F.lit(YEAR)) for n in periods}).drop("_r")


def keltner(b, s=S, n=20, k=2.0):
    keep = b.columns
    b = ewm_scan(true_range(b, s), [ema("mid", "close", n), wilder("a", "tr", n)], s)
    lo = c("mid") - k * c("a")
    return b.select(*keep, div(c("close") - lo, 2 * k * c("a")).alias("kc_pos"))


# ------------------------------------------------------------------ volume

def volume_sma(b, s=S, periods=(10, 20, 50)):
    b = b.withColumns({f"vol_sma_{n}": s.mean("volume", n) for n in periods})
    return b.withColumns({f"vol_ratio_{n}": div("volume", f"vol_sma_{n}") for n in periods})


def obv(b, s=S):
    d = F.signum(c("close") - s.lag("close"))
    b = b.withColumn("_v", F.coalesce(d * c("volume"), c("volume")))
    b = b.withColumn("obv", s.cum("_v")).drop("_v")
    p = s.lag("obv", 9)
    return b.withColumn("obv_slope", F.coalesce(div(c("obv") - p, p), F.when(p == 0, 0.0)))


def trix_volume(b, s=S, n=10):
    keep = b.columns
    for i, x in enumerate(("volume", "t1", "t2")):
        b = ewm_scan(b, [ema(f"t{i + 1}", x, n)], s)
    return b.withColumn("vpt", 100 * ratio_change("t3", s.lag("t3"))).select(*keep, "vpt")


def _flow_volume():
    return F.coalesce(div(2 * c("close") - c("low") - c("high"), c("high") - c("low")), F.lit(0.0)) * c("volume")


def ad_line(b, s=S):
    return b.withColumn("_f", _flow_volume()).withColumn("ad_line", s.cum("_f")).drop("_f")


def cmf(b, s=S, n=20):
    return b.withColumn("_f", _flow_volume()).withColumn("cmf", div(s.sum("_f", n), s.sum("volume", n))).drop("_f")


def volume_z(b, s=S, n=20):
    m, sd = s.mean("volume", n), s.pstd("volume", n)
    return b.withColumns({"volume_z": F.coalesce(div(c("volume") - m, sd), F.when(sd == 0, 0.0)),
                          "volume_high": flag(c("volume") > m + 2 * sd)})


# ------------------------------------------------------------------ trend

def adx(b, s=S, n=14):
    """Wilder directional movement: sums seeded over n-1 bars, index seeded by the mean of n values."""
    keep = b.columns
    b = true_range(b, s)
    up, dn = c("high") - s.lag("high"), s.lag("low") - c("low")
    b = b.withColumns({"pdm": F.when(up.isNotNull(), F.when((up > dn) & (up > 0), up).otherwise(0.0)),
                       "mdm": F.when(dn.isNotNull(), F.when((dn > up) & (dn > 0), dn).otherwise(0.0))})
    d = (n - 1) / n
    b = ewm_scan(b, [Ewm(f"s_{x}", x, d, 1.0, n - 1, seed_sum=True) for x in ("tr", "pdm", "mdm")], s)
    ready = s.row() > n
    b = b.withColumns({"plus_di": F.when(ready, div(100 * c("s_pdm"), "s_tr")),
                       "minus_di": F.when(ready, div(100 * c("s_mdm"), "s_tr"))})
    b = b.withColumn("dx", F.when(c("plus_di").isNotNull(), F.coalesce(
        div(100 * F.abs(c("plus_di") - c("minus_di")), c("plus_di") + c("minus_di")), F.lit(0.0))))
    b = ewm_scan(b, [wilder("adx", "dx", n)], s)
    return b.select(*keep, "plus_di", "minus_di", "adx", flag(c("adx") > 25).alias("adx_strong"),
                    F.signum(c("plus_di") - c("minus_di")).alias("di_side"))


def sar_step(state, high, low, step=0.02, top=0.2):
    """Stop-and-reverse: state is the bar before and (long, stop, extreme, pace); no value for the first bar."""
    if state is None:
        return (high, low, None), (None,)
    h0, l0, trend = state
    if trend is None:
        is_long = not (l0 - low > 0 and l0 - low > high - h0)
        trend = (True, l0, high, step) if is_long else (False, h0, low, step)
    is_long, stop, ep, pace = trend
    crossed = low <= stop if is_long else high >= stop
    if crossed:
        is_long = not is_long
        shown = min(ep, l0, low) if is_long else max(ep, h0, high)
        pace, ep = step, (high if is_long else low)
    else:
        shown = stop
        new_ep = max(ep, high) if is_long else min(ep, low)
        if new_ep != ep:
            ep, pace = new_ep, min(pace + step, top)
    move = shown + pace * (ep - shown)
    stop = min(move, l0, low) if is_long else max(move, h0, high)
    return (high, low, (is_long, stop, ep, pace)), (shown,)


def parabolic_sar(b, s=S, step=0.02, top=0.2):
    """A flip state machine: the bars of a symbol (span / frequency rows) pass through one task as a stream."""
    out = stream_machine(b.select("symbol", "ts", "high", "low", "close"), ["symbol"], ["ts"],
                         lambda state, high, low: sar_step(state, high, low, step, top), lambda: None, ["high", "low"], {"sar": "double"})
    return out.withColumn("sar_side", F.when(c("sar").isNotNull(), F.when(c("close") > c("sar"), 1.0).otherwise(-1.0)))


def linreg(b, s=S, n=20):
    x = s.row().cast("double")
    b = b.withColumn("_x", x)
    return b.withColumns({"lr_slope": div(s.roll2(F.regr_slope, "close", "_x", n), "close"),
                          "lr_r2": s.roll2(F.regr_r2, "close", "_x", n)}).drop("_x")


def trend_consistency(b, s=S):
    def m(lo, hi):
        return F.avg("close").over(s.rows(lo, hi))
    short, long = m(-4, 0) - m(-9, -5), m(-9, 0) - m(-19, -10)
    n = F.count("close").over(s.rows(-19, 0))
    return b.withColumn("trend_same", F.when(n >= 20, flag(short * long > 0)).when(n >= 10, 0.0))


# ------------------------------------------------------------------ support and resistance

def peaks_sr(b, s=S, n=50, distance=5):
    """Distance to the latest local high/low of the last n bars, lower peaks closer than ``distance`` dropped."""
    w = s.rows(1 - n)
    b = b.withColumns({"_hi": F.collect_list("high").over(w), "_lo": F.collect_list(-c("low")).over(w)})

    def last_peak(name):
        xs = c(name)
        idx = F.filter(F.sequence(F.lit(2), F.size(xs) - 1),
                       lambda i: (F.get(xs, i - 1) > F.get(xs, i - 2)) & (F.get(xs, i - 1) > F.get(xs, i)))
        idx = F.when(F.size(xs) >= 3, idx)
        peaks = F.reverse(F.array_sort(F.transform(idx, lambda i: F.struct(F.get(xs, i - 1).alias("h"),
                                                                            i.alias("p")))))
        empty = F.filter(F.transform(idx, lambda i: i), lambda i: F.lit(False))
        kept = F.aggregate(peaks, empty, lambda acc, p: F.when(
            F.exists(acc, lambda k: F.abs(k - p["p"]) < distance), acc).otherwise(F.concat(acc, F.array(p["p"]))))
        at = F.array_max(kept)
        return F.when(at.isNotNull(), F.get(xs, at - 1))

    enough = F.size("_hi") >= 20
    res, sup = last_peak("_hi"), -last_peak("_lo")
    return b.withColumns({
        "resistance_dist": F.when(enough, div(res - c("close"), "close")),
        "support_dist": F.when(enough, div(c("close") - sup, "close"))}).drop("_hi", "_lo")


# Retracement ratios and round-number grid.
FIB = (0.236, 0.382, 0.5, 0.618, 0.786)
ROUND_GRID = (50, 100, 200, 500, 1000)


def fibonacci(b, s=S, n=50):
    hi, lo = s.max("high", n), s.min("low", n)
    b = b.withColumns({"_h": hi, "_l": lo})
    return b.withColumns({
        f"fib_{int(f * 1000)}": F.when(c("_h") != c("_l"), div(
            F.abs(c("close") - (c("_h") - (c("_h") - c("_l")) * f)), "close")) for f in FIB}).drop("_h", "_l")


def round_numbers(b, s=S):
    return b.withColumns({
        f"round_{g}": F.when(c("close") > g * 0.1, div(F.abs(c("close") - F.bround(c("close") / g) * g), "close"))
        for g in ROUND_GRID})


# ------------------------------------------------------------------ candles

def candle_shape(b, s=S):
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    b = b.withColumns({
        "green": flag(c("close") > c("open")), "red": flag(c("close") < c("open")),
        "body": div(F.abs(c("close") - c("open")), "close"),
        "upper_wick": div(c("high") - top, "close"), "lower_wick": div(bottom - c("low"), "close")})
    return b.withColumns({"large_body": flag(c("body") > 0.02), "long_upper": flag(c("upper_wick") > 0.01),
                          "long_lower": flag(c("lower_wick") > 0.01)})


PATTERNS = ("doji", "hammer", "hanging_man", "inverted_hammer", "shooting_star", "engulfing", "harami",
            "dark_cloud", "piercing", "morning_star", "evening_star", "three_soldiers", "three_crows")


def candle_patterns(b, s=S, n=10):
    """Published candlestick definitions: bodies and wicks against the mean body and range of the n bars before.

    Values are 100 (bullish), -100 (bearish), 0 (absent).
    """
    keep = b.columns
    b = b.withColumns({"_bd": F.abs(c("close") - c("open")), "_rg": c("high") - c("low"),
                       "_up": c("high") - F.greatest("open", "close"), "_lw": F.least("open", "close") - c("low"),
                       "_dir": F.signum(c("close") - c("open"))})
    b = b.withColumns({"_ab": F.avg("_bd").over(s.rows(-n, -1)), "_ar": F.avg("_rg").over(s.rows(-n, -1)),
                       "_n": F.count("_bd").over(s.rows(-n, -1)), "_trend": c("close") - s.lag("close", 5)})
    for k in (1, 2):
        b = b.withColumns({f"{x}{k}": s.lag(x, k) for x in ("_bd", "_dir", "_ab")} |
                          {f"_o{k}": s.lag("open", k), f"_c{k}": s.lag("close", k)})
    o, cl, bd, rg, up, lw = c("open"), c("close"), c("_bd"), c("_rg"), c("_up"), c("_lw")
    small, long_ = bd < c("_ab"), bd > c("_ab")
    o1, c1, o2, c2 = c("_o1"), c("_c1"), c("_o2"), c("_c2")
    mid1 = (o1 + c1) / 2
    long1, long2 = c("_bd1") > c("_ab1"), c("_bd2") > c("_ab2")
    d, d1, d2 = c("_dir"), c("_dir1"), c("_dir2")
    pin_low = small & (lw > 2 * bd) & (up < 0.1 * c("_ar"))
    pin_up = small & (up > 2 * bd) & (lw < 0.1 * c("_ar"))
    over = (F.greatest("open", "close") >= F.greatest(o1, c1)) & (F.least("open", "close") <= F.least(o1, c1))
    within = (F.greatest("open", "close") <= F.greatest(o1, c1)) & (F.least("open", "close") >= F.least(o1, c1))
    star = c("_bd1") < c("_ab1")
    mid2 = (o2 + c2) / 2
    rules = {
        "doji": (bd <= 0.1 * c("_ar"), 100), "hammer": (pin_low & (c("_trend") < 0), 100),
        "hanging_man": (pin_low & (c("_trend") > 0), -100), "inverted_hammer": (pin_up & (c("_trend") < 0), 100),
        "shooting_star": (pin_up & (c("_trend") > 0), -100),
        "dark_cloud": ((d1 > 0) & long1 & (d < 0) & (o > c1) & (cl < mid1) & (cl > o1), -100),
        "piercing": ((d1 < 0) & long1 & (d > 0) & (o < c1) & (cl > mid1) & (cl < o1), 100),
        "morning_star": ((d2 < 0) & long2 & star & (d > 0) & (cl > mid2), 100),
        "evening_star": ((d2 > 0) & long2 & star & (d < 0) & (cl < mid2), -100),
        "three_soldiers": ((d > 0) & (d1 > 0) & (d2 > 0) & (cl > c1) & (c1 > c2) & (o > o1) & (o1 > o2), 100),
        "three_crows": ((d < 0) & (d1 < 0) & (d2 < 0) & (cl < c1) & (c1 < c2) & (o < o1) & (o1 < o2), -100),
    }
    cols = {k: F.when(c("_n") == n, F.when(cond, v).otherwise(0)) for k, (cond, v) in rules.items()}
    signed = {"engulfing": long_ & over & (d * d1 < 0), "harami": long1 & small & within & (d * d1 < 0)}
    cols |= {k: F.when(c("_n") == n, F.when(cond, 100 * d).otherwise(0)) for k, cond in signed.items()}
    return b.select(*keep, *[cols[p].cast("double").alias(p) for p in PATTERNS])


# ------------------------------------------------------------------ statistics

def price_z(b, s=S, periods=(10, 20, 50)):
    return b.withColumns({f"z_{n}": div(c("close") - s.mean("close", n), s.pstd("close", n)) for n in periods})


def ret_moments(b, s=S, n=29):
    b = b.withColumn("_r", F.ln(c("close")) - F.ln(s.lag("close")))
    return b.withColumns({"ret_skew": s.roll(F.skewness, "_r", n), "ret_kurt": s.roll(F.kurtosis, "_r", n)}).drop("_r")


def percentile_rank(b, s=S, periods=(20, 50)):
    for n in periods:
        b = b.withColumn("_w", F.collect_list("close").over(s.rows(1 - n)))
        below = F.size(F.filter("_w", lambda x: x < c("close")))
        upto = F.size(F.filter("_w", lambda x: x <= c("close")))
        tied = F.when(upto > below, 1).otherwise(0)
        b = b.withColumn(f"pct_rank_{n}", F.when(F.size("_w") == n, (below + upto + tied) / (2.0 * n)))
    return b.drop("_w")


def ret_autocorr(b, s=S, n=18):
    b = b.withColumn("_r", F.ln(c("close")) - F.ln(s.lag("close"))).withColumn("_p", s.lag("_r"))
    return b.withColumn("ret_autocorr", s.corr("_r", "_p", n)).drop("_r", "_p")


def variance_ratio(b, s=S, n=19):
    b = b.withColumn("_r", F.ln(c("close")) - F.ln(s.lag("close"))).withColumn("_r2", c("_r") + s.lag("_r"))
    return b.withColumn("variance_ratio", div(s.roll(F.var_pop, "_r2", n - 1) / 2, s.roll(F.var_pop, "_r", n))).drop(
        "_r", "_r2")


def hl_spread(b, s=S):
    b = b.withColumn("_h", div(c("high") - c("low"), "close"))
    return b.withColumns({"hl_spread_5": s.mean("_h", 5), "hl_spread_sd": s.pstd("_h", 10)}).drop("_h")


def price_volume_corr(b, s=S, n=9):
    b = b.withColumns({"_dp": c("close") - s.lag("close"), "_dv": c("volume") - s.lag("volume")})
    return b.withColumn("pv_corr", s.corr("_dp", "_dv", n)).drop("_dp", "_dv")


def price_impact_proxy(b, s=S, n=4):
    b = b.withColumn("_i", div(F.abs(c("close") - s.lag("close")), s.lag("volume")))
    return b.withColumn("price_impact", F.avg("_i").over(s.rows(1 - n))).drop("_i")


# ------------------------------------------------------------------ variants for regime and slippage models

def simple_rsi_atr_adx(b, s=S, n=14):
    keep = b.columns
    d = c("close") - s.lag("close")
    b = b.withColumns({"_g": F.greatest(d, F.lit(0.0)), "_l": F.greatest(-d, F.lit(0.0))})
    b = b.withColumns({"_g": F.when(s.row() > 1, c("_g")).otherwise(0.0),
                       "_l": F.when(s.row() > 1, c("_l")).otherwise(0.0)})
    p = s.lag("close")
    b = b.withColumn("_tr", F.greatest(c("high") - c("low"), F.abs(c("high") - p), F.abs(c("low") - p)))
    up, dn = c("high") - s.lag("high"), s.lag("low") - c("low")
    b = b.withColumns({"_pd": F.when((up > dn) & (up > 0), up).otherwise(0.0),
                       "_md": F.when((dn > up) & (dn > 0), dn).otherwise(0.0)})
    gain, loss = s.mean("_g", n), s.mean("_l", n)
    b = b.withColumns({"rsi_simple": 100 * div(gain, gain + loss), "atr_simple": s.mean("_tr", n)})
    b = b.withColumns({"_pi": 100 * div(s.mean("_pd", n), "atr_simple"),
                       "_mi": 100 * div(s.mean("_md", n), "atr_simple")})
    b = b.withColumn("_dx", 100 * div(F.abs(c("_pi") - c("_mi")), c("_pi") + c("_mi")))
    return b.withColumn("adx_simple", s.mean("_dx", n)).select(*keep, "rsi_simple", "atr_simple", "adx_simple")


def bollinger_sample(b, s=S, periods=(20, 50)):
    out = {}
    for n in periods:
        m, sd = s.mean("close", n), s.std("close", n)
        out |= {f"bbs_width_{n}": div(4 * sd, m), f"bbs_pos_{n}": div(c("close") - (m - 2 * sd), 4 * sd)}
    return b.withColumns(out)


def cum_vwap(b, s=S):
    return b.withColumn("cum_vwap", div(s.cum(c("close") * c("volume")), s.cum("volume")))


def multi_horizon(b, s=S, periods=(5, 10, 20, 50)):
    """Returns, sample volatility and bias-corrected moments per look-back."""
    from ..functions.numeric import corrected_kurt, corrected_skew
    b = b.withColumn("_r", ratio_change("close", s.lag("close")))
    out = {}
    for n in periods:
        k = F.lit(float(n))
        out |= {f"h_ret_{n}": ratio_change("close", s.lag("close", n)), f"h_vol_{n}": s.std("_r", n),
                f"h_skew_{n}": corrected_skew(s.roll(F.skewness, "_r", n), k),
                f"h_kurt_{n}": corrected_kurt(s.roll(F.kurtosis, "_r", n), k)}
    return b.withColumns(out).drop("_r")


def quoted_spread(q, s=S, n=20):
    """``bid`` and ``ask`` columns to spread, relative spread and its mean."""
    q = q.withColumn("spread", c("ask") - c("bid"))
    return q.withColumns({"spread_pct": div("spread", (c("ask") + c("bid")) / 2), "spread_ma": s.mean("spread", n)})


def amihud(b, s=S, n=20):
    r = F.abs(ratio_change("close", s.lag("close")))
    b = b.withColumns({"_a": div(r, "volume"), "_d": div(r, c("volume") * c("close"))})
    return b.withColumns({"amihud": s.mean("_a", n), "amihud_dollar": s.mean("_d", n)}).drop("_a", "_d")


def kyle_rolling(b, s=S, n=20):
    b = b.withColumn("_dp", c("close") - s.lag("close"))
    b = b.withColumn("_sv", c("volume") * F.signum("_dp"))
    return b.withColumn("kyle_roll", div(s.roll2(F.covar_samp, "_dp", "_sv", n),
                                         s.roll(F.var_samp, "_sv", n))).drop("_dp", "_sv")


def order_imbalance(q, s=S, n=20):
    q = q.withColumn("imbalance", div(c("bid_volume") - c("ask_volume"), c("bid_volume") + c("ask_volume")))
    return q.withColumn("imbalance_ma", s.mean("imbalance", n))


def vol_cluster(b, s=S):
    b = b.withColumn("_r", ratio_change("close", s.lag("close")))
    b = b.withColumns({"_a": F.abs("_r"), "_ap": s.lag(F.abs(c("_r")))})
    return b.withColumns({"abs_ret_20": s.mean("_a", 20), "vol_ratio_5_20": div(s.std("_r", 5), s.std("_r", 20)),
                          "vol_clustering": s.corr("_a", "_ap", 10)}).drop("_r", "_a", "_ap")


def slippage_features(b, s=S, periods=(5, 10, 20), vol_windows=(10, 20), volume_windows=(5, 10, 20)):
    keep = b.columns
    p = s.lag("close")
    b = b.withColumn("_r", ratio_change("close", p))
    b = b.withColumns({
        "price_range": div(c("high") - c("low"), "close"), "price_gap": ratio_change("open", p),
        "oc_spread": div(F.abs(c("open") - c("close")), "close"),
        "realized_vol": F.sqrt(F.pow(F.ln(c("high") / c("close")), 2) + F.pow(F.ln(c("low") / c("close")), 2)),
        "_tpv": (c("high") + c("low") + c("close")) / 3 * c("volume"),
        **{f"p_mom_{n}": ratio_change("close", s.lag("close", n)) for n in periods},
        **{f"p_rev_{n}": div("close", s.mean("close", n)) - 1 for n in periods},
        **{f"s_vol_{n}": s.std("_r", n) * F.sqrt(F.lit(YEAR)) for n in vol_windows},
        **{f"v_ratio_{n}": div("volume", s.mean("volume", n)) for n in volume_windows},
        **{f"v_std_{n}": s.std("volume", n) for n in volume_windows}})
    b = b.withColumns({
        **{f"vol_regime_{n}": F.coalesce(div(f"s_vol_{n}", s.mean(f"s_vol_{n}", 2 * n)), F.lit(1.0))
           for n in vol_windows},
        "vwap_20": div(s.sum("_tpv", 20), s.sum("volume", 20)),
        "_ob": s.cum(F.coalesce(F.signum("_r"), F.lit(0.0)) * c("volume"))})
    b = b.withColumn("obv_ma", s.mean("_ob", 20))
    return b.select(*keep, *[x for x in b.columns if x not in keep and not x.startswith("_")])


def calendar_features(df, ts="ts"):
    t = F.col(ts)
    h, d, m = F.hour(t), F.weekday(t), F.month(t)
    tau = 6.283185307179586
    return df.withColumns({
        "hour": h, "dow": d, "month": m, "quarter": F.quarter(t),
        "is_open": flag(h.between(9, 15) & (d < 5)), "is_first_hour": flag(h == 9), "is_last_hour": flag(h == 15),
        "is_monday": flag(d == 0), "is_friday": flag(d == 4),
        "hour_sin": F.sin(F.lit(tau) * h / 24), "hour_cos": F.cos(F.lit(tau) * h / 24),
        "dow_sin": F.sin(F.lit(tau) * d / 7), "dow_cos": F.cos(F.lit(tau) * d / 7),
        "month_sin": F.sin(F.lit(tau) * m / 12), "month_cos": F.cos(F.lit(tau) * m / 12)})


WINDOW_FEATURES = (returns, range_position, gaps, intraday_range, sma, ma_cross, stochastic, williams_r, cci,
                   momentum_roc, bollinger, hist_vol, volume_sma, obv, ad_line, cmf, volume_z, linreg,
                   trend_consistency, fibonacci, round_numbers, candle_shape, candle_patterns, price_z, ret_moments,
                   percentile_rank, ret_autocorr, variance_ratio, hl_spread, price_volume_corr, price_impact_proxy)
RECURRENT_FEATURES = (ema_set, rsi, macd, atr, keltner, trix_volume, adx)


def with_technical(b: DataFrame, s: Ordered = S, groups=WINDOW_FEATURES + RECURRENT_FEATURES) -> DataFrame:
    for step in groups:
        b = step(b, s)
    return b
