"""Indicator queries over hourly bars of every symbol."""

from __future__ import annotations

from ..operators import technical as t
from ..operators.timeseries import Ordered, latest
from ..plans.features import feature_table
from .base import ORACLES, add_base, query

W = "PARTITION BY symbol ORDER BY ts"


def roll(fn: str, x: str, n: int) -> str:
    frame = f"OVER ({W} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {fn}({x}) {frame} END"


def roll2(fn: str, a: str, b: str, n: int) -> str:
    frame = f"OVER ({W} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count(({a}) + ({b})) {frame} = {n} THEN {fn}({a}, {b}) {frame} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def one(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1.0 WHEN NOT ({cond}) THEN 0.0 END"


add_base("numbered", f"""SELECT *, row_number() OVER ({W}) AS rn, {lag('"close"')} AS pc, {lag('high')} AS ph,
    {lag('low')} AS pl, {lag('volume')} AS pv, ln("close") - ln({lag('"close"')}) AS lr,
    "close" / {lag('"close"')} - 1 AS r FROM bars""")


#: Groups of the feature pipeline: (functions, columns, SQL).
GROUPS: list[tuple[tuple, str, str]] = []


def tech(name, fns, cols, sql=None):
    fns = fns if isinstance(fns, tuple) else (fns,)
    if sql and all(f in t.WINDOW_FEATURES + t.RECURRENT_FEATURES + (t.calendar_features,) for f in fns):
        GROUPS.append((fns, cols, sql))

    @query(name, "symbol ts " + cols, sql)
    def _run(m):
        b = m.bars()
        for f in fns:
            b = f(b)
        return b


def spec(names, kind="d"):
    return " ".join(f"{n}:{kind}" for n in names)


tech("tech_returns", t.returns, spec(["ret_1", "ret_5", "ret_20", "log_ret"]), f"""
    SELECT symbol, ts, "close" / {lag('"close"')} - 1 AS ret_1, "close" / {lag('"close"', 5)} - 1 AS ret_5,
    "close" / {lag('"close"', 20)} - 1 AS ret_20, lr AS log_ret FROM numbered""")

tech("tech_range_position", t.range_position, "range_pos_20:d", f"""
    SELECT symbol, ts, ("close" - lo) / nullif(hi - lo, 0) AS range_pos_20
    FROM (SELECT *, {roll('min', 'low', 20)} AS lo, {roll('max', 'high', 20)} AS hi FROM bars)""")

tech("tech_gaps", t.gaps, spec(["gap_up", "gap_down"]), """
    SELECT symbol, ts, greatest((open - pc) / pc, 0) AS gap_up, greatest((pc - open) / pc, 0) AS gap_down
    FROM numbered""")

tech("tech_intraday_range", t.intraday_range, spec(["day_range", "close_in_range"]), """
    SELECT symbol, ts, (high - low) / "close" AS day_range, ("close" - low) / nullif(high - low, 0) AS close_in_range
    FROM bars""")

_sma = ", ".join(f"{roll('avg', chr(34) + 'close' + chr(34), n)} AS sma_{n}" for n in t.MA_PERIODS)
tech("tech_sma", t.sma, " ".join(f"sma_{n}:d close_sma_{n}:d sma_slope_{n}:d" for n in t.MA_PERIODS),
     "SELECT symbol, ts, " + ", ".join(
         f'sma_{n}, "close" / sma_{n} AS close_sma_{n}, sma_{n} / {lag(f"sma_{n}", 4)} - 1 AS sma_slope_{n}'
         for n in t.MA_PERIODS) + f" FROM (SELECT *, {_sma} FROM bars)")

tech("tech_ma_cross", t.ma_cross, spec(["sma_10_20", "sma_20_50", "golden_cross", "death_cross"]), f"""
    SELECT symbol, ts, sma_10 / sma_20 AS sma_10_20, sma_20 / sma_50 AS sma_20_50,
    {one('sma_20 > sma_50')} AS golden_cross, {one('sma_20 < sma_50')} AS death_cross
    FROM (SELECT *, {_sma} FROM bars)""")


def rec_ema(src: str, items: list[tuple[str, str, float, float, int, str]]) -> str:
    """Plain row-by-row recursion: (out, input, decay, gain, seed length, avg|sum), inputs numbered by rn."""
    seeds = ", ".join(
        f"CASE WHEN count({x}) OVER ({W}) >= {n} THEN count({x}) OVER ({W}) END AS k_{o}, "
        f"{fn}({x}) OVER ({W}) AS m_{o}" for o, x, _, _, n, fn in items)
    first = ", ".join(f"CASE WHEN k_{o} = {n} THEN m_{o} END AS {o}" for o, _, _, _, n, _ in items)
    nxt = ", ".join(
        f"CASE WHEN s.k_{o} IS NULL THEN NULL WHEN p.{o} IS NULL THEN s.m_{o} ELSE {d!r} * p.{o} + {g!r} * s.{x} END"
        for o, x, d, g, _, _ in items)
    names = ", ".join(o for o, *_ in items)
    return (f"(WITH RECURSIVE seeded AS (SELECT *, {seeds} FROM {src}), walk AS (SELECT symbol, rn, {first} FROM seeded "
            f"WHERE rn = 1 UNION ALL SELECT s.symbol, s.rn, {nxt} FROM walk p JOIN seeded s ON s.symbol = p.symbol "
            f"AND s.rn = p.rn + 1) SELECT b.*, {names} FROM {src} b JOIN walk USING (symbol, rn))")


def e(o, x, n, seeded=True):
    a = 2.0 / (n + 1)
    return (o, x, 1 - a, a, n if seeded else 1, "avg")


def wd(o, x, n):
    return (o, x, (n - 1) / n, 1.0 / n, n, "avg")


CL = '"close"'
_ema_cols = " ".join(f"ema_{n}:d close_ema_{n}:d" for n in t.MA_PERIODS)
_ema_pick = "SELECT symbol, ts, " + ", ".join(f'ema_{n}, "close" / ema_{n} AS close_ema_{n}' for n in t.MA_PERIODS)
tech("tech_ema", t.ema_set, _ema_cols,
     _ema_pick + " FROM " + rec_ema("numbered", [e(f"ema_{n}", CL, n) for n in t.MA_PERIODS]))
tech("variant_ema_first_seed", lambda b: t.ema_set(b, seeded=False), _ema_cols,
     _ema_pick + " FROM " + rec_ema("numbered", [e(f"ema_{n}", CL, n, False) for n in t.MA_PERIODS]))

add_base("moves", """SELECT *, CASE WHEN pc IS NULL THEN NULL ELSE greatest("close" - pc, 0) END AS u,
    CASE WHEN pc IS NULL THEN NULL ELSE greatest(pc - "close", 0) END AS dwn,
    CASE WHEN pc IS NULL THEN NULL ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
    CASE WHEN pc IS NULL THEN NULL WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END AS pdm,
    CASE WHEN pc IS NULL THEN NULL WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END AS mdm
    FROM numbered""")
tech("tech_rsi", t.rsi, " ".join(f"rsi_{n}:d rsi_{n}_high:d rsi_{n}_low:d" for n in t.RSI_PERIODS),
     "SELECT symbol, ts, " + ", ".join(
         f"v{n} AS rsi_{n}, {one(f'v{n} > 70')} AS rsi_{n}_high, {one(f'v{n} < 30')} AS rsi_{n}_low"
         for n in t.RSI_PERIODS) + " FROM (SELECT *, " + ", ".join(
             f"100 * u{n} / nullif(u{n} + d{n}, 0) AS v{n}" for n in t.RSI_PERIODS) + " FROM " + rec_ema(
                 "moves", [x for n in t.RSI_PERIODS for x in (wd(f"u{n}", "u", n), wd(f"d{n}", "dwn", n))]) + ")")

_macd_src = "(SELECT *, fast - slow AS macd FROM " + rec_ema("numbered", [e("fast", CL, 12), e("slow", CL, 26)]) + ")"
_macd_first = "(SELECT *, fast - slow AS macd FROM " + rec_ema(
    "numbered", [e("fast", CL, 12, False), e("slow", CL, 26, False)]) + ")"
_macd_cols = spec(["macd", "macd_signal", "macd_hist", "macd_bull"])
_macd_pick = (f"SELECT symbol, ts, macd, macd_signal, macd - macd_signal AS macd_hist, "
              f"{one('macd > macd_signal')} AS macd_bull FROM ")
tech("tech_macd", t.macd, _macd_cols, _macd_pick + rec_ema(_macd_src, [e("macd_signal", "macd", 9)]))
tech("variant_macd_first_seed", lambda b: t.macd(b, seeded=False), _macd_cols,
     _macd_pick + rec_ema(_macd_first, [e("macd_signal", "macd", 9, False)]))

tech("tech_stochastic", t.stochastic, spec(["stoch_k", "stoch_d", "stoch_high", "stoch_low"]), f"""
    SELECT symbol, ts, stoch_k, {roll('avg', 'stoch_k', 3)} AS stoch_d, {one('stoch_k > 80')} AS stoch_high,
    {one('stoch_k < 20')} AS stoch_low FROM (SELECT *, {roll('avg', 'k', 3)} AS stoch_k FROM (
      SELECT *, 100 * ("close" - lo) / nullif(hi - lo, 0) AS k FROM (
        SELECT *, {roll('min', 'low', 14)} AS lo, {roll('max', 'high', 14)} AS hi FROM bars)))""")

tech("tech_williams_r", t.williams_r, "williams_r:d", f"""
    SELECT symbol, ts, -100 * (hh - "close") / nullif(hh - ll, 0) AS williams_r
    FROM (SELECT *, {roll('max', 'high', 14)} AS hh, {roll('min', 'low', 14)} AS ll FROM bars)""")

tech("tech_cci", t.cci, spec(["cci", "cci_high", "cci_low"]), f"""
    SELECT symbol, ts, cci, {one('cci > 100')} AS cci_high, {one('cci < -100')} AS cci_low FROM (
      SELECT a.symbol, a.ts, (any_value(a.tp) - avg(b.tp)) / nullif(0.015 * avg(abs(b.tp - a.m)), 0) AS cci
      FROM (SELECT *, (high + low + "close") / 3 AS tp, {roll('avg', '((high + low + "close") / 3)', 20)} AS m
            FROM numbered) a
      JOIN (SELECT symbol, rn, (high + low + "close") / 3 AS tp FROM numbered) b
        ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 19 AND a.rn GROUP BY a.symbol, a.ts)""")

tech("tech_momentum_roc", t.momentum_roc, " ".join(f"mom_{n}:d roc_{n}:d" for n in (5, 10, 20)),
     "SELECT symbol, ts, " + ", ".join(
         f"{CL} - {lag(CL, n)} AS mom_{n}, 100 * ({CL} / {lag(CL, n)} - 1) AS roc_{n}" for n in (5, 10, 20)) +
     " FROM bars")

tech("tech_atr", t.atr, "atr:d atr_pct:d",
     'SELECT symbol, ts, atr, atr / "close" AS atr_pct FROM ' + rec_ema("moves", [wd("atr", "tr", 14)]))

tech("tech_bollinger", t.bollinger, spec(["bb_mid", "bb_up", "bb_low", "bb_pos", "bb_squeeze"]), f"""
    SELECT symbol, ts, m AS bb_mid, m + 2 * sd AS bb_up, m - 2 * sd AS bb_low,
    ("close" - (m - 2 * sd)) / nullif(4 * sd, 0) AS bb_pos,
    CASE WHEN 4 * sd < avg(4 * sd) OVER ({W} ROWS 19 PRECEDING) THEN 1.0 WHEN sd IS NOT NULL THEN 0.0 END AS bb_squeeze
    FROM (SELECT *, {roll('avg', CL, 20)} AS m, {roll('stddev_pop', CL, 20)} AS sd FROM bars)""")

tech("tech_hist_vol", t.hist_vol, "vol_10:d vol_20:d", f"""
    SELECT symbol, ts, {roll('stddev_pop', 'lr', 10)} * sqrt(252) AS vol_10,
    {roll('stddev_pop', 'lr', 20)} * sqrt(252) AS vol_20 FROM numbered""")

tech("tech_keltner", t.keltner, "kc_pos:d",
     'SELECT symbol, ts, ("close" - (mid - 2 * a)) / nullif(4 * a, 0) AS kc_pos FROM ' + rec_ema(
         "moves", [e("mid", CL, 20), wd("a", "tr", 20)]))

tech("tech_volume_sma", t.volume_sma, " ".join(f"vol_sma_{n}:d vol_ratio_{n}:d" for n in (10, 20, 50)),
     "SELECT symbol, ts, " + ", ".join(
         f"{roll('avg', 'volume', n)} AS vol_sma_{n}, volume / {roll('avg', 'volume', n)} AS vol_ratio_{n}"
         for n in (10, 20, 50)) + " FROM bars")

tech("tech_obv", t.obv, "obv:d obv_slope:d", f"""
    SELECT symbol, ts, obv, CASE WHEN {lag('obv', 9)} = 0 THEN 0.0 ELSE (obv - {lag('obv', 9)}) / {lag('obv', 9)} END AS obv_slope
    FROM (SELECT *, sum(CASE WHEN pc IS NULL THEN volume ELSE sign("close" - pc) * volume END) OVER ({W}) AS obv
    FROM numbered)""")

_t3 = rec_ema(rec_ema(rec_ema("numbered", [e("t1", "volume", 10)]), [e("t2", "t1", 10)]), [e("t3", "t2", 10)])
tech("tech_trix_volume", t.trix_volume, "vpt:d",
     f"SELECT symbol, ts, 100 * (t3 / {lag('t3')} - 1) AS vpt FROM {_t3}")

_mfv = '(coalesce((2 * "close" - low - high) / nullif(high - low, 0), 0) * volume)'
tech("tech_ad_line", t.ad_line, "ad_line:d",
     f"SELECT symbol, ts, sum({_mfv}) OVER ({W}) AS ad_line FROM bars")
tech("tech_cmf", t.cmf, "cmf:d",
     f"SELECT symbol, ts, {roll('sum', _mfv, 20)} / nullif({roll('sum', 'volume', 20)}, 0) AS cmf FROM bars")

tech("tech_volume_z", t.volume_z, "volume_z:d volume_high:d", f"""
    SELECT symbol, ts, CASE WHEN sd = 0 THEN 0.0 ELSE (volume - m) / sd END AS volume_z,
    {one('volume > m + 2 * sd')} AS volume_high FROM (SELECT *, {roll('avg', 'volume', 20)} AS m,
    {roll('stddev_pop', 'volume', 20)} AS sd FROM bars)""")

_di = rec_ema("moves", [(f"s_{x}", x, 13 / 14, 1.0, 13, "sum") for x in ("tr", "pdm", "mdm")])
_dx = f"""(SELECT *, CASE WHEN plus_di IS NOT NULL THEN coalesce(100 * abs(plus_di - minus_di)
    / nullif(plus_di + minus_di, 0), 0) END AS dx FROM (SELECT *, CASE WHEN rn > 14 THEN 100 * s_pdm / s_tr END
    AS plus_di, CASE WHEN rn > 14 THEN 100 * s_mdm / s_tr END AS minus_di FROM {_di}))"""
tech("tech_adx", t.adx, spec(["plus_di", "minus_di", "adx", "adx_strong", "di_side"]),
     f"SELECT symbol, ts, plus_di, minus_di, adx, {one('adx > 25')} AS adx_strong, "
     f"sign(plus_di - minus_di) AS di_side FROM " + rec_ema(_dx, [wd("adx", "dx", 14)]))

# One row of the stop-and-reverse walk: side, stop carried to the next bar, extreme point, pace, stop shown.
tech("tech_parabolic_sar", t.parabolic_sar, "sar:d sar_side:d", """
    WITH RECURSIVE walk AS (
      SELECT symbol, rn, lng, CASE WHEN lng THEN pl ELSE ph END AS stop, CASE WHEN lng THEN high ELSE low END AS ep,
        0.02::DOUBLE AS pace, NULL::DOUBLE AS sar
      FROM (SELECT *, NOT (pl - low > 0 AND pl - low > high - ph) AS lng FROM numbered WHERE rn = 2)
      UNION ALL
      SELECT symbol, rn + 1, nl,
        CASE WHEN nl THEN least(shown + np * (nep - shown), pl, low) ELSE greatest(shown + np * (nep - shown), ph, high)
        END, nep, np, shown
      FROM (SELECT *, CASE WHEN crossed THEN 0.02 WHEN nep <> ep THEN least(pace + 0.02, 0.2) ELSE pace END AS np
        FROM (SELECT *, CASE WHEN crossed THEN (CASE WHEN nl THEN high ELSE low END)
            WHEN lng THEN greatest(ep, high) ELSE least(ep, low) END AS nep
          FROM (SELECT *, CASE WHEN NOT crossed THEN stop WHEN lng THEN greatest(ep, ph, high)
                ELSE least(ep, pl, low) END AS shown, (lng <> crossed) AS nl
            FROM (SELECT w.*, n.high, n.low, n.ph, n.pl,
                CASE WHEN w.lng THEN n.low <= w.stop ELSE n.high >= w.stop END AS crossed
              FROM walk w JOIN numbered n ON n.symbol = w.symbol AND n.rn = w.rn))))
    ) SELECT n.symbol, n.ts, w.sar, CASE WHEN w.sar IS NULL THEN NULL WHEN n."close" > w.sar THEN 1.0 ELSE -1.0 END
      AS sar_side FROM numbered n LEFT JOIN walk w ON w.symbol = n.symbol AND w.rn = n.rn + 1""")

tech("tech_linreg", t.linreg, "lr_slope:d lr_r2:d", f"""
    SELECT symbol, ts, {roll2('regr_slope', CL, 'rn', 20)} / "close" AS lr_slope,
    {roll2('regr_r2', CL, 'rn', 20)} AS lr_r2 FROM numbered""")

tech("tech_trend_consistency", t.trend_consistency, "trend_same:d", f"""
    SELECT symbol, ts, CASE WHEN rn >= 20 THEN (CASE WHEN (a - b) * (c2 - d) > 0 THEN 1.0 ELSE 0.0 END)
    WHEN rn >= 10 THEN 0.0 END AS trend_same FROM (SELECT *,
    avg("close") OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a,
    avg("close") OVER ({W} ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) AS b,
    avg("close") OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c2,
    avg("close") OVER ({W} ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) AS d FROM numbered)""")

tech("tech_peaks_support_resistance", t.peaks_sr, "resistance_dist:d support_dist:d")

tech("tech_fibonacci", t.fibonacci, spec([f"fib_{int(f * 1000)}" for f in t.FIB]),
     "SELECT symbol, ts, " + ", ".join(
         f'CASE WHEN h <> l THEN abs("close" - (h - (h - l) * {f})) / "close" END AS fib_{int(f * 1000)}'
         for f in t.FIB) + f" FROM (SELECT *, {roll('max', 'high', 50)} AS h, {roll('min', 'low', 50)} AS l FROM bars)")

tech("tech_round_numbers", t.round_numbers, spec([f"round_{g}" for g in t.ROUND_GRID]),
     "SELECT symbol, ts, " + ", ".join(
         f'CASE WHEN "close" > {g * 0.1} THEN abs("close" - round_even("close" / {g}, 0) * {g}) / "close" END '
         f"AS round_{g}" for g in t.ROUND_GRID) + " FROM bars")

tech("tech_candle_shape", t.candle_shape, spec(
    ["green", "red", "body", "upper_wick", "lower_wick", "large_body", "long_upper", "long_lower"]), f"""
    SELECT symbol, ts, {one('"close" > open')} AS green, {one('"close" < open')} AS red, body, upper_wick, lower_wick,
    {one('body > 0.02')} AS large_body, {one('upper_wick > 0.01')} AS long_upper,
    {one('lower_wick > 0.01')} AS long_lower FROM (SELECT *, abs("close" - open) / "close" AS body,
    (high - greatest(open, "close")) / "close" AS upper_wick, (least(open, "close") - low) / "close" AS lower_wick
    FROM bars)""")

_F10 = f"OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
_pat = {
    "doji": "bd <= 0.1 * ar THEN 100",
    "hammer": "bd < ab AND lw > 2 * bd AND uw < 0.1 * ar AND trend < 0 THEN 100",
    "hanging_man": "bd < ab AND lw > 2 * bd AND uw < 0.1 * ar AND trend > 0 THEN -100",
    "inverted_hammer": "bd < ab AND uw > 2 * bd AND lw < 0.1 * ar AND trend < 0 THEN 100",
    "shooting_star": "bd < ab AND uw > 2 * bd AND lw < 0.1 * ar AND trend > 0 THEN -100",
    "engulfing": "bd > ab AND dr * d1 < 0 AND greatest(open, cl) >= greatest(o1, c1) "
                 "AND least(open, cl) <= least(o1, c1) THEN 100 * dr",
    "harami": "bd < ab AND bd1 > ab1 AND dr * d1 < 0 AND greatest(open, cl) <= greatest(o1, c1) "
              "AND least(open, cl) >= least(o1, c1) THEN 100 * dr",
    "dark_cloud": "d1 > 0 AND bd1 > ab1 AND dr < 0 AND open > c1 AND cl < (o1 + c1) / 2 AND cl > o1 THEN -100",
    "piercing": "d1 < 0 AND bd1 > ab1 AND dr > 0 AND open < c1 AND cl > (o1 + c1) / 2 AND cl < o1 THEN 100",
    "morning_star": "d2 < 0 AND bd2 > ab2 AND bd1 < ab1 AND dr > 0 AND cl > (o2 + c2) / 2 THEN 100",
    "evening_star": "d2 > 0 AND bd2 > ab2 AND bd1 < ab1 AND dr < 0 AND cl < (o2 + c2) / 2 THEN -100",
    "three_soldiers": "dr > 0 AND d1 > 0 AND d2 > 0 AND cl > c1 AND c1 > c2 AND open > o1 AND o1 > o2 THEN 100",
    "three_crows": "dr < 0 AND d1 < 0 AND d2 < 0 AND cl < c1 AND c1 < c2 AND open < o1 AND o1 < o2 THEN -100",
}
tech("tech_candle_patterns", t.candle_patterns, spec(t.PATTERNS),
     "SELECT symbol, ts, " + ", ".join(
         f"CASE WHEN n < 10 THEN NULL WHEN {r} ELSE 0 END AS {p}" for p, r in _pat.items()) + f"""
    FROM (SELECT *, "close" AS cl, {lag('bd')} AS bd1, {lag('ab')} AS ab1, {lag('dr')} AS d1, {lag('open')} AS o1,
      {lag(CL)} AS c1, {lag('bd', 2)} AS bd2, {lag('ab', 2)} AS ab2, {lag('dr', 2)} AS d2, {lag('open', 2)} AS o2,
      {lag(CL, 2)} AS c2 FROM (SELECT *, avg(bd) {_F10} AS ab, avg(high - low) {_F10} AS ar, count(bd) {_F10} AS n,
        "close" - {lag(CL, 5)} AS trend FROM (SELECT *, abs("close" - open) AS bd, high - greatest(open, "close") AS uw,
          least(open, "close") - low AS lw, sign("close" - open) AS dr FROM bars)))""")

tech("tech_price_z", t.price_z, "z_10:d z_20:d z_50:d",
     "SELECT symbol, ts, " + ", ".join(
         f"({CL} - {roll('avg', CL, n)}) / nullif({roll('stddev_pop', CL, n)}, 0) AS z_{n}" for n in (10, 20, 50)) +
     " FROM bars")

_m = "FROM (SELECT *, " + ", ".join(
    f"{roll(f, x, 29)} AS {o}" for o, f, x in (("m1", "avg", "lr"), ("m2", "avg", "(lr * lr)"),
                                              ("m3", "avg", "(lr * lr * lr)"), ("m4", "avg", "(lr * lr * lr * lr)"))
) + " FROM numbered)"
tech("tech_ret_moments", t.ret_moments, "ret_skew:d4 ret_kurt:d4", f"""
    SELECT symbol, ts, (m3 - 3 * m1 * m2 + 2 * m1 ** 3) / (m2 - m1 * m1) ** 1.5 AS ret_skew,
    (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 ** 4) / (m2 - m1 * m1) ** 2 - 3 AS ret_kurt {_m}""")

_rank = """(SELECT a.symbol, a.ts, any_value(a.rn) AS rn, count(*) FILTER (b.cl < a."close") AS lt,
    count(*) FILTER (b.cl <= a."close") AS le FROM numbered a JOIN (SELECT symbol, rn, "close" AS cl FROM numbered) b
    ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - {} AND a.rn GROUP BY 1, 2)"""
tech("tech_percentile_rank", t.percentile_rank, "pct_rank_20:d pct_rank_50:d", f"""
    SELECT x.symbol, x.ts, CASE WHEN x.rn >= 20 THEN (x.lt + x.le + (CASE WHEN x.le > x.lt THEN 1 ELSE 0 END)) / 40.0
    END AS pct_rank_20, CASE WHEN y.rn >= 50 THEN (y.lt + y.le + (CASE WHEN y.le > y.lt THEN 1 ELSE 0 END)) / 100.0 END
    AS pct_rank_50 FROM {_rank.format(19)} x JOIN {_rank.format(49)} y USING (symbol, ts)""")

tech("tech_ret_autocorr", t.ret_autocorr, "ret_autocorr:d", f"""
    SELECT symbol, ts, {roll2('corr', 'lr', 'plr', 18)} AS ret_autocorr
    FROM (SELECT *, {lag('lr')} AS plr FROM numbered)""")

tech("tech_variance_ratio", t.variance_ratio, "variance_ratio:d", f"""
    SELECT symbol, ts, {roll('var_pop', 'r2', 18)} / 2 / {roll('var_pop', 'lr', 19)} AS variance_ratio
    FROM (SELECT *, lr + {lag('lr')} AS r2 FROM numbered)""")

tech("tech_hl_spread", t.hl_spread, "hl_spread_5:d hl_spread_sd:d", f"""
    SELECT symbol, ts, {roll('avg', 'h', 5)} AS hl_spread_5, {roll('stddev_pop', 'h', 10)} AS hl_spread_sd
    FROM (SELECT *, (high - low) / "close" AS h FROM bars)""")

tech("tech_price_volume_corr", t.price_volume_corr, "pv_corr:d", f"""
    SELECT symbol, ts, CASE WHEN isfinite(x) THEN x END AS pv_corr FROM (
    SELECT symbol, ts, {roll2('corr', f'({CL} - pc)', '(volume - pv)', 9)} AS x FROM numbered)""")

tech("tech_price_impact", t.price_impact_proxy, "price_impact:d", f"""
    SELECT symbol, ts, avg(abs("close" - pc) / nullif(pv, 0)) OVER ({W} ROWS 3 PRECEDING) AS price_impact
    FROM numbered""")

tech("variant_simple_rsi_atr_adx", t.simple_rsi_atr_adx, "rsi_simple:d atr_simple:d adx_simple:d", f"""
    SELECT symbol, ts, rsi_simple, atr_simple, {roll('avg', 'dx', 14)} AS adx_simple FROM (
      SELECT *, 100 * abs(pi - mi) / nullif(pi + mi, 0) AS dx FROM (SELECT *,
        100 * {roll('avg', 'g', 14)} / nullif({roll('avg', 'g', 14)} + {roll('avg', 'l', 14)}, 0) AS rsi_simple,
        {roll('avg', 'trr', 14)} AS atr_simple, 100 * {roll('avg', 'pd', 14)} / {roll('avg', 'trr', 14)} AS pi,
        100 * {roll('avg', 'md', 14)} / {roll('avg', 'trr', 14)} AS mi FROM (SELECT *, coalesce(u, 0) AS g,
          coalesce(dwn, 0) AS l, coalesce(tr, high - low) AS trr, coalesce(pdm, 0) AS pd, coalesce(mdm, 0) AS md
          FROM moves)))""")

tech("variant_bollinger_sample", t.bollinger_sample, spec(
    ["bbs_width_20", "bbs_pos_20", "bbs_width_50", "bbs_pos_50"]),
     "SELECT symbol, ts, " + ", ".join(
         f"4 * {roll('stddev_samp', CL, n)} / {roll('avg', CL, n)} AS bbs_width_{n}, ({CL} - ({roll('avg', CL, n)} - 2 * "
         f"{roll('stddev_samp', CL, n)})) / nullif(4 * {roll('stddev_samp', CL, n)}, 0) AS bbs_pos_{n}"
         for n in (20, 50)) + " FROM bars")

tech("variant_cum_vwap", t.cum_vwap, "cum_vwap:d",
     f'SELECT symbol, ts, sum("close" * volume) OVER ({W}) / sum(volume) OVER ({W}) AS cum_vwap FROM bars')

tech("variant_multi_horizon", t.multi_horizon,
     " ".join(f"h_ret_{n}:d h_vol_{n}:d h_skew_{n}:d4 h_kurt_{n}:d4" for n in (5, 10, 20, 50)),
     "SELECT symbol, ts, " + ", ".join(
         f"{CL} / {lag(CL, n)} - 1 AS h_ret_{n}, {roll('stddev_samp', 'r', n)} AS h_vol_{n}, "
         f"{roll('skewness', 'r', n)} AS h_skew_{n}, {roll('kurtosis', 'r', n)} AS h_kurt_{n}"
         for n in (5, 10, 20, 50)) + " FROM numbered")

tech("variant_amihud", t.amihud, "amihud:d10 amihud_dollar:d12", f"""
    SELECT symbol, ts, {roll('avg', '(abs(r) / nullif(volume, 0))', 20)} AS amihud,
    {roll('avg', '(abs(r) / nullif(volume * "close", 0))', 20)} AS amihud_dollar FROM numbered""")

tech("variant_kyle_rolling", t.kyle_rolling, "kyle_roll:d", f"""
    SELECT symbol, ts, {roll2('covar_samp', 'dp', 'sv', 20)} / nullif({roll('var_samp', 'sv', 20)}, 0) AS kyle_roll
    FROM (SELECT *, "close" - pc AS dp, volume * sign("close" - pc) AS sv FROM numbered)""")

tech("variant_vol_cluster", t.vol_cluster, "abs_ret_20:d vol_ratio_5_20:d vol_clustering:d", f"""
    SELECT symbol, ts, {roll('avg', 'ar', 20)} AS abs_ret_20,
    {roll('stddev_samp', 'r', 5)} / nullif({roll('stddev_samp', 'r', 20)}, 0) AS vol_ratio_5_20,
    {roll2('corr', 'ar', 'arp', 10)} AS vol_clustering
    FROM (SELECT *, abs(r) AS ar, abs({lag('r')}) AS arp FROM numbered)""")

_sf = (["price_range", "price_gap", "oc_spread", "realized_vol"] + [f"p_mom_{n}" for n in (5, 10, 20)] +
       [f"p_rev_{n}" for n in (5, 10, 20)] + [f"s_vol_{n}" for n in (10, 20)] +
       [f"v_ratio_{n}" for n in (5, 10, 20)] + [f"v_std_{n}" for n in (5, 10, 20)] +
       [f"vol_regime_{n}" for n in (10, 20)] + ["vwap_20", "obv_ma"])
tech("variant_slippage_features", t.slippage_features, spec(_sf), f"""
    SELECT *, {", ".join(f"coalesce(s_vol_{n} / nullif({roll('avg', f's_vol_{n}', 2 * n)}, 0), 1) AS vol_regime_{n}"
                         for n in (10, 20))}, {roll('sum', 'tpv', 20)} / {roll('sum', 'volume', 20)} AS vwap_20,
    {roll('avg', 'ob', 20)} AS obv_ma FROM (SELECT *, (high - low) / "close" AS price_range,
    open / pc - 1 AS price_gap, abs(open - "close") / "close" AS oc_spread,
    sqrt(ln(high / "close") ** 2 + ln(low / "close") ** 2) AS realized_vol,
    {", ".join(f'"close" / {lag(CL, n)} - 1 AS p_mom_{n}' for n in (5, 10, 20))},
    {", ".join(f'"close" / {roll("avg", CL, n)} - 1 AS p_rev_{n}' for n in (5, 10, 20))},
    {", ".join(f"{roll('stddev_samp', 'r', n)} * sqrt(252) AS s_vol_{n}" for n in (10, 20))},
    {", ".join(f"volume / {roll('avg', 'volume', n)} AS v_ratio_{n}" for n in (5, 10, 20))},
    {", ".join(f"{roll('stddev_samp', 'volume', n)} AS v_std_{n}" for n in (5, 10, 20))},
    (high + low + "close") / 3 * volume AS tpv,
    sum(coalesce(sign(r), 0) * volume) OVER ({W}) AS ob FROM numbered)""")

_cal = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos", "is_open", "is_first_hour",
        "is_last_hour", "is_monday", "is_friday"]
tech("variant_calendar", t.calendar_features, "hour:i dow:i month:i quarter:i " + spec(_cal), """
    SELECT symbol, ts, h AS hour, d AS dow, m AS month, quarter(ts) AS quarter, sin(2 * pi() * h / 24) AS hour_sin,
    cos(2 * pi() * h / 24) AS hour_cos, sin(2 * pi() * d / 7) AS dow_sin, cos(2 * pi() * d / 7) AS dow_cos,
    sin(2 * pi() * m / 12) AS month_sin, cos(2 * pi() * m / 12) AS month_cos,
    CAST(h BETWEEN 9 AND 15 AND d < 5 AS INT) AS is_open, CAST(h = 9 AS INT) AS is_first_hour,
    CAST(h = 15 AS INT) AS is_last_hour, CAST(d = 0 AS INT) AS is_monday, CAST(d = 4 AS INT) AS is_friday
    FROM (SELECT *, hour(ts) AS h, isodow(ts) - 1 AS d, month(ts) AS m FROM bars)""")


def _quotes(m):
    from ..operators.book import book_summary
    q = book_summary(m.books())
    return q.select("symbol", "ts", q.best_bid.alias("bid"), q.best_ask.alias("ask"),
                    q.bid_depth.alias("bid_volume"), q.ask_depth.alias("ask_volume"), "event_id")


add_base("quotes", """SELECT symbol, ts, event_id, max(price) FILTER (side = 'bid') AS bid,
    min(price) FILTER (side = 'ask') AS ask, sum(size) FILTER (side = 'bid') AS bid_volume,
    sum(size) FILTER (side = 'ask') AS ask_volume FROM levels GROUP BY ALL""")


def _per_chunk(df, fn, halo):
    """Rolling features over an unbounded tick series: row chunks with a halo instead of one window per symbol."""
    from pyspark.sql import functions as F
    from ..operators.timeseries import chunk_with_halo, index_rows
    d = index_rows(df, "symbol", ["ts", "event_id"], F.date_trunc("hour", "ts"))
    d = chunk_with_halo(d, halo)
    out = fn(d, Ordered(["symbol", "_chunk"], "_i"))
    return out.filter("_own")


@query("variant_quoted_spread", "symbol event_id:i spread:d spread_pct:d spread_ma:d", f"""
    SELECT symbol, event_id, ask - bid AS spread, (ask - bid) / ((ask + bid) / 2) AS spread_pct,
    {roll('avg', '(ask - bid)', 20)} AS spread_ma FROM quotes""")
def _spread(m):
    return _per_chunk(_quotes(m), t.quoted_spread, 20)


@query("variant_order_imbalance", "symbol event_id:i imbalance:d imbalance_ma:d", f"""
    SELECT symbol, event_id, imbalance, {roll('avg', 'imbalance', 20)} AS imbalance_ma FROM (SELECT *,
    (bid_volume - ask_volume) / (bid_volume + ask_volume) AS imbalance FROM quotes)""")
def _imbalance(m):
    return _per_chunk(_quotes(m), t.order_imbalance, 20)


_flag_cols = ["ret_1", "ret_5", "ret_20", "sma_20", "bb_pos", "vol_20"]


@query("flagship_latest_features", "symbol ts " + spec(_flag_cols), f"""
    SELECT * FROM (SELECT symbol, ts, rn, r AS ret_1, "close" / {lag(CL, 5)} - 1 AS ret_5,
      "close" / {lag(CL, 20)} - 1 AS ret_20, {roll('avg', CL, 20)} AS sma_20,
      ("close" - ({roll('avg', CL, 20)} - 2 * {roll('stddev_pop', CL, 20)})) /
        nullif(4 * {roll('stddev_pop', CL, 20)}, 0) AS bb_pos, {roll('stddev_pop', 'lr', 20)} * sqrt(252) AS vol_20
      FROM numbered) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""")
def _flagship(m):
    from ..plans.features import FLAGSHIP
    return latest(t.with_technical(m.bars(), groups=FLAGSHIP), "symbol", "ts")


# ------------------------------------------------------------------ one table of all features for every user as symbol

_feature_cols = " ".join(dict.fromkeys(" ".join(c for _, c, _ in GROUPS).split()))
_per_group = {}
for _, _cols, _sql in GROUPS:
    _new = [x.partition(":")[0] for x in _cols.split() if x.partition(":")[0] not in _per_group]
    for _x in _new:
        _per_group[_x] = len(_per_group)
    add_base(f"features_{len(_per_group)}", f'SELECT symbol AS g_symbol, ts AS g_ts{"".join(f", {x}" for x in _new)} FROM ({_sql})')
    _per_group[f"table {len(_per_group)}"] = f"features_{len(_per_group)}"
_tables = [v for k, v in _per_group.items() if k.startswith("table ")]


@query("pipeline_features", f"symbol ts sent_score:d sent_confidence:d {_feature_cols}", "SELECT b.symbol, b.ts, sent_score, sent_confidence, "
       + ", ".join(x.partition(":")[0] for x in _feature_cols.split()) + " FROM bars b " + " ".join(
           f"JOIN {x} ON {x}.g_symbol = b.symbol AND {x}.g_ts = b.ts" for x in _tables)
       + """ LEFT JOIN (SELECT 'U' || user_id AS s_symbol, date_trunc('hour', ts) AS s_ts, avg(score) AS sent_score, avg(confidence) AS
    sent_confidence FROM sent GROUP BY 1, 2) s ON s_symbol = b.symbol AND s_ts = b.ts""")
def _all_features(m):
    """Technical groups, calendar and sentiment of every user's hourly bars in one table."""
    return feature_table(m.bars_by_user(), m.sentiment_by_user())


ORACLES["pipeline_features"] = ORACLES["pipeline_features"].replace("upper(event_type) AS symbol, 100", "'U' || user_id AS symbol, 100")
