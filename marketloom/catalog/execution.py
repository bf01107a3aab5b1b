"""Order-book, impact and transaction-cost queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import col, div
from ..operators import book as bk
from ..operators import impact as im
from ..operators import mldata as ml
from ..operators import tca
from ..operators.timeseries import Ordered, asof_join, chunk_with_halo, index_rows
from ..session import cut_lineage
from ..sources.bars import ohlcv_bars
from . import technical as _technical  # noqa: F401  (defines shared tables)
from .base import add_base, query
from .technical import roll

BID, ASK = "side = 'bid'", "side = 'ask'"
add_base("book", f"""SELECT event_id, symbol, ts, qty, max(price) FILTER ({BID}) AS best_bid, min(price) FILTER ({ASK}) AS
    best_ask, {', '.join(f"sum(size) FILTER (side = '{s}' AND i <= {n}) AS {s}{n}" for s in ('bid', 'ask') for n in (1, 2, 3, 5))},
    {', '.join(f"sum(size * 0.9 ** (i - 1)) FILTER (side = '{s}') AS {s}_eff, sum(size * price * 0.9 ** (i - 1)) FILTER "
               f"(side = '{s}') AS {s}_val" for s in ('bid', 'ask'))} FROM levels GROUP BY ALL""")
add_base("book2", """SELECT *, (best_bid + best_ask) / 2 AS mid, best_ask - best_bid AS spread,
    (best_ask - best_bid) / ((best_bid + best_ask) / 2) * 10000 AS spread_bps, bid3 / (bid3 + ask3) AS bid_ratio,
    (best_ask - best_bid) / ((best_bid + best_ask) / 2) * 10000 + abs(bid1 - ask1) / (bid1 + ask1) * 10 AS effective_spread
    FROM book""")


def chunked(m, fn, halo):
    d = index_rows(m.books(), "symbol", ["ts", "event_id"], F.date_trunc("hour", "ts"))
    return fn(chunk_with_halo(d, halo), Ordered(["symbol", "_chunk"], "_i")).filter("_own")


@query("book_summary", "event_id:i best_bid:d best_ask:d mid:d spread:d spread_bps:d bid_depth:d ask_depth:d",
       "SELECT *, bid5 AS bid_depth, ask5 AS ask_depth FROM book2")
def _summary(m):
    return bk.book_summary(m.books())


@query("book_depth", "event_id:i bid_depth_size:d bid_depth_price:d bid_depth_levels:i ask_depth_size:d ask_depth_price:d",
       """SELECT event_id, bid_eff AS bid_depth_size, bid_val / bid_eff AS bid_depth_price, 5 AS bid_depth_levels, ask_eff AS
    ask_depth_size, ask_val / ask_eff AS ask_depth_price FROM book2""")
def _depth(m):
    return bk.book_depth(m.books())


@query("book_imbalance", "event_id:i bid_ratio:d imbalance_side imbalance_strength:d", """SELECT event_id, bid_ratio,
    CASE WHEN bid_ratio > 0.6 THEN 'bullish' WHEN bid_ratio < 0.4 THEN 'bearish' ELSE 'neutral' END AS imbalance_side,
    CASE WHEN bid_ratio > 0.6 THEN (bid_ratio - 0.5) * 2 WHEN bid_ratio < 0.4 THEN (0.5 - bid_ratio) * 2 ELSE 0 END AS
    imbalance_strength FROM book2""")
def _imbalance(m):
    return bk.book_imbalance(m.books(), 0.6)


@query("book_liquidity", "event_id:i effective_spread:d liquidity_score:d", """SELECT event_id, effective_spread,
    (least(bid_eff, ask_eff) / 10000 + 5 / 10 + greatest(0, 1 - effective_spread)) / 3 AS liquidity_score FROM book2""")
def _liquidity(m):
    return bk.liquidity(m.books())


@query("book_sweep_cost", "event_id:i feasible:b avg_fill:d8 levels_used:i impact_bps:d shortage:d", """
    WITH w AS (SELECT l.*, 120 + qty AS want, sum(size) OVER (PARTITION BY event_id ORDER BY i) - size AS before FROM levels l
      WHERE l.side = CASE WHEN event_id % 2 = 0 THEN 'ask' ELSE 'bid' END),
    q AS (SELECT event_id, any_value(want) AS want, sum(least(size, greatest(want - before, 0))) AS f,
      sum(least(size, greatest(want - before, 0)) * price) AS c, count(*) FILTER (before < want) AS n FROM w GROUP BY 1)
    SELECT event_id, f >= want AS feasible, CASE WHEN f >= want THEN c / f END AS avg_fill, CASE WHEN f >= want THEN n END AS
      levels_used, CASE WHEN f >= want THEN abs(c / f - mid) / mid * 10000 END AS impact_bps, greatest(want - f, 0) AS shortage
    FROM q JOIN book2 USING (event_id)""")
def _sweep(m):
    b = m.books().withColumns({"order_size": 120 + col("qty"), "side": F.when(col("event_id") % 2 == 0, "buy").otherwise("sell")})
    return bk.sweep_cost(b)


_w = "PARTITION BY symbol ORDER BY ts, event_id"


@query("book_patterns", "event_id:i spread_pattern liquidity_pattern momentum_pattern stepping_share:d patterns:i", f"""
    WITH a AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS gx, mid - lag(mid) OVER o AS dm, best_bid - lag(best_bid)
      OVER o AS db, best_ask - lag(best_ask) OVER o AS da, (bid2 - ask2) / (bid2 + ask2 + 1e-6) AS im, row_number() OVER o AS x,
      count(*) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS 19 PRECEDING) AS seen FROM book2 WINDOW o AS ({_w})),
    b AS (SELECT *, regr_slope(spread_bps, x) OVER f20 AS slope, stddev_pop(spread_bps) OVER f20 AS sd,
      (bid3 - first_value(bid3) OVER f15) / (first_value(bid3) OVER f15 + 1) AS cb,
      (ask3 - first_value(ask3) OVER f15) / (first_value(ask3) OVER f15 + 1) AS ca, avg(dm) OVER f3 AS m3,
      stddev_pop(dm) OVER f9 AS msd, avg(im) OVER f3 AS i3,
      greatest(sum(CAST(db > 0 AS INT)) OVER f11, sum(CAST(db < 0 AS INT)) OVER f11, sum(CAST(da > 0 AS INT)) OVER f11,
        sum(CAST(da < 0 AS INT)) OVER f11) / 11 AS step FROM a
      WINDOW f20 AS ({_w} ROWS 19 PRECEDING), f15 AS ({_w} ROWS 14 PRECEDING), f9 AS ({_w} ROWS 8 PRECEDING),
        f3 AS ({_w} ROWS 2 PRECEDING), f11 AS ({_w} ROWS 10 PRECEDING)),
    c AS (SELECT event_id, CASE WHEN seen >= 10 AND abs(slope) / (sd + 1e-6) > 0.1 THEN (CASE WHEN slope < 0 THEN
        'spread_tightening' ELSE 'spread_widening' END) END AS spread_pattern,
      CASE WHEN seen < 8 OR (abs(cb) <= 0.2 AND abs(ca) <= 0.2) THEN NULL WHEN cb > 0.2 AND ca > 0.2 THEN 'liquidity_buildup'
        WHEN cb < -0.2 AND ca < -0.2 THEN 'liquidity_depletion' WHEN cb > 0.2 THEN 'bid_buildup' WHEN ca > 0.2 THEN
        'ask_buildup' WHEN cb < -0.2 THEN 'bid_depletion' ELSE 'ask_depletion' END AS liquidity_pattern,
      CASE WHEN seen >= 10 AND (abs(m3) / (msd + 1e-6) > 0.5 OR abs(i3) > 0.3) THEN (CASE WHEN m3 > 0 THEN 'bullish' ELSE
        'bearish' END) END AS momentum_pattern, CASE WHEN seen >= 12 AND step > 0.7 THEN step END AS stepping_share FROM b)
    SELECT *, CAST(spread_pattern IS NOT NULL AS INT) + CAST(liquidity_pattern IS NOT NULL AS INT) + CAST(momentum_pattern IS
      NOT NULL AS INT) + CAST(stepping_share IS NOT NULL AS INT) AS patterns FROM c""")
def _patterns(m):
    return chunked(m, lambda d, s: bk.book_patterns(d, s, trend_threshold=0.1), 32)


@query("book_signals", "event_id:i sig_imbalance:b sig_spread sig_size book_sentiment", f"""SELECT *, CASE WHEN bull > bear *
    1.2 THEN 'bullish' WHEN bear > bull * 1.2 THEN 'bearish' ELSE 'neutral' END AS book_sentiment FROM (SELECT *,
    CASE WHEN sig_imbalance AND bid_ratio > 0.5 THEN 0.6 ELSE 0 END + CASE WHEN sig_size = 'bid_size_dominance' THEN 0.25 ELSE 0
    END AS bull, CASE WHEN sig_imbalance AND bid_ratio < 0.5 THEN 0.6 ELSE 0 END + CASE WHEN sig_size = 'ask_size_dominance' THEN
    0.25 ELSE 0 END AS bear FROM (SELECT *, greatest(CASE WHEN bid_ratio > 0.7 THEN (bid_ratio - 0.5) * 2 ELSE 0 END, CASE WHEN
    bid_ratio < 0.3 THEN (0.5 - bid_ratio) * 2 ELSE 0 END) > 0.7 AS sig_imbalance, CASE WHEN spread_bps < av * 0.7 THEN
    'tight_spread' WHEN spread_bps > av * 1.5 THEN 'wide_spread' END AS sig_spread, CASE WHEN bid1 / ask1 > 3 THEN
    'bid_size_dominance' WHEN bid1 / ask1 < 1.0 / 3 THEN 'ask_size_dominance' END AS sig_size FROM (SELECT *, avg(spread_bps) OVER
    ({_w} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS av FROM book2)))""")
def _signals(m):
    return chunked(m, bk.book_signals, 20)


@query("book_stats", "event_id:i liquidity_avg:d liquidity_sd:d spread_avg:d spread_max:d", f"""SELECT event_id, avg(l) OVER w AS
    liquidity_avg, stddev_pop(l) OVER w AS liquidity_sd, avg(spread_bps) OVER w AS spread_avg, max(spread_bps) OVER w AS
    spread_max FROM (SELECT *, (least(bid_eff, ask_eff) / 10000 + 0.5 + greatest(0, 1 - effective_spread)) / 3 AS l FROM book2)
    WINDOW w AS ({_w} ROWS 99 PRECEDING)""")
def _stats(m):
    return chunked(m, bk.book_stats, 100)


def limit_orders(m):
    b = m.books()
    k = (col("event_id") % 3).cast("int")
    side = F.when(col("event_id") % 2 == 0, "buy").otherwise("sell")
    lv = F.when(col("event_id") % 2 == 0, col("bids")).otherwise(col("asks"))
    return b.withColumns({"side": side, "limit_price": F.get(lv, k)["price"], "order_size": 60 + col("qty"),
                          "placed": col("ts") - F.expr("make_dt_interval(0, 0, 0, event_id % 100)")})


add_base("queue", """SELECT *, greatest(0, 1 - ahead / sz) * greatest(0.5, 1 - (spread_bps - 5) / 20) * (1 + 0.2 * (CASE WHEN
    buy THEN bid2 ELSE ask2 END) / (bid2 + ask2)) AS p, floor(least(ahead / (sz / 300 * CASE WHEN spread_bps < 10 THEN 1.5 ELSE 1
    END), 3600)) AS secs FROM (SELECT b.*, l.size AS sz, event_id % 2 = 0 AS buy, l.size * 0.6 * CASE WHEN event_id % 100 < 60 THEN
    1 - (event_id % 100) / 120 ELSE 1 END AS ahead FROM book2 b JOIN (SELECT event_id, size FROM levels WHERE i = event_id % 3 + 1
    AND side = CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END) l USING (event_id))""")


@query("book_queue_estimate", "event_id:i ahead:d level_size:d level_found:b fill_probability:d fill_seconds:i", """SELECT event_id,
    ahead, sz AS level_size, true AS level_found, least(1, p) AS fill_probability, secs AS fill_seconds FROM queue""")
def _queue(m):
    return bk.queue_estimate(limit_orders(m))


@query("book_placement_choice", "event_id:i strategy score:d", """
    WITH w AS (SELECT l.*, 60 + qty AS want, sum(size) OVER (PARTITION BY event_id ORDER BY i) - size AS before FROM levels l
      WHERE l.side = CASE WHEN event_id % 2 = 0 THEN 'ask' ELSE 'bid' END),
    q AS (SELECT event_id, any_value(want) AS want, sum(least(size, greatest(want - before, 0))) AS f,
      sum(least(size, greatest(want - before, 0)) * price) AS c FROM w GROUP BY 1),
    r AS (SELECT event_id, spread_bps, least(1, p) AS p, secs, abs(c / f - mid) / mid * 10000 AS imp FROM q JOIN queue
      USING (event_id) WHERE f >= want),
    s AS (SELECT event_id, 'market_order' AS strategy, 0 AS o, (1 - imp / 50 + 1 + 1) / 3 AS score FROM r UNION ALL
      SELECT event_id, 'join_best', 1, (1 + p + 1 - least(secs / 600, 1)) / 3 FROM r UNION ALL
      SELECT event_id, 'mid_price_order', 2, (1 - imp / 100 + 0.3 + 0.5) / 3 FROM r WHERE spread_bps > 10)
    SELECT event_id, strategy, score FROM ticks LEFT JOIN (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY event_id ORDER
    BY score DESC, o) = 1) USING (event_id)""")
def _placement(m):
    return bk.placement_choice(limit_orders(m))


# ------------------------------------------------------------------ impact

add_base("signed", """SELECT *, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts), 1) * volume AS sv FROM
    (SELECT *, nullif(sign("close" - pc), 0) AS d FROM numbered)""")


@query("impact_signed_volume", "symbol ts signed_volume:d", "SELECT symbol, ts, sv AS signed_volume FROM signed")
def _signed(m):
    return im.signed_volume(m.bars())


add_base("kyle", """SELECT symbol, count(*) AS n, least(greatest(abs(covar_samp(r, sv) / var_samp(sv)), 1e-8), 1e-3) AS lam FROM
    signed WHERE r IS NOT NULL GROUP BY 1""")


@query("impact_kyle_lambda", "symbol n:i lam:d12", "SELECT * FROM kyle")
def _kyle(m):
    return im.kyle_lambda(m.bars())


def executions(m):
    from pyspark.sql import functions as F
    p = m.parents()
    t = m.trades().groupBy("order_id").agg(div(F.sum(col("price") * col("qty")), F.sum("qty")).alias("px"))
    return p.join(t, "order_id").select("symbol", "order_id", col("order_qty").alias("size"),
                                        (col("px") / col("arrival_price") - 1).alias("shortfall"))


add_base("execs", """SELECT p.symbol, order_id, order_qty AS size, px / arrival_price - 1 AS shortfall FROM parents p JOIN (SELECT
    order_id, sum(price * qty) / nullif(sum(qty), 0) AS px FROM trades GROUP BY 1) USING (order_id)""")
add_base("params", """SELECT symbol, volatility, avg_volume, greatest(1e-8, abs(c / v)) AS eta, 0.1 * greatest(1e-8, abs(c / v)) AS
    gamma FROM (SELECT symbol, stddev_samp(r) * sqrt(252) AS volatility, avg(volume) AS avg_volume FROM numbered GROUP BY 1) JOIN
    (SELECT symbol, covar_samp(shortfall, size / av) AS c, var_samp(size / av) AS v FROM execs JOIN (SELECT symbol, avg(volume) AS
    av FROM bars GROUP BY 1) USING (symbol) GROUP BY 1) USING (symbol)""")


@query("impact_params", "symbol volatility:d avg_volume:d eta:d9 gamma:d9", "SELECT * FROM params")
def _params(m):
    return im.impact_params(m.bars(), executions(m))


def estimates(m, blend=None):
    b = m.bars()
    o = m.parents().select("order_id", "symbol", (col("order_qty") * 0.01).alias("size"), (col("slot") % 120).alias("latency_ms"))
    return im.impact_estimate(o, im.kyle_lambda(b), im.impact_params(b, executions(m)), blend)


add_base("est", """SELECT *, CASE WHEN impact_bps < 5 THEN 'low' WHEN impact_bps < 15 THEN 'medium' WHEN impact_bps < 30 THEN 'high'
    ELSE 'very_high' END AS risk_class FROM (SELECT order_id, symbol, (0.4 * lam * size + 0.6 * (eta + gamma) * size / avg_volume +
    greatest(lat - 50, 0) * 1e-4) * 10000 AS impact_bps FROM (SELECT order_id, symbol, order_qty * 0.01 AS size, slot % 120 AS lat
    FROM parents) JOIN kyle USING (symbol) JOIN params USING (symbol))""")


@query("impact_estimate", "order_id impact_bps:d risk_class", "SELECT * FROM est")
def _estimate(m):
    return estimates(m)


@query("impact_blend", "order_id impact_bps:d risk_class", """SELECT order_id, bps AS impact_bps, CASE WHEN bps < 5 THEN 'low' WHEN bps < 15 THEN 'medium'
    WHEN bps < 30 THEN 'high' ELSE 'very_high' END AS risk_class FROM (SELECT order_id, (0.2 * lam * size + 0.3 * (eta + gamma) * size / avg_volume +
    0.5 * volatility * sqrt(size / avg_volume) + greatest(lat - 50, 0) * 1e-4) * 10000 AS bps FROM (SELECT order_id, symbol, order_qty * 0.01 AS size,
    slot % 120 AS lat FROM parents) JOIN kyle USING (symbol) JOIN params USING (symbol))""")
def _blend(m):
    """Another blend of registered impact models."""
    return estimates(m, {"kyle": 0.2, "ac": 0.3, "sqrt": 0.5})


@query("impact_decay", "order_id impact_after_60s:d impact_after_300s:d impact_after_900s:d", """SELECT order_id, impact_bps *
    exp(-ln(2) * 60 / 300) AS impact_after_60s, impact_bps * exp(-ln(2)) AS impact_after_300s, impact_bps * exp(-ln(2) * 3) AS
    impact_after_900s FROM est""")
def _decay(m):
    return im.impact_decay(estimates(m))


@query("impact_analytics", "symbol avg_bps:d sd_bps:d n:i low:i medium:i high:i very_high:i p50:d p95:d", """SELECT symbol,
    avg(impact_bps) AS avg_bps, stddev_pop(impact_bps) AS sd_bps, count(*) AS n, count(*) FILTER (risk_class = 'low') AS low,
    count(*) FILTER (risk_class = 'medium') AS medium, count(*) FILTER (risk_class = 'high') AS high, count(*) FILTER (risk_class =
    'very_high') AS very_high, median(impact_bps) AS p50, quantile_cont(impact_bps, 0.95) AS p95 FROM est GROUP BY 1""")
def _analytics(m):
    return im.impact_analytics(estimates(m), ["symbol"])


def sched_orders(m):
    p = im.impact_params(m.bars(), executions(m))
    o = m.parents().select("order_id", "symbol", col("order_qty").alias("size"), (120 + col("slot") % 900).alias("horizon"))
    return o.join(p, "symbol")


add_base("sched", """SELECT order_id, symbol, order_qty AS size, 120 + slot % 900 AS horizon, volatility, avg_volume, eta, gamma FROM
    parents JOIN params USING (symbol)""")


@query("impact_schedule_ac", "order_id slice:i slice_size:d start_s:d slice_cost:d9", """SELECT *, (eta + gamma) * slice_size /
    avg_volume AS slice_cost FROM (SELECT *, size * (sinh(k * h * (1 - (slice - 1) / n)) - sinh(k * h * (1 - slice / n))) /
    sinh(k * h) AS slice_size, (slice - 1) * horizon / n AS start_s FROM (SELECT *, unnest(range(1, n + 1)) AS slice FROM (SELECT *,
    sqrt(1e-6 * volatility * volatility / eta) AS k, horizon / 3600 AS h, CAST(least(greatest(floor(horizon / 30), 5), 20) AS INT)
    AS n FROM sched)))""")
def _ac(m):
    return im.execution_schedule(sched_orders(m), "ac")


@query("impact_schedule_uniform", "order_id slice:i slice_size:d start_s:d", """SELECT *, size / n AS slice_size, (slice - 1) * horizon
    / n AS start_s FROM (SELECT *, unnest(range(1, n + 1)) AS slice FROM (SELECT *, horizon // 60 AS n FROM sched))""")
def _uniform(m):
    return im.execution_schedule(sched_orders(m), "uniform")


@query("impact_twap_slices", "order_id slice:i slice_size:d start_s:d", """SELECT order_id, slice, size / n AS slice_size, (slice - 1)
    * iv AS start_s FROM (SELECT *, unnest(range(1, CAST(n AS INT) + 1)) AS slice FROM (SELECT *, CASE WHEN vr > 1.5 THEN
    least(n0 * 2, 20) WHEN vr < 0.7 THEN greatest(floor(n0 / 2), 3) ELSE n0 END AS n, CASE WHEN vr > 1.5 THEN greatest(30,
    floor(i0 / 2)) WHEN vr < 0.7 THEN least(300, i0 * 2) ELSE i0 END AS iv FROM (SELECT *, greatest(1, floor(horizon / i0)) AS n0
    FROM (SELECT *, least(greatest(floor(horizon / 10), 30), 120) AS i0 FROM sched JOIN (SELECT symbol, stddev_samp(r) FILTER
    (k <= 20) / stddev_samp(r) AS vr FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM numbered)
    GROUP BY 1) USING (symbol)))))""")
def _twap(m):
    return im.twap_slices(sched_orders(m), m.bars())


@query("impact_vwap_slices", "order_id hour:i slice:i slice_size:d participation:d start_s:d", """SELECT order_id, hour, slice, size *
    share AS slice_size, least(greatest(share * 2, 0.05), 0.2) AS participation, (slice - 1) * greatest(60, horizon // n) AS start_s
    FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY hour) AS slice, count(*) OVER (PARTITION BY order_id) AS n
    FROM sched JOIN (SELECT symbol, hour, v / sum(v) OVER (PARTITION BY symbol) AS share FROM (SELECT symbol, hour(ts) AS hour,
    avg(volume) AS v FROM bars GROUP BY 1, 2)) USING (symbol))""")
def _vwap(m):
    return im.vwap_slices(sched_orders(m), m.bars())


@query("impact_iceberg_slices", "order_id slice:i visible:d slice_size:d start_s:d", """SELECT order_id, slice, visible, least(p, size -
    (slice - 1) * p) AS slice_size, (slice - 1) * 45 AS start_s FROM (SELECT *, greatest(size * visible, 1, size * 0.02) AS p,
    unnest(range(1, 21)) AS slice FROM (SELECT *, CASE WHEN size / v10 > 0.5 THEN 0.05 WHEN size / v10 > 0.2 THEN 0.08 ELSE 0.15 END
    AS visible FROM sched JOIN (SELECT symbol, avg(volume) AS v10 FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY
    symbol ORDER BY ts DESC) <= 10) GROUP BY 1) USING (symbol))) WHERE least(p, size - (slice - 1) * p) > 1e-9""")
def _iceberg(m):
    return im.iceberg_slices(sched_orders(m), m.bars())


def venue_book(m):
    return m.trades().groupBy("symbol", "venue").agg(
        F.stddev_pop("price").alias("cost"), (F.sum("qty") / 30).alias("capacity"), F.avg("qty").alias("avg_slippage"),
        (F.count_if(col("qty") > 20) / F.count(F.lit(1))).alias("success"), F.max("qty").alias("latency_ms"))


add_base("venue_book", """SELECT symbol, venue, stddev_pop(price) AS cost, sum(qty) / 30 AS capacity, avg(qty) AS avg_slippage,
    count(*) FILTER (qty > 20) / count(*) AS success, max(qty) AS latency_ms FROM trades GROUP BY 1, 2""")


@query("impact_venue_allocation", "order_id venue qty:d share:d", """WITH RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY symbol
      ORDER BY cost, venue) AS k, arg_max(venue, capacity) OVER (PARTITION BY symbol) AS big FROM venue_book),
    w AS (SELECT order_id, symbol, order_qty AS size, order_qty AS rest, 0 AS k, NULL::VARCHAR AS venue, 0.0::DOUBLE AS q FROM
      parents UNION ALL SELECT order_id, symbol, size, CASE WHEN a > size * 0.01 THEN rest - a ELSE rest END, k, venue, CASE WHEN a >
      size * 0.01 THEN a ELSE 0 END FROM (SELECT w.order_id, w.symbol, w.size, w.rest, v.k, v.venue, least(v.capacity, w.rest * 0.5)
      AS a FROM w JOIN v ON v.symbol = w.symbol AND v.k = w.k + 1)),
    u AS (SELECT order_id, size, venue, q FROM w WHERE q > 0 UNION ALL SELECT order_id, size, (SELECT any_value(big) FROM v WHERE
      v.symbol = f.symbol), rest FROM w f WHERE k = (SELECT max(k) FROM v WHERE v.symbol = f.symbol) AND rest > 0)
    SELECT order_id, venue, sum(q) AS qty, sum(q) / any_value(size) AS share FROM u GROUP BY 1, 2""")
def _alloc(m):
    o = m.parents().select("order_id", "symbol", col("order_qty").alias("size"))
    return im.venue_allocation(o, venue_book(m).select("symbol", "venue", "cost", "capacity"))


# ------------------------------------------------------------------ transaction costs

add_base("minute", """SELECT symbol, date_trunc('minute', ts) AS bar_ts, arg_max(price, ts) AS "close", sum(qty) AS volume FROM ticks
    GROUP BY 1, 2""")
add_base("costed", """SELECT t.*, arrival_price, CASE WHEN n IS NULL THEN 5 * least(qty / 10000, 0.1) WHEN n < 2 THEN 2.0 ELSE
    least(greatest(abs(c1 - c0) / c0 * least(coalesce(2 * qty / nullif(v, 0), 0), 0.8) * 10000, 0), 20) END AS impact_bps,
    CASE WHEN age <= 60 THEN 0.5 WHEN age <= 300 THEN 1.5 WHEN age <= 900 THEN 3.0 ELSE 5.0 END AS timing_bps, 2.0 AS spread_bps,
    (CASE side WHEN 'buy' THEN 1 ELSE -1 END) * (price - arrival_price) / arrival_price * 10000 AS slippage_bps
    FROM (SELECT t.*, arrival_price, epoch(t.ts - start_ts) AS age FROM trades t JOIN parents USING (order_id)) t LEFT JOIN (SELECT
    trade_id, count(*) AS n, arg_min("close", bar_ts) AS c0, arg_max("close", bar_ts) AS c1, sum(volume) AS v FROM trades x JOIN
    minute b ON x.symbol = b.symbol AND bar_ts BETWEEN x.ts - INTERVAL 2 MINUTE AND x.ts + INTERVAL 2 MINUTE GROUP BY 1)
    USING (trade_id)""")
add_base("rolled", """SELECT *, filled / nullif(order_qty, 0) AS fill_rate, epoch(last_ts - first_ts) AS duration_s, (CASE side WHEN 'buy' THEN 1
    ELSE -1 END) * (avg_price - arrival_price) / arrival_price * 10000 AS slippage_bps FROM parents JOIN (SELECT order_id, sum(qty)
    AS filled, sum(price * qty) / nullif(sum(qty), 0) AS avg_price, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS fills,
    sum(impact_bps * qty) / nullif(sum(qty), 0) AS impact_bps, sum(timing_bps * qty) / nullif(sum(qty), 0) AS timing_bps FROM costed GROUP BY 1)
    USING (order_id)""")


def costed(m):
    return tca.trade_costs(m.trades(), m.parents(), ohlcv_bars(m.ticks(), "1m"))


def rolled(m):
    return tca.order_rollup(costed(m), m.parents())


@query("tca_trade_costs", "trade_id:i impact_bps:d timing_bps:d slippage_bps:d", "SELECT * FROM costed")
def _costs(m):
    return costed(m)


@query("tca_order_rollup", "order_id filled:d avg_price:d fills:i fill_rate:d duration_s:d impact_bps:d timing_bps:d slippage_bps:d",
       "SELECT * FROM rolled")
def _rolled(m):
    return rolled(m)


add_base("bench", """SELECT order_id, sum("close" * volume) / nullif(sum(volume), 0) AS bench_vwap, avg("close") AS bench_twap,
    arg_max("close", b.ts) AS bench_close FROM parents o JOIN bars b ON o.symbol = b.symbol AND b.ts BETWEEN start_ts AND end_ts
    GROUP BY 1""")


@query("tca_benchmarks", "order_id bench_vwap:d bench_twap:d bench_close:d", "SELECT * FROM bench")
def _bench(m):
    return tca.benchmarks(m.parents(), m.bars())


@query("tca_execution_shortfall", "order_id shortfall_bps:d", """SELECT order_id, (CASE side WHEN 'buy' THEN 1 ELSE -1 END) *
    (avg_price - ref) / ref * 10000 AS shortfall_bps FROM (SELECT r.*, coalesce(bench_vwap, arrival_price) AS ref FROM rolled r
    LEFT JOIN bench USING (order_id))""")
def _shortfall(m):
    return tca.execution_shortfall(rolled(m), tca.benchmarks(m.parents(), m.bars()), "vwap")


def venue_ex(m):
    c = cut_lineage(costed(m))
    r = tca.order_rollup(c, m.parents()).select("order_id", "fill_rate", "duration_s")
    return c.select("order_id", "venue", "qty", "impact_bps", "slippage_bps", "ts").join(r, "order_id")


add_base("venue_ex", """SELECT c.order_id, venue, c.qty, c.impact_bps, c.slippage_bps, fill_rate, duration_s, c.ts FROM costed c JOIN rolled
    USING (order_id)""")
add_base("venue_st", """SELECT *, (CASE WHEN 1 + avg_slippage / 10 = 0 THEN 0 ELSE 1 / (1 + avg_slippage / 10) END + avg_fill + 1 /
    (1 + avg_seconds / 60)) / 3 AS composite FROM (SELECT venue, count(*) AS n, avg(slippage_bps) AS avg_slippage,
    stddev_pop(slippage_bps) AS sd_slippage, avg(impact_bps) AS avg_impact, avg(fill_rate) AS avg_fill, avg(duration_s) AS
    avg_seconds, quantile_cont(slippage_bps, 0.25) AS p25, median(slippage_bps) AS median, quantile_cont(slippage_bps, 0.75) AS p75
    FROM venue_ex GROUP BY 1)""")


@query("tca_venue_stats", "venue n:i avg_slippage:d sd_slippage:d avg_impact:d avg_fill:d avg_seconds:d p25:d median:d p75:d "
       "composite:d rank:i", "SELECT *, rank() OVER (ORDER BY composite DESC) AS rank FROM venue_st")
def _venues(m):
    return tca.venue_stats(venue_ex(m))


@query("tca_venue_stats_24h", "venue n:i avg_slippage:d sd_slippage:d avg_fill:d avg_seconds:d median:d rank:i", """SELECT *, rank() OVER (ORDER BY
    composite DESC) AS rank FROM (SELECT *, (CASE WHEN 1 + avg_slippage / 10 = 0 THEN 0 ELSE 1 / (1 + avg_slippage / 10) END + avg_fill + 1 /
    (1 + avg_seconds / 60)) / 3 AS composite FROM (SELECT venue, count(*) AS n, avg(slippage_bps) AS avg_slippage, stddev_pop(slippage_bps) AS
    sd_slippage, avg(fill_rate) AS avg_fill, avg(duration_s) AS avg_seconds, median(slippage_bps) AS median FROM venue_ex WHERE ts > TIMESTAMP
    '2024-01-19' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1 HAVING count(*) >= 10))""")
def _venues_24h(m):
    return tca.venue_stats(venue_ex(m), as_of="2024-01-20")


@query("tca_venue_recommend", "venue urgency_score:d", """SELECT venue, 0.2 / (1 + avg_slippage / 10) + 0.5 * avg_fill + 0.3 /
    (1 + avg_seconds / 60) AS urgency_score FROM venue_st ORDER BY 2 DESC, 1 LIMIT 3""")
def _recommend(m):
    return tca.venue_recommend(tca.venue_stats(venue_ex(m)), "high")


add_base("algo_rank", "SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY start_ts DESC, order_id) AS k FROM rolled")
add_base("algo_eval", """SELECT *, 0.4 * fill + 0.4 * greatest(0, 1 - abs(slippage) / 50) + 0.2 * greatest(0, 1 - secs / 1800) AS
    quality, impact / slippage AS impact_share, slippage - impact - timing AS residual FROM (SELECT algorithm, count(*) AS n,
    avg(slippage_bps) AS slippage, avg(fill_rate) AS fill, avg(duration_s) AS secs, avg(impact_bps) AS impact, avg(timing_bps) AS
    timing FROM algo_rank WHERE k <= 50 GROUP BY 1)""")
_algo = "algorithm n:i slippage:d fill:d secs:d impact:d timing:d quality:d impact_share:d residual:d"


@query("tca_algorithm_eval", _algo, "SELECT * FROM algo_eval")
def _algorithms(m):
    return tca.algorithm_eval(rolled(m))


@query("tca_compare_algorithms", "algorithm quality:d rank:i", """SELECT algorithm, quality, rank() OVER (ORDER BY quality DESC) AS rank
    FROM algo_eval""")
def _compare(m):
    return tca.compare_algorithms(tca.algorithm_eval(rolled(m)))


add_base("algo_trend", """SELECT algorithm, regr_slope(slippage_bps, -k) AS slip_slope, regr_slope(fill_rate, -k) AS fill_slope,
    avg(slippage_bps) FILTER (k <= 20) - avg(slippage_bps) FILTER (k BETWEEN 21 AND 40) AS recent_change FROM algo_rank WHERE k <= 100
    GROUP BY 1""")


@query("tca_algorithm_trend", "algorithm slip_slope:d fill_slope:d recent_change:d direction", """SELECT *, CASE WHEN slip_slope < -0.1
    THEN 'improving' WHEN slip_slope > 0.1 THEN 'deteriorating' ELSE 'stable' END AS direction FROM algo_trend""")
def _trend(m):
    return tca.algorithm_trend(rolled(m))


@query("tca_dashboard", "orders:i fill:d slippage:d secs:d success:d median:d p95:d quality_grade fill_grade", """SELECT *, CASE WHEN
    slippage < 5 THEN 'Excellent' WHEN slippage < 15 THEN 'Good' WHEN slippage < 30 THEN 'Fair' ELSE 'Poor' END AS quality_grade,
    CASE WHEN success > 0.95 THEN 'Excellent' WHEN success > 0.9 THEN 'Good' WHEN success > 0.8 THEN 'Fair' ELSE 'Poor' END AS
    fill_grade FROM (SELECT count(*) AS orders, avg(fill_rate) AS fill, avg(slippage_bps) AS slippage, avg(duration_s) AS secs,
    count(*) FILTER (fill_rate > 0.95) / count(*) AS success, median(slippage_bps) AS median, quantile_cont(slippage_bps, 0.95) AS p95
    FROM rolled WHERE start_ts > TIMESTAMP '2024-01-19' AND start_ts <= TIMESTAMP '2024-01-20')""")
def _dashboard(m):
    return tca.tca_dashboard(rolled(m), "2024-01-20")


@query("tca_alerts", "key type value:d severity", """SELECT order_id AS key, 'poor_execution' AS type, slippage_bps AS value, CASE WHEN
    slippage_bps > 50 THEN 'high' ELSE 'medium' END AS severity FROM rolled WHERE slippage_bps > 20 UNION ALL SELECT algorithm,
    'algorithm_degradation', recent_change, 'medium' FROM algo_trend WHERE recent_change > 10""")
def _alerts(m):
    r = rolled(m)
    return tca.tca_alerts(r, tca.algorithm_trend(r))


def router_orders(m):
    return m.parents().select("order_id", "symbol", (col("order_qty") * (1 + col("slot") % 5)).alias("size"), "urgency",
                              (col("slot") % 50 / 100).alias("volatility"), (col("order_qty") * (col("slot") % 9) * 500).alias(
                                  "volume"), (col("slot") % 30).cast("double").alias("spread_bps"))


add_base("router", """SELECT order_id, symbol, order_qty * (1 + slot % 5) AS size, urgency AS u, (slot % 50) / 100 AS vol, order_qty *
    (slot % 9) * 500 AS v, slot % 30 AS sp, coalesce(order_qty * (1 + slot % 5) / nullif(order_qty * (slot % 9) * 500, 0), 0.1) AS r
    FROM parents""")
add_base("strat", """SELECT order_id, r, least(greatest(0.5 + CASE u WHEN 'normal' THEN 0.2 WHEN 'high' THEN -0.1 ELSE 0.1 END + CASE WHEN
    vol BETWEEN 0.15 AND 0.25 THEN 0.2 WHEN vol > 0.35 THEN -0.1 ELSE 0 END + CASE WHEN r < 0.1 THEN 0.1 WHEN r > 0.5 THEN -0.2 ELSE
    0 END + CASE WHEN sp < 15 THEN 0.1 ELSE 0 END, 0), 1) AS t, least(greatest(0.5 + CASE WHEN r > 0.2 THEN 0.3 WHEN r < 0.05 THEN
    -0.2 ELSE 0 END + CASE WHEN v > 500000 THEN 0.2 WHEN v < 50000 THEN -0.3 ELSE 0 END + CASE u WHEN 'low' THEN 0.1 WHEN 'high' THEN
    -0.2 ELSE 0 END + CASE WHEN vol < 0.2 THEN 0.1 ELSE 0 END, 0), 1) AS w, least(greatest(0.4 + CASE WHEN r > 0.5 THEN 0.4 WHEN r >
    0.3 THEN 0.2 WHEN r < 0.1 THEN -0.3 ELSE 0 END + CASE WHEN v > 1000000 THEN 0.2 WHEN v < 100000 THEN -0.4 ELSE 0 END + CASE u
    WHEN 'high' THEN -0.3 WHEN 'low' THEN 0.2 ELSE 0 END + CASE WHEN sp < 10 THEN 0.2 WHEN sp > 25 THEN -0.2 ELSE 0 END, 0), 1) AS i
    FROM router""")


@query("tca_strategy_score", "order_id TWAP:d VWAP:d ICEBERG:d strategy", """WITH h AS (SELECT algorithm, (1 - least(avg(slippage_bps) /
      30, 1)) * 0.5 + avg(fill_rate) * 0.5 AS p FROM algo_rank WHERE k <= 20 GROUP BY 1),
    b AS (SELECT order_id, r, round(0.7 * t + 0.3 * (SELECT p FROM h WHERE algorithm = 'TWAP'), 12) AS "TWAP", round(0.7 * w + 0.3 *
      (SELECT p FROM h WHERE algorithm = 'VWAP'), 12) AS "VWAP", round(0.7 * i + 0.3 * (SELECT p FROM h WHERE algorithm = 'ICEBERG'),
      12) AS "ICEBERG" FROM strat)
    SELECT *, CASE WHEN greatest("TWAP", "VWAP", "ICEBERG") >= 0.7 THEN (CASE greatest("TWAP", "VWAP", "ICEBERG") WHEN "TWAP" THEN
      'TWAP' WHEN "VWAP" THEN 'VWAP' ELSE 'ICEBERG' END) WHEN r > 0.3 THEN 'ICEBERG' WHEN r > 0.1 THEN 'VWAP' ELSE 'TWAP' END AS
      strategy FROM b""")
def _strategy(m):
    return tca.strategy_score(router_orders(m), rolled(m))


@query("tca_venue_score", "order_id venue score:d", """SELECT order_id, arg_max(venue, s) AS venue, max(s) AS score FROM (SELECT order_id,
    venue, 0.3 * (1 - least(size / capacity, 1)) + 0.3 / (1 + avg_slippage / 10) + success * 0.2 + (CASE u WHEN 'high' THEN 0.2 ELSE
    0.1 END) / (1 + latency_ms / 100) AS s FROM router JOIN venue_book USING (symbol)) GROUP BY 1""")
def _venue_score(m):
    return tca.venue_score(router_orders(m), venue_book(m))


@query("tca_execution_performance", "order_id fill_rate:d slippage:d avg_seconds:d venues:i vs_expected:d grade", """SELECT *, slippage -
    10 AS vs_expected, CASE WHEN slippage < 5 THEN 'excellent' WHEN slippage < 15 THEN 'good' ELSE 'fair' END AS grade FROM (SELECT
    order_id, sum(f) / nullif(sum(q), 0) AS fill_rate, sum(s * f) / nullif(sum(f), 0) AS slippage, avg(t) AS avg_seconds, count(*) AS
    venues FROM (SELECT order_id, venue, sum(qty) AS q, sum(qty * 0.9) AS f, avg(slippage_bps) AS s, avg(duration_s) AS t FROM
    venue_ex GROUP BY 1, 2) GROUP BY 1)""")
def _performance(m):
    return tca.execution_performance(venue_ex(m).withColumn("filled", col("qty") * 0.9))


@query("tca_execution_risk_flags", "order_id risks risk_level", """SELECT order_id, array_to_string(f, ',') AS risks, CASE WHEN len(f) >= 3
    THEN 'high' WHEN len(f) <= 1 THEN 'low' ELSE 'medium' END AS risk_level FROM (SELECT order_id, list_filter([CASE WHEN impact_bps >
    1 THEN 'high_market_impact' END, CASE WHEN duration_s > 3600 THEN 'execution_timeout_risk' END, CASE WHEN (slot % 50) / 100 > 0.3
    THEN 'high_volatility' END, CASE WHEN fill_rate < 0.95 THEN 'low_liquidity' END], lambda x: x IS NOT NULL) AS f FROM rolled)""")
def _flags(m):
    o = rolled(m).withColumns({"impact_bps": col("impact_bps") + 14, "volatility": col("slot") % 50 / 100,
                               "liquidity_score": col("fill_rate") - 0.65})
    return tca.execution_risk_flags(o).withColumn("risks", F.array_join("risks", ","))


@query("tca_order_features_asof", "symbol ts order_id size_log:d is_buy:i urgency_code:i", """SELECT b.symbol, b.ts, o.order_id, ln(1 +
    o.order_qty) AS size_log, CAST(o.side = 'buy' AS INT) AS is_buy, CASE o.urgency WHEN 'low' THEN 0 WHEN 'normal' THEN 1 WHEN
    'high' THEN 2 END AS urgency_code FROM bars b ASOF LEFT JOIN parents o ON b.symbol = o.symbol AND b.ts >= o.start_ts""")
def _order_features(m):
    o = m.parents().select("symbol", "order_id", "order_qty", "side", "urgency", "start_ts")
    d = asof_join(m.bars(), o, "symbol", ["order_id", "order_qty", "side", "urgency"], right_ts="start_ts")
    return d.withColumns({"size_log": F.log1p("order_qty"), "is_buy": F.when(col("side") == "buy", 1).when(
        col("side") == "sell", 0), "urgency_code": F.when(col("urgency") == "low", 0).when(col("urgency") == "normal", 1).when(
            col("urgency") == "high", 2)})


@query("tca_execution_features_asof", "symbol ts slip_ma5:d slip_ma20:d slip_sd10:d venue", f"""WITH e AS (SELECT symbol, ts, trade_id,
      venue, {roll('avg', 'slippage_bps', 5).replace('ORDER BY ts', 'ORDER BY ts, trade_id')} AS slip_ma5,
      {roll('avg', 'slippage_bps', 20).replace('ORDER BY ts', 'ORDER BY ts, trade_id')} AS slip_ma20,
      {roll('stddev_samp', 'slippage_bps', 10).replace('ORDER BY ts', 'ORDER BY ts, trade_id')} AS slip_sd10 FROM costed)
    SELECT b.symbol, b.ts, slip_ma5, slip_ma20, slip_sd10, venue FROM bars b ASOF LEFT JOIN e ON b.symbol = e.symbol AND
    b.ts >= e.ts""")
def _execution_features(m):
    d = index_rows(costed(m), "symbol", ["ts", "trade_id"], F.date_trunc("hour", "ts"))
    d = chunk_with_halo(d, 20)
    s = Ordered(["symbol", "_chunk"], "_i")
    d = d.withColumns({"slip_ma5": s.mean("slippage_bps", 5), "slip_ma20": s.mean("slippage_bps", 20),
                       "slip_sd10": s.std("slippage_bps", 10)}).filter("_own")
    cols = ["slip_ma5", "slip_ma20", "slip_sd10", "venue"]
    return asof_join(m.bars(), d.select("symbol", "ts", "trade_id", *cols), "symbol", cols, right_tie=["trade_id"])


SLIPPAGE_FEATURES = ["price_range", "realized_vol", "v_ratio_5", "vol_regime_10", "hour_sin", "hour_cos", "order_qty"]


def slippage_rows(m):
    from ..operators import technical as tech
    f = tech.calendar_features(tech.slippage_features(m.bars()))
    r = rolled(m).select("symbol", "order_id", "slippage_bps", "start_ts", "order_qty").withColumnRenamed("start_ts", "ts")
    return asof_join(r, f, "symbol", SLIPPAGE_FEATURES[:-1])


@query("tca_slippage_model", "n:i mae:d rmse:d")
def _model(m):
    return tca.slippage_model(slippage_rows(m), SLIPPAGE_FEATURES, split_ts="2024-01-24")[2]


@query("tca_slippage_buckets", "risk_bucket n:i")
def _buckets(m):
    pred = tca.slippage_model(slippage_rows(m), SLIPPAGE_FEATURES, split_ts="2024-01-24")[1]
    return pred.groupBy("risk_bucket").agg(F.count(F.lit(1)).alias("n"))


@query("tca_slippage_folds", "fold:i test_rows:i mae:d rmse:d")
def _slippage_folds(m):
    """Folds train half as many trees, as an estimate of the error only needs; a day of embargo."""
    d = cut_lineage(slippage_rows(m))
    return ml.cross_validate(d, tca.slippage_fit(SLIPPAGE_FEATURES, trees=5), "slippage_bps", folds=5, embargo_seconds=86400)


@query("tca_slippage_importance", "feature base_error:d error:d importance:d")
def _slippage_importance(m):
    d = cut_lineage(slippage_rows(m))
    cut = F.lit("2024-01-24").cast("timestamp_ntz")
    model = tca.slippage_fit(SLIPPAGE_FEATURES)(d.filter(col("ts") < cut))
    return ml.permutation_importance(model, d.filter(col("ts") >= cut), SLIPPAGE_FEATURES, "slippage_bps", ["order_id"])
