"""Ledger, account and signal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import col
from ..operators import ledger as lg
from ..operators import machines as mc
from ..operators import signals as sg
from ..operators.timeseries import latest
from . import technical as _technical  # noqa: F401  (defines shared tables)
from .base import add_base, query


def walk(src: str, key: str, order: str) -> str:
    """Row-by-row average-cost ledger."""
    return f"""(WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn,
      CASE side WHEN 'buy' THEN qty ELSE -qty END AS dq FROM {src}),
    w AS (SELECT {key}, 0::BIGINT AS rn, 0.0::DOUBLE AS q, 0.0::DOUBLE AS av, 0.0::DOUBLE AS realized, '' AS event FROM n WHERE rn = 1 UNION ALL
      SELECT {key}, rn, CASE WHEN abs(q + dq) < 1e-8 THEN 0 ELSE q + dq END, CASE WHEN dq = 0 THEN av WHEN q * dq >= 0 THEN
        (q * av + dq * price) / (q + dq) WHEN abs(q + dq) < 1e-8 THEN 0 WHEN abs(dq) < abs(q) THEN av ELSE price END,
        CASE WHEN q * dq >= 0 THEN 0 ELSE (price - av) * least(abs(dq), abs(q)) * sign(q) END,
        CASE WHEN dq = 0 THEN 'none' WHEN q = 0 THEN 'open' WHEN q * dq >= 0 THEN 'increase' WHEN abs(q + dq) < 1e-8 THEN 'close'
        WHEN abs(dq) < abs(q) THEN 'reduce' ELSE 'flip' END
      FROM (SELECT n.{key}, n.rn, n.dq, n.price, w.q, w.av FROM w JOIN n ON n.{key} = w.{key} AND n.rn = w.rn + 1))
    SELECT n.*, w.q AS position, w.av AS avg_price, w.realized, w.event FROM n JOIN w USING ({key}, rn))"""


# Trades with sides changing every trade, so that positions grow, shrink and flip.
add_base("moves_t", """SELECT trade_id, symbol, ts, price, qty, CASE WHEN trade_id % 7 < 4 THEN
    'buy' ELSE 'sell' END AS side, price * qty * 0.001 AS commission FROM trades""")
add_base("ledger_t", "SELECT * FROM " + walk("moves_t", "symbol", "ts, trade_id"))
add_base("ledger_f", "SELECT * FROM " + walk("fills", "symbol", "ts, order_id, line, supp, qty, price, side, commission"))


def trades(m):
    return m.trades().select("trade_id", "symbol", "ts", "price", "qty",
                             F.when(col("trade_id") % 7 < 4, "buy").otherwise("sell").alias("side"),
                             (col("price") * col("qty") * 0.001).alias("commission"))


def ledger(m):
    return lg.build_positions(trades(m), ["ts", "trade_id"], F.date_trunc("hour", "ts"))


@query("ledger_positions_ticks", "trade_id:i position:d avg_price:d realized:d event", "SELECT * FROM ledger_t")
def _ledger(m):
    return ledger(m)


_sum = "symbol{} qty:d avg_price:d8 realized_pnl:d commission:d max_qty:d fills:i"
_sum_sql = """SELECT symbol, arg_max(position, rn) AS qty, arg_max(CASE WHEN position = 0 THEN 0 ELSE avg_price END, rn) AS avg_price,
    sum(realized) AS realized_pnl, sum(commission) AS commission, max(abs(position)) AS max_qty, count(*) AS fills FROM {} GROUP BY 1"""


@query("ledger_position_summary", _sum.format(":i"), _sum_sql.format("ledger_f"))
def _summary(m):
    order = ["ts", "order_id", "line", "supp", "qty", "price", "side", "commission"]
    # a part has a few dozen fills: one block each, cut by its counts where there are many
    return lg.position_summary(lg.build_positions(m.fills(), order, F.lit(0), keep=["commission"]))


@query("ledger_venue_breakdown", "symbol:i venue qty:d fills:i", """SELECT symbol, venue, sum(qty) AS qty, count(*) AS fills FROM fills
    GROUP BY 1, 2""")
def _venues(m):
    return lg.venue_breakdown(m.fills())


add_base("mtm", """SELECT *, max(u) OVER w AS hw, min(u) OVER w AS lw FROM (SELECT b.symbol, b.ts, (b."close" - l.avg_price) * l.position AS u,
    l.position, l.avg_price FROM bars b ASOF JOIN (SELECT * FROM ledger_t) l ON b.symbol = l.symbol AND b.ts >= l.ts) WINDOW w AS
    (PARTITION BY symbol ORDER BY ts)""")


@query("ledger_mark_to_market", "symbol ts position:d unrealized:d4 high_water:d4 low_water:d4 drawdown:d4 run_up:d4", """SELECT *, u AS unrealized,
    hw AS high_water, lw AS low_water, hw - u AS drawdown, u - lw AS run_up FROM mtm""")
def _mtm(m):
    return lg.mark_to_market(ledger(m), m.bars(), ["trade_id"])


add_base("held", """SELECT s.*, c AS price FROM (SELECT symbol, arg_max(position, rn) AS qty, arg_max(avg_price, rn) AS avg_price, sum(realized)
    AS realized_pnl FROM ledger_t GROUP BY 1) s JOIN (SELECT symbol, arg_max("close", ts) AS c FROM bars GROUP BY 1) USING (symbol)""")


def held(m):
    last = m.bars().groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    return lg.position_summary(ledger(m)).join(last, "symbol")


@query("ledger_portfolio_summary", "open:i long:i short:i gross:d net:d unrealized:d realized:d win_rate:d best:d worst:d", """SELECT
    count(*) FILTER (qty <> 0) AS open, count(*) FILTER (qty > 0) AS long, count(*) FILTER (qty < 0) AS short, sum(abs(qty * price)) AS gross,
    sum(qty * price) AS net, sum(u) AS unrealized, sum(realized_pnl) AS realized, count(*) FILTER (u + realized_pnl > 0) / count(*) AS
    win_rate, max(u + realized_pnl) AS best, min(u + realized_pnl) AS worst FROM (SELECT *, (price - avg_price) * qty AS u FROM held)""")
def _psum(m):
    return lg.portfolio_summary(held(m))


@query("ledger_concentration", "symbol share:d", "SELECT symbol, abs(qty * price) / sum(abs(qty * price)) OVER () AS share FROM held")
def _conc(m):
    return lg.concentration(held(m))


@query("ledger_position_risk_flags", "symbol ts flags", """SELECT symbol, ts, 'drawdown' AS flags FROM mtm WHERE hw - u > 0.05 *
    abs(avg_price * position)""")
def _flags(m):
    d = lg.mark_to_market(ledger(m), m.bars(), ["trade_id"])
    d = d.select("symbol", "ts", col("position").alias("qty"), "avg_price", col("close").alias("price"), "drawdown")
    return lg.position_risk_flags(d).withColumn("flags", F.array_join("flags", ","))


@query("orders_state", "order_id filled:d remaining:d avg_price:d state", """SELECT order_id, f AS filled, greatest(order_qty - f, 0) AS
    remaining, avg_price, CASE WHEN f >= order_qty - 1e-9 THEN 'filled' WHEN f > 0 THEN 'partially_filled' ELSE 'submitted' END AS state FROM
    (SELECT p.*, coalesce(fl, 0) AS f, avg_price FROM parents p LEFT JOIN (SELECT order_id, sum(qty) AS fl, sum(qty * price) /
    nullif(sum(qty), 0) AS avg_price FROM trades WHERE slot % 7 > 0 GROUP BY 1) USING (order_id))""")
def _state(m):
    return lg.order_state(m.parents(), m.trades().filter("slot % 7 > 0"))


@query("orders_stale", "order_id:i issue", """SELECT order_id, CASE WHEN ts < TIMESTAMP '2001-07-30' - INTERVAL 1440 MINUTE THEN 'expired' ELSE
    'stale' END AS issue FROM ords WHERE status IN ('open', 'partial') AND ts < TIMESTAMP '2001-07-30' - INTERVAL 30 MINUTE""")
def _stale(m):
    return lg.stale_orders(m.orders(), "2001-07-30")


@query("orders_validate", "order_id:i reasons valid:b", """SELECT order_id, array_to_string(r, ',') AS reasons, len(r) = 0 AS valid FROM (SELECT
    order_id, list_filter([CASE WHEN qty <= 0 THEN 'quantity' END, CASE WHEN k = 0 AND lim IS NULL THEN 'limit_price' END, CASE WHEN k = 1
    THEN 'stop_price' END, CASE WHEN n > 10 THEN 'symbol_orders' END, CASE WHEN m > 14000 THEN 'total_orders' END, CASE WHEN qty * coalesce(lim, 100) > 100000 THEN 'value' END], lambda x:
    x IS NOT NULL) AS r FROM (SELECT order_id, order_id % 50 - 5 AS qty, order_id % 3 AS k, CASE WHEN order_id % 4 > 0 THEN value / 20 END
    AS lim, row_number() OVER (PARTITION BY account ORDER BY order_id) AS n, row_number() OVER (ORDER BY order_id) AS m FROM ords))""")
def _validate(m):
    k = col("order_id") % 3
    o = m.orders().select("order_id", col("account").alias("symbol"), (col("order_id") % 50 - 5).alias("qty"), F.when(
        k == 0, "limit").when(k == 1, "stop").otherwise("market").alias("order_type"), F.when(
            col("order_id") % 4 > 0, col("value") / 20).alias("limit_price"), F.lit(None).cast("double").alias("stop_price"))
    return lg.validate_orders(o, max_total=14000).withColumn("reasons", F.array_join("reasons", ","))


# ------------------------------------------------------------------ accounts

_aw = "PARTITION BY account ORDER BY ts, snap"
_at = "epoch_us(ts) * 1000000::HUGEINT + snap"


@query("account_metrics", "account:i equity:d margin_use:d net_liquidity:d total_return:d volatility:d sharpe:d max_drawdown:d", f"""SELECT *,
    margin_used / equity AS margin_use, equity - margin_used AS net_liquidity, equity / e0 - 1 AS total_return, mu / nullif(volatility, 0) AS
    sharpe FROM (SELECT account, arg_max(equity, k) AS equity, arg_max(margin_used, k) AS margin_used, arg_min(equity, k) AS e0,
    stddev_samp(r) * sqrt(252) AS volatility, avg(r) * 252 AS mu, min(equity / pk - 1) AS max_drawdown FROM (SELECT *, {_at} AS k, equity /
    lag(equity) OVER w - 1 AS r, max(equity) OVER w AS pk FROM accounts WINDOW w AS ({_aw})) GROUP BY 1)""")
def _metrics(m):
    return lg.account_metrics(m.accounts())


@query("account_history", "account:i start_equity:d end_equity:d min_equity:d max_equity:d avg_equity:d cv:d snapshots:i", f"""SELECT account,
    arg_min(equity, {_at}) AS start_equity, arg_max(equity, {_at}) AS end_equity, min(equity) AS min_equity, max(equity) AS max_equity,
    avg(equity) AS avg_equity, stddev_samp(equity) / avg(equity) AS cv, count(*) AS snapshots FROM accounts WHERE ts > TIMESTAMP '2000-01-01'
    - INTERVAL 730 DAY AND ts <= TIMESTAMP '2000-01-01' GROUP BY 1""")
def _history(m):
    return lg.account_history(m.accounts(), "2000-01-01", 730)


add_base("pnl", """SELECT a.*, b.equity AS prev_equity, (a.equity - b.equity) / b.equity * 100 AS pnl_pct, a.equity - b.equity AS pnl FROM
    accounts a LEFT JOIN accounts b ON b.snap = (SELECT c.snap FROM accounts c WHERE c.account = a.account AND c.ts <= a.ts - INTERVAL 24 HOUR
    ORDER BY c.ts DESC, c.snap DESC LIMIT 1) AND b.account = a.account""")


@query("account_daily_pnl", "account:i snap:i prev_equity:d pnl:d pnl_pct:d", "SELECT * FROM pnl")
def _pnl(m):
    return lg.daily_pnl(m.accounts())


def alerts(m):
    a = m.accounts()
    p = lg.daily_pnl(a).select("account", "snap", "pnl_pct")
    return lg.account_alerts(a.join(p, ["account", "snap"]))


add_base("acct_alerts", """SELECT account, snap, ts, 'low_buying_power' AS alert, 'warning' AS level, buying_power AS value FROM pnl WHERE
      buying_power < 1000 UNION ALL
    SELECT account, snap, ts, 'high_margin_utilization', 'critical', margin_used FROM pnl WHERE margin_used / equity > 0.8 UNION ALL
    SELECT account, snap, ts, 'maintenance_margin_call', 'emergency', equity FROM pnl WHERE equity < margin_used * 1.25 UNION ALL
    SELECT account, snap, ts, 'pattern_day_trader_violation', 'critical', equity FROM pnl WHERE day_trades >= 3 AND equity < 25000 UNION ALL
    SELECT account, snap, ts, 'daily_loss_threshold', 'warning', pnl_pct FROM pnl WHERE pnl_pct < -5""")


@query("account_alerts", "account:i snap:i alert level value:d", "SELECT * FROM acct_alerts")
def _alerts(m):
    return alerts(m)


@query("account_alert_cooldown", "symbol event_id:i ts", """WITH RECURSIVE c AS (SELECT symbol, ts, event_id, row_number() OVER (PARTITION BY
    symbol ORDER BY ts, event_id) AS rn FROM ticks WHERE qty > 60), w AS (SELECT symbol, rn, ts, event_id, ts AS last_ts, true AS emitted FROM c
    WHERE rn = 1 UNION ALL SELECT c.symbol, c.rn, c.ts, c.event_id, CASE WHEN c.ts - w.last_ts >= INTERVAL 60 MINUTE THEN c.ts
    ELSE w.last_ts END, c.ts - w.last_ts >= INTERVAL 60 MINUTE FROM w JOIN c ON c.symbol = w.symbol AND c.rn = w.rn + 1) SELECT * FROM w WHERE emitted""")
def _cooldown(m):
    a = m.ticks().filter("qty > 60").select("symbol", "ts", "event_id")
    return mc.alert_cooldown(a, ["symbol"], 60, ["event_id"])


# ------------------------------------------------------------------ signals

def predictions(m):
    s = m.sentiment()
    return s.select("event_id", "symbol", "ts", (col("score") * 1.2).alias("prediction"), "confidence", "score", "mentions", "source")


@query("signals_make", "event_id:i side strength:d", """SELECT event_id, CASE WHEN score > 0 THEN 'BUY' WHEN score < 0 THEN 'SELL' ELSE 'HOLD'
    END AS side, least(abs(score * 1.2), 1) AS strength FROM sent""")
def _make(m):
    return sg.make_signals(predictions(m))


GATE_AT = "2024-01-20 12:00:00"
add_base("gate_in", f"""SELECT event_id, symbol, ts, least(abs(score * 1.2), 1) AS strength, confidence, event_id % 3 > 0 AS tech, CASE WHEN
    event_id % 5 > 0 THEN score END AS ss, event_id % 3 = 1 AS two, source IN ('reddit', 'news') AS good_src FROM sent WHERE ts BETWEEN
    TIMESTAMP '{GATE_AT}' - INTERVAL 600 MINUTE AND TIMESTAMP '{GATE_AT}' AND symbol <> 'ERROR'""")
_modes = {
    "adaptive": ("strength >= 0.6", "CASE WHEN tech AND ss IS NOT NULL THEN least(1, confidence + 0.1) ELSE confidence END"),
    "technical_only": ("two", "confidence"), "sentiment_only": ("abs(ss) >= 0.7 AND good_src", "confidence"),
    "conservative": ("confidence >= 0.8 AND tech AND ss IS NOT NULL", "confidence"),
}
for _mode, (_cond, _conf) in _modes.items():
    @query(f"signals_gate_{_mode}", "event_id:i confidence:d slot:i", f"""SELECT * FROM (SELECT event_id, {_conf} AS confidence, row_number()
        OVER (ORDER BY {_conf} DESC, symbol, ts) AS slot FROM gate_in WHERE {_cond}) WHERE slot <= 9""")
    def _gate(m, mode=_mode):
        e = col("event_id") % 3
        ind = F.when(e == 1, F.array(F.lit("RSI_14"), F.lit("macd_hist"))).when(e == 2, F.array(F.lit("bollinger_pos"))).otherwise(
            F.expr("cast(array() AS array<string>)"))
        s = sg.make_signals(predictions(m)).withColumns({
            "indicators": ind, "sentiment_score": F.when(col("event_id") % 5 > 0, col("score")), "sources": F.array("source")})
        p = m.ticks().filter("symbol = 'ERROR'").select("symbol").distinct()
        return sg.gate_signals(s, p, mode, GATE_AT, max_positions=10, max_age_min=600)


@query("signals_sentiment", "event_id:i side", """SELECT event_id, CASE WHEN score > 0 THEN 'BUY' ELSE 'SELL' END AS side FROM sent WHERE
    abs(score) >= 0.7 AND confidence >= 0.6 AND mentions >= 50""")
def _sent(m):
    return sg.sentiment_signals(m.sentiment())


@query("signals_size_orders", "event_id:i qty:i", "SELECT event_id, floor(20000.0 * 0.02 / price) AS qty FROM ticks")
def _size(m):
    return sg.size_orders(m.ticks().select("event_id", F.lit(20000.0).alias("equity"), col("price").alias("mid")))


@query("signals_time_exit", "trade_id:i", "SELECT trade_id FROM trades WHERE ts < TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR")
def _exit(m):
    return sg.time_exit(m.trades().withColumnRenamed("ts", "entry_ts"), "2024-01-20")


def sweep(m):
    t = m.raw("region").select(col("r_regionkey").cast("long").alias("param_id"))
    k = col("param_id")
    return t.select("param_id", (0.02 + k * 0.003).alias("enter"), (0.02 + k * 0.002).alias("target"), (0.01 + k * 0.002).alias("stop"))


add_base("rule_walk", """WITH RECURSIVE b AS (SELECT n.symbol, n.ts, rn, "close" AS c, "close" / max("close") OVER (PARTITION BY symbol ORDER BY ts
      ROWS 19 PRECEDING) - 1 AS dip FROM numbered n), p AS (SELECT r_regionkey AS param_id, 0.02 + r_regionkey * 0.003 AS enter, 0.02 +
      r_regionkey * 0.002 AS target, 0.01 + r_regionkey * 0.002 AS stp FROM region),
    w AS (SELECT symbol, param_id, 0::BIGINT AS rn, NULL::TIMESTAMP AS ts, NULL::DOUBLE AS c, 10000.0::DOUBLE AS cash, 0::BIGINT AS held,
      0.0::DOUBLE AS entry, NULL::VARCHAR AS action, 0::BIGINT AS shares FROM (SELECT DISTINCT symbol FROM b), p UNION ALL
      SELECT symbol, param_id, rn, ts, c, CASE WHEN buy THEN cash - n * c WHEN sell THEN cash + held * c ELSE cash END, CASE WHEN buy THEN n
        WHEN sell THEN 0 ELSE held END, CASE WHEN buy THEN c WHEN sell THEN 0 ELSE entry END, CASE WHEN buy THEN 'buy' WHEN sell THEN 'sell'
        END, CASE WHEN buy THEN n ELSE held END FROM (SELECT *, held = 0 AND dip <= -enter AND n > 0 AS buy, held > 0 AND (c / entry - 1 >=
        target OR c / entry - 1 <= -stp) AS sell FROM (SELECT b.symbol, w.param_id, b.rn, b.ts, b.c, b.dip, w.cash, w.held, w.entry, enter,
        target, stp, CAST(floor(w.cash * 0.95 / b.c) AS BIGINT) AS n FROM w JOIN p USING (param_id) JOIN b ON b.symbol = w.symbol AND b.rn =
        w.rn + 1)))
    SELECT symbol, param_id, ts, c, cash, action, shares FROM w WHERE action IS NOT NULL""")


@query("rule_trades", "symbol param_id:i ts action shares:i cash:d", "SELECT * FROM rule_walk")
def _rules(m):
    return mc.rule_trades(m.bars(), sweep(m))


@query("rule_trade_stats", "symbol param_id:i trades:i win_rate:d mean_return:d final_value:d total_return:d", """SELECT x.symbol, x.param_id,
    count(*) AS trades, count(*) FILTER (x.c > b.c) / count(*) AS win_rate, avg(x.c / b.c - 1) AS mean_return, arg_max(x.cash, x.ts) AS
    final_value, arg_max(x.cash, x.ts) / 10000 - 1 AS total_return FROM (SELECT *, row_number() OVER (PARTITION BY symbol, param_id ORDER BY ts)
    AS k FROM rule_walk WHERE action = 'sell') x JOIN (SELECT *, row_number() OVER (PARTITION BY symbol, param_id ORDER BY ts) AS k FROM
    rule_walk WHERE action = 'buy') b USING (symbol, param_id, k) GROUP BY 1, 2""")
def _rule_stats(m):
    return sg.trade_stats(mc.rule_trades(m.bars(), sweep(m)))


@query("signals_fixed_risk_size", "event_id:i shares:i position_value:d reward_risk:d", """SELECT event_id, shares, shares * price AS
    position_value, abs(price * 0.08) / abs(price * d) AS reward_risk FROM (SELECT event_id, price, d, floor(200.0 / abs(price - price * (1 - d)))
    AS shares FROM (SELECT *, 0.0313 + qty / 1000 AS d FROM ticks))""")
def _fixed(m):
    d = 0.0313 + col("qty") / 1000
    return sg.fixed_risk_size(m.ticks().select("event_id", col("price").alias("entry"), (col("price") * (1 - d)).alias("stop"),
                                               (col("price") * 1.08).alias("target")))
