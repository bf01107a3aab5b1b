"""Positions, orders and account analytics from fills and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import div
from ..session import cut_lineage
from .timeseries import Ordered, affine_scan, asof_join, index_rows, join_on


def reconcile(ledger: DataFrame, broker: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Quantities that differ between two books; absent means zero."""
    a = ledger.select("symbol", F.col("qty").alias("ledger"))
    b = broker.select("symbol", F.col("qty").alias("broker"))
    j = a.join(b, "symbol", "full_outer").fillna(0.0, ["ledger", "broker"])
    return j.filter(F.abs(F.col("ledger") - F.col("broker")) > tol)


# ------------------------------------------------------------------ positions

def build_positions(fills: DataFrame, order: list[str], block, key: str = "symbol", keep: list[str] | None = None) -> DataFrame:
    """Average-cost ledger, one row per fill with the position after it.

    The quantity path is a running sum, so it is known before the cost path; given it, the signed cost basis is an
    affine recurrence (add: +price*dq, reduce: scaled by q/q_prev, close: 0, flip: restart at the fill price).  Both are
    scanned in chunks, so a symbol with a third of all fills is spread over many tasks.  A fill of quantity zero leaves
    the position alone (event ``none``).  Where ``keep`` is given, only the key, the results and these columns of the
    fills are carried on once the rows are in order.
    """
    d = index_rows(fills.withColumn("dq", F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))),
                   key, order, block, totals={"_q": "dq"}, size="_n")
    if keep is not None:
        d = d.select(*dict.fromkeys([key, "_i", "_n", "_q", "dq", "price", *keep]))

    def whole(q):
        return F.when(F.abs(q) < 1e-8, 0.0).otherwise(q)

    # what follows from the path of quantities is computed where it is used, not shuffled
    position, qp = whole(F.col("_q")), whole(F.col("_q") - F.col("dq"))
    same = qp * F.col("dq") >= 0
    reduce_ = ~same & (F.abs("dq") < F.abs(qp) - 1e-8)
    flip = ~same & (F.abs("dq") > F.abs(qp) + 1e-8)
    a = F.when(qp == 0, 0.0).when(same, 1.0).when(reduce_, position / F.nullif(qp, F.lit(0.0))).otherwise(0.0)
    b = F.when(same, F.col("price") * F.col("dq")).when(flip, F.col("price") * position).otherwise(0.0)
    d = affine_scan(cut_lineage(d), key, a, b, "cost_basis", "_cp", size="_n").withColumns({"position": position, "_qp": qp})
    avg_prev = div("_cp", "_qp")
    closed = F.when(~same, F.least(F.abs("dq"), F.abs("_qp"))).otherwise(0.0)
    return d.withColumns({
        "avg_price": F.coalesce(div("cost_basis", "position"), F.lit(0.0)),
        "realized": F.when(closed > 0, (F.col("price") - avg_prev) * closed * F.signum("_qp")).otherwise(0.0),
        "event": F.when(F.col("dq") == 0, "none").when(F.col("_qp") == 0, "open").when(same, "increase").when(reduce_, "reduce").when(flip, "flip")
        .otherwise("close")}).drop("_n", "_q", "_qp", "_cp")


def position_summary(ledger: DataFrame, key: str = "symbol") -> DataFrame:
    last = F.struct("position", "avg_price")
    g = ledger.groupBy(key).agg(F.max_by(last, "_i").alias("_l"), F.sum("realized").alias("realized_pnl"),
                                F.sum("commission").alias("commission"), F.max(F.abs("position")).alias("max_qty"),
                                F.count(F.lit(1)).alias("fills"))
    return g.select(key, F.col("_l.position").alias("qty"), F.col("_l.avg_price").alias("avg_price"), "realized_pnl",
                    "commission", "max_qty", "fills")


def venue_breakdown(fills: DataFrame) -> DataFrame:
    return fills.groupBy("symbol", "venue").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("fills"))


def mark_to_market(ledger: DataFrame, bars: DataFrame, tie: list[str]) -> DataFrame:
    """Position as of each bar, its P&L, and the running high and low water since the first bar."""
    cols = ["position", "avg_price"]
    ledger = cut_lineage(ledger.select("symbol", "ts", *tie, *cols))  # the join reads its sides more than once
    d = asof_join(bars.select("symbol", "ts", "close"), ledger, "symbol", cols, right_tie=tie).filter("position IS NOT NULL")
    s = Ordered()
    d = d.withColumn("unrealized", (F.col("close") - F.col("avg_price")) * F.col("position"))
    d = d.withColumns({"unrealized_pct": div("unrealized", F.abs(F.col("avg_price") * F.col("position"))) * 100,
                       "high_water": F.max("unrealized").over(s.running), "low_water": F.min("unrealized").over(s.running)})
    return d.withColumns({"drawdown": F.col("high_water") - F.col("unrealized"),
                          "run_up": F.col("unrealized") - F.col("low_water")})


def portfolio_summary(p: DataFrame) -> DataFrame:
    """Positions with qty, avg_price, price, realized_pnl."""
    d = p.withColumns({"_n": F.col("qty") * F.col("price"), "_u": (F.col("price") - F.col("avg_price")) * F.col("qty")})
    d = d.withColumn("_t", F.col("_u") + F.col("realized_pnl"))
    return d.agg(F.count_if(F.col("qty") != 0).alias("open"), F.count_if(F.col("qty") > 0).alias("long"),
                 F.count_if(F.col("qty") < 0).alias("short"), F.sum(F.abs("_n")).alias("gross"), F.sum("_n").alias("net"),
                 F.sum("_u").alias("unrealized"), F.sum("realized_pnl").alias("realized"),
                 (F.count_if(F.col("_t") > 0) / F.count(F.lit(1))).alias("win_rate"), F.max("_t").alias("best"),
                 F.min("_t").alias("worst"))


def concentration(p: DataFrame) -> DataFrame:
    """Share of gross notional per symbol, through one scalar total."""
    d = p.withColumn("_n", F.abs(F.col("qty") * F.col("price")))
    total = d.agg(F.sum("_n")).scalar()
    return d.withColumn("share", div("_n", total)).drop("_n")


def position_risk_flags(p: DataFrame) -> DataFrame:
    d = p.withColumn("loss_pct", div((F.col("price") - F.col("avg_price")) * F.signum("qty"), "avg_price"))
    flags = F.array_compact(F.array(F.when(F.col("loss_pct") < -0.10, F.lit("large_loss")),
                                    F.when(F.col("drawdown") > 0.05 * F.abs(F.col("avg_price") * F.col("qty")), F.lit("drawdown"))))
    return d.withColumn("flags", flags).filter(F.size("flags") > 0)


# ------------------------------------------------------------------ orders

def order_state(orders: DataFrame, fills: DataFrame) -> DataFrame:
    f = fills.groupBy("order_id").agg(F.sum("qty").alias("filled"), div(F.sum(F.col("qty") * F.col("price")), F.sum("qty")).alias(
        "avg_price"))
    d = orders.join(f, "order_id", "left").withColumn("filled", F.coalesce("filled", F.lit(0.0)))
    return d.withColumns({"remaining": F.greatest(F.col("order_qty") - F.col("filled"), F.lit(0.0)),
                          "state": F.when(F.col("filled") >= F.col("order_qty") - 1e-9, "filled").when(
                              F.col("filled") > 0, "partially_filled").otherwise("submitted")})


def stale_orders(orders: DataFrame, as_of, stale_minutes: int = 30, timeout_minutes: int = 1440) -> DataFrame:
    at = F.lit(as_of).cast("timestamp_ntz")
    d = orders.filter(F.col("status").isin("open", "partial"))
    return d.withColumn("issue", F.when(F.col("ts") < at - F.expr(f"interval {timeout_minutes} minutes"), "expired").when(
        F.col("ts") < at - F.expr(f"interval {stale_minutes} minutes"), "stale")).filter("issue IS NOT NULL")


def validate_orders(orders: DataFrame, max_per_symbol: int = 10, max_value: float = 100000.0, max_total: int | None = None,
                    order: str = "order_id") -> DataFrame:
    """Rejection reasons per order; only orders past a limit, in the order of ``order``, break it.

    The limits become thresholds: the last admitted order of each symbol and of all, found by top-k steps that reduce
    map-side, so a busy symbol is not sorted in one task.
    """
    w = Window.partitionBy("symbol").orderBy(order)
    last = orders.select("symbol", order).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_per_symbol).groupBy(
        "symbol").agg(F.max(order).alias("_last"), F.count(F.lit(1)).alias("_n"))
    d = join_on(orders, last, "symbol", "left")
    total = F.lit(None)
    if max_total is not None:
        edge = orders.select(order).orderBy(order).limit(max_total).agg(F.max(order).alias("edge")).scalar()
        total = F.when(F.col(order) > edge, F.lit("total_orders"))
    price = F.coalesce("limit_price", F.lit(100.0))
    why = F.array_compact(F.array(
        F.when(F.col("qty") <= 0, F.lit("quantity")),
        F.when(F.col("order_type").isin("limit", "stop_limit") & F.col("limit_price").isNull(), F.lit("limit_price")),
        F.when(F.col("order_type").isin("stop", "stop_limit") & F.col("stop_price").isNull(), F.lit("stop_price")),
        F.when((F.col("_n") >= max_per_symbol) & (F.col(order) > F.col("_last")), F.lit("symbol_orders")), total.cast("string"), F.when(F.col("qty") * price > max_value, F.lit("value"))))
    return d.withColumn("reasons", why).withColumn("valid", F.size("reasons") == 0).drop("_n", "_last")


# ------------------------------------------------------------------ accounts

A = Ordered("account", ["ts", "snap"])


def account_metrics(snaps: DataFrame) -> DataFrame:
    """Snapshots of one account are bounded by its snapshot interval times the time span."""
    d = snaps.withColumns({"_r": F.col("equity") / F.nullif(A.lag("equity"), F.lit(0.0)) - 1, "_pk": F.max("equity").over(A.running)})
    at = F.struct("ts", "snap")
    g = d.groupBy("account").agg(
        F.max_by("equity", at).alias("equity"), F.max_by("margin_used", at).alias("margin_used"), F.min_by("equity", at).alias("_e0"),
        (F.stddev_samp("_r") * F.sqrt(F.lit(252))).alias("volatility"), (F.avg("_r") * 252).alias("_mu"),
        F.min(F.col("equity") / F.nullif("_pk", F.lit(0.0)) - 1).alias("max_drawdown"))
    return g.withColumns({"net_liquidity": F.col("equity") - F.col("margin_used"), "margin_use": div("margin_used", "equity"),
                          "total_return": div("equity", "_e0") - 1, "sharpe": div("_mu", "volatility")}).drop("_e0", "_mu")


def account_history(snaps: DataFrame, as_of, days: int) -> DataFrame:
    d = snaps.filter((F.col("ts") > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days"))
                     & (F.col("ts") <= F.lit(as_of).cast("timestamp_ntz")))
    at = F.struct("ts", "snap")
    e = "equity"
    return d.groupBy("account").agg(
        F.min_by(e, at).alias("start_equity"), F.max_by(e, at).alias("end_equity"), F.min(e).alias("min_equity"),
        F.max(e).alias("max_equity"), F.avg(e).alias("avg_equity"), div(F.stddev_samp(e), F.avg(e)).alias("cv"),
        F.count(F.lit(1)).alias("snapshots"))


def daily_pnl(snaps: DataFrame, hours: int = 24) -> DataFrame:
    """Each snapshot against the newest one at least 24 hours older: a backward as-of join with itself."""
    left = snaps.select("account", "snap", "equity", "ts", (F.col("ts") - F.expr(f"interval {hours} hours")).alias("_at"))
    right = snaps.select("account", F.col("ts").alias("rts"), F.col("snap").alias("rsnap"), F.col("equity").alias("prev_equity"))
    d = asof_join(left, right, "account", ["prev_equity"], "_at", "rts", ["rsnap"], block="year")
    return d.withColumns({"pnl": F.col("equity") - F.col("prev_equity"),
                          "pnl_pct": div(F.col("equity") - F.col("prev_equity"), "prev_equity") * 100})


def account_alerts(d: DataFrame, maintenance: float = 0.25) -> DataFrame:
    """Snapshots with buying_power, margin_used, equity, day_trades, pnl_pct to one row per alert."""
    def alert(cond, kind, level, value):
        return F.when(cond, F.struct(F.lit(kind).alias("alert"), F.lit(level).alias("level"), F.col(value).alias("value")))
    use = div("margin_used", "equity")
    rules = F.array_compact(F.array(
        alert(F.col("buying_power") < 1000, "low_buying_power", "warning", "buying_power"),
        alert(use > 0.8, "high_margin_utilization", "critical", "margin_used"),
        alert(F.col("equity") < 0, "negative_net_liquidity", "emergency", "equity"),
        alert(F.col("equity") < F.col("margin_used") * (1 + maintenance), "maintenance_margin_call", "emergency", "equity"),
        alert((F.col("day_trades") >= 3) & (F.col("equity") < 25000), "pattern_day_trader_violation", "critical", "equity"),
        alert(F.col("pnl_pct") < -5, "daily_loss_threshold", "warning", "pnl_pct")))
    return d.select("account", "snap", "ts", F.inline(rules))
