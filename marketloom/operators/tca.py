"""Transaction-cost analysis: trades and parent orders to costs, venue and algorithm marts, alerts, strategy choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, col, div
from .mldata import fit_stages
from .timeseries import exact_percentiles, interval_join, join_on


def seconds(a, b) -> Column:
    return (F.unix_micros(col(a).cast("timestamp")) - F.unix_micros(col(b).cast("timestamp"))) / 1e6


def implementation_shortfall(price, arrival, side="side") -> Column:
    sign = F.when(col(side) == "buy", 1.0).otherwise(-1.0)
    return sign * div(col(price) - col(arrival), arrival) * 10000


def trade_costs(trades: DataFrame, parents: DataFrame, minute_bars: DataFrame) -> DataFrame:
    """Impact from the bars two minutes around each trade, timing by age of the order, half spread."""
    t = trades.join(parents.select("order_id", "start_ts", "arrival_price"), "order_id")
    two = F.expr("interval 2 minutes")
    span = t.select("trade_id", "symbol", (col("ts") - two).alias("lo"), (col("ts") + two).alias("hi"))
    bars = minute_bars.select("symbol", col("ts").alias("bar_ts"), "close", "volume")
    w = interval_join(bars, span, "symbol", "bar_ts", "lo", "hi", 240).groupBy("trade_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("close", "bar_ts").alias("_c0"), F.max_by("close", "bar_ts").alias("_c1"),
        F.sum("volume").alias("_v"))
    d = t.join(w, "trade_id", "left")
    part = F.coalesce(div("qty", "_v"), F.lit(0.0))
    move = F.abs(div(col("_c1") - col("_c0"), "_c0"))
    impact = F.when(col("_n").isNull(), 5 * F.least(col("qty") / 10000, F.lit(0.1))).when(col("_n") < 2, 2.0).otherwise(
        clip(move * F.least(2 * part, F.lit(0.8)) * 10000, 0, 20))
    age = seconds("ts", "start_ts")
    timing = F.when(age <= 60, 0.5).when(age <= 300, 1.5).when(age <= 900, 3.0).otherwise(5.0)
    return d.select(*trades.columns, "arrival_price", impact.alias("impact_bps"), timing.alias("timing_bps"),
                    F.lit(2.0).alias("spread_bps"), implementation_shortfall("price", "arrival_price").alias("slippage_bps"))


def order_rollup(costed: DataFrame, parents: DataFrame) -> DataFrame:
    q = F.sum("qty")
    def qw(c):
        return div(F.sum(col(c) * col("qty")), q)
    g = costed.groupBy("order_id").agg(
        q.alias("filled"), qw("price").alias("avg_price"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("fills"), qw("impact_bps").alias("impact_bps"), qw("timing_bps").alias("timing_bps"),
        qw("spread_bps").alias("spread_bps"))
    d = parents.join(g, "order_id")
    return d.withColumns({"fill_rate": div("filled", "order_qty"), "duration_s": seconds("last_ts", "first_ts"),
                          "slippage_bps": implementation_shortfall("avg_price", "arrival_price")})


def benchmarks(parents: DataFrame, bars: DataFrame) -> DataFrame:
    """Interval VWAP, TWAP and close from the bars inside [start, end] of each order."""
    b = bars.select("symbol", col("ts").alias("bar_ts"), "close", "volume")
    hit = interval_join(b, parents, "symbol", "bar_ts", "start_ts", "end_ts", 21600)
    return hit.groupBy("order_id").agg(div(F.sum(col("close") * col("volume")), F.sum("volume")).alias("bench_vwap"),
                                       F.avg("close").alias("bench_twap"), F.max_by("close", "bar_ts").alias("bench_close"))


def execution_shortfall(rolled: DataFrame, bench: DataFrame, which: str = "vwap") -> DataFrame:
    d = rolled.join(bench, "order_id", "left")
    ref = F.coalesce(f"bench_{which}", "arrival_price") if which != "arrival" else col("arrival_price")
    return d.withColumn("_ref", ref).withColumn("shortfall_bps", implementation_shortfall("avg_price", "_ref")).drop("_ref")


def venue_stats(ex: DataFrame, min_n: int = 10, as_of=None, hours: float = 24) -> DataFrame:
    """ex (venue, slippage_bps, impact_bps, fill_rate, duration_s; ts with ``as_of``: the last ``hours`` up to it count).  Four venues share all rows: percentiles are exact
    through value cells, the rest are partial aggregates."""
    if as_of is not None:
        now = F.lit(as_of).cast("timestamp_ntz")
        ex = ex.filter((col("ts") > now - F.expr(f"interval {round(hours * 3600)} seconds")) & (col("ts") <= now))
    g = ex.groupBy("venue").agg(
        F.count(F.lit(1)).alias("n"), F.avg("slippage_bps").alias("avg_slippage"), F.stddev_pop("slippage_bps").alias(
            "sd_slippage"), F.avg("impact_bps").alias("avg_impact"), F.avg("fill_rate").alias("avg_fill"),
        F.avg("duration_s").alias("avg_seconds"), (F.count_if(col("fill_rate") > 0.95) / F.count(F.lit(1))).alias("success"))
    g = join_on(g.filter(col("n") >= min_n), exact_percentiles(ex, "venue", "slippage_bps", {
        "p25": 0.25, "median": 0.5, "p75": 0.75}), "venue", "left")
    comp = (F.coalesce(div(F.lit(1.0), 1 + col("avg_slippage") / 10), F.lit(0.0)) + col("avg_fill")
            + 1 / (1 + col("avg_seconds") / 60)) / 3
    g = g.withColumn("composite", comp)
    return g.withColumn("rank", F.rank().over(Window.partitionBy(F.lit(1)).orderBy(col("composite").desc())))


URGENCY = {"high": (0.2, 0.5, 0.3), "normal": (0.4, 0.4, 0.2), "low": (0.6, 0.3, 0.1)}


def venue_recommend(stats: DataFrame, urgency: str = "normal", top: int = 3) -> DataFrame:
    a, b, c = URGENCY[urgency]
    s = (a * F.coalesce(div(F.lit(1.0), 1 + col("avg_slippage") / 10), F.lit(0.0)) + b * col("avg_fill")
         + c / (1 + col("avg_seconds") / 60))
    return stats.withColumn("urgency_score", s).orderBy(col("urgency_score").desc(), "venue").limit(top)


def _newest(orders: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("algorithm").orderBy(col("start_ts").desc(), "order_id")
    return orders.withColumn("_k", F.row_number().over(w)).filter(col("_k") <= n)


def algorithm_eval(orders: DataFrame, last: int = 50, min_n: int = 20) -> DataFrame:
    d = _newest(orders, last)
    g = d.groupBy("algorithm").agg(
        F.count(F.lit(1)).alias("n"), F.avg("slippage_bps").alias("slippage"), F.avg("fill_rate").alias("fill"),
        F.avg("duration_s").alias("secs"), F.avg("impact_bps").alias("impact"), F.avg("timing_bps").alias("timing"))
    g = g.filter(col("n") >= min_n)
    quality = (0.4 * col("fill") + 0.4 * F.greatest(F.lit(0.0), 1 - F.abs("slippage") / 50)
               + 0.2 * F.greatest(F.lit(0.0), 1 - col("secs") / 1800))
    return g.withColumns({"quality": quality, "impact_share": div("impact", "slippage"), "timing_share": div("timing", "slippage"),
                          "residual": col("slippage") - col("impact") - col("timing")})


def algorithm_trend(orders: DataFrame, last: int = 100) -> DataFrame:
    d = _newest(orders, last)
    x = -col("_k").cast("double")
    g = d.groupBy("algorithm").agg(
        F.regr_slope("slippage_bps", x).alias("slip_slope"), F.regr_slope("fill_rate", x).alias("fill_slope"),
        (F.avg(F.when(col("_k") <= 20, col("slippage_bps"))) - F.avg(F.when(col("_k").between(21, 40), col("slippage_bps"))))
        .alias("recent_change"), F.count(F.lit(1)).alias("n")).filter(col("n") >= 40)
    return g.withColumn("direction", F.when(col("slip_slope") < -0.1, "improving").when(
        col("slip_slope") > 0.1, "deteriorating").otherwise("stable"))


def compare_algorithms(evaluated: DataFrame) -> DataFrame:
    """A handful of rows, one per algorithm."""
    return evaluated.withColumn("rank", F.rank().over(Window.partitionBy(F.lit(1)).orderBy(col("quality").desc())))


def tca_dashboard(orders: DataFrame, as_of, hours: int = 24) -> DataFrame:
    at = F.lit(as_of).cast("timestamp_ntz")
    d = orders.filter((col("start_ts") > at - F.expr(f"interval {hours} hours")) & (col("start_ts") <= at))
    g = d.agg(F.count(F.lit(1)).alias("orders"), F.avg("fill_rate").alias("fill"), F.avg("slippage_bps").alias("slippage"),
              F.avg("duration_s").alias("secs"), (F.count_if(col("fill_rate") > 0.95) / F.count(F.lit(1))).alias("success"))
    p = exact_percentiles(d, [], "slippage_bps", {"median": 0.5, "p95": 0.95})
    one = p.select(F.struct("median", "p95")).scalar()
    def grade(c, cuts, up):
        names = ("Excellent", "Good", "Fair")
        e = F.when(F.lit(False), "")
        for n, x in zip(names, cuts):
            e = e.when(col(c) > x if up else col(c) < x, n)
        return e.otherwise("Poor")
    return g.withColumns({"median": one["median"], "p95": one["p95"],
                          "quality_grade": grade("slippage", (5, 15, 30), False),
                          "fill_grade": grade("success", (0.95, 0.90, 0.80), True)})


def tca_alerts(orders: DataFrame, trends: DataFrame) -> DataFrame:
    a = orders.filter(col("slippage_bps") > 20).select(
        col("order_id").alias("key"), F.lit("poor_execution").alias("type"), col("slippage_bps").alias("value"),
        F.when(col("slippage_bps") > 50, "high").otherwise("medium").alias("severity"))
    b = trends.filter(col("recent_change") > 10).select(
        col("algorithm").alias("key"), F.lit("algorithm_degradation").alias("type"), col("recent_change").alias("value"),
        F.lit("medium").alias("severity"))
    return a.unionByName(b)


def strategy_score(o: DataFrame, history: DataFrame | None = None, feedback: float = 0.3, floor: float = 0.7) -> DataFrame:
    """orders (size, urgency, volatility, volume, spread_bps) to clipped scores and the choice; below the confidence
    floor the size rule decides."""
    u, vol, v, sp = col("urgency"), col("volatility"), col("volume"), col("spread_bps")
    r = F.coalesce(div("size", "volume"), F.lit(0.1))

    def pts(*rules):
        e = F.lit(None)
        for i, (cond, x) in enumerate(rules):
            e = F.when(cond, x) if i == 0 else e.when(cond, x)
        return F.coalesce(e, F.lit(0.0))

    twap = (0.5 + pts((u == "normal", 0.2), (u == "high", -0.1), (u == "low", 0.1))
            + pts((vol.between(0.15, 0.25), 0.2), (vol > 0.35, -0.1)) + pts((r < 0.1, 0.1), (r > 0.5, -0.2))
            + pts((sp < 15, 0.1)))
    vwap = (0.5 + pts((r > 0.2, 0.3), (r < 0.05, -0.2)) + pts((v > 500000, 0.2), (v < 50000, -0.3))
            + pts((u == "low", 0.1), (u == "high", -0.2)) + pts((vol < 0.20, 0.1)))
    ice = (0.4 + pts((r > 0.5, 0.4), (r > 0.3, 0.2), (r < 0.1, -0.3)) + pts((v > 1000000, 0.2), (v < 100000, -0.4))
           + pts((u == "high", -0.3), (u == "low", 0.2)) + pts((sp < 10, 0.2), (sp > 25, -0.2)))
    d = o.withColumns({"TWAP": clip(twap, 0, 1), "VWAP": clip(vwap, 0, 1), "ICEBERG": clip(ice, 0, 1)})
    if history is not None:
        h = _newest(history, 20).groupBy("algorithm").agg(
            F.avg("slippage_bps").alias("s"), F.avg("fill_rate").alias("f"), F.count(F.lit(1)).alias("n")).filter("n >= 5")
        perf = h.agg(*[F.max(F.when(col("algorithm") == a, (1 - F.least(col("s") / 30, F.lit(1.0))) * 0.5 + col("f") * 0.5))
                       .alias(a) for a in ("TWAP", "VWAP", "ICEBERG")])
        one = perf.select(F.struct("TWAP", "VWAP", "ICEBERG")).scalar()
        d = d.withColumns({a: F.coalesce((1 - feedback) * col(a) + feedback * one[a], col(a))
                           for a in ("TWAP", "VWAP", "ICEBERG")})
    best = F.array_max(F.array(*[F.struct(col(a).alias("s"), F.lit(-i).alias("i"), F.lit(a).alias("n"))
                                 for i, a in enumerate(("TWAP", "VWAP", "ICEBERG"))]))
    rule = F.when(r > 0.3, "ICEBERG").when(r > 0.1, "VWAP").otherwise("TWAP")
    d = d.withColumn("confidence", best["s"])
    return d.withColumn("strategy", F.when(col("confidence") >= floor, best["n"]).otherwise(rule))


def venue_score(o: DataFrame, venues: DataFrame) -> DataFrame:
    """Best venue per order from (symbol, venue, capacity, avg_slippage, success, latency_ms)."""
    d = o.join(venues, "symbol")
    cap = 1 - F.coalesce(F.least(div("size", "capacity"), F.lit(1.0)), F.lit(1.0))
    s = (cap * 0.3 + 0.3 / (1 + col("avg_slippage") / 10) + col("success") * 0.2
         + F.when(col("urgency") == "high", 0.2).otherwise(0.1) / (1 + col("latency_ms") / 100))
    return d.groupBy("order_id").agg(F.max(s).alias("score"), F.max_by("venue", F.struct(s, "venue")).alias("venue"))


def execution_performance(ex: DataFrame, expected_bps: float = 10.0) -> DataFrame:
    """ex (order_id, venue, qty, filled, slippage_bps, duration_s)."""
    g = ex.groupBy("order_id", "venue").agg(F.sum("qty").alias("q"), F.sum("filled").alias("f"),
                                            F.avg("slippage_bps").alias("s"), F.avg("duration_s").alias("t"))
    g = g.groupBy("order_id").agg(div(F.sum("f"), F.sum("q")).alias("fill_rate"), div(F.sum(col("s") * col("f")), F.sum("f"))
                                  .alias("slippage"), F.avg("t").alias("avg_seconds"), F.count(F.lit(1)).alias("venues"))
    return g.withColumns({"vs_expected": col("slippage") - expected_bps, "grade": F.when(col("slippage") < 5, "excellent").when(
        col("slippage") < 15, "good").otherwise("fair")})


def execution_risk_flags(o: DataFrame, max_seconds: float = 3600) -> DataFrame:
    flags = F.array_compact(F.array(
        F.when(col("impact_bps") > 15, F.lit("high_market_impact")),
        F.when(col("duration_s") > max_seconds, F.lit("execution_timeout_risk")),
        F.when(col("volatility") > 0.30, F.lit("high_volatility")),
        F.when(col("liquidity_score") < 0.3, F.lit("low_liquidity"))))
    d = o.withColumn("risks", flags)
    n = F.size("risks")
    return d.withColumn("risk_level", F.when(n >= 3, "high").when(n <= 1, "low").otherwise("medium"))


# Upper bounds (shares of the price) of the risk buckets of a predicted slippage; beyond the last it is very high.
SLIPPAGE_BUCKETS = ((0.0005, "very_low"), (0.001, "low"), (0.002, "medium"), (0.005, "high"))


def slippage_bucket(bps) -> Column:
    out = None
    for bound, name in SLIPPAGE_BUCKETS:
        cond = col(bps) < bound * 10_000
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.when(col(bps).isNotNull(), out.otherwise("very_high"))


def slippage_fit(features: Sequence[str], label: str = "slippage_bps", seed: int = 7, trees: int = 10, estimator=None):
    """A function from training rows to a fitted model: gradient-boosted trees unless another estimator is given."""
    from pyspark.ml.regression import GBTRegressor
    last = estimator or GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=3, seed=seed)
    return lambda train: fit_stages(train, features, last, vector="features")


def slippage_model(train_rows: DataFrame, features: Sequence[str], label: str = "slippage_bps", split_ts=None, seed: int = 7, estimator=None):
    """Regression with a time split; returns (model, test predictions with their risk bucket, error table).

    ``mldata.cross_validate`` and ``mldata.permutation_importance`` take the same ``slippage_fit``.
    """
    cut = F.lit(split_ts).cast("timestamp_ntz")
    train, test = train_rows.filter(col("ts") < cut), train_rows.filter(col("ts") >= cut)
    model = slippage_fit(features, label, seed, estimator=estimator)(train)
    pred = model.transform(test).withColumn("risk_bucket", slippage_bucket("prediction"))
    e = col("prediction") - col(label)
    errors = pred.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n"))
    return model, pred, errors
