"""Market impact: signed volume, Kyle and Almgren-Chriss estimates, slices and venue allocation for all orders at once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, col, div
from .timeseries import Ordered, latest

YEAR = 252
# Default intraday volume profile.
PROFILE = (0.20, 0.15, 0.10, 0.08, 0.08, 0.10, 0.15, 0.14)


def signed_volume(bars: DataFrame, s: Ordered = Ordered()) -> DataFrame:
    """Tick rule; an unchanged price inherits the previous sign."""
    d = F.signum(col("close") - s.lag("close"))
    b = bars.withColumn("_d", F.when(d != 0, d))
    sign = F.coalesce(F.last("_d", ignorenulls=True).over(s.running), F.lit(1.0))
    return b.withColumn("signed_volume", sign * col("volume")).drop("_d")


def kyle_lambda(bars: DataFrame, min_obs: int = 50, default: float = 1e-6) -> DataFrame:
    s = Ordered()
    b = signed_volume(bars).withColumn("_r", col("close") / s.lag("close") - 1).filter("_r IS NOT NULL")
    g = b.groupBy("symbol").agg(F.covar_samp("_r", "signed_volume").alias("_c"), F.var_samp("signed_volume").alias("_v"),
                                F.count(F.lit(1)).alias("n"))
    lam = clip(F.abs(div("_c", "_v")), 1e-8, 1e-3)
    return g.select("symbol", "n", F.when((col("n") >= min_obs) & (col("_v") > 0), lam).otherwise(default).alias("lam"))


def impact_params(bars: DataFrame, executions: DataFrame, permanent: float = 0.1) -> DataFrame:
    """Volatility per symbol; eta from shortfall on size / mean volume; gamma a tenth of eta."""
    s = Ordered()
    b = bars.withColumn("_r", col("close") / s.lag("close") - 1)
    g = b.groupBy("symbol").agg((F.stddev_samp("_r") * F.sqrt(F.lit(YEAR))).alias("volatility"),
                                F.avg("volume").alias("avg_volume"))
    e = executions.join(g.select("symbol", "avg_volume"), "symbol").withColumn("_x", div("size", "avg_volume"))
    f = e.groupBy("symbol").agg(F.covar_samp("shortfall", "_x").alias("_c"), F.var_samp("_x").alias("_v"),
                                F.count(F.lit(1)).alias("_n"))
    eta = F.when((col("_n") > 20) & (col("_v") > 0), F.greatest(F.lit(1e-8), F.abs(div("_c", "_v")))).otherwise(1e-6)
    return g.join(f, "symbol", "left").withColumn("eta", eta).withColumn("gamma", col("eta") * permanent).drop(
        "_c", "_v", "_n")


# An impact model is a function from a row's columns (size, lam, eta, gamma, avg_volume, volatility, ...) to a share of the price.
IMPACT_MODELS: dict[str, Callable[[], Column]] = {
    "kyle": lambda: col("lam") * col("size"),
    "ac": lambda: (col("eta") + col("gamma")) * div("size", "avg_volume"),
    "sqrt": lambda: col("volatility") * F.sqrt(div("size", "avg_volume")),
}


def register_impact_model(name: str, model: Callable[[], Column]) -> None:
    """Add a model of one's own to those that ``impact_estimate`` may blend."""
    if name in IMPACT_MODELS:
        raise ValueError(f"impact model {name} is registered twice")
    IMPACT_MODELS[name] = model


def impact_estimate(orders: DataFrame, kyle: DataFrame, params: DataFrame, blend: Mapping[str, float] | None = None) -> DataFrame:
    """orders (order_id, symbol, size, latency_ms) to the blended impact, its class and the venue adjustment.

    ``blend`` names models of ``IMPACT_MODELS`` with their weights; each adds a column ``<name>_impact``.
    """
    blend = {"kyle": 0.4, "ac": 0.6} if blend is None else blend
    d = orders.join(kyle.select("symbol", "lam", "n"), "symbol").join(params, "symbol")
    late = F.greatest(col("latency_ms") - 50, F.lit(0)) * 1e-4
    d = d.withColumns({**{f"{m}_impact": IMPACT_MODELS[m]() for m in blend}, "venue_adjustment": late})
    total = reduce(lambda a, b: a + b, [w * col(f"{m}_impact") for m, w in blend.items()])
    d = d.withColumn("impact_bps", (total + col("venue_adjustment")) * 10000)
    return d.withColumn("risk_class", F.when(col("impact_bps") < 5, "low").when(col("impact_bps") < 15, "medium").when(
        col("impact_bps") < 30, "high").otherwise("very_high"))


def impact_decay(d: DataFrame, half_life: float = 300.0, horizons: Sequence[int] = (60, 300, 900)) -> DataFrame:
    return d.withColumns({f"impact_after_{h}s": col("impact_bps") * F.exp(F.lit(-0.6931471805599453 * h / half_life))
                          for h in horizons})


def execution_schedule(orders: DataFrame, kind: str = "ac", risk_aversion: float = 1e-6) -> DataFrame:
    """orders (order_id, size, horizon seconds, volatility, eta, gamma, avg_volume) to slices.

    Almgren-Chriss slices are the differences of the holdings trajectory, so they add up to the order.
    """
    n = F.least(F.greatest(F.floor(col("horizon") / 30), F.lit(5)), F.lit(20)) if kind == "ac" else F.greatest(
        F.floor(col("horizon") / 60), F.lit(1))
    d = orders.withColumn("slices", n).withColumn("slice", F.explode(F.sequence(F.lit(1).cast("long"), col("slices").cast("long"))))
    if kind == "ac":
        kappa, hours = F.sqrt(risk_aversion * col("volatility") * col("volatility") / col("eta")), col("horizon") / 3600
        def held(i):
            left = hours * (1 - i / col("slices"))
            return F.when(kappa * hours > 1e-6, div(F.sinh(kappa * left), F.sinh(kappa * hours))).otherwise(left / hours)
        share = held(col("slice") - 1) - held(col("slice"))
    else:
        share = 1 / col("slices")
    d = d.withColumns({"slice_size": col("size") * share, "start_s": (col("slice") - 1) * col("horizon") / col("slices")})
    return d.withColumn("slice_cost", (col("eta") + col("gamma")) * div("slice_size", "avg_volume"))


def twap_slices(orders: DataFrame, bars: DataFrame) -> DataFrame:
    s = Ordered()
    b = bars.withColumn("_r", col("close") / s.lag("close") - 1)
    r = b.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(col("ts").desc())))
    v = r.groupBy("symbol").agg(div(F.stddev_samp(F.when(col("_k") <= 20, col("_r"))), F.stddev_samp("_r")).alias("vr"))
    d = orders.join(v, "symbol", "left").withColumn("_i", clip(F.floor(col("horizon") / 10), 30, 120))
    n = F.greatest(F.lit(1.0), F.floor(col("horizon") / col("_i")))
    hot, calm = col("vr") > 1.5, col("vr") < 0.7
    d = d.withColumns({
        "slices": F.when(hot, F.least(n * 2, F.lit(20.0))).when(calm, F.greatest(F.floor(n / 2), F.lit(3.0))).otherwise(n),
        "interval_s": F.when(hot, F.greatest(F.lit(30.0), F.floor(col("_i") / 2))).when(
            calm, F.least(F.lit(300.0), col("_i") * 2)).otherwise(col("_i"))})
    d = d.withColumn("slice", F.explode(F.sequence(F.lit(1).cast("long"), col("slices").cast("long"))))
    return d.select("order_id", "symbol", "slice", (col("size") / col("slices")).alias("slice_size"),
                    ((col("slice") - 1) * col("interval_s")).alias("start_s"))


def vwap_slices(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """Hourly mean-volume shares; symbols with fewer than six hours get the default profile."""
    h = bars.groupBy("symbol", F.hour("ts").alias("hour")).agg(F.avg("volume").alias("v"))
    w = Window.partitionBy("symbol")
    h = h.select("symbol", "hour", (col("v") / F.sum("v").over(w)).alias("share"), F.count(F.lit(1)).over(w).alias("hours"))
    std = F.array(*[F.struct(F.lit(9 + i).alias("hour"), F.lit(p).alias("share")) for i, p in enumerate(PROFILE)])
    short = h.filter("hours < 6").select("symbol").distinct().select("symbol", F.inline(std))
    prof = h.filter("hours >= 6").select("symbol", "hour", "share").unionByName(short)
    d = orders.join(prof, "symbol")
    i = F.row_number().over(Window.partitionBy("order_id").orderBy("hour"))
    n = F.count(F.lit(1)).over(Window.partitionBy("order_id"))
    d = d.withColumns({"slice": i, "_n": n, "slice_size": col("size") * col("share"),
                       "participation": clip(col("share") * 2, 0.05, 0.20)})
    return d.withColumn("start_s", (col("slice") - 1) * F.greatest(F.lit(60), F.floor(col("horizon") / col("_n")))).drop("_n")


def iceberg_slices(orders: DataFrame, bars: DataFrame) -> DataFrame:
    r = bars.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(col("ts").desc())))
    v = r.filter("_k <= 10").groupBy("symbol").agg(F.avg("volume").alias("v10"))
    d = orders.join(v, "symbol", "left")
    ratio = F.coalesce(div("size", "v10"), F.lit(0.1))
    shown = F.when(ratio > 0.5, 0.05).when(ratio > 0.2, 0.08).otherwise(0.15)
    d = d.withColumn("visible", shown)
    piece = F.greatest(col("size") * col("visible"), F.lit(1.0), col("size") * 0.02)
    d = d.withColumn("_p", piece).withColumn("slice", F.explode(F.sequence(F.lit(1), F.greatest(
        F.lit(1), F.ceil(col("size") / col("_p")).cast("int")))))
    left = col("size") - (col("slice") - 1) * col("_p")
    d = d.withColumn("slice_size", F.least(col("_p"), left)).filter(col("slice_size") > 1e-9)
    return d.select("order_id", "symbol", "slice", "visible", "slice_size", ((col("slice") - 1) * 45).alias("start_s"))


def venue_allocation(orders: DataFrame, venues: DataFrame, max_share: float = 0.5, min_share: float = 0.01) -> DataFrame:
    """Greedy by cost: at most half of what remains per venue, the rest to the largest venue.

    ``venues`` (symbol, venue, cost, capacity): the list of one symbol is its trading venues, a handful, and is folded
    inside the row of each order.
    """
    lst = venues.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("cost", "venue", "capacity"))).alias("vs"))
    d = orders.join(lst, "symbol")
    start = F.struct(col("size").cast("double").alias("left"), F.slice(F.transform("vs", lambda v: F.struct(
        v["venue"].alias("venue"), F.lit(0.0).alias("qty"))), 1, 0).alias("out"))

    def step(a, v):
        q = F.least(v["capacity"], a["left"] * max_share)
        ok = (q > col("size") * min_share) & (a["left"] > 0)
        return F.struct(F.when(ok, a["left"] - q).otherwise(a["left"]).alias("left"),
                        F.when(ok, F.concat(a["out"], F.array(F.struct(v["venue"].alias("venue"), q.alias("qty")))))
                        .otherwise(a["out"]).alias("out"))

    d = d.withColumn("_r", F.aggregate("vs", start, step))
    big = F.array_max(F.transform("vs", lambda v: F.struct(v["capacity"].alias("c"), v["venue"].alias("venue"))))["venue"]
    rest = F.array(F.struct(big.alias("venue"), col("_r.left").alias("qty")))
    d = d.select("order_id", "size", F.inline(F.concat(col("_r.out"), rest)))
    g = d.groupBy("order_id", "venue").agg(F.sum("qty").alias("qty"), F.max("size").alias("size"))
    return g.filter("qty > 0").withColumn("share", col("qty") / col("size"))


def impact_analytics(d: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    from .timeseries import exact_percentiles, join_on
    b = col("impact_bps")
    g = d.groupBy(*keys).agg(F.avg(b).alias("avg_bps"), F.stddev_pop(b).alias("sd_bps"), F.count(b).alias("n"),
                             *[F.count_if(col("risk_class") == c).alias(c) for c in ("low", "medium", "high", "very_high")])
    q = exact_percentiles(d, list(keys), "impact_bps", {"p50": 0.5, "p95": 0.95})
    return join_on(g, q, list(keys), "left") if keys else g.crossJoin(q)
