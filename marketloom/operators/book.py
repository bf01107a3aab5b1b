"""Order-book analytics over snapshots with bids[] and asks[] of (price, size, orders), best level first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, div, flag
from .timeseries import Ordered

DEPTH, DECAY, IMBALANCE = 5, 0.9, 0.7


def _sum_size(levels, n) -> Column:
    return F.aggregate(F.slice(levels, 1, n), F.lit(0.0), lambda a, x: a + x["size"])


def book_summary(b: DataFrame) -> DataFrame:
    bid, ask = F.get("bids", F.lit(0))["price"], F.get("asks", F.lit(0))["price"]
    b = b.withColumns({"best_bid": bid, "best_ask": ask})
    b = b.withColumns({"mid": (bid + ask) / 2, "spread": ask - bid,
                       "bid_depth": _sum_size("bids", DEPTH), "ask_depth": _sum_size("asks", DEPTH)})
    return b.withColumn("spread_bps", div("spread", "mid") * 10000)


def side_depth(levels, n: int = DEPTH, decay: float = DECAY) -> Column:
    """Struct (size, price, count): sizes of the first n levels shrunk by decay^i, and their mean price."""
    top = F.slice(levels, 1, n)
    w = F.transform(top, lambda x, i: F.struct((x["size"] * F.pow(F.lit(decay), i)).alias("s"), x["price"].alias("p")))
    sums = F.aggregate(w, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("v")),
                       lambda a, x: F.struct((a["s"] + x["s"]).alias("s"), (a["v"] + x["s"] * x["p"]).alias("v")))
    return F.struct(sums["s"].alias("size"), F.coalesce(div(sums["v"], sums["s"]), F.lit(0.0)).alias("price"),
                    F.size(top).alias("levels"))


def book_depth(b: DataFrame) -> DataFrame:
    b = b.withColumns({"_b": side_depth("bids"), "_a": side_depth("asks")})
    return b.withColumns({f"{n}_depth_{f}": F.col(f"{c}.{f}") for n, c in (("bid", "_b"), ("ask", "_a"))
                          for f in ("size", "price", "levels")}).drop("_b", "_a")


def book_imbalance(b: DataFrame, threshold: float = IMBALANCE) -> DataFrame:
    bid, ask = _sum_size("bids", 3), _sum_size("asks", 3)
    r = F.coalesce(div(bid, bid + ask), F.lit(0.5))
    b = b.withColumn("bid_ratio", r)
    up, down = F.col("bid_ratio") > threshold, F.col("bid_ratio") < 1 - threshold
    return b.withColumns({
        "imbalance_side": F.when(up, "bullish").when(down, "bearish").otherwise("neutral"),
        "imbalance_strength": F.when(up, (F.col("bid_ratio") - 0.5) * 2).when(down, (0.5 - F.col("bid_ratio")) * 2).otherwise(0.0)})


def liquidity(b: DataFrame, max_levels: int = 10) -> DataFrame:
    """Effective spread with a size-imbalance penalty, and the mean of three liquidity sub-scores."""
    b = book_depth(book_summary(b))
    s1, s2 = F.get("bids", F.lit(0))["size"], F.get("asks", F.lit(0))["size"]
    eff = F.coalesce("spread_bps", F.lit(0.0)) + F.coalesce(div(F.abs(s1 - s2), s1 + s2), F.lit(0.0)) * 10
    b = b.withColumn("effective_spread", eff)
    score = (F.least("bid_depth_size", "ask_depth_size") / 10000 + F.least(F.size("bids"), F.size("asks")) / max_levels
             + F.greatest(F.lit(0.0), 1 - F.col("effective_spread"))) / 3
    return b.withColumn("liquidity_score", score)


def sweep(levels, size) -> Column:
    """Walk the levels: struct (filled, cost, used)."""
    start = F.struct(F.lit(0.0).alias("f"), F.lit(0.0).alias("c"), F.lit(0).alias("n"))

    def take(a, x):
        q = F.least(x["size"], F.greatest(size - a["f"], F.lit(0.0)))
        return F.struct((a["f"] + q).alias("f"), (a["c"] + q * x["price"]).alias("c"),
                        (a["n"] + F.when(q > 0, 1).otherwise(0)).alias("n"))

    return F.aggregate(levels, start, take)


def sweep_cost(b: DataFrame, size: str = "order_size", side: str = "side") -> DataFrame:
    b = book_summary(b)
    lv = F.when(F.col(side) == "buy", F.col("asks")).otherwise(F.col("bids"))
    b = b.withColumn("_s", sweep(lv, F.col(size)))
    done = F.col("_s.f") >= F.col(size)
    avg = div("_s.c", "_s.f")
    return b.withColumns({
        "feasible": done, "avg_fill": F.when(done, avg), "levels_used": F.when(done, F.col("_s.n")),
        "impact_bps": F.when(done, F.abs(avg - F.col("mid")) / F.col("mid") * 10000),
        "shortage": F.greatest(F.col(size) - F.col("_s.f"), F.lit(0.0))}).drop("_s")


def book_patterns(b: DataFrame, s: Ordered, momentum_threshold: float = 0.5, trend_threshold: float = 0.5) -> DataFrame:
    """Spread trend (20), liquidity change (15), momentum (10) and stepping (12) over summarised snapshots."""
    b = book_summary(b).withColumns({"_b3": _sum_size("bids", 3), "_a3": _sum_size("asks", 3),
                                     "_b2": _sum_size("bids", 2), "_a2": _sum_size("asks", 2)})
    x = F.row_number().over(s.w).cast("double")
    b = b.withColumns({"_x": x, "_dm": F.col("mid") - s.lag("mid"), "_db": F.col("best_bid") - s.lag("best_bid"),
                       "_da": F.col("best_ask") - s.lag("best_ask"),
                       "_im": (F.col("_b2") - F.col("_a2")) / (F.col("_b2") + F.col("_a2") + 1e-6)})

    b = b.withColumn("_seen", F.count(F.lit(1)).over(s.rows(-19)))
    f20, f15, f10 = s.rows(-19), s.rows(-14), s.rows(-9)
    b = b.withColumns({
        "_slope": F.regr_slope("spread_bps", "_x").over(f20), "_sd": F.stddev_pop("spread_bps").over(f20),
        "_cb": (F.col("_b3") - F.first("_b3").over(f15)) / (F.first("_b3").over(f15) + 1),
        "_ca": (F.col("_a3") - F.first("_a3").over(f15)) / (F.first("_a3").over(f15) + 1),
        "_m3": F.avg("_dm").over(s.rows(-2)), "_msd": F.stddev_pop("_dm").over(s.rows(-8)),
        "_i3": F.avg("_im").over(s.rows(-2)),
        **{f"_{n}": F.sum(F.when(cond, 1).otherwise(0)).over(s.rows(-10)) / 11 for n, cond in (
            ("bu", F.col("_db") > 0), ("bd", F.col("_db") < 0), ("au", F.col("_da") > 0), ("ad", F.col("_da") < 0))}})
    sig = F.abs("_slope") / (F.col("_sd") + 1e-6)
    cb, ca, t = F.col("_cb"), F.col("_ca"), 0.2
    mom = F.abs("_m3") / (F.col("_msd") + 1e-6)
    step = F.greatest("_bu", "_bd", "_au", "_ad")
    b = b.withColumns({
        "spread_pattern": F.when((F.col("_seen") >= 10) & (sig > trend_threshold), F.when(F.col("_slope") < 0, "spread_tightening")
                                 .otherwise("spread_widening")),
        "liquidity_pattern": F.when((F.col("_seen") >= 8) & ((F.abs(cb) > t) | (F.abs(ca) > t)),
                                    F.when((cb > t) & (ca > t), "liquidity_buildup").when((cb < -t) & (ca < -t),
                                                                                         "liquidity_depletion")
                                    .when(cb > t, "bid_buildup").when(ca > t, "ask_buildup").when(cb < -t, "bid_depletion")
                                    .otherwise("ask_depletion")),
        "momentum_pattern": F.when((F.col("_seen") >= 10) & ((mom > momentum_threshold) | (F.abs("_i3") > 0.3)),
                                   F.when(F.col("_m3") > 0, "bullish").otherwise("bearish")),
        "stepping_share": F.when((F.col("_seen") >= 12) & (step > 0.7), step)})
    names = ("spread_pattern", "liquidity_pattern", "momentum_pattern", "stepping_share")
    n = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in names), F.lit(0))
    b = b.withColumn("patterns", n).withColumn("pattern_confidence", F.least(F.col("patterns") / 3, F.lit(1.0)))
    return b.drop(*[c for c in b.columns if c.startswith("_") and c not in ("_own", "_chunk", "_i")])


def book_signals(b: DataFrame, s: Ordered) -> DataFrame:
    b = book_imbalance(book_summary(b))
    avg = F.avg("spread_bps").over(s.rows(-20, -1))
    ratio = div(F.get("bids", F.lit(0))["size"], F.get("asks", F.lit(0))["size"])
    b = b.withColumns({
        "sig_imbalance": F.col("imbalance_strength") > 0.7,
        "sig_spread": F.when(F.col("spread_bps") < avg * 0.7, "tight_spread").when(
            F.col("spread_bps") > avg * 1.5, "wide_spread"),
        "sig_size": F.when(ratio > 3, "bid_size_dominance").when(ratio < 1 / 3, "ask_size_dominance")})
    bull = (F.when(F.col("sig_imbalance") & (F.col("imbalance_side") == "bullish"), 0.6).otherwise(0.0)
            + F.when(F.col("sig_size") == "bid_size_dominance", 0.25).otherwise(0.0))
    bear = (F.when(F.col("sig_imbalance") & (F.col("imbalance_side") == "bearish"), 0.6).otherwise(0.0)
            + F.when(F.col("sig_size") == "ask_size_dominance", 0.25).otherwise(0.0))
    return b.withColumn("book_sentiment", F.when(bull > bear * 1.2, "bullish").when(bear > bull * 1.2, "bearish")
                        .otherwise("neutral"))


def book_stats(b: DataFrame, s: Ordered, n: int = 100) -> DataFrame:
    w = s.rows(1 - n)
    b = liquidity(b)
    return b.withColumns({"liquidity_avg": F.avg("liquidity_score").over(w), "liquidity_sd": F.stddev_pop(
        "liquidity_score").over(w), "spread_avg": F.avg("spread_bps").over(w), "spread_max": F.max("spread_bps").over(w)})


def queue_estimate(o: DataFrame) -> DataFrame:
    """Limit orders already matched with a snapshot (price, side, placed, bids, asks, ts): queue, probability, time."""
    o = book_summary(o)
    lv = F.when(F.col("side") == "buy", F.col("bids")).otherwise(F.col("asks"))
    size = F.get(F.filter(lv, lambda x: F.abs(x["price"] - F.col("limit_price")) < 1e-9), F.lit(0))["size"]
    age = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("placed").cast("timestamp"))) / 1e6
    ahead = size * 0.6 * F.when(age < 60, 1 - age / 120).otherwise(1.0)
    o = o.withColumns({"level_size": size, "ahead": ahead})
    b2, a2 = _sum_size("bids", 2), _sum_size("asks", 2)
    own = F.when(F.col("side") == "buy", b2).otherwise(a2)
    p = (F.greatest(F.lit(0.0), 1 - div("ahead", "level_size")) * F.greatest(F.lit(0.5), 1 - (F.col("spread_bps") - 5) / 20)
         * (1 + 0.2 * div(own, b2 + a2)))
    rate = F.col("level_size") / 300 * F.when(F.col("spread_bps") < 10, 1.5).otherwise(1.0) * F.when(
        F.col("level_size") > 10000, 0.7).otherwise(1.0)
    return o.withColumns({"level_found": F.col("level_size").isNotNull(),
                          "fill_probability": F.coalesce(F.least(F.lit(1.0), p), F.lit(0.0)),
                          "fill_seconds": F.floor(F.least(div("ahead", rate), F.lit(3600.0)))})


def placement_choice(o: DataFrame, mode: str = "optimal") -> DataFrame:
    """Market, join and mid candidates of each order scored in one row; the chosen one is kept."""
    o = queue_estimate(sweep_cost(o))
    def cand(name, impact, certainty, seconds):
        return F.struct(F.lit(name).alias("strategy"), impact.cast("double").alias("impact"),
                        certainty.cast("double").alias("certainty"), seconds.cast("double").alias("seconds"))
    c = F.array_compact(F.array(
        F.when(F.col("feasible"), cand("market_order", F.col("impact_bps"), F.lit(1.0), F.lit(0.0))),
        F.when(F.col("feasible"), cand("join_best", F.lit(0.0), F.col("fill_probability"), F.coalesce("fill_seconds", F.lit(0)))),
        F.when(F.col("feasible") & (F.col("spread_bps") > 10), cand("mid_price_order", F.col("impact_bps") * 0.5, F.lit(0.3),
                                                                  F.lit(300.0)))))
    def score(x):
        if mode == "aggressive":
            return x["certainty"]
        if mode == "passive":
            return -x["impact"]
        return (1 - x["impact"] / 50 + x["certainty"] + 1 - F.least(x["seconds"] / 600, F.lit(1.0))) / 3
    ranked = F.transform(c, lambda x, i: F.struct(score(x).alias("s"), (-i).alias("i"), x.alias("c")))
    return o.withColumn("_best", F.array_max(ranked)).withColumns(
        {"strategy": F.col("_best.c.strategy"), "score": F.col("_best.s")}).drop("_best")
