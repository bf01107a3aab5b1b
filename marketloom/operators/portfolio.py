"""Portfolio inputs, scoring of candidate weights, regime allocation and rebalancing over many accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, col, div
from .risk import YEAR, both_ways, portfolio_cov

# Class weights per regime (equities, bonds, commodities, cash).
CLASSES = ("equities", "bonds", "commodities", "cash")
REGIME_WEIGHTS = {
    "bull": (0.70, 0.20, 0.05, 0.05), "bear": (0.20, 0.50, 0.10, 0.20), "high_vol": (0.30, 0.40, 0.15, 0.15),
    "low_vol": (0.60, 0.30, 0.05, 0.05), "crisis": (0.10, 0.60, 0.05, 0.25), "recovery": (0.55, 0.25, 0.10, 0.10),
    "normal": (0.50, 0.35, 0.10, 0.05),
}


def expected_returns(returns: DataFrame, method: str = "mean", shrink: float = 0.2, rf: float = 0.02) -> DataFrame:
    """mean | shrink (towards the grand mean) | capm (beta to the equal-weight market)."""
    if method in ("mean", "shrink"):
        g = returns.groupBy("symbol").agg((F.avg("ret") * YEAR).alias("mu"))
        if method == "shrink":
            grand = g.agg(F.avg("mu")).scalar()
            g = g.withColumn("mu", (1 - shrink) * col("mu") + shrink * grand)
        return g
    if method != "capm":
        raise ValueError(f"unknown method {method!r}")
    mk = returns.groupBy("ts").agg(F.avg("ret").alias("mkt"))
    b = returns.join(mk, "ts").groupBy("symbol").agg(div(F.covar_samp("ret", "mkt"), F.var_samp("mkt")).alias("beta"))
    m = mk.agg(F.avg("mkt") * YEAR).scalar()
    return b.withColumn("mu", rf + col("beta") * (m - rf))


def covariance(pairs: DataFrame, method: str = "sample", shrink: float = 0.2) -> DataFrame:
    """Annual covariance of the pair table; shrinkage pulls towards a diagonal of the mean variance."""
    d = pairs.withColumn("cov", col("cov") * YEAR + F.when(col("a") == col("b"), 1e-8).otherwise(0.0))
    if method == "sample":
        return d
    if method != "shrink":
        raise ValueError(f"unknown method {method!r}")
    avg = d.filter("a = b").agg(F.avg("cov")).scalar()
    return d.withColumn("cov", (1 - shrink) * col("cov") + F.when(col("a") == col("b"), shrink * avg).otherwise(0.0))


def robust_returns(returns: DataFrame, z: float = 3.0, keep: float = 0.7) -> DataFrame:
    """Drop dates on which any symbol is an outlier, unless too few dates would stay."""
    st = returns.groupBy("symbol").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    bad = returns.join(st, "symbol").filter(F.abs(col("ret") - col("m")) >= z * col("s")).select("ts").distinct()
    total = returns.agg(F.countDistinct("ts")).scalar()
    n_bad = bad.agg(F.count(F.lit(1))).scalar()
    flagged = returns.join(bad.withColumn("_bad", F.lit(True)), "ts", "left")
    return flagged.filter(col("_bad").isNull() | (1 - n_bad / total < keep)).drop("_bad")


def robust_adjust(mu: DataFrame, returns: DataFrame, kind: str = "ellipsoidal", k: float = 0.1) -> DataFrame:
    """Adjusted expected return and the covariance multiplier."""
    sd = returns.groupBy("symbol").agg((F.stddev_samp("ret") * F.sqrt(F.lit(YEAR))).alias("sd"))
    e = col("mu") - k * col("sd") if kind == "box" else col("mu") * (1 - k * 0.5)
    return mu.join(sd, "symbol").select("symbol", e.alias("mu"), F.lit(1 + k).alias("cov_scale"))


def score_portfolios(candidates: DataFrame, mu: DataFrame, cov: DataFrame, rf: float = 0.02) -> DataFrame:
    """candidates (portfolio_id, symbol, weight) with annual mu and covariance to return, risk and concentration."""
    d = portfolio_cov(candidates, cov.withColumn("corr", F.lit(0.0))).join(mu.select("symbol", "mu"), "symbol")
    sd = cov.filter("a = b").select(col("a").alias("symbol"), F.sqrt("cov").alias("sd"))
    d = d.join(sd, "symbol")
    var = F.sum(col("weight") * col("sw"))
    g = d.groupBy("portfolio_id").agg(
        F.sum(col("weight") * col("mu")).alias("ret"), F.sqrt(var).alias("risk"),
        div(F.sum(F.abs("weight") * col("sd")), F.sqrt(var)).alias("diversification"),
        F.sum(col("weight") * col("weight")).alias("hhi"), (F.max(col("weight") * col("sw")) / var).alias("max_risk_share"),
        F.max("weight").alias("max_weight"))
    return g.withColumn("sharpe", div(col("ret") - rf, "risk"))


#: Symbols of a covariance block and candidates of a weight block.
SYMBOL_BLOCK, CANDIDATE_BLOCK = 64, 1024


def _unit_numbers(seed: int, ids, places):
    """The numbers of ``unit_hash(seed, id, place)`` as a matrix, ids by places."""
    import numpy as np

    m = 2147483647
    h = ((seed * 48271 + np.asarray(ids, np.int64)[:, None] % m) * 16807 + 12345) % m
    h = ((h * 48271 + np.asarray(places, np.int64)[None, :] % m) * 16807 + 12345) % m
    return (h * 69621 % m + 1) / 2147483649.0


def sweep_scores(mu: DataFrame, cov: DataFrame, n: int, seed: int = 42, rf: float = 0.02) -> DataFrame:
    """ret, risk, max_weight and sharpe of n random long-only candidates, weights from (seed, candidate, place of the symbol).

    Quadratic forms by blocks: the covariance is packed to blocks of two symbol groups, candidates come in blocks of ids, and
    a task multiplies one weight block with one covariance block (rows of W S times W).  Weights are made where they are
    needed and never become rows; a block leaves one row of sums per candidate.  Both ends of the scale are cut: many
    candidates make many blocks, many symbols make many tiles.
    """
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("symbol"))  # one row per symbol
    names = mu.select("symbol", "mu").withColumn("_p", place)
    side = {s: names.select(col("symbol").alias(s), col("_p").alias(f"p{s}"), col("mu").alias(f"mu{s}")) for s in "ab"}
    pairs = cov.select("a", "b", "cov").join(side["a"], "a").join(side["b"], "b")
    block = {s: F.floor((col(f"p{s}") - 1) / SYMBOL_BLOCK).cast("int").alias(f"g{s}") for s in "ab"}
    tiles = pairs.groupBy(block["a"], block["b"]).agg(F.collect_list(F.struct("pa", "pb", "cov", "mua")).alias("cells"))
    ids = F.explode(F.sequence(F.lit(0), F.lit(-(-n // CANDIDATE_BLOCK) - 1))).alias("part")
    jobs = tiles.select("ga", "gb", "cells", ids).repartition("ga", "gb", "part")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for cells, part in zip(batch.column("cells"), batch.column("part").to_pylist()):
                c = cells.as_py()
                pa_, pb = np.array([x["pa"] for x in c]), np.array([x["pb"] for x in c])
                rows, at = np.unique(pa_, return_inverse=True)
                columns, to = np.unique(pb, return_inverse=True)
                s = np.zeros((len(rows), len(columns)))
                s[at, to] = [x["cov"] for x in c]
                who = np.arange(part * CANDIDATE_BLOCK, min(n, (part + 1) * CANDIDATE_BLOCK))
                wa, wb = (-np.log(_unit_numbers(seed, who, p)) for p in (rows, columns))
                own = pa_ == pb  # the diagonal carries what is said of single symbols
                only = np.isin(rows, pa_[own])
                gain = np.zeros(len(rows))
                gain[at[own]] = [x["mua"] for x, o in zip(c, own) if o]
                off = s.copy()
                off[at[own], to[own]] = 0.0
                form = ((wa @ off) * wb).sum(1) * 2 + (wa[:, at[own]] ** 2) @ s[at[own], to[own]]
                w = wa[:, only]
                yield pa.RecordBatch.from_pydict({
                    "portfolio_id": who, "form": form, "total": w.sum(1), "gain": wa @ gain,
                    "most": w.max(1) if w.shape[1] else np.zeros(len(who))})

    sums = jobs.mapInArrow(run, "portfolio_id long, form double, total double, gain double, most double")
    g = sums.groupBy("portfolio_id").agg(F.sum("form").alias("f"), F.sum("total").alias("t"), F.sum("gain").alias("m"), F.max("most").alias("w"))
    g = g.select("portfolio_id", (col("m") / col("t")).alias("ret"), (F.sqrt("f") / col("t")).alias("risk"), (col("w") / col("t")).alias("max_weight"))
    return g.withColumn("sharpe", div(col("ret") - rf, "risk"))


def frontier_sweep(scored: DataFrame, bins: int = 50, max_weight: float = 0.4) -> DataFrame:
    """Least-risk candidate per return bin among those within the weight bound, plus max-Sharpe and min-variance."""
    ok = scored.filter(col("max_weight") <= max_weight)
    lim = ok.agg(F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    one = lim.select(F.struct("lo", "hi")).scalar()
    b = F.least(F.floor((col("ret") - one["lo"]) / F.nullif(one["hi"] - one["lo"], F.lit(0.0)) * bins), F.lit(bins - 1))
    pick = F.struct("portfolio_id", "ret", "risk", "sharpe")
    bins_df = ok.withColumn("bin", b).groupBy("bin").agg(F.min_by(pick, F.struct("risk", "portfolio_id")).alias("p"))
    out = bins_df.select(F.lit("frontier").alias("kind"), col("bin").cast("long").alias("bin"), "p.*")
    best = ok.agg(F.max_by(pick, F.struct("sharpe", "portfolio_id")).alias("s"), F.min_by(pick, F.struct(
        "risk", "portfolio_id")).alias("v"))
    for name, c in (("max_sharpe", "s"), ("min_variance", "v")):
        out = out.unionByName(best.select(F.lit(name).alias("kind"), F.lit(None).cast("long").alias("bin"), f"{c}.*"))
    return out


def equilibrium_returns(market: DataFrame, cov: DataFrame, risk_aversion: float = 3.0) -> DataFrame:
    """pi = lambda * Sigma * w for market weights (symbol, weight)."""
    p = market.select(F.lit(0).alias("portfolio_id"), "symbol", "weight")
    return portfolio_cov(p, cov.withColumn("corr", F.lit(0.0))).select("symbol", (risk_aversion * col("sw")).alias("pi"))


def tau(returns: DataFrame, method: str = "inverse_t", fixed: float = 0.05) -> DataFrame:
    n = F.countDistinct("ts")
    e = {"inverse_t": 1 / n, "fixed": F.lit(fixed), "variance": F.var_samp("ret") / 10}[method]
    return returns.agg(e.alias("tau"))


def view_decay(views: DataFrame, as_of, rate: float = 0.05, floor: float = 0.1, max_days: int = 30) -> DataFrame:
    days = F.datediff(F.lit(as_of).cast("date"), F.to_date("ts"))
    d = views.withColumn("age_days", days).filter(col("age_days").between(0, max_days))
    return d.withColumn("confidence_now", F.greatest(col("confidence") * F.pow(F.lit(1 - rate), "age_days"), F.lit(floor)))


def vol_target(positions: DataFrame, cov: DataFrame, target: float = 0.12) -> DataFrame:
    d = portfolio_cov(positions, cov.withColumn("corr", F.lit(0.0)))
    w = Window.partitionBy("portfolio_id")
    vol = F.sqrt(F.sum(col("weight") * col("sw")).over(w))
    scale = F.least(div(F.lit(target), vol), F.lit(2.0))
    d = d.withColumns({"portfolio_vol": vol, "scale": scale})
    d = d.withColumn("scaled", col("weight") * col("scale"))
    return d.withColumn("weight_target", col("scaled") / F.sum("scaled").over(w)).drop("sw")


def crisis_covariance(pairs: DataFrame, rho: float = 0.8, vol_mult: float = 1.5) -> DataFrame:
    """Correlations halfway to rho, volatilities scaled; correlations come from the covariance itself."""
    sd = pairs.filter("a = b").select("a", F.sqrt("cov").alias("sd"))
    d = pairs.join(sd, "a").join(sd.select(col("a").alias("b"), col("sd").alias("sdb")), "b")
    r = F.when(col("a") == col("b"), 1.0).otherwise(0.5 * col("cov") / (col("sd") * col("sdb")) + 0.5 * rho)
    return d.select("a", "b", (r * col("sd") * col("sdb") * vol_mult * vol_mult).alias("cov"), r.alias("corr"))


def regime_allocation(assets: DataFrame, regimes: DataFrame, speed: float = 0.3, max_change: float = 0.2) -> DataFrame:
    """assets (account, symbol, class, weight) and (account, regime, confidence) to constrained target weights."""
    table = F.create_map(*[x for k, ws in REGIME_WEIGHTS.items() for x in (
        F.lit(k), F.create_map(*[y for c, v in zip(CLASSES, ws) for y in (F.lit(c), F.lit(v))]))])
    d = assets.join(regimes, "account")
    normal = table[F.lit("normal")]
    base = F.coalesce(table[col("regime")], normal)
    blend = col("confidence") * base[col("class")] + (1 - col("confidence")) * normal[col("class")]
    acc, cls = Window.partitionBy("account"), Window.partitionBy("account", "class")
    d = d.withColumn("_t", blend / F.count(F.lit(1)).over(cls))
    left = F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum("_t").over(acc), F.lit(0.0)))
    n_left = F.count_if(col("_t").isNull()).over(acc)
    d = d.withColumn("_t", F.coalesce("_t", left / F.nullif(n_left, F.lit(0))))
    d = d.withColumn("target", col("_t") / F.sum("_t").over(acc))
    d = d.withColumn("_s", col("weight") + speed * col("confidence") * (col("target") - col("weight")))
    d = d.withColumn("_s", col("_s") / F.sum("_s").over(acc))
    step = F.greatest(F.lit(0.0), col("weight") + clip(col("_s") - col("weight"), -max_change, max_change))
    d = d.withColumn("_c", step)
    return d.withColumn("new_weight", col("_c") / F.sum("_c").over(acc)).drop("_t", "_s", "_c")


# ------------------------------------------------------------------ rebalancing

def transaction_cost(d: DataFrame) -> DataFrame:
    """(account, symbol, weight, target, value) to turnover and cost per account."""
    g = d.groupBy("account").agg((F.sum(F.abs(col("weight") - col("target"))) / 2).alias("turnover"), F.max("value").alias("value"))
    t = col("turnover")
    return g.withColumn("cost", col("value") * (0.001 * t + 0.0001 * t * t + 0.0002 * t))


def rebalance_triggers(d: DataFrame, accounts: DataFrame, as_of, risk_shares: DataFrame | None = None,
                       weight_limit: float = 0.05, avg_limit: float = 0.02, every_days: int = 30, min_days: int = 7,
                       vol_high: float = 0.25, vol_low: float = 0.10, budget: float = 0.03, emergency: float = 0.25) -> DataFrame:
    """Weights against targets, and accounts (last rebalance, vol, regime), to the triggers fired per account."""
    drift = F.abs(col("weight") - col("target"))
    g = d.groupBy("account").agg(F.max(drift).alias("max_drift"), F.avg(drift).alias("avg_drift"),
                                 F.max(drift / F.greatest("target", F.lit(0.01))).alias("rel_drift"))
    g = g.join(accounts, "account")
    if risk_shares is not None:
        g = g.join(risk_shares.groupBy("account").agg(F.max(F.abs(col("risk_share") - col("target_share"))).alias("risk_drift")),
                   "account", "left")
    else:
        g = g.withColumn("risk_drift", F.lit(None).cast("double"))
    days = F.coalesce(F.datediff(F.lit(as_of).cast("date"), F.to_date("last_rebalance")), F.lit(999))
    g = g.withColumn("days", days)
    crisis = col("regime") == "crisis"
    hot = F.coalesce((col("vol") > vol_high) | (col("vol") < vol_low), F.lit(False))
    fired = F.array_compact(F.array(
        F.when((col("max_drift") > weight_limit) | (col("rel_drift") > weight_limit) | (col("avg_drift") > avg_limit),
               F.lit("threshold")), F.when(col("days") >= max(every_days, min_days), F.lit("time")),
        F.when(hot, F.lit("volatility")), F.when(col("risk_drift") > budget, F.lit("risk_budget")),
        F.when(crisis, F.lit("regime_change"))))
    g = g.withColumns({"fired": fired, "emergency": col("max_drift") > emergency})
    quiet = crisis & (col("days") < min_days / 0.5) & ~col("emergency")
    return g.withColumn("should_rebalance", ((F.size("fired") > 0) | col("emergency")) & ~quiet)


def rebalance_trades(current: DataFrame, target: DataFrame, min_diff: float = 0.01) -> DataFrame:
    """Full outer: a holding without a target is sold, a target without a holding is bought."""
    a = current.select("account", "symbol", "weight")
    b = target.select("account", "symbol", col("weight").alias("target"))
    j = a.join(b, ["account", "symbol"], "full_outer").fillna(0.0, ["weight", "target"])
    d = j.withColumn("diff", col("target") - col("weight")).filter(F.abs("diff") > min_diff)
    return d.withColumn("side", F.when(col("diff") > 0, "buy").otherwise("sell"))


def rebalance_timing(d: DataFrame, history: DataFrame, min_turnover: float = 0.01) -> DataFrame:
    """Expected 30-day drift from the real weight history against the cost of trading now."""
    v = history.groupBy("account", "symbol").agg(F.var_pop("drift").alias("v"))
    pen = v.groupBy("account").agg(F.sum(col("v") * 30).alias("p"))
    c = transaction_cost(d).join(pen, "account")
    c = c.withColumn("drift_penalty", col("p") * col("value") * 0.5)
    return c.withColumns({"net_benefit": col("drift_penalty") - col("cost"), "should_rebalance": (
        col("drift_penalty") > col("cost")) & (col("turnover") > min_turnover)}).drop("p")
