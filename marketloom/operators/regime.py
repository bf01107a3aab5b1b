"""Regime and label operators over bars (one row per symbol and bar)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col, div
from .risk import YEAR
from .timeseries import Ordered

S = Ordered()


def label_regime6(df: DataFrame, adx_limit: float = 30.0, s: Ordered = S) -> DataFrame:
    """Needs close and adx.  Later rules override earlier ones; high volatility wins."""
    b = df.withColumn("_r", col("close") / s.lag("close") - 1)
    r20, v20 = col("close") / s.lag("close", 20) - 1, s.std("_r", 20)
    strong = col("adx") > adx_limit
    return b.withColumn("regime", F.when(v20 > 0.03, "high_volatility").when((r20 > 0.02) & strong, "strong_bull").when(
        (r20 < -0.02) & strong, "strong_bear").when((r20 > 0) & (r20 <= 0.02) & strong, "bull").when(
        (r20 < 0) & (r20 >= -0.02) & strong, "bear").otherwise("sideways")).drop("_r")


def label_next_return(df: DataFrame, s: Ordered = S) -> DataFrame:
    return df.withColumn("next_ret", s.lead("close") / col("close") - 1)


def label_pattern(df: DataFrame, vol: float = 0.03, trend: float = 0.02, s: Ordered = S) -> DataFrame:
    """Volatility and mean of the 20 bars before (19 returns); the first 20 bars have no pattern."""
    b = df.withColumn("_r", col("close") / s.lag("close") - 1)
    w = s.rows(-19, -1)
    sd, m = F.stddev_samp("_r").over(w), F.avg("_r").over(w)
    return b.withColumn("pattern", F.when(s.row() <= 20, "no_pattern").when(sd > vol, "high_volatility").when(
        m > trend, "bull_flag").when(m < -trend, "bear_flag").otherwise("sideways")).drop("_r")


def regime_threshold(df: DataFrame, s: Ordered = S) -> DataFrame:
    b = df.withColumn("_r", col("close") / s.lag("close") - 1)
    r, v = s.mean("_r", 20) * YEAR, s.std("_r", 20) * F.sqrt(F.lit(YEAR))
    return b.withColumn("regime", F.when(r.isNull(), "normal").when(v > 0.25, "high_volatility").when(
        r > 0.15, "bull_trending").when(r < -0.10, "bear_trending").when(v < 0.12, "low_volatility").otherwise("normal")).drop("_r")


FACTOR_WEIGHTS = {"return": 0.25, "volatility": 0.25, "correlation": 0.20, "momentum": 0.15, "vix": 0.15}


def regime_multifactor(df: DataFrame) -> DataFrame:
    """Measures per date (ret20 annualised, vol_short, vol_long, avg_corr, momentum60, vix, vix_ma) to weighted votes.

    Each factor casts one vote (regime, confidence); scores are summed per regime and the largest wins.
    """
    def v(regime, conf):
        return F.struct(F.lit(regime).alias("regime"), F.lit(conf).alias("c"))
    def when(*rules, other=("normal", 0.6)):
        e = None
        for cond, (r, c) in rules:
            e = F.when(cond, v(r, c)) if e is None else e.when(cond, v(r, c))
        return e.otherwise(v(*other))
    sv, lv, x = col("vol_short"), col("vol_long"), col("vix")
    votes = {
        "return": when((col("ret20") > 0.15, ("bull_trending", 0.8)), (col("ret20") < -0.10, ("bear_trending", 0.8))),
        "volatility": when(((sv > 0.25) & (sv > 1.5 * lv), ("crisis", 0.9)), (sv > 0.25, ("high_volatility", 0.8)),
                           (sv < 0.12, ("low_volatility", 0.8))),
        "correlation": when((col("avg_corr") > 0.7, ("crisis", 0.8)), (col("avg_corr") < 0.3, ("low_volatility", 0.7))),
        "momentum": when((col("momentum60") > 0.05, ("bull_trending", 0.7)), (col("momentum60") < -0.05, ("bear_trending", 0.7))),
        "vix": when(((x > 30) & (x > 1.3 * col("vix_ma")), ("crisis", 0.9)), (x > 30, ("high_volatility", 0.8)),
                    (x < 15, ("low_volatility", 0.8)), (x.between(25, 30), ("bear_trending", 0.7))),
    }
    items = F.array(*[F.struct(e["regime"].alias("regime"), (e["c"] * FACTOR_WEIGHTS[k]).alias("score"))
                      for k, e in votes.items()])
    d = df.select("ts", F.inline(items)).groupBy("ts", "regime").agg(F.sum("score").alias("score"))
    return d.groupBy("ts").agg(F.max_by("regime", F.struct(F.round("score", 12), "regime")).alias("regime"),
                               F.max("score").alias("confidence"))


def market_measures(returns: DataFrame, corr: DataFrame, vix: DataFrame) -> DataFrame:
    """Equal-weight market series per date with its rolling measures; one row per date after the first groupBy."""
    m = returns.groupBy("ts").agg(F.avg("ret").alias("r")).withColumn("k", F.lit(1))
    s = Ordered("k")
    m = m.withColumns({
        "ret20": F.avg("r").over(s.rows(-19)) * YEAR, "vol_short": F.stddev_samp("r").over(s.rows(-19)) * F.sqrt(F.lit(YEAR)),
        "vol_long": F.stddev_samp("r").over(s.rows(-59)) * F.sqrt(F.lit(YEAR)),
        "momentum60": F.exp(F.sum(F.log1p("r")).over(s.rows(-59))) - 1})
    d = m.join(corr.select("ts", "avg_corr"), "ts", "left").join(vix.select("ts", "vix"), "ts", "left")
    return d.withColumn("vix_ma", F.avg("vix").over(s.rows(-19))).drop("k", "r")


def regime_gmm(returns: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Mixture over six rolling statistics; components are named by their mean volatility, not by index."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    s = Ordered()
    d = returns.withColumns({"m20": s.mean("ret", 20), "v20": s.std("ret", 20), "m60": s.mean("ret", 60), "v60": s.std("ret", 60),
                             "sk": s.roll(F.skewness, "ret", 20), "ku": s.roll(F.kurtosis, "ret", 20)}).dropna()
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["m20", "v20", "m60", "v60", "sk", "ku"], outputCol="raw"),
                            StandardScaler(inputCol="raw", outputCol="features", withMean=True),
                            GaussianMixture(k=k, seed=seed, maxIter=20)])
    p = pipe.fit(d).transform(d)
    order = p.groupBy("prediction").agg(F.avg("v20").alias("vol"))
    names = order.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("vol"))).select(
        "prediction", F.get(F.array(F.lit("low_volatility"), F.lit("normal"), F.lit("high_volatility")), col("rank") - 1)
        .alias("regime"))
    return p.join(F.broadcast(names), "prediction").select("symbol", "ts", "regime", "v20")


def regime_transitions(df: DataFrame, s: Ordered = S) -> DataFrame:
    d = df.withColumn("from_regime", s.lag("regime")).filter("from_regime IS NOT NULL")
    g = d.groupBy("from_regime", col("regime").alias("to_regime")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("probability", col("n") / F.sum("n").over(Window.partitionBy("from_regime")))
