"""Model evaluation, statistical tests and drift.

Row-level inputs are reduced by aggregation; anything that needs an order over unbounded rows (thresholds, KS) uses
``ordered_running``.  Per-model result tables are a handful of rows and may be ranked in one window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import PRIME, col, correlation, div, finite, mixed_hash, normal_cdf
from ..session import cut_lineage
from .risk import YEAR, P
from .timeseries import Ordered, exact_percentiles, join_on, ordered_running



# ------------------------------------------------------------------ returns

def return_metrics(dd: DataFrame, periods: DataFrame) -> DataFrame:
    """dd from ``drawdown_series``, periods from ``drawdown_periods``; one row per portfolio."""
    r = col("ret")
    g = dd.groupBy("portfolio_id").agg(
        (F.max_by("equity", "ts") - 1).alias("total_return"), (F.pow(1 + F.avg(r), F.lit(YEAR)) - 1).alias("annual_return"),
        (F.stddev_samp(r) * F.sqrt(F.lit(YEAR))).alias("volatility"), div(F.avg(r), F.stddev_samp(r)).alias("_s"),
        F.min("drawdown").alias("max_drawdown"), F.avg(F.when(col("drawdown") < 0, col("drawdown"))).alias("avg_drawdown"),
        F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurt"), (F.count_if(r > 0) / F.count(r)).alias("hit_rate"),
        F.avg(F.when(r > 0, r)).alias("avg_win"), F.avg(F.when(r < 0, r)).alias("avg_loss"),
        div(F.sum(F.when(r > 0, r)), F.abs(F.sum(F.when(r < 0, r)))).alias("profit_factor"))
    g = g.withColumns({"sharpe": col("_s") * F.sqrt(F.lit(YEAR)), "calmar": div("annual_return", F.abs("max_drawdown"))}).drop("_s")
    longest = periods.groupBy("portfolio_id").agg(F.max("bars").alias("drawdown_duration"))
    q = exact_percentiles(dd, "portfolio_id", "ret", {"var_5": 0.05}, 1_000_000)
    tail = join_on(dd, q, "portfolio_id").filter(r <= col("var_5")).groupBy("portfolio_id").agg(F.avg(r).alias("cvar_5"))
    return reduce(lambda d, x: join_on(d, x, "portfolio_id", "left"), (longest, q, tail), g)


def risk_tail(pr: DataFrame) -> DataFrame:
    r = col("ret")
    q = exact_percentiles(pr, "portfolio_id", "ret", {"var_1": 0.01, "var_5": 0.05, "var_10": 0.1, "p95": 0.95}, 1_000_000)
    d = join_on(pr, q, "portfolio_id", "left")
    g = d.groupBy("portfolio_id").agg(
        *[F.max(c).alias(c) for c in ("var_1", "var_5", "var_10")],
        *[F.avg(F.when(r <= col(f"var_{k}"), r)).alias(f"cvar_{k}") for k in (1, 5, 10)],
        F.abs(div(F.max("p95"), F.max("var_5"))).alias("tail_ratio"), F.stddev_samp(F.when(r < 0, r)).alias("downside"),
        F.avg(r).alias("_m"))
    return g.withColumn("sortino", div("_m", "downside") * F.sqrt(F.lit(YEAR))).drop("_m")


def sharpe_test(pr: DataFrame, benchmark: float = 0.0, z: float = 1.959963984540054) -> DataFrame:
    """Jobson-Korkie standard error; the p-value uses the normal limit of the t distribution."""
    g = pr.groupBy("portfolio_id").agg(F.count("ret").alias("n"), (div(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.lit(YEAR)))
                                       .alias("sharpe")).filter("n >= 30")
    se = F.sqrt((1 + 0.5 * col("sharpe") * col("sharpe")) / col("n"))
    g = g.withColumn("se", se).withColumn("t", (col("sharpe") - benchmark) / col("se"))
    p = 2 * (1 - normal_cdf(F.abs("t")))
    return g.withColumns({"p_value": p, "significant": p < 0.05, "ci_low": col("sharpe") - z * col("se"),
                          "ci_high": col("sharpe") + z * col("se")})


def paired_diff_test(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two models' returns (keys, ret) on common keys."""
    j = a.select(*keys, col("ret").alias("ra")).join(b.select(*keys, col("ret").alias("rb")), list(keys))
    d = col("ra") - col("rb")
    g = j.agg(F.avg(d).alias("mean_diff"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se"), F.count(d).alias("n"))
    g = g.withColumn("t", div("mean_diff", "se"))
    return g.withColumns({"p_value": 2 * (1 - normal_cdf(F.abs("t"))), "better": F.when(col("mean_diff") > 0, "first").otherwise(
        "second")})


# Poisson(1): P(X <= k); beyond twelve the rest is below the step of the hash.
POISSON = np.cumsum([np.exp(-1) / math.factorial(k) for k in range(13)])


def resample_weights(ids: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) weights of rows x repetitions from the repeatable hash of (seed, row, repetition)."""
    ids = ids.astype(np.int64)
    u = mixed_hash(seed, ids[:, None], ids[:, None] // PRIME, reps[None, :])
    return np.searchsorted(POISSON, u, side="left").astype(float)


def _resampled(df: DataFrame, value: str, row_id: str) -> DataFrame:
    return df.select(col(row_id).cast("long").alias("_id"), finite(col(value).cast("double")).alias("_x")).dropna()


def _blocks(batches: Iterator[pd.DataFrame], rows: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for pdf in batches:
        ids, x = pdf["_id"].to_numpy(dtype=np.int64), pdf["_x"].to_numpy(dtype=float)
        for lo in range(0, len(x), rows):
            yield ids[lo:lo + rows], x[lo:lo + rows]


def bootstrap_sums(df: DataFrame, value: str, row_id: str, reps: int = 1000, seed: int = 42) -> DataFrame:
    """(rep, w, wx, wxx): sums under Poisson(1) resampling weights drawn from a hash of (seed, row, rep).

    Every task accumulates its rows into one line per rep, so neither row copies nor groups are shuffled and the result
    does not depend on the partitioning.  Null, NaN and infinite values are left out.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc, rep = np.zeros((3, reps)), np.arange(reps)
        for ids, x in _blocks(batches):
            w = resample_weights(ids, rep, seed)
            acc += np.stack([w.sum(0), w.T @ x, w.T @ (x * x)])
        yield pd.DataFrame({"rep": rep, "w": acc[0], "wx": acc[1], "wxx": acc[2]})

    out = _resampled(df, value, row_id).mapInPandas(run, "rep long, w double, wx double, wxx double")
    return out.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("w", "wx", "wxx")])


def bootstrap_quantiles(df: DataFrame, value: str, row_id: str, p: float = 0.5, reps: int = 1000, seed: int = 42) -> DataFrame:
    """(rep, stat): the exact ``p`` quantile (linear interpolation) of every weighted resample, of rows of any number.

    Cells of the value axis lie around the sample's own quantile, half a standard error wide.  A first pass sums the weights
    of (rep, cell); they tell the one or two cells in which a resample's quantile lies.  A second pass takes only rows of
    such cells and only for the repetitions that need them, about the root of the rows; a cell far out is taken the same way.
    """
    d = _resampled(df, value, row_id)
    n = d.count()
    if n == 0:
        return d.select(col("_id").alias("rep"), col("_x").alias("stat"))
    se = math.sqrt(p * (1 - p) / n)
    probs = {f"e{i}": min(max(p + z / 2 * se, 0.0), 1.0) for i, z in enumerate(range(-10, 11))}
    edges = np.unique([float(e) for e in exact_percentiles(d, [], "_x", probs).first()])  # 21 numbers

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rep, acc = np.arange(reps), np.zeros((len(edges) + 1, reps))
        for ids, x in _blocks(batches):
            np.add.at(acc, np.searchsorted(edges, x), resample_weights(ids, rep, seed))
        cell, at = np.nonzero(acc)
        yield pd.DataFrame({"rep": at, "cell": cell, "w": acc[cell, at]})

    cells = d.mapInPandas(weigh, "rep long, cell long, w double").groupBy("rep", "cell").agg(F.sum("w").alias("w"))
    by = Window.partitionBy("rep")  # at most 22 rows
    r = (F.sum("w").over(by) - 1) * p
    need = cells.select("rep", "cell", (F.sum("w").over(by.orderBy("cell")) - col("w")).alias("before"), "w", F.floor(r).alias("lo"),
                        F.ceil(r).alias("hi"), (r - F.floor(r)).alias("share"))
    need = need.filter((col("lo").between(col("before"), col("before") + col("w") - 1))
                       | (col("hi").between(col("before"), col("before") + col("w") - 1)))
    need = cut_lineage(need)
    wanted: dict[int, list[int]] = {}
    for row in need.select("cell", "rep").toLocalIterator():  # at most two rows a repetition
        wanted.setdefault(row.cell, []).append(row.rep)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, x in _blocks(batches):
            cell = np.searchsorted(edges, x)
            for c in np.unique(cell):
                rep = np.array(wanted.get(int(c), []), dtype=np.int64)
                if not len(rep):
                    continue
                values, place = np.unique(x[cell == c], return_inverse=True)
                acc = np.zeros((len(values), len(rep)))
                np.add.at(acc, place, resample_weights(ids[cell == c], rep, seed))
                v, at = np.nonzero(acc)
                yield pd.DataFrame({"rep": rep[at], "cell": int(c), "x": values[v], "m": acc[v, at]})

    rows = d.mapInPandas(pick, "rep long, cell long, x double, m double").groupBy("rep", "cell", "x").agg(F.sum("m").alias("m"))
    rows = rows.join(need, ["rep", "cell"])
    upto = col("before") + F.sum("m").over(Window.partitionBy("rep", "cell").orderBy("x"))
    rows = rows.withColumn("_upto", upto)
    inside_lo = (col("_upto") > col("lo")) & (col("lo") >= col("_upto") - col("m"))
    inside_hi = (col("_upto") > col("hi")) & (col("hi") >= col("_upto") - col("m"))
    low, high = F.max(F.when(inside_lo, col("x"))), F.max(F.when(inside_hi, col("x")))
    return rows.groupBy("rep").agg((low + (high - low) * F.max("share")).alias("stat"))


def bootstrap_callable(df: DataFrame, value: str, statistic: Callable[[np.ndarray, np.ndarray], float], reps: int = 1000,
                       seed: int = 42, cells: int = 4096) -> DataFrame:
    """(rep, stat) of any callable ``statistic(values, weights)``; rep -1 is the sample itself.

    The sample is reduced to at most ``cells`` values: its distinct values where there are no more (then resampling is
    exact), else cells of equal frequency by exact rank, each standing for its mean.  A cell of m rows gets a Poisson(m)
    weight, which is what its m rows would get together, so no row is touched a thousand times and no resample is ever
    one task's list of rows.  Repetitions are spread over tasks; each has its own seed, so a lost one comes back the same.
    """
    x = df.select(finite(col(value).cast("double")).alias("_x")).dropna()
    run = ordered_running(x, [], "_x", {"n": F.lit(1)})
    distinct = run.count()
    if distinct > cells:
        run = run.groupBy(F.floor((col("cum_n") - 1) * cells / col("all_n")).alias("_c")).agg(
            F.sum("n").alias("n"), (F.sum(col("_x") * col("n")) / F.sum("n")).alias("_x"))
    table = run.select("_x", "n").orderBy("_x").toPandas()  # at most ``cells`` rows
    values, counts = table["_x"].to_numpy(dtype=float), table["n"].to_numpy(dtype=float)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rep in pdf["rep"]:
                w = counts if rep < 0 else np.random.default_rng([seed, int(rep)]).poisson(counts).astype(float)
                out.append(float(statistic(values, w)) if w.sum() > 0 else None)
            yield pd.DataFrame({"rep": pdf["rep"], "stat": pd.Series(out, dtype="float64", index=pdf.index)})

    tasks = max(1, min(reps, df.sparkSession.sparkContext.defaultParallelism))
    return df.sparkSession.range(-1, reps, 1, tasks).withColumnRenamed("id", "rep").mapInPandas(draw, "rep long, stat double")


def trimmed_mean(values: np.ndarray, weights: np.ndarray) -> float:
    """Mean of the middle four fifths: a callable for ``bootstrap_callable``."""
    upto = weights.cumsum()
    low, high = upto[-1] * 0.1, upto[-1] * 0.9
    kept = (upto.clip(low, high) - (upto - weights).clip(low, high))
    return float((values * kept).sum() / kept.sum())


STATISTICS = {
    "mean": lambda: div("wx", "w"),
    "std": lambda: F.sqrt(div(col("wxx") - col("wx") * col("wx") / col("w"), col("w") - 1)),
    "sharpe": lambda: div(div("wx", "w"), F.sqrt(div(col("wxx") - col("wx") * col("wx") / col("w"), col("w") - 1))) * F.sqrt(F.lit(YEAR)),
}


def bootstrap_ci(df: DataFrame, value: str, row_id: str, statistic: str | float | Callable = "mean", reps: int = 1000,
                 level: float = 0.95, seed: int = 42) -> DataFrame:
    """Mean, spread and percentile interval of a statistic over resamples.

    ``statistic``: a name of ``STATISTICS``, "median", a number (that quantile), or a callable of (values, weights).
    """
    if callable(statistic):
        s = bootstrap_callable(df, value, statistic, reps, seed).filter("rep >= 0")
    elif statistic == "median" or not isinstance(statistic, str):
        s = bootstrap_quantiles(df, value, row_id, 0.5 if statistic == "median" else float(statistic), reps, seed)
    else:
        s = bootstrap_sums(df, value, row_id, reps, seed).withColumn("stat", STATISTICS[statistic]())
    a = (1 - level) / 2
    return s.agg(F.avg("stat").alias("boot_mean"), F.stddev_pop("stat").alias("boot_std"),
                 F.percentile("stat", a).alias("low"), F.percentile("stat", 1 - a).alias("high"))


# ------------------------------------------------------------------ predictions

def confusion(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, "actual", "pred").agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Per class precision, recall, F1, specificity; accuracy and support-weighted F1 per key."""
    keys = list(keys)
    c = confusion(df, keys)
    long = c.select(*keys, F.inline(F.array(
        F.struct(col("actual").alias("cls"), col("n").alias("fn_all"), F.lit(0).cast("long").alias("fp_all"),
                 F.when(col("actual") == col("pred"), col("n")).otherwise(0).alias("tp")),
        F.struct(col("pred").alias("cls"), F.lit(0).cast("long").alias("fn_all"), col("n").alias("fp_all"),
                 F.lit(0).cast("long").alias("tp")))))
    g = long.groupBy(*keys, "cls").agg(F.sum("tp").alias("tp"), F.sum("fn_all").alias("support"), F.sum("fp_all").alias("said"))
    w = Window.partitionBy(*keys)
    g = g.withColumns({"total": F.sum("support").over(w), "accuracy": F.sum("tp").over(w) / F.sum("support").over(w)})
    g = g.withColumns({"precision": F.coalesce(div("tp", "said"), F.lit(0.0)), "recall": F.coalesce(div("tp", "support"), F.lit(0.0)),
                       "specificity": div(col("total") - col("support") - (col("said") - col("tp")), col("total") - col("support"))})
    g = g.withColumn("f1", F.coalesce(div(2 * col("precision") * col("recall"), col("precision") + col("recall")), F.lit(0.0)))
    return g.withColumn("weighted_f1", F.sum(col("f1") * col("support")).over(w) / col("total"))


def regression_metrics(df: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    e = col("score") - col("actual")
    g = df.groupBy(*keys).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("actual").alias("_v"),
                              correlation("score", "actual").alias("ic"))
    return g.withColumns({"rmse": F.sqrt("mse"), "r2": 1 - div("mse", "_v")}).drop("_v")


def best_threshold(df: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Threshold with the largest F1; ties go to the higher threshold."""
    run = ordered_running(df, list(keys), "score", {"n": F.lit(1), "pos": col("actual")}, descending=True)
    f1 = 2 * col("cum_pos") / (col("cum_n") + col("all_pos"))
    run = run.withColumn("f1", f1)
    return run.groupBy(*keys).agg(F.max_by("score", F.struct("f1", "score")).alias("threshold"), F.max("f1").alias("f1"))


def rank_models(metrics: DataFrame, higher: Sequence[str], lower: Sequence[str]) -> DataFrame:
    """Rank per metric and the Borda total; one row per model."""
    items = F.array(*[F.struct(F.lit(m).alias("metric"), (col(m) if m in higher else -col(m)).alias("v"))
                      for m in (*higher, *lower)])
    d = metrics.select("model", F.inline(items))
    d = d.withColumn("rank", F.rank().over(Window.partitionBy("metric").orderBy(col("v").desc())))
    n = len(higher) + len(lower)
    g = d.groupBy("model").agg(F.avg("rank").alias("avg_rank"), F.sum(F.lit(n) - col("rank")).alias("borda"))
    return g.withColumn("overall", F.rank().over(Window.partitionBy(F.lit(1)).orderBy("avg_rank")))


# Grade letters from 50 points in steps of five.
LETTERS = ("A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-")


def model_grade(m: DataFrame) -> DataFrame:
    def pts(c, cuts, up=True):
        e = None
        for x, p in cuts:
            cond = col(c) > x if up else col(c) < x
            e = F.when(cond, p) if e is None else e.when(cond, p)
        return e.otherwise(0)
    m = m.withColumn("_dd", F.abs("max_drawdown"))
    s = (pts("sharpe", ((2, 30), (1.5, 25), (1, 20), (0.5, 10))) + pts("_dd", ((0.05, 25), (0.10, 20), (0.20, 15), (0.30, 10)), False)
         + pts("hit_rate", ((0.6, 15), (0.55, 10))) + pts("profit_factor", ((2, 15), (1.5, 10)))
         + F.when(col("significant"), 15).otherwise(0))
    e = None
    for i, letter in enumerate(LETTERS):
        cond = col("points") >= 90 - 5 * i
        e = F.when(cond, letter) if e is None else e.when(cond, letter)
    return m.withColumn("points", F.least(s, F.lit(100))).withColumn("grade", e.otherwise("F")).drop("_dd")


def residual_diag(df: DataFrame, lags: int = 10, s: Ordered = Ordered()) -> DataFrame:
    """Residual moments, autocorrelations and Ljung-Box Q per symbol over one row per bar."""
    mean = F.avg("resid").over(Window.partitionBy(*s.keys))
    d = df.withColumn("_e", col("resid") - mean)
    d = d.withColumns({f"_l{k}": col("_e") * s.lag("_e", k) for k in range(1, lags + 1)})
    ss = F.sum(col("_e") * col("_e"))
    g = d.groupBy(*s.keys).agg(F.avg("resid").alias("mean"), F.stddev_pop("resid").alias("sd"), F.skewness("resid").alias("skew"),
                               F.kurtosis("resid").alias("kurt"), F.count("resid").alias("n"),
                               *[div(F.sum(f"_l{k}"), ss).alias(f"acf_{k}") for k in range(1, lags + 1)])
    q = sum((col(f"acf_{k}") * col(f"acf_{k}") / (col("n") - k) for k in range(1, lags + 1)), F.lit(0.0))
    return g.withColumn("ljung_box", col("n") * (col("n") + 2) * q)


# ------------------------------------------------------------------ drift

def drift_ks(df: DataFrame, value: str, is_new: Column, threshold: float = 0.05, resolution: int = 4096) -> DataFrame:
    """Two-sample statistic from running counts over the merged values; asymptotic p-value."""
    d = df.select(col(value).alias("v"), F.when(is_new, 0).otherwise(1).alias("b"), F.when(is_new, 1).otherwise(0).alias("c"))
    run = ordered_running(d, [], "v", {"nb": col("b"), "nc": col("c")}, resolution)
    g = run.agg(F.max(F.abs(div("cum_nb", "all_nb") - div("cum_nc", "all_nc"))).alias("d"), F.max("all_nb").alias("nb"),
                F.max("all_nc").alias("nc"))
    x = F.sqrt(col("nb") * col("nc") / (col("nb") + col("nc"))) * col("d")
    p = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * x * x) for k in range(1, 21)), F.lit(0.0))
    g = g.withColumn("p_value", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
    return g.withColumns({"drift": col("p_value") < threshold, "severity": F.when(col("p_value") < threshold / 10, "high").when(
        col("p_value") < threshold / 2, "medium").when(col("p_value") < threshold, "low").otherwise("none")})


def _histogram(df, value, is_new, bins, lo, hi) -> DataFrame:
    b = F.least(F.floor((col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins), F.lit(bins - 1))
    d = df.filter(col(value).between(lo, hi)).groupBy(b.alias("bin")).agg(F.count_if(~is_new).alias("nb"), F.count_if(is_new).alias("nc"))
    grid = df.sparkSession.range(bins).select(col("id").alias("bin"))
    return grid.join(d, "bin", "left").fillna(0, ["nb", "nc"])


def drift_psi(df: DataFrame, value: str, is_new: Column, bins: int = 10) -> DataFrame:
    """Equal-width bins of the baseline; values outside its range fall into no bin."""
    one = df.agg(F.struct(F.min(F.when(~is_new, col(value))).alias("lo"), F.max(F.when(~is_new, col(value))).alias("hi"),
                          F.count_if(~is_new).alias("nb"), F.count_if(is_new).alias("nc"))).scalar()
    h = _histogram(df, value, is_new, bins, one["lo"], one["hi"])
    p, q = col("nb") / one["nb"], col("nc") / one["nc"]
    p, q = F.when(p == 0, 0.0001).otherwise(p), F.when(q == 0, 0.0001).otherwise(q)
    g = h.agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))
    return g.withColumns({"drift": col("psi") > 0.2, "severity": F.when(col("psi") > 0.25, "high").when(
        col("psi") > 0.2, "medium").when(col("psi") > 0.1, "low").otherwise("none")})


def drift_js(df: DataFrame, value: str, is_new: Column, bins: int = 50) -> DataFrame:
    one = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_if(~is_new).alias("nb"),
                          F.count_if(is_new).alias("nc"))).scalar()
    h = _histogram(df, value, is_new, bins, one["lo"], one["hi"])
    eps = 1e-10
    p, q = col("nb") / one["nb"] + eps, col("nc") / one["nc"] + eps
    total = 1 + bins * eps
    p, q = p / total, q / total
    mid = ((col("nb") / one["nb"] + eps) + (col("nc") / one["nc"] + eps)) / 2 / total
    g = h.agg((0.5 * F.sum(p * F.ln(p / mid)) + 0.5 * F.sum(q * F.ln(q / mid))).alias("js"))
    return g.withColumns({"drift": col("js") > 0.1, "severity": F.when(col("js") > 0.2, "high").when(
        col("js") > 0.1, "medium").when(col("js") > 0.05, "low").otherwise("none")})


def degradation_alerts(current: DataFrame, baseline: DataFrame, lower_is_better: Sequence[str] = ("mse", "mae", "rmse"),
                       limit: float = 0.10) -> DataFrame:
    """(model, metric, value) now and before: relative change in the bad direction."""
    j = current.join(baseline.withColumnRenamed("value", "base"), ["model", "metric"])
    change = div(col("base") - col("value"), F.abs("base"))
    worse = F.when(col("metric").isin(list(lower_is_better)), -change).otherwise(change)
    return j.withColumn("degradation", worse).filter(col("degradation") > limit).withColumn("severity", F.when(
        col("degradation") > 0.25, "high").when(col("degradation") > 0.15, "medium").otherwise("low"))


def threshold_alerts(m: DataFrame, accuracy: float = 0.5, sharpe: float = 0.5, drawdown: float = 0.2) -> DataFrame:
    """A drawdown alert fires when the drawdown is deeper than the limit."""
    rules = F.array_compact(F.array(
        F.when(col("accuracy") < accuracy, F.struct(F.lit("accuracy").alias("metric"), col("accuracy").alias("value"))),
        F.when(col("sharpe") < sharpe, F.struct(F.lit("sharpe").alias("metric"), col("sharpe").alias("value"))),
        F.when(F.abs("max_drawdown") > drawdown, F.struct(F.lit("max_drawdown").alias("metric"), col("max_drawdown").alias("value")))))
    return m.select("model", F.inline(rules))


# ------------------------------------------------------------------ ensembles

def ensemble_vote(p: DataFrame, weights: DataFrame, row: str = "event_id") -> DataFrame:
    """Long predictions (row, model, score, pred) to soft, hard and weighted votes; a row has one entry per model."""
    j = p.join(weights.select("model", "w"), "model")
    g = j.groupBy(row).agg(F.avg("score").alias("soft"), div(F.sum(col("score") * col("w")), F.sum("w")).alias("weighted"),
                           F.sum(F.when(col("pred") == 1, 1).otherwise(-1)).alias("_v"))
    return g.withColumn("hard", F.when(col("_v") > 0, 1).otherwise(0)).drop("_v")


def wide_predictions(p: DataFrame, models: Sequence[str], row: str = "event_id") -> DataFrame:
    return p.groupBy(row).agg(*[F.max(F.when(col("model") == m, col(c))).alias(f"{c}_{m}") for m in models for c in ("score", "pred")],
                              F.max("actual").alias("actual"))


def ensemble_diversity(p: DataFrame, models: Sequence[str]) -> DataFrame:
    """Pair statistics as columns of one aggregation over one row per example; the model list is a parameter."""
    w = wide_predictions(p, models)
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
    aggs = []
    for a, b in pairs:
        pa, pb = col(f"pred_{a}"), col(f"pred_{b}")
        n = {k: F.count_if((pa == int(k[0])) & (pb == int(k[1]))) for k in ("11", "10", "01", "00")}
        ad, bc = n["11"] * n["00"], n["10"] * n["01"]
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(f"score_{a}", f"score_{b}").alias("corr"),
                             (F.count_if(pa != pb) / F.count(F.lit(1))).alias("disagreement"),
                             ((ad - bc) / (ad + bc + 1e-10)).alias("q")))
    return w.agg(F.array(*aggs).alias("s")).select(F.inline("s"))


def meta_features(p: DataFrame, models: Sequence[str]) -> DataFrame:
    w = wide_predictions(p, models)
    xs = F.array(*[col(f"score_{m}") for m in models])
    n = len(models)
    mean = sum((col(f"score_{m}") for m in models), F.lit(0.0)) / n
    var = sum((F.pow(col(f"score_{m}") - mean, F.lit(2.0)) for m in models), F.lit(0.0)) / n
    dis = [F.when(col(f"pred_{a}") != col(f"pred_{b}"), 1).otherwise(0) for i, a in enumerate(models) for b in models[i + 1:]]
    conf = [F.greatest(col(f"score_{m}"), 1 - col(f"score_{m}")) for m in models]
    return w.withColumns({"disagreement": sum(dis, F.lit(0)) / len(dis), "score_std": F.sqrt(var),
                          "score_range": F.array_max(xs) - F.array_min(xs), "conf_mean": sum(conf, F.lit(0.0)) / n,
                          "conf_min": F.least(*conf)})


def performance_weights(m: DataFrame, metric: str = "weighted_f1") -> DataFrame:
    """One row per model; weights proportional to the clipped metric, equal when all are zero."""
    v = F.greatest(col(metric), F.lit(0.0))
    w = Window.partitionBy(F.lit(1))
    return m.select("model", F.coalesce(div(v, F.sum(v).over(w)), 1 / F.count(F.lit(1)).over(w)).alias("w"))
