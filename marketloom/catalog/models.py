"""Evaluation, drift, ensemble and model-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import col
from ..operators import evaluate as ev
from ..operators import mldata as ml
from ..operators import regime as rg
from ..operators import risk as rk
from ..operators import technical as tech
from . import risk as _risk  # noqa: F401  (defines shared tables)
from .base import add_base, mixed_sql, normal_sql, query, unit_sql
from .risk import dds, pret
from .technical import W, roll

MODELS = ("a", "b", "c")
add_base("preds", """SELECT *, CAST(score > 0.5 AS INT) AS pred FROM (SELECT event_id, ts, m AS model, ((qty * (CASE m WHEN 'a' THEN 3 WHEN 'b'
    THEN 7 ELSE 11 END) + event_id) % 101) / 100 AS score, CAST(price > 100.7 AS INT) AS actual FROM ticks, (SELECT unnest(['a', 'b', 'c']) AS
    m))""")


def preds(m):
    k = F.array(*[F.struct(F.lit(n).alias("model"), ((col("qty") * x + col("event_id")) % 101 / 100).alias("score"))
                  for n, x in zip(MODELS, (3, 7, 11))])
    t = m.ticks().select("event_id", "ts", F.when(col("price") > 100.7, 1).otherwise(0).alias("actual"), F.inline(k))
    return t.withColumn("pred", F.when(col("score") > 0.5, 1).otherwise(0))


_ret = ("total_return annual_return volatility max_drawdown avg_drawdown hit_rate avg_win avg_loss profit_factor sharpe "
        "var_5 cvar_5").split()
add_base("ret_metrics", """SELECT * FROM (SELECT portfolio_id, arg_max(equity, ts) - 1 AS total_return, (1 + avg(ret)) ** 252 - 1 AS annual_return,
    stddev_samp(ret) * sqrt(252) AS volatility, min(drawdown) AS max_drawdown, avg(drawdown) FILTER (drawdown < 0) AS avg_drawdown,
    count(*) FILTER (ret > 0) / count(*) AS hit_rate, avg(ret) FILTER (ret > 0) AS avg_win, avg(ret) FILTER (ret < 0) AS avg_loss, sum(ret)
    FILTER (ret > 0) / abs(sum(ret) FILTER (ret < 0)) AS profit_factor, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, quantile_cont(ret,
    0.05) AS var_5 FROM dds GROUP BY 1) JOIN (SELECT portfolio_id, max(bars) AS drawdown_duration FROM dd_runs GROUP BY 1) USING (portfolio_id)
    JOIN (SELECT p.portfolio_id, avg(ret) AS cvar_5 FROM pret p JOIN (SELECT portfolio_id, quantile_cont(ret, 0.05) AS q FROM pret GROUP BY 1) x
    ON x.portfolio_id = p.portfolio_id AND ret <= q GROUP BY 1) USING (portfolio_id)""")


@query("eval_return_metrics", "portfolio_id:i drawdown_duration:i " + " ".join(f"{c}:d" for c in _ret), "SELECT * FROM ret_metrics")
def _metrics(m):
    d = dds(m)
    return ev.return_metrics(d, rk.drawdown_periods(d))


@query("eval_risk_tail", "portfolio_id:i var_1:d var_5:d var_10:d cvar_1:d cvar_5:d cvar_10:d tail_ratio:d downside:d sortino:d", """SELECT
    portfolio_id, any_value(q1) AS var_1, any_value(q5) AS var_5, any_value(q10) AS var_10, avg(ret) FILTER (ret <= q1) AS cvar_1, avg(ret) FILTER
    (ret <= q5) AS cvar_5, avg(ret) FILTER (ret <= q10) AS cvar_10, abs(any_value(q95) / any_value(q5)) AS tail_ratio, stddev_samp(ret) FILTER
    (ret < 0) AS downside, avg(ret) / stddev_samp(ret) FILTER (ret < 0) * sqrt(252) AS sortino FROM pret JOIN (SELECT portfolio_id,
    quantile_cont(ret, 0.01) AS q1, quantile_cont(ret, 0.05) AS q5, quantile_cont(ret, 0.1) AS q10, quantile_cont(ret, 0.95) AS q95 FROM pret
    GROUP BY 1) USING (portfolio_id) GROUP BY 1""")
def _tail(m):
    return ev.risk_tail(pret(m))


@query("eval_sharpe_test", "portfolio_id:i sharpe:d se:d t:d significant:b ci_low:d ci_high:d", """SELECT *, sharpe / se AS t, abs(sharpe / se) >
    1.959963984540054 AS significant, sharpe - 1.959963984540054 * se AS ci_low, sharpe + 1.959963984540054 * se AS ci_high FROM (SELECT *,
    sqrt((1 + 0.5 * sharpe * sharpe) / n) AS se FROM (SELECT portfolio_id, count(*) AS n, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe FROM
    pret GROUP BY 1))""")
def _sharpe(m):
    return ev.sharpe_test(pret(m))


@query("eval_paired_difference", "mean_diff:d8 se:d8 t:d n:i better", """SELECT *, mean_diff / se AS t, CASE WHEN mean_diff > 0 THEN 'first' ELSE
    'second' END AS better FROM (SELECT avg(a.ret - b.ret) AS mean_diff, stddev_samp(a.ret - b.ret) / sqrt(count(*)) AS se, count(*) AS n FROM
    pret a JOIN pret b USING (ts) WHERE a.portfolio_id = 1 AND b.portfolio_id = 2)""")
def _paired(m):
    p = pret(m)
    return ev.paired_diff_test(p.filter("portfolio_id = 1"), p.filter("portfolio_id = 2"), ["ts"])


_interval = "boot_mean:d boot_std:d low:d high:d"
# quantiles of prices with few decimals: at six places means of resamples lie on ties
_fine = "boot_mean:d9 boot_std:d9 low:d9 high:d9"


def boot_sql(reps: int, body: str) -> str:
    """Interval of a statistic: ``body`` takes (rep, x, w), the rows with their weights in every repetition, to (stat)."""
    rows = mixed_sql(f"(SELECT event_id AS id, price AS x, rep FROM ticks, range({reps}) t(rep) WHERE price IS NOT NULL)", 42, "id",
                     "id // 2147483647", "rep")
    steps = " + ".join(f"(u > {float(t)!r}::DOUBLE)::INT" for t in ev.POISSON)
    return f"""SELECT avg(stat) AS boot_mean, stddev_pop(stat) AS boot_std, quantile_cont(stat, 0.025) AS low, quantile_cont(stat, 0.975) AS high
        FROM (WITH r AS (SELECT rep, x, {steps} AS w FROM {rows}) {body})"""


_sums = "(SELECT rep, sum(w) AS w, sum(w * x) AS wx, sum(w * x * x) AS wxx FROM r GROUP BY 1)"


@query("eval_bootstrap_ci", _interval, boot_sql(1000, f"SELECT wx / w AS stat FROM {_sums}"))
def _boot(m):
    return ev.bootstrap_ci(m.ticks(), "price", "event_id", "mean")


@query("eval_bootstrap_sharpe", _interval, boot_sql(1000, f"SELECT wx / w / sqrt((wxx - wx * wx / w) / (w - 1)) * sqrt(252) AS stat FROM {_sums}"))
def _boot_sharpe(m):
    return ev.bootstrap_ci(m.ticks(), "price", "event_id", "sharpe")


def quantile_stat(p: float) -> str:
    return f"""SELECT lo + (hi - lo) * share AS stat FROM (SELECT rep, max(pos - floor(pos)) AS share, min(x) FILTER (upto > floor(pos)) AS lo,
        min(x) FILTER (upto > ceil(pos)) AS hi FROM (SELECT rep, x, sum(w) OVER (PARTITION BY rep ORDER BY x) AS upto,
        (sum(w) OVER (PARTITION BY rep) - 1) * {p}::DOUBLE AS pos FROM r WHERE w > 0) GROUP BY rep)"""


@query("eval_bootstrap_median", _fine, boot_sql(200, quantile_stat(0.5)))
def _boot_median(m):
    return ev.bootstrap_ci(m.ticks(), "price", "event_id", "median", reps=200)


@query("eval_bootstrap_tail", _fine, boot_sql(200, quantile_stat(0.05)))
def _boot_tail(m):
    return ev.bootstrap_ci(m.ticks(), "price", "event_id", 0.05, reps=200)


@query("eval_bootstrap_callable", _interval)
def _boot_callable(m):
    return ev.bootstrap_ci(m.ticks(), "price", "event_id", ev.trimmed_mean)


_cls = "model cls:i precision:d recall:d f1:d specificity:d accuracy:d weighted_f1:d"
add_base("cls", """SELECT *, sum(f1 * sup) OVER (PARTITION BY model) / n AS weighted_f1 FROM (SELECT *, coalesce(2 * precision * recall /
    nullif(precision + recall, 0), 0) AS f1 FROM (SELECT model, c AS cls, count(*) AS n, count(*) FILTER (actual = c) AS sup, coalesce(count(*)
    FILTER (actual = c AND pred = c) / nullif(count(*) FILTER (pred = c), 0), 0) AS precision, coalesce(count(*) FILTER (actual = c AND pred = c) /
    nullif(count(*) FILTER (actual = c), 0), 0) AS recall, count(*) FILTER (actual <> c AND pred <> c) / count(*) FILTER (actual <> c) AS
    specificity, count(*) FILTER (actual = pred) / count(*) AS accuracy FROM preds, (SELECT unnest([0, 1]) AS c) GROUP BY 1, 2))""")


@query("eval_classification", _cls, "SELECT * FROM cls")
def _class(m):
    return ev.classification_metrics(preds(m))


@query("eval_classification_labels", "cls:i precision:d recall:d f1:d accuracy:d", """SELECT c AS cls, precision, recall, coalesce(2 * precision *
    recall / nullif(precision + recall, 0), 0) AS f1, accuracy FROM (SELECT c, coalesce(count(*) FILTER (quality = c AND toxic = c) /
    nullif(count(*) FILTER (toxic = c), 0), 0) AS precision, count(*) FILTER (quality = c AND toxic = c) / count(*) FILTER (quality = c) AS recall,
    count(*) FILTER (quality = toxic) / count(*) AS accuracy FROM labels, (SELECT unnest([0, 1]) AS c) GROUP BY 1)""")
def _labels(m):
    d = m.raw("labels").select(F.lit("x").alias("model"), col("quality").alias("actual"), col("toxic").alias("pred"))
    return ev.classification_metrics(d)


add_base("regm", """SELECT model, avg((score - actual) ** 2) AS mse, avg(abs(score - actual)) AS mae, sqrt(avg((score - actual) ** 2)) AS rmse, 1 -
    avg((score - actual) ** 2) / var_pop(actual) AS r2, corr(score, actual) AS ic FROM preds GROUP BY 1""")


@query("eval_regression", "model mse:d mae:d rmse:d r2:d ic:d", "SELECT * FROM regm")
def _reg(m):
    return ev.regression_metrics(preds(m))


@query("eval_information_coefficient", "symbol ic:d", """SELECT symbol, corr(v, ret) AS ic FROM (SELECT symbol, ts, avg(score) AS v FROM (SELECT
    symbol, date_trunc('hour', ts) AS ts, score FROM sent) GROUP BY 1, 2) JOIN rets USING (symbol, ts) GROUP BY 1""")
def _ic(m):
    s = m.sentiment().groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("score").alias("score"))
    d = s.join(m.returns(), ["symbol", "ts"]).withColumn("actual", col("ret"))
    return ev.regression_metrics(d, ["symbol"])


@query("eval_best_threshold", "model threshold:d f1:d", """SELECT model, arg_max(t, f * 1e6 + t) AS threshold, max(f) AS f1 FROM (SELECT p.model, t,
    2 * count(*) FILTER (score >= t AND actual = 1) / (count(*) FILTER (score >= t) + sum(actual)) AS f FROM preds p JOIN (SELECT DISTINCT model,
    score AS t FROM preds) s ON s.model = p.model GROUP BY 1, 2) GROUP BY 1""")
def _thr(m):
    return ev.best_threshold(preds(m))


@query("eval_rank_models", "model avg_rank:d borda:i overall:i", """SELECT *, rank() OVER (ORDER BY avg_rank) AS overall FROM (SELECT model, (r1 + r2 +
    r3) / 3 AS avg_rank, 9 - r1 - r2 - r3 AS borda FROM (SELECT model, rank() OVER (ORDER BY r2 DESC) AS r1, rank() OVER (ORDER BY ic DESC) AS r2,
    rank() OVER (ORDER BY mae) AS r3 FROM regm))""")
def _rank(m):
    return ev.rank_models(ev.regression_metrics(preds(m)), ["r2", "ic"], ["mae"])


@query("eval_model_grade", "portfolio_id:i points:i grade", """SELECT *, CASE WHEN points >= 90 THEN 'A+' WHEN points >= 85 THEN 'A' WHEN points >= 80
    THEN 'A-' WHEN points >= 75 THEN 'B+' WHEN points >= 70 THEN 'B' WHEN points >= 65 THEN 'B-' WHEN points >= 60 THEN 'C+' WHEN points >= 55 THEN
    'C' WHEN points >= 50 THEN 'C-' ELSE 'F' END AS grade FROM (SELECT portfolio_id, CASE WHEN sharpe > 2 THEN 30 WHEN sharpe > 1.5 THEN 25 WHEN
    sharpe > 1 THEN 20 WHEN sharpe > 0.5 THEN 10 ELSE 0 END + CASE WHEN -max_drawdown < 0.05 THEN 25 WHEN -max_drawdown < 0.1 THEN 20 WHEN
    -max_drawdown < 0.2 THEN 15 WHEN -max_drawdown < 0.3 THEN 10 ELSE 0 END + CASE WHEN hit_rate > 0.6 THEN 15 WHEN hit_rate > 0.55 THEN 10 ELSE 0
    END + CASE WHEN profit_factor > 2 THEN 15 WHEN profit_factor > 1.5 THEN 10 ELSE 0 END + CASE WHEN abs(sharpe / sqrt((1 + 0.5 * sharpe *
    sharpe) / 719)) > 1.959963984540054 THEN 15 ELSE 0 END AS points FROM ret_metrics)""")
def _grade(m):
    d = dds(m)
    r = ev.return_metrics(d, rk.drawdown_periods(d)).join(ev.sharpe_test(d).select("portfolio_id", "significant"), "portfolio_id")
    return ev.model_grade(r)


@query("eval_residual_diagnostics", "symbol mean:d8 sd:d n:i acf_1:d acf_2:d acf_10:d ljung_box:d", f"""WITH e AS (SELECT symbol, ts, ret - avg(ret) OVER
    (PARTITION BY symbol) AS e, ret FROM rets), l AS (SELECT *, {', '.join(f'e * lag(e, {k}) OVER ({W}) AS l{k}' for k in range(1, 11))} FROM e),
    g AS (SELECT symbol, avg(ret) AS mean, stddev_pop(ret) AS sd, count(*) AS n, {', '.join(f'sum(l{k}) / sum(e * e) AS acf_{k}' for k in range(1, 11))}
    FROM l GROUP BY 1) SELECT *, n * (n + 2) * ({' + '.join(f'acf_{k} ** 2 / (n - {k})' for k in range(1, 11))}) AS ljung_box FROM g""")
def _resid(m):
    return ev.residual_diag(m.returns().withColumnRenamed("ret", "resid"))


_NEW = "ts >= TIMESTAMP '2024-01-20'"
IS_NEW = "ts >= timestamp_ntz'2024-01-20'"


@query("drift_ks", "d:d p_value:d drift:b severity", f"""SELECT d, p AS p_value, p < 0.05 AS drift, CASE WHEN p < 0.005 THEN 'high' WHEN p < 0.025 THEN
    'medium' WHEN p < 0.05 THEN 'low' ELSE 'none' END AS severity FROM (SELECT d, least(1, greatest(0, (SELECT sum(2 * (-1.0) ** (k - 1) * exp(-2 * k *
    k * x * x)) FROM (SELECT unnest(range(1, 21)) AS k)))) AS p FROM (SELECT d, sqrt(nb * nc / (nb + nc)) * d AS x FROM (SELECT max(abs(cb / nb - cc /
    nc)) AS d, max(nb) AS nb, max(nc) AS nc FROM (SELECT sum(b) OVER (ORDER BY price) AS cb, sum(c) OVER (ORDER BY price) AS cc, sum(b) OVER () AS nb,
    sum(c) OVER () AS nc FROM (SELECT price, count(*) FILTER (NOT {_NEW}) AS b, count(*) FILTER ({_NEW}) AS c FROM ticks GROUP BY 1)))))""")
def _ks(m):
    return ev.drift_ks(m.ticks(), "price", F.expr(IS_NEW))


_sev = "CASE WHEN {0} > {1} THEN 'high' WHEN {0} > {2} THEN 'medium' WHEN {0} > {3} THEN 'low' ELSE 'none' END AS severity"


@query("drift_psi", "psi:d drift:b severity", f"""SELECT psi, psi > 0.2 AS drift, {_sev.format('psi', 0.25, 0.2, 0.1)} FROM (SELECT sum((q - p) * ln(q / p))
    AS psi FROM (SELECT CASE WHEN b = 0 THEN 0.0001 ELSE b / nb END AS p, CASE WHEN c = 0 THEN 0.0001 ELSE c / nc END AS q FROM (SELECT k, count(*)
    FILTER (bin = k AND NOT {_NEW}) AS b, count(*) FILTER (bin = k AND {_NEW}) AS c, any_value(nb) AS nb, any_value(nc) AS nc FROM (SELECT *, CASE WHEN
    price BETWEEN lo AND hi THEN least(floor((price - lo) / (hi - lo) * 10), 9) END AS bin FROM ticks, (SELECT min(price) FILTER (NOT {_NEW}) AS lo,
    max(price) FILTER (NOT {_NEW}) AS hi, count(*) FILTER (NOT {_NEW}) AS nb, count(*) FILTER ({_NEW}) AS nc FROM ticks)), (SELECT unnest(range(0, 10))
    AS k) GROUP BY k)))""")
def _psi(m):
    return ev.drift_psi(m.ticks(), "price", F.expr(IS_NEW))


@query("drift_js", "js:d8 drift:b severity", f"""SELECT js, js > 0.1 AS drift, {_sev.format('js', 0.2, 0.1, 0.05)} FROM (SELECT 0.5 * sum(p * ln(p / m)) + 0.5
    * sum(q * ln(q / m)) AS js FROM (SELECT p, q, (p + q) / 2 AS m FROM (SELECT (b / nb + 1e-10) / (1 + 50e-10) AS p, (c / nc + 1e-10) / (1 + 50e-10) AS
    q FROM (SELECT k, count(*) FILTER (bin = k AND NOT {_NEW}) AS b, count(*) FILTER (bin = k AND {_NEW}) AS c, any_value(nb) AS nb, any_value(nc) AS nc
    FROM (SELECT *, least(floor((price - lo) / (hi - lo) * 50), 49) AS bin FROM ticks, (SELECT min(price) AS lo, max(price) AS hi, count(*) FILTER (NOT
    {_NEW}) AS nb, count(*) FILTER ({_NEW}) AS nc FROM ticks)), (SELECT unnest(range(0, 50)) AS k) GROUP BY k))))""")
def _js(m):
    return ev.drift_js(m.ticks(), "price", F.expr(IS_NEW))


def metric_rows(m, cond):
    g = ev.regression_metrics(preds(m).filter(cond))
    return g.select("model", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), col(k).alias("value")) for k in ("mse", "mae", "ic")])))


add_base("mrows", f"""SELECT model, n, metric, CASE metric WHEN 'mse' THEN mse WHEN 'mae' THEN mae ELSE ic END AS value FROM (SELECT model, {_NEW} AS n,
    avg((score - actual) ** 2) AS mse, avg(abs(score - actual)) AS mae, corr(score, actual) AS ic FROM preds GROUP BY 1, 2), (SELECT unnest(['mse',
    'mae', 'ic']) AS metric)""")


@query("monitor_degradation_alerts", "model metric value:d base:d degradation:d severity", """SELECT *, CASE WHEN degradation > 0.25 THEN 'high' WHEN
    degradation > 0.15 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT a.model, a.metric, a.value, b.value AS base, (b.value - a.value) /
    abs(b.value) * (CASE WHEN a.metric = 'ic' THEN 1 ELSE -1 END) AS degradation FROM mrows a JOIN mrows b ON a.model = b.model AND a.metric = b.metric
    AND a.n AND NOT b.n) WHERE degradation > 0.0001""")
def _degr(m):
    return ev.degradation_alerts(metric_rows(m, IS_NEW), metric_rows(m, f"NOT ({IS_NEW})"), limit=0.0001)


@query("monitor_threshold_alerts", "model:i metric value:d", """SELECT portfolio_id AS model, 'accuracy' AS metric, hit_rate AS value FROM ret_metrics
    WHERE hit_rate < 0.5 UNION ALL SELECT portfolio_id, 'sharpe', sharpe FROM ret_metrics WHERE sharpe < 0.5 UNION ALL SELECT portfolio_id,
    'max_drawdown', max_drawdown FROM ret_metrics WHERE abs(max_drawdown) > 0.02""")
def _thresholds(m):
    d = dds(m)
    r = ev.return_metrics(d, rk.drawdown_periods(d)).select(col("portfolio_id").alias("model"), col("hit_rate").alias("accuracy"), "sharpe",
                                                           "max_drawdown")
    return ev.threshold_alerts(r, drawdown=0.02)


add_base("wts", "SELECT model, weighted_f1 / sum(weighted_f1) OVER () AS w FROM (SELECT DISTINCT model, weighted_f1 FROM cls)")


def weights(m):
    c = ev.classification_metrics(preds(m)).select("model", "weighted_f1").distinct()
    return ev.performance_weights(c)


@query("ensemble_performance_weights", "model w:d", "SELECT * FROM wts")
def _weights(m):
    return weights(m)


@query("ensemble_vote", "event_id:i soft:d weighted:d8 hard:i", """SELECT event_id, avg(score) AS soft, sum(score * w) / sum(w) AS weighted, CAST(sum(pred)
    >= 2 AS INT) AS hard FROM preds JOIN wts USING (model) GROUP BY 1""")
def _vote(m):
    return ev.ensemble_vote(preds(m), weights(m))


@query("ensemble_diversity", "a b corr:d disagreement:d q:d", """SELECT x.model AS a, y.model AS b, corr(x.score, y.score) AS corr, count(*) FILTER (x.pred
    <> y.pred) / count(*) AS disagreement, (count(*) FILTER (x.pred = 1 AND y.pred = 1) * count(*) FILTER (x.pred = 0 AND y.pred = 0) - count(*) FILTER
    (x.pred = 1 AND y.pred = 0) * count(*) FILTER (x.pred = 0 AND y.pred = 1)) / (count(*) FILTER (x.pred = 1 AND y.pred = 1) * count(*) FILTER (x.pred =
    0 AND y.pred = 0) + count(*) FILTER (x.pred = 1 AND y.pred = 0) * count(*) FILTER (x.pred = 0 AND y.pred = 1) + 1e-10) AS q FROM preds x JOIN preds y
    ON x.event_id = y.event_id AND x.model < y.model GROUP BY 1, 2""")
def _diversity(m):
    return ev.ensemble_diversity(preds(m), MODELS)


@query("ensemble_meta_features", "event_id:i disagreement:d score_std:d score_range:d conf_mean:d8 conf_min:d", """SELECT event_id, CASE WHEN sum(pred) IN (0,
    3) THEN 0 ELSE 2 / 3 END AS disagreement, stddev_pop(score) AS score_std, max(score) - min(score) AS score_range, avg(greatest(score, 1 - score)) AS
    conf_mean, min(greatest(score, 1 - score)) AS conf_min FROM preds GROUP BY 1""")
def _meta(m):
    return ev.meta_features(preds(m), MODELS)


@query("ensemble_stacked_meta", "n:i accuracy:d")
def _stacked(m):
    w = ev.wide_predictions(preds(m), MODELS).withColumn("is_train", col("event_id") % 5 > 0)
    p = ml.stacked_meta(w, MODELS)[1]
    return p.agg(F.count(F.lit(1)).alias("n"), F.avg((col("prediction") == col("actual")).cast("int")).alias("accuracy"))


# ------------------------------------------------------------------ model data

@query("data_lag_features", "symbol ts " + " ".join(f"close_lag_{n}:d" for n in (1, 5, 10, 20)) + " close_mean_7:d close_std_7:d close_mean_30:d close_std_30:d",
       "SELECT symbol, ts, " + ", ".join(f'lag("close", {n}) OVER ({W}) AS close_lag_{n}' for n in (1, 5, 10, 20)) + ", " + ", ".join(
           f"{roll('avg', chr(34) + 'close' + chr(34), n)} AS close_mean_{n}, {roll('stddev_samp', chr(34) + 'close' + chr(34), n)} AS close_std_{n}"
           for n in (7, 30)) + " FROM bars")
def _lags(m):
    return ml.lag_features(m.bars(), "close")


@query("data_sequences", "symbol ts n:i first:d last:d target:d", f"""SELECT symbol, ts, 60 AS n, lag("close", 59) OVER ({W}) AS first, "close" AS last,
    lead("close", 2) OVER ({W}) AS target FROM numbered QUALIFY target IS NOT NULL AND rn >= 60 AND (rn - 60) % 5 = 0""")
def _seq(m):
    d = ml.sequences(m.bars(), "close", 60, 5, 2)
    return d.withColumns({"n": F.size("seq"), "first": F.get("seq", F.lit(0)), "last": F.element_at("seq", -1)})


@query("data_temporal_split", "event_id:i split", """SELECT event_id, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.85) THEN 'val' ELSE
    'test' END AS split FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM ticks)""")
def _split(m):
    return ml.temporal_split(m.ticks(), ["ts", "event_id"])


@query("data_walk_forward_folds", "fold:i train_end:i test_end:i train_rows:i val_rows:i test_rows:i", """WITH d AS (SELECT floor(epoch(ts - min(ts) OVER ())
    / 86400) AS day, epoch(max(ts) OVER () - min(ts) OVER ()) / 86400 AS span FROM ords), f AS (SELECT k AS fold, (24 + k) * 30 AS te, (27 + k) * 30 AS ve,
    (28 + k) * 30 AS ee FROM (SELECT unnest(range(0, 100)) AS k) WHERE (28 + k) * 30 <= (SELECT max(span) FROM d))
    SELECT fold, te AS train_end, ee AS test_end, count(*) FILTER (day < te) AS train_rows, count(*) FILTER (day >= te AND day < ve) AS val_rows,
    count(*) FILTER (day >= ve AND day < ee) AS test_rows FROM f, d GROUP BY 1, 2, 3 HAVING count(*) FILTER (day < te) >= 1000""")
def _folds(m):
    return ml.walk_forward_folds(m.orders())


add_base("cfg", """SELECT user_id % 20 AS config, CAST(day(ts) // 3 AS BIGINT) AS fold, avg(price) AS score FROM ticks GROUP BY 1, 2""")


@query("data_summarise_configs", "config:i mean_score:d best:d worst:d folds:i stopped_at:i", """WITH b AS (SELECT *, max(score) OVER (PARTITION BY config ORDER
    BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM cfg), a AS (SELECT *, last_value(CASE WHEN pb IS NULL OR score > pb THEN fold END
    IGNORE NULLS) OVER (PARTITION BY config ORDER BY fold) AS at_fold FROM b) SELECT config, avg(score) AS mean_score, max(score) AS best, min(score) AS
    worst, count(*) AS folds, min(fold) FILTER (fold - at_fold >= 3) AS stopped_at FROM a GROUP BY 1""")
def _configs(m):
    d = m.ticks().groupBy((col("user_id") % 20).alias("config"), F.floor(F.dayofmonth("ts") / 3).alias("fold")).agg(F.avg("price").alias("score"))
    return ml.summarise_configs(d)


@query("data_select_k_best", "feature:i f_value:d4 chosen:b picked:b", """WITH e AS (SELECT label, unnest(range(len(embedding))) AS feature,
    unnest(embedding)::DOUBLE AS x FROM embeddings), p AS (SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM e GROUP BY 1, 2),
    a AS (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS g FROM p WINDOW w AS (PARTITION BY feature)),
    f AS (SELECT feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_value FROM a GROUP BY 1)
    SELECT feature, f_value, row_number() OVER (ORDER BY f_value DESC, feature) <= 8 AS chosen, chosen AS picked FROM f""")
def _kbest(m):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    e = m.raw("embeddings").select("vec_id", array_to_vector(col("embedding").cast("array<double>")).alias("fv"), col("label").cast("double").alias("label"))
    # the places that the fitted selector picked, found by their values
    one = ml.select_k_best(e, "fv", "label", 8).limit(1).select(vector_to_array("fv").alias("all"), vector_to_array("selected").alias("s"))
    picked = one.select(F.posexplode("all").alias("at", "x"), "s").select("at", F.array_contains("s", col("x")).alias("picked"))
    return ml.selection_scores(m.raw("embeddings"), "embedding", "label", 8).join(picked, col("feature") == col("at"))


@query("data_mutual_information", "feature:i mi:d chosen:b", """WITH e AS (SELECT label, unnest(range(len(embedding))) AS feature,
    unnest(embedding)::DOUBLE AS x FROM embeddings), b AS (SELECT feature, label, floor((rank() OVER (PARTITION BY feature ORDER BY x) - 1) * 10.0 /
    count(*) OVER (PARTITION BY feature)) AS bin FROM e), j AS (SELECT feature, bin, label, count(*) AS n FROM b GROUP BY 1, 2, 3),
    w AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS r, sum(n) OVER (PARTITION BY feature, label) AS k
    FROM j), f AS (SELECT feature, sum(n / t * ln(n * t / (r * k))) AS mi FROM w GROUP BY 1)
    SELECT feature, mi, row_number() OVER (ORDER BY round(mi, 12) DESC, feature) <= 8 AS chosen FROM f""")
def _mi(m):
    return ml.mutual_information(m.raw("embeddings"), "embedding", "label", 8)


@query("data_chi2_scores", "feature:i chi2:d4 chosen:b", """WITH e AS (SELECT label, unnest(range(len(embedding))) AS feature, (unnest(embedding) > 0)::INT AS x
    FROM embeddings), j AS (SELECT feature, x, label, count(*) AS n FROM e GROUP BY 1, 2, 3), g AS (SELECT feature, x, label FROM (SELECT DISTINCT feature, x
    FROM j), (SELECT DISTINCT label FROM j)), w AS (SELECT g.feature, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY g.feature, g.x) AS r,
    sum(coalesce(n, 0)) OVER (PARTITION BY g.feature, g.label) AS k, sum(coalesce(n, 0)) OVER (PARTITION BY g.feature) AS t FROM g LEFT JOIN j USING
    (feature, x, label)), f AS (SELECT feature, sum((n - r * k / t) ** 2 / (r * k / t)) AS chi2 FROM w GROUP BY 1)
    SELECT feature, chi2, row_number() OVER (ORDER BY round(chi2, 9) DESC, feature) <= 8 AS chosen FROM f""")
def _chi2(m):
    """Signs of the vector's places as categories."""
    d = m.raw("embeddings").select("label", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("sign"))
    return ml.chi2_scores(d, "sign", "label", 8)


REGIME_FEATURES = ["bbs_width_20", "bbs_pos_20", "vol_10", "vol_20", "abs_ret_20"]


def regime_rows(m):
    return rg.regime_threshold(tech.vol_cluster(tech.hist_vol(tech.bollinger_sample(m.bars()))))


@query("data_regime_classifier", "model cls accuracy:d weighted_f1:d")
def _classifier(m):
    p = ml.regime_classifier(regime_rows(m), REGIME_FEATURES, "2024-01-24")[1]
    p = p.select(F.lit("forest").alias("model"), col("label").alias("actual"), col("prediction").alias("pred"))
    return ev.classification_metrics(p)


@query("data_regime_importance", "feature base_error:d error:d importance:d")
def _regime_importance(m):
    d = regime_rows(m)
    model, test = ml.regime_classifier(d, REGIME_FEATURES, "2024-01-24")
    test = test.select("symbol", "ts", "regime", *REGIME_FEATURES)
    # the forest's own stages index the label, so errors are counted on that index
    return ml.permutation_importance(model, test, REGIME_FEATURES, "regime", ["symbol", "ts"], lambda _: ml.zero_one_error("label"))


@query("data_purged_folds", "fold:i train_rows:i test_rows:i", f"""WITH z AS (SELECT min(epoch_us(ts)) AS t0 FROM ticks),
    c AS (SELECT unnest(range(1, 6)) AS fold, t0 + round(unnest(q)) AS lo FROM (SELECT any_value(t0) AS t0, quantile_cont((epoch_us(ts) - t0)::DOUBLE,
    {[i / 6 for i in range(1, 6)]}) AS q FROM ticks, z)),
    f AS (SELECT fold, lo, coalesce(lead(lo) OVER (ORDER BY fold), 9e18) AS hi FROM c)
    SELECT fold, count(*) FILTER (epoch_us(ts) < lo - 3600000000) AS train_rows, count(*) FILTER (epoch_us(ts) >= lo AND epoch_us(ts) < hi) AS test_rows
    FROM f, ticks GROUP BY 1""")
def _folds(m):
    return ml.fold_sizes(m.ticks(), folds=5, embargo_seconds=3600)


_row = ("length(symbol)", "ascii(symbol)", "ascii(right(symbol, 1))", "epoch_us(ts) // 1000000")
_noisy = " UNION ALL ".join(f"SELECT symbol, 'noise_{x}' AS scenario, ret + g * sd * {x} AS value FROM p" for x in (0.01, 0.05, 0.1))
_gappy = " UNION ALL ".join(f"""SELECT symbol, 'missing_{x}', last_value(CASE WHEN v >= {x} THEN ret END IGNORE NULLS) OVER
    (PARTITION BY symbol ORDER BY ts) FROM p""" for x in (0.05, 0.1, 0.2))


@query("data_robustness_perturb", "symbol scenario score:d loss:d", f"""SELECT s.symbol, scenario, score, (base - score) / abs(base) AS loss FROM
    (SELECT symbol, scenario, avg(value) / nullif(stddev_samp(value), 0) AS score FROM (WITH p AS (SELECT *, {normal_sql(11, *_row)} AS g,
      {unit_sql(13, *_row)} AS v, stddev_samp(ret) OVER (PARTITION BY symbol) AS sd FROM rets) {_noisy} UNION ALL {_gappy}) GROUP BY ALL) s
    JOIN (SELECT symbol, avg(ret) / nullif(stddev_samp(ret), 0) AS base FROM rets GROUP BY 1) b ON b.symbol = s.symbol""")
def _perturb(m):
    return ml.degradation(ml.robustness_perturb(m.returns(), "ret"))
