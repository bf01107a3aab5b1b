"""Regime, portfolio and rebalancing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import col
from ..operators import machines as mc
from ..operators import portfolio as pf
from ..operators import regime as rg
from ..operators import risk as rk
from ..operators import technical as tech
from . import risk as _risk  # noqa: F401  (defines shared tables)
from .base import add_base, query, unit_sql
from .technical import CL, W, _dx, lag, rec_ema, roll, wd

REG = f"""SELECT *, CASE WHEN sd > 0.03 THEN 'high_volatility' WHEN r20 > 0.02 AND adx > 30 THEN 'strong_bull' WHEN r20 < -0.02 AND
    adx > 30 THEN 'strong_bear' WHEN r20 > 0 AND r20 <= 0.02 AND adx > 30 THEN 'bull' WHEN r20 < 0 AND r20 >= -0.02 AND adx > 30 THEN
    'bear' ELSE 'sideways' END AS regime FROM (SELECT *, {CL} / {lag(CL, 20)} - 1 AS r20, {roll('stddev_samp', 'r', 20)} AS sd FROM
    {rec_ema(_dx, [wd('adx', 'dx', 14)])})"""


@query("regime_six_labels", "symbol ts regime", REG)
def _six(m):
    return rg.label_regime6(tech.adx(m.bars()))


@query("label_next_return", "symbol ts next_ret:d", f"""SELECT symbol, ts, (lead({CL}) OVER ({W})) / {CL} - 1 AS next_ret FROM bars""")
def _next(m):
    return rg.label_next_return(m.bars())


@query("label_pattern", "symbol ts pattern", f"""SELECT symbol, ts, CASE WHEN rn <= 20 THEN 'no_pattern' WHEN sd > 0.012 THEN
    'high_volatility' WHEN mu > 0.001 THEN 'bull_flag' WHEN mu < -0.001 THEN 'bear_flag' ELSE 'sideways' END AS pattern FROM (SELECT *,
    stddev_samp(r) OVER w AS sd, avg(r) OVER w AS mu FROM numbered WINDOW w AS ({W} ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING))""")
def _pattern(m):
    return rg.label_pattern(m.bars(), 0.012, 0.001)


add_base("regime_thr", f"""SELECT symbol, ts, CASE WHEN mu IS NULL THEN 'normal' WHEN v > 0.25 THEN 'high_volatility' WHEN mu > 0.15 THEN
    'bull_trending' WHEN mu < -0.1 THEN 'bear_trending' WHEN v < 0.12 THEN 'low_volatility' ELSE 'normal' END AS regime, rn FROM (SELECT
    *, {roll('avg', 'r', 20)} * 252 AS mu, {roll('stddev_samp', 'r', 20)} * sqrt(252) AS v FROM numbered)""")


@query("regime_threshold", "symbol ts regime", "SELECT * FROM regime_thr")
def _threshold(m):
    return rg.regime_threshold(m.bars())


add_base("mmx", """SELECT *, avg(vix) OVER (ORDER BY ts ROWS 19 PRECEDING) AS vix_ma FROM (SELECT ts, avg(r) OVER (ORDER BY ts ROWS 19
    PRECEDING) * 252 AS ret20, stddev_samp(r) OVER (ORDER BY ts ROWS 19 PRECEDING) * sqrt(252) AS sv, stddev_samp(r) OVER (ORDER BY ts
    ROWS 59 PRECEDING) * sqrt(252) AS lv, exp(sum(ln(1 + r)) OVER (ORDER BY ts ROWS 59 PRECEDING)) - 1 AS mom FROM (SELECT ts, avg(ret)
    AS r FROM rets GROUP BY 1)) LEFT JOIN (SELECT ts, max(volume) / 12 AS vix FROM bars GROUP BY 1) USING (ts)""")
add_base("votes", """SELECT ts, CASE WHEN ret20 > 0.15 THEN 'bull_trending' WHEN ret20 < -0.1 THEN 'bear_trending' ELSE 'normal' END AS
      regime, 0.25 * CASE WHEN ret20 > 0.15 OR ret20 < -0.1 THEN 0.8 ELSE 0.6 END AS s FROM mmx UNION ALL
    SELECT ts, CASE WHEN sv > 0.25 AND sv > 1.5 * lv THEN 'crisis' WHEN sv > 0.25 THEN 'high_volatility' WHEN sv < 0.12 THEN
      'low_volatility' ELSE 'normal' END, 0.25 * CASE WHEN sv > 0.25 AND sv > 1.5 * lv THEN 0.9 WHEN sv > 0.25 OR sv < 0.12 THEN 0.8
      ELSE 0.6 END FROM mmx UNION ALL
    SELECT ts, CASE WHEN c > 0.7 THEN 'crisis' WHEN c < 0.3 THEN 'low_volatility' ELSE 'normal' END, 0.2 * CASE WHEN c > 0.7 THEN 0.8
      WHEN c < 0.3 THEN 0.7 ELSE 0.6 END FROM (SELECT ts, avg_corr AS c FROM mmx LEFT JOIN corr_reg USING (ts)) UNION ALL
    SELECT ts, CASE WHEN mom > 0.05 THEN 'bull_trending' WHEN mom < -0.05 THEN 'bear_trending' ELSE 'normal' END, 0.15 * CASE WHEN mom >
      0.05 OR mom < -0.05 THEN 0.7 ELSE 0.6 END FROM mmx UNION ALL
    SELECT ts, CASE WHEN vix > 30 AND vix > 1.3 * vix_ma THEN 'crisis' WHEN vix > 30 THEN 'high_volatility' WHEN vix < 15 THEN
      'low_volatility' WHEN vix BETWEEN 25 AND 30 THEN 'bear_trending' ELSE 'normal' END, 0.15 * CASE WHEN vix > 30 AND vix > 1.3 *
      vix_ma THEN 0.9 WHEN vix > 30 OR vix < 15 THEN 0.8 WHEN vix BETWEEN 25 AND 30 THEN 0.7 ELSE 0.6 END FROM mmx""")


@query("regime_multifactor", "ts regime confidence:d", """SELECT ts, regime, s AS confidence FROM (SELECT ts, regime, sum(s) AS s FROM votes
    GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY ts ORDER BY round(s, 12) DESC, regime DESC) = 1""")
def _multi(m):
    r = m.returns()
    vix = m.bars().groupBy("ts").agg((F.max("volume") / 12).alias("vix"))
    return rg.regime_multifactor(rg.market_measures(r, rk.correlation_regime(r), vix))


@query("regime_gaussian_mixture", "regime n:i mean_vol:d")
def _gmm(m):
    d = rg.regime_gmm(m.returns())
    return d.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.avg("v20").alias("mean_vol"))


_walk = """WITH RECURSIVE c AS (SELECT *, 0.5 + (hour(ts) * 7 % 10) / 20 AS conf FROM regime_thr), walk AS (
    SELECT symbol, rn, ts, CASE WHEN conf >= 0.7 THEN regime ELSE 'normal' END AS kept, 1 AS bars FROM c WHERE rn = 1
    UNION ALL SELECT symbol, rn, ts, k, CASE WHEN k = kept THEN bars + 1 ELSE 1 END FROM (SELECT c.symbol, c.rn, c.ts, w.kept, w.bars,
      CASE WHEN c.regime <> w.kept AND w.bars < 5 AND conf * 0.2 < 0.7 THEN w.kept WHEN conf >= 0.7 THEN c.regime ELSE 'normal' END AS k
      FROM walk w JOIN c ON c.symbol = w.symbol AND c.rn = w.rn + 1))"""


def kept(m):
    d = rg.regime_threshold(m.bars()).withColumn("confidence", 0.5 + (F.hour("ts") * 7 % 10) / 20)
    return mc.regime_persistence(d)


@query("regime_persistence", "symbol ts regime_kept", _walk + " SELECT symbol, ts, kept AS regime_kept FROM walk")
def _persistence(m):
    return kept(m)


@query("regime_transitions", "from_regime to_regime n:i probability:d", f"""SELECT *, n / sum(n) OVER (PARTITION BY from_regime) AS
    probability FROM (SELECT f AS from_regime, regime AS to_regime, count(*) AS n FROM (SELECT *, lag(regime) OVER ({W}) AS f FROM
    regime_thr) WHERE f IS NOT NULL GROUP BY 1, 2)""")
def _transitions(m):
    return rg.regime_transitions(rg.regime_threshold(m.bars()))


# ------------------------------------------------------------------ inputs

add_base("mus", "SELECT symbol, avg(ret) * 252 AS mu FROM rets GROUP BY 1")
add_base("mkt", "SELECT ts, avg(ret) AS mkt FROM rets GROUP BY 1")
for _m, _sql in {
    "mean": "SELECT * FROM mus", "shrink": "SELECT symbol, 0.8 * mu + 0.2 * avg(mu) OVER () AS mu FROM mus",
    "capm": """SELECT symbol, 0.02 + covar_samp(ret, mkt) / var_samp(mkt) * ((SELECT avg(mkt) * 252 FROM mkt) - 0.02) AS mu FROM rets JOIN
        mkt USING (ts) GROUP BY 1""",
}.items():
    @query(f"portfolio_expected_returns_{_m}", "symbol mu:d", _sql)
    def _mu(m, method=_m):
        return pf.expected_returns(m.returns(), method)

add_base("ann", "SELECT a, b, cov * 252 + CASE WHEN a = b THEN 1e-8 ELSE 0 END AS cov FROM pairs")
for _m, _sql in {"sample": "SELECT * FROM ann", "shrink": """SELECT a, b, 0.8 * cov + CASE WHEN a = b THEN 0.2 * (SELECT avg(cov) FROM ann
        WHERE a = b) ELSE 0 END AS cov FROM ann"""}.items():
    @query(f"portfolio_covariance_{_m}", "a b cov:d8", _sql)
    def _cov(m, method=_m):
        return pf.covariance(rk.pair_moments(m.returns()), method)


@query("portfolio_covariance_robust", "a b cov:d8", """WITH st AS (SELECT symbol, avg(ret) AS mu, stddev_samp(ret) AS sd FROM rets GROUP BY 1),
    bad AS (SELECT DISTINCT ts FROM rets JOIN st USING (symbol) WHERE abs(ret - mu) >= 3 * sd), good AS (SELECT * FROM rets WHERE ts NOT IN
    (SELECT ts FROM bad) OR (SELECT count(*) FROM bad) > 0.3 * (SELECT count(DISTINCT ts) FROM rets))
    SELECT x.symbol AS a, y.symbol AS b, covar_samp(x.ret, y.ret) AS cov FROM good x JOIN good y ON x.ts = y.ts AND x.symbol <= y.symbol
    GROUP BY 1, 2""")
def _robust(m):
    return rk.pair_moments(pf.robust_returns(m.returns()))


for _k, _e in {"ellipsoidal": "mu * 0.95", "box": "mu - 0.1 * sd"}.items():
    @query(f"portfolio_robust_adjust_{_k}", "symbol mu:d cov_scale:d", f"""SELECT symbol, {_e} AS mu, 1.1 AS cov_scale FROM (SELECT symbol,
        avg(ret) * 252 AS mu, stddev_samp(ret) * sqrt(252) AS sd FROM rets GROUP BY 1)""")
    def _adj(m, kind=_k):
        r = m.returns()
        return pf.robust_adjust(pf.expected_returns(r), r, kind)

add_base("ann2", "SELECT a, b, cov FROM ann UNION ALL SELECT b, a, cov FROM ann WHERE a < b")
add_base("ann_sw", """SELECT p.portfolio_id, p.symbol, any_value(p.weight) AS weight, sum(q.weight * cov) AS sw FROM positions p JOIN ann2 ON a =
    p.symbol JOIN positions q ON q.symbol = b AND q.portfolio_id = p.portfolio_id GROUP BY 1, 2""")


@query("portfolio_score", "portfolio_id:i ret:d risk:d diversification:d hhi:d max_risk_share:d sharpe:d", """SELECT *, (ret - 0.02) / risk
    AS sharpe FROM (SELECT portfolio_id, sum(weight * mu) AS ret, sqrt(sum(weight * sw)) AS risk, sum(abs(weight) * sd) / sqrt(sum(weight *
    sw)) AS diversification, sum(weight * weight) AS hhi, max(weight * sw) / sum(weight * sw) AS max_risk_share FROM ann_sw JOIN mus
    USING (symbol) JOIN (SELECT a AS symbol, sqrt(cov) AS sd FROM ann WHERE a = b) USING (symbol) GROUP BY 1)""")
def _score(m):
    r = m.returns()
    return pf.score_portfolios(m.positions(), pf.expected_returns(r), pf.covariance(rk.pair_moments(r)))


add_base("sweep", f"""SELECT *, (ret - 0.02) / risk AS sharpe FROM (SELECT r.portfolio_id, ret, risk, max_weight FROM (SELECT portfolio_id, sum(weight * mu) AS ret,
    max(weight) AS max_weight FROM sweep_w GROUP BY 1) r JOIN (SELECT x.portfolio_id, sqrt(sum(x.weight * y.weight * cov)) AS risk FROM sweep_w x JOIN ann2 ON
    a = x.symbol JOIN sweep_w y ON y.symbol = b AND y.portfolio_id = x.portfolio_id GROUP BY 1) q USING (portfolio_id)) WHERE max_weight <= 0.4""")
add_base("sweep_w", f"""SELECT *, e / sum(e) OVER (PARTITION BY portfolio_id) AS weight FROM (SELECT portfolio_id, symbol, mu,
    -ln({unit_sql(42, 'portfolio_id', 'place')}) AS e FROM (SELECT range AS portfolio_id FROM range(2000)), (SELECT *, dense_rank() OVER (ORDER BY symbol) AS
    place FROM mus))""")


@query("portfolio_frontier_sweep", "kind bin:i portfolio_id:i ret:d risk:d sharpe:d", """WITH b AS (SELECT *, CAST(least(floor((ret - (SELECT min(ret) FROM
    sweep)) / ((SELECT max(ret) FROM sweep) - (SELECT min(ret) FROM sweep)) * 20), 19) AS BIGINT) AS bin FROM sweep)
    SELECT 'frontier' AS kind, bin, portfolio_id, ret, risk, sharpe FROM b QUALIFY row_number() OVER (PARTITION BY bin ORDER BY risk, portfolio_id) = 1 UNION ALL
    (SELECT 'max_sharpe', NULL, portfolio_id, ret, risk, sharpe FROM b ORDER BY sharpe DESC, portfolio_id DESC LIMIT 1) UNION ALL
    (SELECT 'min_variance', NULL, portfolio_id, ret, risk, sharpe FROM b ORDER BY risk, portfolio_id LIMIT 1)""")
def _frontier(m):
    r = m.returns()
    return pf.frontier_sweep(pf.sweep_scores(pf.expected_returns(r), pf.covariance(rk.pair_moments(r)), 2000), 20)


add_base("cap_w", "SELECT symbol, sum(volume) / (SELECT sum(volume) FROM bars) AS weight FROM bars GROUP BY 1")


@query("portfolio_equilibrium_returns", "symbol pi:d", """SELECT a AS symbol, 3 * sum(cov * weight) AS pi FROM ann2 JOIN cap_w ON symbol = b
    GROUP BY 1""")
def _equilibrium(m):
    b = m.bars()
    total = b.agg(F.sum("volume")).scalar()
    w = b.groupBy("symbol").agg((F.sum("volume")).alias("v")).select("symbol", (col("v") / total).alias("weight"))
    return pf.equilibrium_returns(w, pf.covariance(rk.pair_moments(m.returns())))


@query("portfolio_tau", "tau:d8", "SELECT 1 / count(DISTINCT ts) AS tau FROM rets")
def _tau(m):
    return pf.tau(m.returns())


@query("portfolio_view_decay", "event_id:i age_days:i confidence_now:d10", """SELECT event_id, d AS age_days, greatest(confidence * 0.95 ** d,
    0.1) AS confidence_now FROM (SELECT *, DATE '2024-01-30' - CAST(ts AS DATE) AS d FROM sent) WHERE d BETWEEN 0 AND 20""")
def _views(m):
    return pf.view_decay(m.sentiment(), "2024-01-30", max_days=20)


@query("portfolio_risk_contributions", "portfolio_id:i symbol risk_share:d", """SELECT portfolio_id, symbol, weight * sw / sum(weight * sw) OVER
    (PARTITION BY portfolio_id) AS risk_share FROM ann_sw""")
def _contrib(m):
    return rk.marginal_risk(m.positions(), pf.covariance(rk.pair_moments(m.returns())))


@query("portfolio_vol_target", "portfolio_id:i symbol portfolio_vol:d scale:d weight_target:d", """SELECT *, weight * scale / sum(weight * scale)
    OVER (PARTITION BY portfolio_id) AS weight_target FROM (SELECT *, least(0.12 / portfolio_vol, 2) AS scale FROM (SELECT *, sqrt(sum(weight *
    sw) OVER (PARTITION BY portfolio_id)) AS portfolio_vol FROM ann_sw))""")
def _voltarget(m):
    return pf.vol_target(m.positions(), pf.covariance(rk.pair_moments(m.returns())))


@query("portfolio_crisis_covariance", "a b cov:d8 corr:d", """SELECT x.a, x.b, r * sa * sb * 2.25 AS cov, r AS corr FROM (SELECT x.a, x.b,
    sqrt(p.cov) AS sa, sqrt(q.cov) AS sb, CASE WHEN x.a = x.b THEN 1 ELSE 0.5 * x.cov / sqrt(p.cov * q.cov) + 0.4 END AS r FROM pairs x JOIN
    pairs p ON p.a = x.a AND p.b = x.a JOIN pairs q ON q.a = x.b AND q.b = x.b) x""")
def _crisis(m):
    return pf.crisis_covariance(rk.pair_moments(m.returns()))


def assets(m):
    c = F.get(F.array(*[F.lit(x) for x in ("equities", "bonds", "commodities", "cash", "other")]),
              F.when(col("symbol") == "CLICK", 0).when(col("symbol") == "VIEW", 1).when(col("symbol") == "ERROR", 2).when(
                  col("symbol") == "SIGNUP", 0).otherwise(4))
    return m.positions().select(col("portfolio_id").alias("account"), "symbol", c.alias("class"), "weight")


def regimes(m):
    names = F.array(*[F.lit(x) for x in pf.REGIME_WEIGHTS])
    return m.positions().select(col("portfolio_id").alias("account")).distinct().select(
        "account", F.get(names, (col("account") % 7).cast("int")).alias("regime"), (0.5 + col("account") / 20).alias("confidence"))


_table = ", ".join(f"('{r}', '{c}', {v})" for r, ws in pf.REGIME_WEIGHTS.items() for c, v in zip(pf.CLASSES, ws))
_names = "[" + ", ".join(f"'{x}'" for x in pf.REGIME_WEIGHTS) + "]"
add_base("acct_assets", f"""SELECT portfolio_id AS account, symbol, weight, CASE symbol WHEN 'CLICK' THEN 'equities' WHEN 'SIGNUP' THEN
    'equities' WHEN 'VIEW' THEN 'bonds' WHEN 'ERROR' THEN 'commodities' ELSE 'other' END AS class, ({_names})[portfolio_id % 7 + 1] AS regime,
    0.5 + portfolio_id / 20 AS confidence FROM positions""")
add_base("regime_target", f"""WITH t(regime, class, w) AS (VALUES {_table}), x AS (SELECT a.*, (confidence * t.w + (1 - confidence) * n.w) /
      count(*) OVER (PARTITION BY account, a.class) AS t0 FROM acct_assets a LEFT JOIN t ON t.regime = a.regime AND t.class = a.class LEFT
      JOIN t n ON n.regime = 'normal' AND n.class = a.class),
    y AS (SELECT *, coalesce(t0, greatest(0, 1 - sum(t0) OVER a) / count(*) FILTER (t0 IS NULL) OVER a) AS t1 FROM x WINDOW a AS
      (PARTITION BY account)),
    z AS (SELECT *, t1 / sum(t1) OVER (PARTITION BY account) AS target FROM y),
    s AS (SELECT *, weight + 0.3 * confidence * (target - weight) AS s0 FROM z),
    u AS (SELECT *, s0 / sum(s0) OVER (PARTITION BY account) AS s1 FROM s),
    c AS (SELECT *, greatest(0, weight + least(greatest(s1 - weight, -0.2), 0.2)) AS c0 FROM u)
    SELECT *, c0 / sum(c0) OVER (PARTITION BY account) AS new_weight FROM c""")


@query("portfolio_regime_allocation", "account:i symbol target:d new_weight:d", "SELECT * FROM regime_target")
def _alloc(m):
    return pf.regime_allocation(assets(m), regimes(m))


def targets(m):
    return pf.regime_allocation(assets(m), regimes(m)).withColumn("value", 100000.0 * (1 + col("account")))


add_base("cost", """SELECT *, value * (0.001 * turnover + 0.0001 * turnover * turnover + 0.0002 * turnover) AS cost FROM (SELECT account,
    sum(abs(weight - target)) / 2 AS turnover, 100000.0 * (1 + account) AS value FROM regime_target GROUP BY 1)""")


@query("rebalance_transaction_cost", "account:i turnover:d cost:d", "SELECT * FROM cost")
def _cost(m):
    return pf.transaction_cost(targets(m))


@query("rebalance_triggers", "account:i max_drift:d fired emergency:b should_rebalance:b", """SELECT account, max_drift,
    array_to_string(list_filter([CASE WHEN max_drift > 0.05 OR rel > 0.05 OR av > 0.02 THEN 'threshold' END, CASE WHEN days >= 30 THEN 'time'
    END, CASE WHEN vol > 0.25 OR vol < 0.1 THEN 'volatility' END, CASE WHEN regime = 'crisis' THEN 'regime_change' END], lambda x: x IS NOT
    NULL), ',') AS fired, max_drift > 0.25 AS emergency, NOT (regime = 'crisis' AND days < 14 AND max_drift <= 0.25) AS should_rebalance
    FROM (SELECT account, max(abs(weight - target)) AS max_drift, avg(abs(weight - target)) AS av, max(abs(weight - target) /
    greatest(target, 0.01)) AS rel, any_value(regime) AS regime, account * 4 AS days, account / 25 AS vol FROM regime_target GROUP BY 1)""")
def _triggers(m):
    acc = regimes(m).select("account", "regime", (col("account") / 25).alias("vol"), F.date_sub(
        F.lit("2024-01-30").cast("date"), (col("account") * 4).cast("int")).alias("last_rebalance"))
    return pf.rebalance_triggers(targets(m), acc, "2024-01-30").withColumn("fired", F.array_join("fired", ","))


@query("rebalance_trades", "account:i symbol diff:d side", """SELECT *, CASE WHEN diff > 0 THEN 'buy' ELSE 'sell' END AS side FROM (SELECT
    coalesce(a.account, b.account) AS account, coalesce(a.symbol, b.symbol) AS symbol, coalesce(t, 0) - coalesce(w, 0) AS diff FROM (SELECT
    account, symbol, weight AS w FROM regime_target WHERE symbol <> 'VIEW') a FULL JOIN (SELECT account, symbol, new_weight AS t FROM
    regime_target WHERE symbol <> 'ERROR') b ON a.account = b.account AND a.symbol = b.symbol) WHERE abs(diff) > 0.01""")
def _trades(m):
    t = targets(m)
    return pf.rebalance_trades(t.filter("symbol <> 'VIEW'"), t.filter("symbol <> 'ERROR'").select(
        "account", "symbol", col("new_weight").alias("weight")))


add_base("drift_hist", """SELECT portfolio_id AS account, symbol, weight * ret AS drift FROM positions JOIN rets USING (symbol)""")


@query("rebalance_timing", "account:i drift_penalty:d net_benefit:d should_rebalance:b", """SELECT account, pen AS drift_penalty, pen - cost AS
    net_benefit, pen > cost AND turnover > 0.01 AS should_rebalance FROM (SELECT account, turnover, cost, p * value * 0.5 AS pen FROM cost
    JOIN (SELECT account, sum(v * 30) AS p FROM (SELECT account, symbol, var_pop(drift) AS v FROM drift_hist GROUP BY 1, 2) GROUP BY 1)
    USING (account))""")
def _timing(m):
    h = m.positions().join(m.returns(), "symbol").select(col("portfolio_id").alias("account"), "symbol",
                                                         (col("weight") * col("ret")).alias("drift"))
    return pf.rebalance_timing(targets(m), h)
