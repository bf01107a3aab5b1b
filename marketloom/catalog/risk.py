"""Risk queries over ten derived portfolios of five symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import col
from ..operators import machines as mc
from ..operators import risk as rk
from . import technical as _technical  # noqa: F401  (defines shared tables)
from .base import add_base, normal_sql, query

W = "PARTITION BY portfolio_id ORDER BY ts"
add_base("pret", """SELECT portfolio_id, ts, sum(weight * ret) AS ret FROM positions JOIN rets USING (symbol)
    GROUP BY 1, 2""")
add_base("recent_pret", f"SELECT * FROM pret QUALIFY row_number() OVER (PARTITION BY portfolio_id ORDER BY ts DESC) <= 252")
add_base("dds", f"""SELECT *, equity / peak - 1 AS drawdown FROM (SELECT *, max(equity) OVER ({W}) AS peak FROM (
    SELECT *, exp(sum(ln(1 + ret)) OVER ({W})) AS equity FROM pret))""")
add_base("pairs", """SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, covar_samp(a.ret, b.ret) AS cov,
    corr(a.ret, b.ret) AS corr FROM rets a JOIN rets b ON a.ts = b.ts AND a.symbol <= b.symbol GROUP BY 1, 2""")
add_base("pairs2", "SELECT a, b, cov, corr FROM pairs UNION ALL SELECT b, a, cov, corr FROM pairs WHERE a < b")
add_base("sigma_w", """SELECT p.portfolio_id, p.symbol, any_value(p.weight) AS weight, sum(q.weight * cov) AS sw
    FROM positions p JOIN pairs2 ON a = p.symbol JOIN positions q ON q.symbol = b AND q.portfolio_id = p.portfolio_id
    GROUP BY 1, 2""")


def pret(m):
    return rk.portfolio_returns(m.positions(), m.returns())


def dds(m):
    return rk.drawdown_series(pret(m))


@query("risk_portfolio_returns", "portfolio_id:i ts ret:d", "SELECT * FROM pret")
def _pret(m):
    return pret(m)


@query("risk_var_historical", "portfolio_id:i level:d var:d cvar:d n:i worst:d best:d", """
    WITH q AS (SELECT portfolio_id, count(*) AS n, min(ret) AS worst, max(ret) AS best,
      unnest(quantile_cont(ret, [0.01, 0.05, 0.1])) AS var, unnest([0.01, 0.05, 0.1]) AS level FROM recent_pret GROUP BY 1)
    SELECT q.*, (SELECT avg(ret) FROM recent_pret r WHERE r.portfolio_id = q.portfolio_id AND r.ret <= q.var) AS cvar
    FROM q""")
def _var(m):
    return rk.var_historical(pret(m))


@query("risk_var_parametric", "portfolio_id:i level:d var:d cvar:d", """SELECT portfolio_id, level, mu + z * sd AS var,
    mu - sd * f / level AS cvar FROM (SELECT portfolio_id, avg(ret) AS mu, stddev_samp(ret) AS sd FROM recent_pret GROUP BY 1),
    (VALUES (0.01, -2.3263478740408408, 0.02665214220345808), (0.05, -1.6448536269514729, 0.10313564037537128),
    (0.1, -1.2815515655446004, 0.17549833193248680)) t(level, z, f)""")
def _varp(m):
    return rk.var_parametric(pret(m))


@query("risk_var_monte_carlo", "portfolio_id:i level:d var:d", f"""WITH s AS (
    SELECT portfolio_id, mu + sd * {normal_sql(42, "portfolio_id", "i")} AS r FROM (SELECT portfolio_id, avg(ret) AS mu, stddev_samp(ret) AS sd
    FROM recent_pret GROUP BY 1), (SELECT unnest(range(1, 10001)) AS i)) """ + " UNION ALL ".join(
    f"SELECT portfolio_id, {x} AS level, quantile_cont(r, {x}) AS var FROM s GROUP BY 1" for x in (0.01, 0.05, 0.1)))
def _varmc(m):
    return rk.var_monte_carlo(pret(m))


@query("risk_portfolio_metrics", "portfolio_id:i volatility:d expected_return:d sharpe:d hhi:d effective_n:d max_weight:d "
       "leverage:d positions:i", """SELECT *, expected_return / volatility AS sharpe, 1 / hhi AS effective_n FROM (SELECT
    portfolio_id, sqrt(sum(weight * sw) * 252) AS volatility, max(abs(weight)) AS max_weight, sum(abs(weight)) AS leverage,
    sum(weight * weight) AS hhi, count(*) AS positions, sum(weight * mu) AS expected_return FROM sigma_w JOIN (SELECT symbol,
    avg(ret) * 252 AS mu FROM rets GROUP BY 1) USING (symbol) GROUP BY 1)""")
def _metrics(m):
    r = m.returns()
    return rk.portfolio_risk(m.positions(), r, rk.pair_moments(r))


@query("risk_marginal_contributions", "portfolio_id:i symbol marginal:d risk_share:d", """SELECT portfolio_id, symbol,
    sw / sqrt(v) AS marginal, weight * sw / v AS risk_share FROM (SELECT *, sum(weight * sw) OVER (PARTITION BY portfolio_id)
    AS v FROM sigma_w)""")
def _marginal(m):
    return rk.marginal_risk(m.positions(), rk.pair_moments(m.returns()))


@query("risk_drawdown_series", "portfolio_id:i ts equity:d peak:d drawdown:d", "SELECT * FROM dds")
def _dds(m):
    return dds(m)


add_base("dd_runs", f"""SELECT portfolio_id, run, min(ts) AS start_ts, max(ts) AS end_ts, min(drawdown) AS depth,
    count(*) AS bars, max(peak) AS peak, max(ts) = any_value(last_ts) AS ongoing FROM (SELECT *, rn - row_number() OVER ({W})
    AS run FROM (SELECT *, row_number() OVER ({W}) AS rn, max(ts) OVER (PARTITION BY portfolio_id) AS last_ts FROM dds)
    WHERE drawdown < 0) GROUP BY portfolio_id, run""")


@query("risk_drawdown_periods", "portfolio_id:i start_ts end_ts depth:d bars:i peak:d ongoing:b", "SELECT * FROM dd_runs")
def _periods(m):
    return rk.drawdown_periods(dds(m))


@query("risk_drawdown_stats", "portfolio_id:i max_drawdown:d current_drawdown:d ulcer:d avg_drawdown:d periods:i avg_bars:d "
       "max_bars:i recovery_factor:d frequency:d", """SELECT *, (fin - 1) / abs(max_drawdown) AS recovery_factor,
    periods / n AS frequency FROM (SELECT portfolio_id, min(drawdown) AS max_drawdown, arg_max(drawdown, ts) AS
    current_drawdown, sqrt(avg(drawdown * drawdown)) AS ulcer, arg_max(equity, ts) AS fin, count(*) AS n FROM dds GROUP BY 1)
    JOIN (SELECT portfolio_id, avg(depth) AS avg_drawdown, count(*) AS periods, avg(bars) AS avg_bars, max(bars) AS max_bars
    FROM dd_runs GROUP BY 1) USING (portfolio_id)""")
def _ddstats(m):
    d = dds(m)
    return rk.drawdown_stats(d, rk.drawdown_periods(d))


@query("risk_recovery_metrics", "portfolio_id:i start_ts required_gain:d recovered:b hours_to_recover:d", f"""
    SELECT r.portfolio_id, start_ts, 1 / (1 + depth) - 1 AS required_gain, NOT ongoing AS recovered,
    epoch(nxt - start_ts) / 3600 AS hours_to_recover FROM dd_runs r JOIN (SELECT portfolio_id, ts, lead(ts) OVER ({W}) AS nxt
    FROM dds) d ON d.portfolio_id = r.portfolio_id AND d.ts = r.end_ts""")
def _recovery(m):
    d = dds(m)
    return rk.recovery_metrics(rk.drawdown_periods(d), d)


_hi = "max(equity) OVER ({} RANGE BETWEEN INTERVAL {} PRECEDING AND CURRENT ROW)"
add_base("dd_state", f"""SELECT *, coalesce((drawdown - lag(drawdown) OVER ({W})) / (epoch(ts - lag(ts) OVER ({W})) / 3600), 0)
    AS velocity, equity / {_hi.format(W, '1 DAY')} - 1 AS dd_day, equity / {_hi.format(W, '7 DAY')} - 1 AS dd_week,
    equity / {_hi.format(W, '30 DAY')} - 1 AS dd_month, abs(drawdown) AS a FROM dds""")


@query("risk_drawdown_state", "portfolio_id:i ts dd_day:d dd_week:d dd_month:d velocity:d severity size_multiplier:d "
       "circuit_breaker:b", """SELECT *, CASE WHEN a >= 0.018 THEN 'critical' WHEN a >= 0.015 THEN 'caution' WHEN a >= 0.01
    THEN 'warning' ELSE 'normal' END AS severity, CASE WHEN a <= 0.01 THEN 1 ELSE greatest(0.1, 1 - 0.8 * least(1, (a - 0.01)
    / 0.19)) END AS size_multiplier, abs(dd_day) >= 0.02 OR abs(dd_week) >= 0.05 OR abs(dd_month) >= 0.10 OR a >= 0.2 AS
    circuit_breaker FROM dd_state""")
def _state(m):
    return rk.drawdown_state(dds(m))


@query("risk_off_state", "portfolio_id:i ts risk_off:b event", f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER ({W}) AS rn
    FROM dd_state), walk AS (
      SELECT portfolio_id, rn, ts, CASE WHEN a >= 0.015 OR velocity < -0.005 THEN ts END AS since,
        CASE WHEN a >= 0.015 OR velocity < -0.005 THEN 'enter' END AS event FROM n WHERE rn = 1
      UNION ALL SELECT n.portfolio_id, n.rn, n.ts,
        CASE WHEN w.since IS NULL THEN (CASE WHEN a >= 0.015 OR velocity < -0.005 THEN n.ts END)
          WHEN n.ts - w.since >= INTERVAL 24 HOUR AND a <= 0.0075 THEN NULL ELSE w.since END,
        CASE WHEN w.since IS NULL THEN (CASE WHEN a >= 0.015 OR velocity < -0.005 THEN 'enter' END)
          WHEN n.ts - w.since >= INTERVAL 24 HOUR AND a <= 0.0075 THEN 'exit' END
      FROM walk w JOIN n ON n.portfolio_id = w.portfolio_id AND n.rn = w.rn + 1)
    SELECT portfolio_id, ts, since IS NOT NULL AS risk_off, event FROM walk""")
def _risk_off(m):
    return mc.risk_off_state(rk.drawdown_state(dds(m)))


def _summary(m):
    r, p = m.returns(), m.positions()
    metrics = rk.portfolio_risk(p, r, rk.pair_moments(r))
    pr = pret(m)
    var = rk.var_historical(pr).filter("level = 0.05").select("portfolio_id", "var")
    dd = dds(m).groupBy("portfolio_id").agg(F.max_by("drawdown", "ts").alias("drawdown"))
    return metrics.join(var, "portfolio_id").join(dd, "portfolio_id")


add_base("risk_now", """SELECT * FROM (SELECT portfolio_id, sqrt(sum(weight * sw) * 252) AS volatility, max(abs(weight)) AS
    max_weight, sum(abs(weight)) AS leverage, sum(weight * weight) AS hhi FROM sigma_w GROUP BY 1) JOIN (SELECT portfolio_id,
    quantile_cont(ret, 0.05) AS var FROM recent_pret GROUP BY 1) USING (portfolio_id) JOIN (SELECT portfolio_id,
    arg_max(drawdown, ts) AS drawdown FROM dds GROUP BY 1) USING (portfolio_id)""")


@query("risk_limit_utilisation", "portfolio_id:i limit_name current:d utilisation:d status", """SELECT *, CASE WHEN
    current > lim THEN 'BREACH' WHEN utilisation > 0.8 THEN 'APPROACH' ELSE 'OK' END AS status FROM (SELECT *, current / lim AS
    utilisation FROM (SELECT portfolio_id, 'var_limit' AS limit_name, abs(var) AS current, 0.02 AS lim FROM risk_now UNION ALL
    SELECT portfolio_id, 'position_limit', max_weight, 0.1 FROM risk_now UNION ALL SELECT portfolio_id, 'leverage_limit',
    round(leverage, 12), 1.0 FROM risk_now UNION ALL SELECT portfolio_id, 'drawdown_limit', abs(drawdown), 0.2 FROM risk_now))""")
def _limits(m):
    return rk.limit_utilisation(_summary(m).withColumn("leverage", F.round("leverage", 12)))


@query("risk_score", "portfolio_id:i risk_score:d", """SELECT portfolio_id, least(least(30, abs(var) / 0.02 * 30) +
    least(20, volatility * 100) + least(20, hhi * 20) + least(20, abs(drawdown) / 0.2 * 20) + least(10, leverage * 10), 100)
    AS risk_score FROM risk_now""")
def _score(m):
    return rk.risk_score(_summary(m))


_last = "(SELECT * FROM rets WHERE ts IN (SELECT DISTINCT ts FROM rets ORDER BY ts DESC LIMIT {}))"


@query("risk_correlation_pairs", "a b window:i n:i corr:d cov:d9", " UNION ALL ".join(f"""SELECT x.symbol AS a, y.symbol AS b,
    {n} AS "window", count(*) AS n, corr(x.ret, y.ret) AS corr, covar_samp(x.ret, y.ret) AS cov FROM {_last.format(n)} x JOIN
    {_last.format(n)} y ON x.ts = y.ts AND x.symbol < y.symbol GROUP BY 1, 2
    HAVING count(*) > 1""" for n in (30, 90, 252)))
def _pairs(m):
    return rk.corr_pairs(m.returns())


@query("risk_correlation_summary", "avg_corr:d max_corr:d min_corr:d sd_corr:d p25:d p75:d violations:i", """SELECT
    avg(abs(corr)) AS avg_corr, max(abs(corr)) AS max_corr, min(abs(corr)) AS min_corr, stddev_samp(abs(corr)) AS sd_corr,
    quantile_cont(abs(corr), 0.25) AS p25, quantile_cont(abs(corr), 0.75) AS p75, count(*) FILTER (abs(corr) > 0.05) AS
    violations FROM pairs WHERE a < b""")
def _corr_sum(m):
    return rk.corr_summary(rk.pair_moments(m.returns()), 0.05)


@query("risk_diversification_ratio", "diversification_ratio:d", """SELECT avg(sqrt(cov)) FILTER (a = b) / (sqrt(sum(CASE WHEN
    a = b THEN cov ELSE 2 * cov END)) / count(*) FILTER (a = b)) AS diversification_ratio FROM pairs""")
def _div(m):
    return rk.diversification_ratio(rk.pair_moments(m.returns()))


@query("risk_position_correlation", "portfolio_id:i symbol avg_corr:d", """SELECT p.portfolio_id, p.symbol,
    sum(q.weight * abs(corr)) / sum(q.weight) AS avg_corr FROM positions p JOIN pairs2 ON a = p.symbol AND a <> b JOIN
    positions q ON q.symbol = b AND q.portfolio_id = p.portfolio_id GROUP BY 1, 2""")
def _pos_corr(m):
    return rk.position_correlation(m.positions(), rk.pair_moments(m.returns()))


_pen = {"linear": "1 - 2 * (abs(corr) - 0.02)", "exponential": "exp(-2 * (abs(corr) - 0.02))", "threshold": "0.5"}
for _m, _e in _pen.items():
    @query(f"risk_correlation_penalty_{_m}", "portfolio_id:i symbol penalty:d", f"""SELECT p.portfolio_id, p.symbol,
        greatest(min(CASE WHEN abs(corr) > 0.02 THEN 1 - (1 - ({_e})) * q.weight ELSE 1 END), 0.1) AS penalty FROM positions p
        JOIN pairs2 ON a = p.symbol AND a <> b JOIN positions q ON q.symbol = b AND q.portfolio_id = p.portfolio_id
        GROUP BY 1, 2""")
    def _penalty(m, method=_m):
        return rk.corr_penalty(m.positions(), rk.pair_moments(m.returns()), method, 0.02)


def sectors(m):
    return m.ticks().select("symbol").distinct().withColumn("sector", F.when(
        col("symbol").isin("CLICK", "VIEW", "ERROR"), "web").otherwise("sales"))


add_base("sector_pos", """SELECT *, sum(abs(weight)) OVER (PARTITION BY portfolio_id, sector) AS sector_weight FROM (SELECT *,
    CASE WHEN symbol IN ('CLICK', 'VIEW', 'ERROR') THEN 'web' ELSE 'sales' END AS sector FROM positions)""")


@query("risk_sector_concentration", "portfolio_id:i symbol sector sector_weight:d penalty:d", """SELECT *, CASE WHEN
    sector_weight > 0.4 THEN greatest(1 - 2 * (sector_weight - 0.4), 0.1) ELSE 1 END AS penalty FROM sector_pos""")
def _sector(m):
    return rk.sector_concentration(m.positions(), sectors(m))


@query("risk_correlation_clusters", "symbol cluster", """WITH RECURSIVE e AS (SELECT a, b FROM pairs2 WHERE a <> b AND
    abs(corr) > 0.04), reach AS (SELECT DISTINCT a AS s, a AS t FROM pairs2 UNION SELECT r.s, e.b FROM reach r JOIN e ON
    e.a = r.t) SELECT s AS symbol, min(t) AS cluster FROM reach GROUP BY 1""")
def _clusters(m):
    return rk.corr_clusters(rk.pair_moments(m.returns()), 0.04)


add_base("clusters", """SELECT s AS symbol, min(t) AS cluster FROM (WITH RECURSIVE e AS (SELECT a, b FROM pairs2 WHERE a <> b AND
    abs(corr) > 0.04), reach AS (SELECT DISTINCT a AS s, a AS t FROM pairs2 UNION SELECT r.s, e.b FROM reach r JOIN e ON
    e.a = r.t) SELECT * FROM reach) GROUP BY 1""")


@query("risk_cluster_quality", "within:d between:d", """SELECT avg(abs(corr)) FILTER (x.cluster = y.cluster) AS within, avg(abs(corr))
    FILTER (x.cluster <> y.cluster) AS between FROM pairs JOIN clusters x ON x.symbol = a JOIN clusters y ON y.symbol = b WHERE a < b""")
def _cluster_quality(m):
    p = rk.pair_moments(m.returns())
    return rk.cluster_quality(p, rk.corr_clusters(p, 0.04))


@query("risk_cluster_penalty", "portfolio_id:i symbol cluster_weight:d penalty:d", """SELECT portfolio_id, symbol,
    cluster_weight, CASE WHEN cluster_weight > 1.5 / k AND cs > 1 THEN 1 - least(0.5, cluster_weight * 0.5) ELSE 1 END AS
    penalty FROM (SELECT portfolio_id, symbol, sum(abs(weight)) OVER w AS cluster_weight, count(*) OVER w AS cs FROM positions
    JOIN clusters USING (symbol) WINDOW w AS (PARTITION BY portfolio_id, cluster)) JOIN (SELECT portfolio_id, count(DISTINCT cluster)
    AS k FROM positions JOIN clusters USING (symbol) GROUP BY 1) USING (portfolio_id)""")
def _cluster_pen(m):
    return rk.cluster_penalty(m.positions(), rk.corr_clusters(rk.pair_moments(m.returns()), 0.04), 1)


@query("risk_apply_penalties", "portfolio_id:i symbol adjusted:d", """SELECT portfolio_id, symbol, weight * CASE WHEN
    sector_weight > 0.4 THEN greatest(1 - 2 * (sector_weight - 0.4), 0.1) ELSE 1 END AS adjusted FROM sector_pos""")
def _apply(m):
    p = m.positions()
    return rk.apply_penalties(p, rk.sector_concentration(p, sectors(m)))


@query("risk_correlation_alerts", "portfolio_id:i type severity value:d", """SELECT CAST(NULL AS BIGINT) AS portfolio_id, 'HIGH_CORRELATION' AS
    type, 'HIGH' AS severity, max(abs(corr)) AS value FROM pairs WHERE a < b HAVING max(abs(corr)) > 0.01 UNION ALL
    SELECT portfolio_id, 'SECTOR_CONCENTRATION', 'MEDIUM', max(sector_weight) FROM sector_pos GROUP BY 1
    HAVING max(sector_weight) > 0.4""")
def _corr_alerts(m):
    s = rk.corr_summary(rk.pair_moments(m.returns()))
    return rk.correlation_alerts(s, rk.sector_concentration(m.positions(), sectors(m)), 0.01)


add_base("corr_reg", """SELECT ts, avg(abs(r)) FILTER (isfinite(r)) AS avg_corr, avg(abs(r)) FILTER (isfinite(r)) > 0.8 AS high FROM (SELECT t.ts, p.a, p.b,
    corr(ra, rb) AS r FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM rets)) t JOIN (SELECT a.symbol AS a, b.symbol AS b,
    a.i, a.ret AS ra, b.ret AS rb FROM (SELECT symbol, i, ret FROM rets JOIN (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM
    rets)) USING (ts)) a JOIN (SELECT symbol, i, ret FROM rets JOIN (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM rets))
    USING (ts)) b ON a.i = b.i AND a.symbol < b.symbol) p ON p.i BETWEEN t.i - 89 AND t.i WHERE t.i >= 90 GROUP BY 1, 2, 3) GROUP BY 1""")


@query("regime_correlation", "ts avg_corr:d high:b", "SELECT * FROM corr_reg")
def _corr_regime(m):
    return rk.correlation_regime(m.returns())


add_base("part_ret", """SELECT CAST(l_partkey AS VARCHAR) AS symbol, date_trunc('month', l_shipdate) AS ts, avg(l_discount - l_tax) AS ret FROM lineitem
    GROUP BY 1, 2""")


@query("risk_correlation_parts", "symbol pairs:i avg_corr:d4 max_corr:d4", """SELECT symbol, count(*) AS pairs, avg(abs(r)) AS avg_corr, max(abs(r)) AS max_corr
    FROM (SELECT unnest([a, b]) AS symbol, r FROM (SELECT a.symbol AS a, b.symbol AS b, corr(a.ret, b.ret) AS r, count(*) AS n FROM part_ret a JOIN part_ret b
    ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1, 2 HAVING count(*) >= 6 AND var_pop(a.ret) * count(*) > 1e-12 * sum(a.ret * a.ret) AND var_pop(b.ret) * count(*) > 1e-12 * sum(b.ret * b.ret))) GROUP BY 1""")
def _parts(m):
    """Monthly margin of every part against every other one."""
    f = m.raw("lineitem").groupBy(col("l_partkey").cast("string").alias("symbol"), F.date_trunc("month", "l_shipdate").alias("ts")).agg(
        F.avg(col("l_discount") - col("l_tax")).alias("ret"))
    return rk.correlation_summary(f, 6)


add_base("ret100", "SELECT * FROM rets QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100")
add_base("kelly", """SELECT *, (avg_win / avg_loss * win_rate - (1 - win_rate)) / (avg_win / avg_loss) AS kelly FROM (SELECT
    symbol, count(*) FILTER (ret > 0) / count(*) AS win_rate, avg(ret) FILTER (ret > 0) AS avg_win, abs(avg(ret) FILTER
    (ret < 0)) AS avg_loss, avg(ret) / stddev_samp(ret) AS sharpe FROM ret100 GROUP BY 1)""")


@query("sizing_kelly", "symbol win_rate:d avg_win:d avg_loss:d kelly:d kelly_adj:d sharpe:d growth:d", """SELECT *,
    kelly * 0.25 AS kelly_adj, (SELECT avg(ln(1 + k.kelly * 0.25 * ret)) FROM ret100 r WHERE r.symbol = k.symbol AND
    1 + k.kelly * 0.25 * ret > 0) AS growth FROM kelly k""")
def _kelly(m):
    r = m.returns()
    k = rk.kelly_single(r)
    return k.join(rk.kelly_growth(r, k), "symbol")


@query("sizing_inverse_volatility", "symbol vol:d weight:d", """SELECT symbol, vol, 0.15 / vol / sum(0.15 / vol) OVER () AS
    weight FROM (SELECT symbol, stddev_samp(ret) * sqrt(252) AS vol FROM rets GROUP BY 1)""")
def _invvol(m):
    return rk.inverse_vol_weights(m.returns())


add_base("sized", """SELECT *, CASE WHEN t > 0.3 THEN s2 * 0.3 / t ELSE s2 END AS size FROM (SELECT *, sum(abs(s2)) OVER
    (PARTITION BY portfolio_id) AS t FROM (SELECT *, CASE WHEN abs(s1) < 0.005 THEN 0 WHEN abs(s1) > 0.1 THEN sign(s1) * 0.1
    ELSE s1 END AS s2 FROM (SELECT portfolio_id, symbol, weight * 0.3 * ((0.4 + weight) / 0.6) ** 2 *
    least(greatest(0.15 / (sd * sqrt(252)), 0.1), 3) * least(greatest(1 + mu * 2520, 1 / 1.5), 1.5) AS s1 FROM positions JOIN
    (SELECT symbol, stddev_samp(ret) AS sd FROM (SELECT * FROM rets QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts
    DESC) <= 30) GROUP BY 1) USING (symbol) JOIN (SELECT symbol, avg(ret) AS mu FROM (SELECT * FROM rets QUALIFY row_number()
    OVER (PARTITION BY symbol ORDER BY ts DESC) <= 20) GROUP BY 1) USING (symbol))))""")


def _sized(m):
    p = m.positions().select("portfolio_id", "symbol", (col("weight") * 0.3).alias("size"),
                             (0.4 + col("weight")).alias("confidence"))
    return rk.size_adjust(p, m.returns(), max_exposure=0.3)


@query("sizing_adjusted", "portfolio_id:i symbol size:d", "SELECT * FROM sized")
def _size(m):
    return _sized(m)


@query("sizing_metrics", "portfolio_id:i total_allocation:d max_position:d positions:i hhi:d", """SELECT portfolio_id,
    sum(abs(size)) AS total_allocation, max(abs(size)) AS max_position, count(*) FILTER (size <> 0) AS positions,
    sum(size * size) AS hhi FROM sized GROUP BY 1""")
def _sizing(m):
    return rk.sizing_metrics(_sized(m))


add_base("sr_levels", """WITH x AS (SELECT symbol, ts, "close" AS level, CASE WHEN "close" = lo THEN 'support' ELSE 'resistance'
      END AS kind FROM (SELECT *, min("close") OVER w AS lo, max("close") OVER w AS hi, count(*) OVER w AS n FROM bars WINDOW w
      AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING)) WHERE n = 41 AND ("close" = lo OR
      "close" = hi)),
    g AS (SELECT *, sum(CASE WHEN level / prev - 1 <= 0.02 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, kind ORDER BY level,
      ts) AS grp FROM (SELECT *, lag(level) OVER (PARTITION BY symbol, kind ORDER BY level, ts) AS prev FROM x)),
    l AS (SELECT symbol, kind, grp, avg(level) AS level, count(*) AS members FROM g GROUP BY 1, 2, 3)
    SELECT l.symbol, kind, level, members, count(*) AS touches FROM l JOIN bars b ON b.symbol = l.symbol AND
    abs(b."close" - level) / level < 0.01 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2""")


@query("stops_support_resistance", "symbol kind level:d members:i touches:i", "SELECT * FROM sr_levels")
def _sr(m):
    return rk.support_resistance(m.bars())


add_base("regime50", """SELECT *, CASE WHEN m IS NULL THEN 'neutral' WHEN m > 0.001 AND abs(m) / sd > 0.1 THEN 'bull' WHEN m <
    -0.001 AND abs(m) / sd > 0.1 THEN 'bear' WHEN sd > 0.02 THEN 'volatile' ELSE 'neutral' END AS regime FROM (SELECT *,
    CASE WHEN count(r) OVER w = 50 THEN avg(r) OVER w END AS m, CASE WHEN count(r) OVER w = 50 THEN stddev_samp(r) OVER w END
    AS sd FROM numbered WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING))""")


@query("regime_simple", "symbol ts regime", "SELECT * FROM regime50")
def _regime(m):
    return rk.regime_simple(m.bars())


def entries(m):
    """One position per (symbol, day): entered at the first close of the day, long on even days."""
    b = m.bars()
    d = b.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.min("ts").alias("t0"), F.min_by("close", "ts").alias("entry"))
    return d.withColumns({"is_long": F.dayofmonth("day") % 2 == 0, "position_id": F.concat_ws("-", "symbol", "day")})


add_base("entries", """SELECT *, day(d) % 2 = 0 AS is_long, symbol || '-' || d AS position_id FROM (SELECT symbol,
    CAST(ts AS DATE) AS d, min(ts) AS t0, arg_min("close", ts) AS entry FROM bars GROUP BY 1, 2)""")


@query("stops_optimal", "position_id stop_pct:d stop_price:d risk_amount:d", """WITH a AS (SELECT symbol, atr / "close" AS atr_pct,
      regime FROM (SELECT *, avg(CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc))
      END) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING) AS atr FROM regime50) QUALIFY row_number() OVER (PARTITION
      BY symbol ORDER BY ts DESC) = 1),
    s AS (SELECT e.*, (SELECT max(level) FROM sr_levels l WHERE l.symbol = e.symbol AND kind = 'support' AND level < entry) AS sup,
      (SELECT min(level) FROM sr_levels l WHERE l.symbol = e.symbol AND kind = 'resistance' AND level > entry) AS res
      FROM entries e),
    t AS (SELECT *, CASE WHEN is_long THEN (entry - sup * 0.998) / entry ELSE (res * 1.002 - entry) / entry END AS sr
      FROM s JOIN a USING (symbol)),
    u AS (SELECT *, least(greatest(coalesce(CASE WHEN sr > 0 THEN sr END, 0.05 * least(greatest(atr_pct * 2 / 0.05, 0.5), 3)) *
      CASE regime WHEN 'bull' THEN 1.2 WHEN 'bear' THEN 0.8 WHEN 'volatile' THEN 1.5 ELSE 1 END, 0.01), 0.15) AS stop_pct FROM t)
    SELECT *, entry * (1 + CASE WHEN is_long THEN -1 ELSE 1 END * stop_pct) AS stop_price, 10 * entry * stop_pct AS risk_amount
    FROM u""")
def _optimal(m):
    from ..operators import technical as tech
    from ..operators.timeseries import latest
    b = m.bars()
    now = latest(tech.simple_rsi_atr_adx(rk.regime_simple(b)), "symbol", "ts")
    now = now.withColumn("atr_pct", col("atr_simple") / col("close"))
    return rk.optimal_stop(entries(m).withColumn("size", F.lit(10.0)), now, rk.support_resistance(b))


def paths(m):
    e = entries(m).withColumn("stop0", F.when(col("is_long"), col("entry") * 0.98).otherwise(col("entry") * 1.02))
    b = m.bars().select("symbol", "ts", "close", F.to_date("ts").alias("day"))
    return e.join(b, ["symbol", "day"])


add_base("stop_path", """SELECT *, CASE WHEN is_long THEN greatest(stop0, coalesce(max(c) OVER w, stop0)) ELSE
    least(stop0, coalesce(min(c) OVER w, stop0)) END AS stop FROM (SELECT *, CASE WHEN is_long AND px / entry - 1 >= 0.01 THEN
    greatest(entry, max(px) OVER w) * 0.995 WHEN NOT is_long AND 1 - px / entry >= 0.01 THEN least(entry, min(px) OVER w) * 1.005
    END AS c FROM (SELECT position_id, is_long, entry, b.ts, "close" AS px, CASE WHEN is_long THEN entry * 0.98 ELSE entry * 1.02
    END AS stop0 FROM entries e JOIN bars b ON b.symbol = e.symbol AND CAST(b.ts AS DATE) = e.d)
    WINDOW w AS (PARTITION BY position_id ORDER BY ts)) WINDOW w AS (PARTITION BY position_id ORDER BY ts)""")


@query("stops_trailing", "position_id ts stop:d", "SELECT * FROM stop_path")
def _trailing(m):
    return rk.trailing_stop(paths(m), trigger=0.01)


@query("stops_triggers", "position_id ts exit:d stop:d pnl_pct:d n:i", """SELECT * FROM (SELECT *, CASE WHEN is_long THEN
    exit / entry - 1 ELSE 1 - exit / entry END AS pnl_pct, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts,
    position_id) AS n FROM (SELECT position_id, entry, is_long, min(ts) AS ts, arg_min(px, ts) AS exit, arg_min(p, ts) AS stop
    FROM (SELECT *, coalesce(lag(stop) OVER (PARTITION BY position_id ORDER BY ts), stop0) AS p FROM stop_path) WHERE
    CASE WHEN is_long THEN px <= p ELSE px >= p END GROUP BY 1, 2, 3)) WHERE n <= 3""")
def _triggers(m):
    return rk.stop_triggers(rk.trailing_stop(paths(m), trigger=0.01))
