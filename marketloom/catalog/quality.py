"""Rule and cleaning queries over bars with planted faults (derived from the ticks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import col
from ..operators import cleaning as cl
from ..operators import quality as q
from .base import add_base, query

ISSUE = "symbol rule severity field n_bad:i"


def faulty(m):
    """Bars with faults by trade count: 3 high lowered, 4 low raised, 5 null close, 6 negative volume, 1 zero volume."""
    n = F.col("trades")
    return m.bars().withColumns({
        "high": F.when(n == 3, col("high") * 0.97).otherwise(col("high")),
        "low": F.when(n == 4, col("low") * 1.03).otherwise(col("low")),
        "close": F.when(n % 5 == 0, F.lit(None)).otherwise(col("close")),
        "volume": F.when(n == 6, -col("volume")).when(n == 1, 0.0).otherwise(col("volume")),
        "open": F.when(n == 7, 0.0).otherwise(col("open"))}).select(
            "symbol", "ts", "open", "high", "low", "close", "volume", "trades")


add_base("faulty", """SELECT symbol, ts, CASE WHEN trades = 7 THEN 0.0 ELSE open END AS open,
    CASE WHEN trades = 3 THEN high * 0.97 ELSE high END AS high, CASE WHEN trades = 4 THEN low * 1.03 ELSE low END AS low,
    CASE WHEN trades % 5 = 0 THEN NULL ELSE "close" END AS "close",
    CASE WHEN trades = 6 THEN -volume WHEN trades = 1 THEN 0.0 ELSE volume END AS volume, trades FROM bars""")


def issues(rows: list[tuple[str, str, str, str]], src: str) -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT symbol, '{r}' AS rule, '{s}' AS severity, '{f}' AS field, {n} AS n_bad FROM {src} GROUP BY symbol"
        for r, s, f, n in rows) + ") WHERE n_bad > 0"


def cnt(cond):
    return f"count(*) FILTER ({cond})"


@query("quality_required_columns", ISSUE, """
    SELECT DISTINCT symbol, 'missing_column' AS rule, 'ERROR' AS severity, 'adjusted_close' AS field, 1 AS n_bad
    FROM bars""")
def _required(m):
    return q.required_issues(m.bars(), ["open", "close", "adjusted_close"])


@query("quality_timestamps", ISSUE, """SELECT * FROM (
    SELECT symbol, 'time_gap' AS rule, 'WARNING' AS severity, 'ts' AS field, count(*) FILTER (gap > 3) AS n_bad
    FROM (SELECT symbol, epoch(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) / 3600 AS gap FROM bars) GROUP BY 1
    UNION ALL SELECT symbol, 'unsorted', 'WARNING', 'ts', count(*) FILTER (back) FROM (SELECT symbol,
    ts < lag(ts) OVER (PARTITION BY symbol ORDER BY volume * 1000 + trades, ts) AS back FROM bars) GROUP BY 1)
    WHERE n_bad > 0""")
def _timestamps(m):
    b = m.bars().withColumn("seq", F.struct(col("volume") * 1000 + col("trades"), "ts"))
    return q.check_timestamps(b, "seq", 3)


@query("quality_ohlc", ISSUE, issues(
    [r for p in ("open", "high", "low", '"close"') for r in (
        ("null_price", "ERROR", p.strip('"'), cnt(f"{p} IS NULL")),
        ("non_positive_price", "ERROR", p.strip('"'), cnt(f"{p} <= 0")),
        ("price_out_of_range", "WARNING", p.strip('"'), cnt(f"{p} > 0 AND ({p} < 0.001 OR {p} > 1e6)")))] +
    [("high_below_body_or_low", "ERROR", "high",
      cnt('high < greatest(open, "close") - 0.001 OR high < low - 0.001')),
     ("low_above_body", "ERROR", "low", cnt('low > least(open, "close") + 0.001 OR low > high + 0.001'))], "faulty"))
def _ohlc(m):
    return q.check_ohlc(faulty(m))


@query("quality_volume", ISSUE, issues([
    ("negative_volume", "ERROR", "volume", cnt("volume < 0")),
    ("volume_too_large", "WARNING", "volume", cnt("volume > 1e12")),
    ("zero_volume_share", "WARNING", "volume",
     f"CASE WHEN {cnt('volume = 0')} > count(*) * 0.1 THEN {cnt('volume = 0')} ELSE 0 END")], "faulty"))
def _volume(m):
    return q.check_volume(faulty(m))


@query("quality_price_change", ISSUE, """SELECT symbol, 'price_jump' AS rule, 'WARNING' AS severity, 'close' AS field,
    count(*) FILTER (abs(("close" - pc) / pc) * 100 > 2) AS n_bad FROM (SELECT *, lag("close") OVER
    (PARTITION BY symbol ORDER BY ts) AS pc FROM bars) GROUP BY 1 HAVING n_bad > 0""")
def _change(m):
    return q.check_price_change(m.bars(), 2.0)


@query("quality_duplicates", ISSUE, """SELECT symbol, 'duplicate_rows' AS rule,
    CASE WHEN sum(c - 1) / sum(c) > 0.1 THEN 'ERROR' ELSE 'WARNING' END AS severity, '*' AS field, sum(c - 1) AS n_bad
    FROM (SELECT source AS symbol, md5(text) AS h, lang, count(*) AS c FROM documents GROUP BY 1, 2, 3) GROUP BY 1
    HAVING n_bad > 0""")
def _dupes(m):
    return q.check_duplicates(m.raw("documents").select(col("source").alias("symbol"), F.md5("text").alias("h"),
                                                        "lang"))


@query("quality_range", ISSUE, issues([("out_of_range", "ERROR", "score", cnt("score < -0.9 OR score > 0.9"))], "sent"))
def _range(m):
    return q.check_range(m.sentiment(), "score", -0.9, 0.9)


@query("quality_mentions", ISSUE, issues([
    ("negative_count", "ERROR", "mentions", cnt("mentions - 10 < 0")),
    ("count_too_large", "WARNING", "mentions", cnt("mentions - 10 > 1000000"))], "sent"))
def _mentions(m):
    return q.check_mentions(m.sentiment().withColumn("mentions", col("mentions") - 10))


@query("quality_sources", ISSUE, """SELECT symbol, 'unknown_source' AS rule, 'WARNING' AS severity, source AS field,
    count(*) AS n_bad FROM sent WHERE source IN ('twitter', 'unusual_whales') GROUP BY 1, 4""")
def _sources(m):
    return q.check_sources(m.sentiment(), ("reddit", "news"))


@query("quality_symbols_absent", ISSUE, """SELECT CAST(p_partkey AS VARCHAR) AS symbol, 'symbol_absent' AS rule,
    'ERROR' AS severity, 'symbol' AS field, 1 AS n_bad FROM part
    WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def _absent(m):
    want = m.raw("part").select(col("p_partkey").cast("string").alias("symbol"))
    have = m.raw("lineitem").filter("l_quantity > 49").select(col("l_partkey").cast("string").alias("symbol"))
    return q.check_symbol_present(want, have)


def feature_rows(m):
    """A map of twelve features per tick with planted nulls, infinities and one far value."""
    v, k = col("price"), col("qty")
    t = m.ticks()
    names = [F.lit(f"f{i}") for i in range(10)]
    pairs = [x for i, n in enumerate(names) for x in (n, (k * (i + 3)) % 11.0 + 0.5)]
    far = F.when(k % 9 == 0, v * 1e7).when(k % 9 == 1, F.lit(float("inf"))).when(k % 9 == 2, F.lit(None)).otherwise(v)
    return t.select("event_id", "symbol", F.create_map(
        *pairs, F.lit("far"), far, F.lit("bad name"), F.when(k % 4 == 0, F.lit(float("nan"))).otherwise(k))
        .alias("features"))


add_base("feature_long", """SELECT event_id, symbol, name, CASE name
      WHEN 'far' THEN CASE WHEN qty % 9 = 0 THEN price * 1e7 WHEN qty % 9 = 1 THEN 'inf'::DOUBLE
        WHEN qty % 9 = 2 THEN NULL ELSE price END
      WHEN 'bad name' THEN CASE WHEN qty % 4 = 0 THEN 'nan'::DOUBLE ELSE qty END
      ELSE (qty * (CAST(substr(name, 2) AS INT) + 3)) % 11 + 0.5 END AS value
    FROM ticks, (SELECT unnest(['f0','f1','f2','f3','f4','f5','f6','f7','f8','f9','far','bad name']) AS name)""")

_MISS = "(value IS NULL OR isnan(value))"


@query("quality_features", ISSUE, f"""SELECT * FROM (
    SELECT symbol, 'null_feature' AS rule, 'WARNING' AS severity, 'features' AS field, {cnt(_MISS)} AS n_bad
    FROM feature_long GROUP BY 1 UNION ALL
    SELECT symbol, 'infinite_feature', 'ERROR', 'features', {cnt('isinf(value)')} FROM feature_long GROUP BY 1 UNION ALL
    SELECT symbol, 'feature_out_of_range', 'WARNING', 'features',
      {cnt('isfinite(value) AND abs(value) > 1e6')} FROM feature_long GROUP BY 1 UNION ALL
    SELECT symbol, 'bad_feature_name', 'WARNING', 'features', {cnt("name = 'bad name'")} FROM feature_long GROUP BY 1
    UNION ALL SELECT symbol, 'too_many_missing', 'ERROR', 'features', {cnt('miss > 0.3 * n')} FROM (SELECT symbol,
      event_id, {cnt(_MISS)} AS miss, count(*) AS n FROM feature_long GROUP BY 1, 2) GROUP BY 1) WHERE n_bad > 0""")
def _features(m):
    return q.check_features(feature_rows(m))


# Sums run over the features in the order of the row, as the query's do: another order gives other last digits.
_ROW = """(SELECT event_id, n, mu, sqrt(list_reduce(list_transform(v, lambda x: (x - mu) * (x - mu)), lambda a, x: a + x) / n) AS sd
    FROM (SELECT event_id, v, len(v) AS n, list_reduce(v, lambda a, x: a + x) / len(v) AS mu FROM (SELECT event_id,
      list(value ORDER BY list_position(['f0','f1','f2','f3','f4','f5','f6','f7','f8','f9','far','bad name'], name)) AS v
      FROM feature_long WHERE isfinite(value) GROUP BY 1)))"""


@query("quality_feature_outliers", "event_id:i name value:d z:d", f"""
    SELECT event_id, name, value, (value - mu) / sd AS z FROM feature_long JOIN {_ROW} USING (event_id)
    WHERE n > 10 AND sd > 0 AND abs((value - mu) / sd) > 3""")
def _outlying(m):
    return q.feature_outliers(feature_rows(m), z=3.0)


_score = """SELECT b.symbol, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings,
    least(greatest(1 - 0.1 * coalesce(errors, 0) - 0.05 * coalesce(warnings, 0) + 0.1, 0), 1) AS score,
    coalesce(errors, 0) = 0 AS is_valid"""


@query("quality_score_market", "symbol errors:i warnings:i score:d is_valid:b", f"""
    {_score} FROM (SELECT DISTINCT symbol FROM bars) b LEFT JOIN (SELECT symbol,
      count(*) FILTER (sev = 'E') AS errors, count(*) FILTER (sev = 'W') AS warnings FROM (
        SELECT symbol, 'E' AS sev FROM faulty GROUP BY 1 HAVING count(*) FILTER ("close" IS NULL) > 0 UNION ALL
        SELECT symbol, 'E' FROM faulty GROUP BY 1 HAVING count(*) FILTER (open <= 0) > 0 UNION ALL
        SELECT symbol, 'E' FROM faulty GROUP BY 1
          HAVING count(*) FILTER (high < greatest(open, "close") - 0.001 OR high < low - 0.001) > 0 UNION ALL
        SELECT symbol, 'E' FROM faulty GROUP BY 1
          HAVING count(*) FILTER (low > least(open, "close") + 0.001 OR low > high + 0.001) > 0 UNION ALL
        SELECT symbol, 'E' FROM faulty GROUP BY 1 HAVING count(*) FILTER (volume < 0) > 0 UNION ALL
        SELECT symbol, 'W' FROM faulty GROUP BY 1
          HAVING count(*) FILTER (volume = 0) > 0.1 * count(*)) GROUP BY 1) i USING (symbol)""")
def _score_market(m):
    b = faulty(m)
    return q.quality_score(q.market_issues(b), b.select("symbol").distinct(), "market")


@query("quality_score_sentiment", "symbol errors:i warnings:i score:d is_valid:b", """
    SELECT symbol, 0 AS errors, 0 AS warnings, least(1 + least(0.2, 0.05 * count(DISTINCT source)) +
    0.1 * avg(confidence), 1) AS score, true AS is_valid FROM sent GROUP BY 1""")
def _score_sentiment(m):
    s = m.sentiment()
    extra = s.groupBy("symbol").agg(F.countDistinct("source").alias("n_sources"),
                                    F.avg("confidence").alias("avg_confidence"))
    return q.quality_score(q.sentiment_issues(s), extra, "sentiment")


# ------------------------------------------------------------------ cleaning

@query("clean_drop_duplicates", "h lang n_chars:i", """
    SELECT DISTINCT md5(text) AS h, lang, n_chars FROM documents""")
def _drop(m):
    return cl.drop_dupes(m.raw("documents").select(F.md5("text").alias("h"), "lang", "n_chars"))


@query("clean_repair_ohlc", "symbol ts high:d low:d ohlc_fixed:b", """
    SELECT symbol, ts, CASE WHEN "close" IS NULL THEN high ELSE greatest(open, high, low, "close") END AS high,
    CASE WHEN "close" IS NULL THEN low ELSE least(open, high, low, "close") END AS low,
    "close" IS NOT NULL AND (greatest(open, high, low, "close") <> high OR least(open, high, low, "close") <> low)
    AS ohlc_fixed FROM faulty""")
def _repair(m):
    return cl.repair_ohlc(faulty(m))


@query("clean_repair_low_values", "symbol ts open:d volume:d", """
    SELECT symbol, ts, CASE WHEN open >= 0.001 THEN open END AS open, greatest(volume, 0) AS volume FROM faulty
    WHERE volume > 0 OR volume IS NULL""")
def _low(m):
    return cl.repair_low_values(faulty(m), drop_zero_volume=True)


@query("clean_sentiment_fields", "event_id:i score:d confidence:d mentions:i source", """
    SELECT event_id, least(greatest(score * 2, -1), 1) AS score, least(greatest(confidence * 2, 0), 1) AS confidence,
    greatest(mentions - 30, 0) AS mentions, CASE source WHEN 'reddit' THEN 'reddit' WHEN 'news' THEN 'news'
    WHEN 'twitter' THEN 'twitter' ELSE 'unusual_whales' END AS source FROM sent""")
def _fields(m):
    alias = F.when(col("source") == "reddit", "WSB").when(col("source") == "news", "Article").when(
        col("source") == "twitter", "tweet").otherwise("UnusualWhales")
    return cl.clean_sentiment(m.sentiment().withColumns({
        "score": col("score") * 2, "confidence": col("confidence") * 2, "mentions": col("mentions") - 30,
        "source": alias}))


_W = "PARTITION BY symbol ORDER BY ts"
for _strategy, _sql in {
    "drop": 'SELECT symbol, ts, "close" FROM faulty WHERE "close" IS NOT NULL',
    "ffill": f'SELECT symbol, ts, last_value("close" IGNORE NULLS) OVER ({_W}) AS "close" FROM faulty',
    "bfill": f"""SELECT symbol, ts, first_value("close" IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND
        UNBOUNDED FOLLOWING) AS "close" FROM faulty""",
    "median": """SELECT symbol, ts, coalesce("close", med) AS "close" FROM faulty JOIN (SELECT symbol,
        median("close") AS med FROM faulty GROUP BY 1) USING (symbol)""",
    "interpolate": f"""SELECT symbol, ts, coalesce("close", v0 + (v1 - v0) * (rn - p0) / (p1 - p0), v0) AS "close" FROM (
        SELECT *, last_value("close" IGNORE NULLS) OVER w AS v0,
          last_value(CASE WHEN "close" IS NOT NULL THEN rn END IGNORE NULLS) OVER w AS p0,
          first_value("close" IGNORE NULLS) OVER f AS v1,
          first_value(CASE WHEN "close" IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS p1
        FROM (SELECT *, row_number() OVER ({_W}) AS rn FROM faulty)
        WINDOW w AS ({_W}), f AS ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
}.items():
    @query(f"clean_impute_{_strategy}", "symbol ts close:d", _sql)
    def _impute(m, strategy=_strategy):
        return cl.impute(faulty(m), ["close"], strategy)


@query("clean_interpolate_run_limit", "symbol ts close:d", f"""
    WITH n AS (SELECT *, row_number() OVER ({_W}) AS rn FROM faulty), g AS (SELECT *,
      last_value("close" IGNORE NULLS) OVER w AS v0, first_value("close" IGNORE NULLS) OVER f AS v1,
      last_value(CASE WHEN "close" IS NOT NULL THEN rn END IGNORE NULLS) OVER w AS p0,
      first_value(CASE WHEN "close" IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS p1
      FROM n WINDOW w AS ({_W}), f AS ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    runs AS (SELECT symbol, max(c) AS worst FROM (SELECT symbol, rn - k AS isl, count(*) AS c FROM (SELECT symbol, rn,
      row_number() OVER (PARTITION BY symbol ORDER BY rn) AS k FROM n WHERE "close" IS NULL) GROUP BY 1, 2) GROUP BY 1)
    SELECT g.symbol, ts, CASE WHEN worst <= 2 THEN coalesce("close", v0 + (v1 - v0) * (rn - p0) / (p1 - p0), v0)
      ELSE "close" END AS "close" FROM g JOIN runs USING (symbol)""")
def _run_limit(m):
    return cl.impute(faulty(m), ["close"], "interpolate", max_run=2)


add_base("value_stats", """SELECT symbol, avg(price) AS mu, stddev_samp(price) AS sd, count(*) AS n,
    max(abs(price - avg_p)) / stddev_samp(price) AS worst, quantile_cont(price, 0.01) AS p1,
    quantile_cont(price, 0.99) AS p99, list(price ORDER BY price) AS xs
    FROM (SELECT *, avg(price) OVER (PARTITION BY symbol) AS avg_p FROM ticks) GROUP BY 1""")
for _method, _sql in {
    "remove": """SELECT event_id, price FROM ticks JOIN value_stats USING (symbol)
        WHERE NOT (n >= 10 AND abs(price - mu) / sd > 4)""",
    "clip": """SELECT event_id, CASE WHEN worst > 4 THEN least(greatest(price, mu - 4 * sd), mu + 4 * sd) ELSE price
        END AS price FROM ticks JOIN value_stats USING (symbol)""",
    "cap": """SELECT event_id, CASE WHEN worst > 4 THEN least(greatest(price, p1), p99) ELSE price END AS price
        FROM ticks JOIN value_stats USING (symbol)""",
    "winsorize": """SELECT event_id, CASE WHEN worst > 4 THEN least(greatest(price, xs[CAST(floor(0.01 * n) AS INT) + 1]),
        xs[n - CAST(floor(0.01 * n) AS INT)]) ELSE price END AS price FROM ticks JOIN value_stats USING (symbol)""",
}.items():
    @query(f"clean_outliers_{_method}", "event_id:i price:d", _sql)
    def _outlier(m, method=_method):
        return cl.outliers(m.ticks(), "price", method, z=4.0)


@query("clean_feature_outliers_clip", "event_id:i name value:d2", f"""
    SELECT event_id, name, CASE WHEN value IS NULL OR isnan(value) THEN NULL WHEN n > 10 AND sd > 0 THEN
    least(greatest(value, mu - 3 * sd), mu + 3 * sd) ELSE value END AS value
    FROM feature_long JOIN {_ROW} USING (event_id)""")
def _feature_clip(m):
    # as in the SQL, an event without a single finite feature has no statistics and no rows
    rows = feature_rows(m).filter(F.exists(F.map_values("features"), lambda x: F.abs(x) < float("inf")))
    d = cl.clip_feature_outliers(rows, z=3.0)
    d = d.select("event_id", F.explode("features").alias("name", "value"))
    return d.withColumn("value", F.when(~F.isnan("value"), col("value")))


@query("clean_fill_gaps", "symbol ts close:d volume:d filled:b", f"""
    WITH grid AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bars GROUP BY 1),
    j AS (SELECT g.symbol, g.ts, b."close", b.volume, row_number() OVER (PARTITION BY g.symbol ORDER BY g.ts) AS rn
      FROM grid g LEFT JOIN bars b USING (symbol, ts)),
    k AS (SELECT *, last_value("close" IGNORE NULLS) OVER w AS c0, first_value("close" IGNORE NULLS) OVER f AS c1,
      last_value(volume IGNORE NULLS) OVER w AS v0, first_value(volume IGNORE NULLS) OVER f AS v1,
      last_value(CASE WHEN "close" IS NOT NULL THEN rn END IGNORE NULLS) OVER w AS p0,
      first_value(CASE WHEN "close" IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS p1
      FROM j WINDOW w AS ({_W}), f AS ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT symbol, ts, coalesce("close", c0 + (c1 - c0) * (rn - p0) / (p1 - p0)) AS "close",
      coalesce(volume, v0 + (v1 - v0) * (rn - p0) / (p1 - p0)) AS volume, "close" IS NULL AS filled FROM k""")
def _gaps(m):
    return cl.fill_gaps(m.bars(), ["close", "volume"])


_fit = """(SELECT avg(volume) AS mu, stddev_pop(volume) AS sd, min(volume) AS lo, max(volume) AS hi,
    quantile_cont(volume, 0.25) AS q1, median(volume) AS q2, quantile_cont(volume, 0.75) AS q3 FROM bars
    WHERE ts < TIMESTAMP '2024-01-20')"""
for _method, _expr in {"standard": "(volume - mu) / sd", "minmax": "(volume - lo) / (hi - lo)",
                       "robust": "(volume - q2) / (q3 - q1)"}.items():
    @query(f"clean_scale_{_method}", "symbol ts scaled_volume:d",
           f"SELECT symbol, ts, {_expr} AS scaled_volume FROM bars, {_fit}")
    def _scale(m, method=_method):
        b = m.bars()
        return cl.scale(b.filter("ts < timestamp_ntz'2024-01-20'"), b, ["volume"], method)


@query("clean_features", "event_id:i name value:d2", """
    SELECT event_id, name, CASE WHEN value IS NULL OR NOT isfinite(value) THEN 0.0
    ELSE least(greatest(value, -1e6), 1e6) END AS value FROM feature_long""")
def _clean_features(m):
    return cl.clean_features(feature_rows(m)).select("event_id", F.explode("features").alias("name", "value"))


@query("clean_features_drop_invalid", "event_id:i name value:d2", """
    SELECT event_id, name, least(greatest(value, -1e6), 1e6) AS value FROM feature_long WHERE isfinite(value)""")
def _drop_invalid(m):
    return cl.clean_features(feature_rows(m), drop_invalid=True).select(
        "event_id", F.explode("features").alias("name", "value"))


@query("clean_select_top_features", "event_id:i name value:d2", """
    SELECT event_id, name, value FROM (SELECT event_id, name, CASE WHEN value IS NULL OR NOT isfinite(value) THEN 0.0
      ELSE least(greatest(value, -1e6), 1e6) END AS value FROM feature_long)
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(value) DESC, name) <= 3""")
def _top(m):
    d = cl.select_top_features(cl.clean_features(feature_rows(m)), 3)
    return d.select("event_id", F.explode("features").alias("name", "value"))


@query("clean_report", "symbol rows_in:i null_close:i negative_volume:i rows_out:i filled:i ohlc_fixed:i", """
    WITH a AS (SELECT symbol, count(*) AS rows_in, count(*) FILTER ("close" IS NULL) AS null_close,
      count(*) FILTER (volume < 0) AS negative_volume, count(*) FILTER ("close" IS NOT NULL AND
      (greatest(open, high, low, "close") <> high OR least(open, high, low, "close") <> low)) AS ohlc_fixed,
      epoch(max(ts) - min(ts)) / 3600 + 1 AS rows_out FROM faulty GROUP BY 1)
    SELECT symbol, rows_in, null_close, negative_volume, rows_out, rows_out - rows_in AS filled, ohlc_fixed FROM a""")
def _report(m):
    raw = faulty(m)
    return cl.clean_report(raw, cl.clean_market(raw))
