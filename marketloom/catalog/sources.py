"""Scan, upsert, retention, standardisation, join and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import col
from ..operators import timeseries as ts
from ..sources import store
from ..sources.bars import ohlcv_bars
from ..session import scratch_path
from .base import add_base, query

CUT = "TIMESTAMP '2024-01-15'"


@query("read_bars", "symbol ts close:d", f"""SELECT symbol, ts, "close" FROM bars WHERE symbol = 'CLICK'
    AND ts BETWEEN TIMESTAMP '2024-01-05' AND {CUT} ORDER BY ts DESC LIMIT 100""")
def _read_bars(m):
    return store.read_bars(m.bars(), "click", None, "2024-01-05", "2024-01-15", 100)


@query("read_sentiment", "event_id:i symbol source score:d", f"""SELECT event_id, symbol, source, score FROM sent
    WHERE symbol = 'VIEW' AND source IN ('news', 'reddit') AND ts >= {CUT} ORDER BY ts DESC, event_id LIMIT 200""")
def _read_sentiment(m):
    s = m.sentiment().filter("symbol = 'VIEW'")
    return store.read_sentiment(s, None, ["news", "reddit"], "2024-01-15", None, 200, tie=["event_id"])


def signals(m):
    o = m.orders()
    return o.select(
        col("order_id").cast("string").alias("signal_id"), (col("account") % 50).cast("string").alias("symbol"),
        F.when(col("order_id") % 3 == 0, "BUY").when(col("order_id") % 3 == 1, "SELL").otherwise("HOLD")
        .alias("signal_type"), ((col("order_id") % 101) / 100).alias("strength"), (col("status") == "filled")
        .alias("executed"), F.lit(None).cast("double").alias("executed_price"),
        F.lit(None).cast("timestamp_ntz").alias("executed_at"), col("ts"),
        F.when(col("order_id") % 4 > 0, col("ts") + F.expr("interval 90 days")).alias("expires_at"))


add_base("signals", """SELECT CAST(order_id AS VARCHAR) AS signal_id, CAST(account % 50 AS VARCHAR) AS symbol,
    CASE order_id % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'HOLD' END AS signal_type,
    (order_id % 101) / 100 AS strength, status = 'filled' AS executed, ts,
    CASE WHEN order_id % 4 > 0 THEN ts + INTERVAL 90 DAY END AS expires_at FROM ords""")


@query("active_signals", "signal_id symbol signal_type strength:d ts", """SELECT * FROM signals WHERE NOT executed
    AND (expires_at IS NULL OR expires_at > TIMESTAMP '2001-01-01') AND signal_type IN ('BUY', 'SELL')""")
def _active(m):
    return store.active_signals(signals(m), "2001-01-01", types=["BUY", "SELL"])


@query("upsert_last_write_wins", "symbol day close:d version:i", """SELECT symbol, day, "close", version FROM (
    SELECT upper(symbol) AS symbol, date_trunc('day', ts) AS day, "close", epoch_us(ts) AS version FROM bars)
    QUALIFY row_number() OVER (PARTITION BY symbol, day ORDER BY version DESC) = 1""")
def _upsert(m):
    b = m.bars().select("symbol", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "close",
                        F.unix_micros(col("ts").cast("timestamp")).alias("version"))
    old, new = b.filter("version % 2000000 = 0"), b.filter("version % 2000000 <> 0")
    return store.upsert(old, new, ["symbol", "day"], ["version"])


@query("upsert_partitioned_table", "symbol ts version:i tier:i close:d", """WITH old AS (SELECT symbol, ts, 1 AS version, CAST(floor("close") AS BIGINT) %
    4 AS tier, "close" FROM bars), new AS (SELECT symbol, ts, 2 AS version, CAST(floor("close") AS BIGINT) % 4 // 2 * 2 AS tier, "close" + 1 AS
    "close" FROM bars WHERE hour(ts) % 2 = 0 OR CAST(floor("close") AS BIGINT) % 4 = 3) SELECT * FROM (SELECT * FROM old UNION ALL SELECT * FROM new)
    QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY version DESC) = 1""")
def _upsert_table(m):
    """Keys that change their partition, and a partition that loses all of its rows."""
    path = scratch_path(m.spark, "upsert-table")
    tier = F.floor("close") % 4
    b = m.bars().select("symbol", "ts", "close")
    b.select("symbol", "ts", F.lit(1).alias("version"), tier.alias("tier"), "close").write.partitionBy("tier").parquet(path)
    batch = b.filter((F.hour("ts") % 2 == 0) | (tier == 3)).select(
        "symbol", "ts", F.lit(2).alias("version"), (F.floor(tier / 2) * 2).alias("tier"), (col("close") + 1).alias("close"))
    store.upsert_partitions(path, batch, ["symbol", "ts"], ["version"], "tier")
    return m.spark.read.parquet(path)


@query("append_and_read_back", "symbol n:i", "SELECT symbol, 2 * count(*) AS n FROM bars GROUP BY 1")
def _append(m):
    path = scratch_path(m.spark, "append")
    b = m.bars().withColumn("day", F.to_date("ts"))
    store.append_batch(b, path, ["day"])
    store.append_batch(b, path, ["day"])
    return m.spark.read.parquet(path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("mark_executed", "signal_id executed:b executed_price:d executed_at", """
    SELECT signal_id, executed OR fill_at IS NOT NULL AS executed, price AS executed_price, fill_at AS executed_at
    FROM signals LEFT JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS signal_id, max(l_extendedprice) AS price,
    max(l_shipdate) AS fill_at FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) USING (signal_id)""")
def _mark(m):
    e = m.raw("lineitem").filter("l_returnflag = 'R'").groupBy(col("l_orderkey").cast("string").alias("signal_id")).agg(
        F.max("l_extendedprice").alias("price"), F.max("l_shipdate").alias("at"))
    return store.mark_executed(signals(m), e)


def _tf(df):
    return df.withColumn("timeframe", F.when(F.hour("ts") % 2 == 0, "5min").otherwise("1day"))


@query("retain_recent", "symbol ts timeframe", f"""SELECT symbol, ts, timeframe FROM (SELECT *, CASE WHEN hour(ts) % 2 = 0
    THEN '5min' ELSE '1day' END AS timeframe FROM bars) WHERE NOT (ts < TIMESTAMP '2024-01-30' - INTERVAL 10 DAY
    AND timeframe IN ('1min', '5min', '15min'))""")
def _retain(m):
    return store.retain(_tf(m.bars()), "bars", "2024-01-30", 10)


@query("retention_report", "table deleted:i total:i", """
    SELECT 'market_data' AS "table", count(*) FILTER (hour(ts) % 2 = 0 AND ts < TIMESTAMP '2024-01-20') AS deleted,
      count(*) AS total FROM bars UNION ALL
    SELECT 'sentiment_data', count(*) FILTER (ts < TIMESTAMP '2024-01-20'), count(*) FROM sent UNION ALL
    SELECT 'trading_signals', count(*) FILTER (executed AND ts < TIMESTAMP '2024-01-20'), count(*) FROM signals""")
def _retention(m):
    return store.retention_report({"market_data": (_tf(m.bars()), "bars"), "sentiment_data": (
        m.sentiment(), "sentiment"), "trading_signals": (signals(m), "signals")}, "2024-01-30", 10)


@query("table_stats", "table rows:i first_ts last_ts", """
    SELECT 'market_data' AS "table", count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM bars UNION ALL
    SELECT 'orders', count(*), min(ts), max(ts) FROM ords UNION ALL
    SELECT 'fills', count(*), min(ts), max(ts) FROM fills""")
def _stats(m):
    return store.table_stats({"market_data": (m.bars(), "ts"), "orders": (m.orders(), "ts"),
                              "fills": (m.fills(), "ts")})


@query("data_summary", "symbol records:i first_ts last_ts avg_close:d", """SELECT symbol, count(*) AS records,
    min(ts) AS first_ts, max(ts) AS last_ts, avg("close") AS avg_close FROM bars GROUP BY 1""")
def _summary(m):
    return store.data_summary(m.bars())


@query("sentiment_summary", "symbol source records:i avg_score:d",
       "SELECT symbol, source, count(*) AS records, avg(score) AS avg_score FROM sent GROUP BY 1, 2")
def _sent_summary(m):
    return store.sentiment_summary(m.sentiment())


@query("standardize_price_series", "symbol ts open:d close:d volume:d", """SELECT upper(symbol) AS symbol,
    date_trunc('millisecond', ts) AS ts, price AS open, price AS "close", 0.0 AS volume FROM ticks""")
def _std_price(m):
    t = m.ticks().select("symbol", F.unix_millis(col("ts").cast("timestamp")).alias("time_ms"),
                         col("price").cast("string").alias("price"))
    return store.standardize_ohlcv(t, "price_series")


@query("standardize_numbered_feed", "symbol ts open:d high:d close:d volume:d source", """SELECT upper(symbol) AS symbol,
    ts, open, high, "close", volume, 'bars_numbered' AS source FROM bars""")
def _std_num(m):
    b = m.bars().select("symbol", col("ts").cast("string").alias("timestamp"), *[
        col(c).cast("string").alias(f"{i + 1}. {c}") for i, c in enumerate(["open", "high", "low", "close", "volume"])])
    return store.standardize_ohlcv(b, "bars_numbered")


@query("standardize_short_feed", "symbol ts open:d high:d low:d close:d volume:d source", """SELECT upper(symbol) AS symbol, ts, open, high, low, "close", volume,
    'bars_short' AS source FROM bars""")
def _std_short(m):
    b = m.bars().select("symbol", F.unix_millis(col("ts").cast("timestamp")).alias("t"), *[
        col(c).cast("string").alias(c[0]) for c in ("open", "high", "low", "close", "volume")])
    return store.standardize_ohlcv(b, "bars_short")


@query("standardize_plain_feed", "symbol ts open:d high:d low:d close:d volume:d source", """SELECT upper(symbol) AS symbol, ts, open, high, low, "close",
    CASE WHEN hour(ts) % 5 = 0 THEN 0.0 ELSE volume END AS volume, 'bars_plain' AS source FROM bars""")
def _std_plain(m):
    """Volumes that are no numbers count as 0."""
    b = m.bars().select("symbol", col("ts").cast("string").alias("timestamp"), "open", "high", "low", "close",
                        F.when(F.hour("ts") % 5 == 0, "n/a").otherwise(col("volume").cast("string")).alias("volume"))
    return store.standardize_ohlcv(b, "bars_plain")


@query("coalesce_sources", "symbol hour source score:d", """SELECT symbol, hour, source, score FROM (
    SELECT symbol, date_trunc('hour', ts) AS hour, source, avg(score) AS score FROM sent GROUP BY 1, 2, 3)
    QUALIFY row_number() OVER (PARTITION BY symbol, hour ORDER BY list_position(['news', 'twitter', 'reddit'], source)
    NULLS LAST, source DESC) = 1""")
def _coalesce(m):
    s = m.sentiment().groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "source").agg(
        F.avg("score").alias("score"))
    return store.coalesce_sources(s, ["news", "twitter", "reddit"], ["symbol", "hour"])


for _f, _trunc in {"1m": "INTERVAL 1 MINUTE", "5m": "INTERVAL 5 MINUTE", "15m": "INTERVAL 15 MINUTE", "1h": "INTERVAL 1 HOUR",
                   "1d": "INTERVAL 1 DAY"}.items():
    @query(f"bars_{_f}", "symbol ts open:d high:d low:d close:d volume:d vwap:d8 trades:i", f"""
        SELECT symbol, time_bucket({_trunc}, ts) AS ts, arg_min(price, ts) AS open, max(price) AS high,
        min(price) AS low, arg_max(price, ts) AS "close", sum(qty) AS volume,
        sum(price * qty) / nullif(sum(qty), 0) AS vwap, count(*) AS trades FROM ticks GROUP BY 1, 2""")
    def _bars(m, f=_f):
        return ohlcv_bars(m.ticks(), f)


@query("clean_fundamentals", "symbol:i eps:d beta:d", """SELECT p_partkey AS symbol,
    CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice / 10 END AS eps, CASE WHEN p_size % 3 = 0 THEN NULL
    ELSE p_size / 10 END AS beta FROM part""")
def _fund(m):
    s = col("p_size")
    raw = m.raw("part").select(
        col("p_partkey").alias("symbol"),
        F.when(s % 10 == 0, "None").when(s % 10 == 5, "-").otherwise((col("p_retailprice") / 10).cast("string"))
        .alias("eps"), F.when(s % 3 == 0, "").otherwise((s / 10).cast("string")).alias("beta"))
    return store.clean_fundamentals(raw, ["eps", "beta"])


@query("economic_series", "indicator date value:d", """SELECT 'nation_' || (o_custkey % 5) AS indicator,
    CAST(o_orderdate AS DATE) AS date, o_totalprice AS value FROM orders WHERE o_orderkey % 7 <> 0""")
def _economic(m):
    o = m.raw("orders")
    bad = col("o_orderkey") % 7 == 0
    return store.economic_series(o.select(
        F.concat(F.lit("nation_"), (col("o_custkey") % 5).cast("string")).alias("indicator"),
        F.to_date("o_orderdate").cast("string").alias("date"),
        F.when(bad, ".").otherwise(col("o_totalprice").cast("string")).alias("value")))


@query("news_ticker_sentiment", "id:i ticker score:d relevance:d", """SELECT id, 'AAA' AS ticker, score,
    confidence AS relevance FROM articles UNION ALL
    SELECT id, 'BBB', -score, CASE WHEN id % 3 = 0 THEN NULL ELSE 0.5 END FROM articles""")
def _ticker_sent(m):
    a = m.articles()
    def entry(t, s, r):
        return F.struct(F.lit(t).alias("ticker"), s.cast("string").alias("score"), r.alias("relevance"))
    second = F.when(col("id") % 3 == 0, "n/a").otherwise("0.5")
    conf = col("confidence").cast("string")
    nested = F.array(entry("aaa", col("score"), conf), entry("BBB", -col("score"), second),
                     entry("AAA", col("score") * 0, conf))
    return store.news_ticker_sentiment(a.select("id", nested.alias("ticker_sentiment")))


@query("news_sentiment_summary", "source avg_score:d positive:i negative:i neutral:i articles:i", """SELECT source,
    avg(score) AS avg_score, count(*) FILTER (score > 0.1) AS positive, count(*) FILTER (score < -0.1) AS negative,
    count(*) FILTER (score BETWEEN -0.1 AND 0.1) AS neutral, count(*) AS articles FROM articles GROUP BY 1""")
def _news_summary(m):
    return store.news_sentiment_summary(m.articles(), ["source"])


@query("feature_store_rows", "symbol ts total:i missing:i quality_score:d n_kept:i ret_1:d", """
    SELECT symbol, ts, 3 AS total, CAST(r IS NULL AS INT) AS missing, 1 - CAST(r IS NULL AS INT) / 3 AS quality_score,
    3 - CAST(r IS NULL AS INT) AS n_kept, r AS ret_1 FROM (SELECT *, "close" / lag("close") OVER (PARTITION BY symbol
    ORDER BY ts) - 1 AS r FROM bars)""")
def _store(m):
    from ..operators.technical import intraday_range, returns
    b = returns(m.bars()).withColumn("span", col("high") - col("low"))
    long = b.select("symbol", "ts", F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), col(n).alias("value")) for n in ("ret_1", "span", "volume")])))
    fs = store.write_feature_store(long, "v1")
    return fs.withColumns({"n_kept": F.size("features"), "ret_1": col("features")["ret_1"]})


@query("orders_summary", "status symbol:i n:i level:i", """SELECT status, account % 20 AS symbol, count(*) AS n,
    grouping(status) * 2 + grouping(account % 20) AS level FROM ords
    GROUP BY GROUPING SETS ((status), (account % 20), ())""")
def _orders_summary(m):
    return store.orders_summary(m.orders().withColumn("symbol", col("account") % 20))


# ------------------------------------------------------------------ joins

@query("join_inner_features_target", "symbol ts ret:d next_ret:d", """SELECT a.symbol, a.ts, a.ret, b.ret AS next_ret
    FROM rets a JOIN (SELECT symbol, ts - INTERVAL 1 HOUR AS ts, ret FROM rets) b USING (symbol, ts)""")
def _inner(m):
    r = m.returns()
    nxt = r.select("symbol", (col("ts") - F.expr("interval 1 hour")).alias("ts"), col("ret").alias("next_ret"))
    return r.join(nxt, ["symbol", "ts"])


@query("join_asof_backward", "trade_id:i ts asof_ts bar_close:d", """SELECT t.trade_id, t.ts, b.ts AS asof_ts,
    b."close" AS bar_close FROM trades t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.ts >= b.ts""")
def _asof(m):
    b = m.bars().withColumnRenamed("close", "bar_close")
    return ts.asof_join(m.trades(), b, "symbol", ["bar_close"])


@query("join_asof_hot_key", "event_id:i user_id:i seen:i", """SELECT e.event_id, CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE e.user_id END AS
    user_id, r.event_id AS seen FROM (SELECT *, CASE WHEN event_id % 11 <> 0 THEN (CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END) END AS k,
    CASE WHEN event_id % 13 <> 0 THEN ts END AS t FROM events) e ASOF LEFT JOIN (SELECT event_id, ts, CASE WHEN user_id % 3 = 0 THEN 0 ELSE
    user_id END AS k FROM events WHERE value > 60) r ON e.k = r.k AND e.t >= r.ts""")
def _asof_hot(m):
    """A third of the rows under one key, which is split by its counts; null keys and times stay and match nothing."""
    e = m.raw("events")
    key = F.when(col("user_id") % 3 == 0, 0).otherwise(col("user_id"))
    left = e.select("event_id", F.when(col("event_id") % 11 != 0, col("user_id")).alias("user_id"), F.when(
        col("event_id") % 11 != 0, key).alias("k"), F.when(col("event_id") % 13 != 0, col("ts")).alias("ts"))
    right = e.filter("value > 60").select(key.alias("k"), "ts", col("event_id").alias("seen"))
    return ts.asof_join(left, right, "k", ["seen"], right_tie=["seen"])


@query("index_rows_null_keys", "event_id:i k:i i:i", """SELECT event_id, k, row_number() OVER (PARTITION BY k ORDER BY t NULLS FIRST, event_id) AS i
    FROM (SELECT event_id, CASE WHEN user_id % 5 > 0 THEN user_id % 5 END AS k, CASE WHEN event_id % 7 > 0 THEN ts END AS t FROM events)""")
def _index_nulls(m):
    d = m.raw("events").select("event_id", F.when(col("user_id") % 5 > 0, col("user_id") % 5).alias("k"), F.when(
        col("event_id") % 7 > 0, col("ts")).alias("t"))
    return ts.index_rows(d, "k", ["t", "event_id"], F.date_trunc("day", "t"), out="i")


@query("join_range_two_minutes", "trade_id:i n:i avg_price:d", """SELECT t.trade_id, count(*) AS n,
    avg(b.price) AS avg_price FROM trades t JOIN ticks b ON t.symbol = b.symbol
    AND b.ts BETWEEN t.ts - INTERVAL 2 MINUTE AND t.ts + INTERVAL 2 MINUTE GROUP BY 1""")
def _range(m):
    two = F.expr("interval 2 minutes")
    spans = m.trades().select("trade_id", "symbol", (col("ts") - two).alias("lo"), (col("ts") + two).alias("hi"))
    d = ts.range_totals(m.ticks().select("symbol", "ts", "event_id", "price"), spans, "symbol", "ts", "event_id", "lo", "hi", "price")
    return d.select("trade_id", "n", (col("total") / col("n")).alias("avg_price"))


@query("join_interval_orders", "order_id n:i volume:d", """SELECT o.order_id, count(*) AS n, sum(b.volume) AS volume
    FROM parents o JOIN bars b ON o.symbol = b.symbol AND b.ts BETWEEN o.start_ts AND o.end_ts GROUP BY 1""")
def _interval(m):
    hits = ts.interval_join(m.bars().select("symbol", "ts", "volume"), m.parents(), "symbol", "ts", "start_ts",
                            "end_ts", 21600)
    return hits.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query("join_left_default", "account:i segment equity:d", """SELECT o_custkey AS account,
    coalesce(CASE WHEN c_nationkey < 20 THEN n_name END, 'unknown') AS segment, sum(o_totalprice) AS equity
    FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def _default(m):
    dim = m.raw("nation").filter("n_nationkey < 20").select(col("n_nationkey").alias("c_nationkey"), "n_name")
    o = m.raw("orders").groupBy(col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("equity"))
    j = o.join(m.raw("customer").select("c_custkey", "c_nationkey"), "c_custkey").join(dim, "c_nationkey", "left")
    return j.select(col("c_custkey").alias("account"), F.coalesce("n_name", F.lit("unknown")).alias("segment"),
                    "equity")


@query("join_anti_semi", "symbol:i kind", """SELECT p_partkey AS symbol, CASE WHEN p_partkey IN (SELECT l_partkey
    FROM lineitem WHERE l_discount > 0.08) THEN 'held' ELSE 'new' END AS kind FROM part""")
def _anti(m):
    p = m.raw("part").select(col("p_partkey").alias("symbol"))
    held = m.raw("lineitem").filter("l_discount > 0.08").select(col("l_partkey").alias("symbol"))
    return p.join(held, "symbol", "left_semi").withColumn("kind", F.lit("held")).unionByName(
        p.join(held, "symbol", "left_anti").withColumn("kind", F.lit("new")))


@query("join_full_outer_reconcile", "symbol:i ledger:d broker:d", """SELECT * FROM (SELECT coalesce(a.s, b.s) AS symbol,
    coalesce(a.q, 0) AS ledger, coalesce(b.q, 0) AS broker FROM
    (SELECT l_partkey AS s, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) a FULL JOIN
    (SELECT l_partkey AS s, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b ON a.s = b.s)
    WHERE abs(ledger - broker) > 1e-6""")
def _reconcile(m):
    from ..operators.ledger import reconcile
    li = m.raw("lineitem").withColumnRenamed("l_partkey", "symbol")
    def q(cond):
        return li.filter(cond).groupBy("symbol").agg(F.sum("l_quantity").alias("qty"))
    return reconcile(q("l_linestatus = 'F'"), q("l_returnflag = 'A'"))


@query("join_same_day", "symbol ts close:d day_score:d", """SELECT symbol, ts, "close", s AS day_score FROM bars JOIN
    (SELECT symbol, CAST(ts AS DATE) AS d, avg(score) AS s FROM sent GROUP BY 1, 2) x USING (symbol)
    WHERE CAST(bars.ts AS DATE) = x.d""")
def _same_day(m):
    s = m.sentiment().groupBy("symbol", F.to_date("ts").alias("day")).agg(F.avg("score").alias("day_score"))
    return m.bars().withColumn("day", F.to_date("ts")).join(s, ["symbol", "day"])


# ------------------------------------------------------------------ set operations

@query("set_union_all", "kind n:i chars:i", """SELECT 'document' AS kind, count(*) AS n, sum(length(text)) AS chars
    FROM documents UNION ALL SELECT 'turn', count(*), sum(length(text)) FROM conversations UNION ALL
    SELECT 'page', count(*), NULL FROM pages""")
def _union(m):
    d = m.raw("documents").select(F.lit("document").alias("kind"), F.length("text").alias("c"))
    c = m.raw("conversations").select(F.lit("turn").alias("kind"), F.length("text").alias("c"))
    p = m.raw("pages").select(F.lit("page").alias("kind"))
    u = d.unionByName(c).unionByName(p, allowMissingColumns=True)
    return u.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("chars"))


@query("set_universe_union_distinct", "symbol:i", """SELECT symbol FROM (SELECT l_partkey AS symbol FROM lineitem
    WHERE l_quantity = 50 UNION SELECT p_partkey FROM part WHERE p_size > 45)""")
def _universe(m):
    a = m.raw("lineitem").filter("l_quantity = 50").select(col("l_partkey").alias("symbol"))
    b = m.raw("part").filter("p_size > 45").select(col("p_partkey").alias("symbol"))
    return a.union(b).distinct()


@query("set_except_intersect", "id:i extra:i shared:i", """SELECT conv_id AS id,
    len(list_filter(list_distinct(string_split(lower(text), ' ')), lambda w: NOT list_contains(['the','and','of','le'], w)))
    AS extra, len(list_filter(list_distinct(string_split(lower(text), ' ')), lambda w:
    list_contains(['the','and','of','le'], w))) AS shared FROM conversations""")
def _except(m):
    stop = F.array(*[F.lit(w) for w in ("the", "and", "of", "le")])
    w = F.array_distinct(F.split(F.lower("text"), " "))
    return m.raw("conversations").select(col("conv_id").alias("id"), F.size(F.array_except(w, stop)).alias("extra"),
                                         F.size(F.array_intersect(w, stop)).alias("shared"))


@query("topk_per_group", "priority order_id:i value:d rank:i", """SELECT priority, order_id, value,
    row_number() OVER (PARTITION BY priority ORDER BY value DESC, order_id) AS rank FROM ords QUALIFY rank <= 10""")
def _topk(m):
    from pyspark.sql import Window
    w = Window.partitionBy("priority").orderBy(col("value").desc(), "order_id")
    return m.orders().withColumn("rank", F.row_number().over(w)).filter("rank <= 10")


@query("dedupe_first_wins", "key id:i", """SELECT md5(lower(trim(title))) AS key, min(id) AS id FROM posts GROUP BY 1""")
def _dedupe(m):
    from ..operators.mentions import first_wins
    p = m.posts().select(F.md5(F.lower(F.trim("title"))).alias("key"), "id")
    return first_wins(p, ["key"], ["id"])
