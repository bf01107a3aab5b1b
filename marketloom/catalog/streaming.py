"""Streaming queries drained over the event table, compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import col
from ..session import scratch_path
from ..streaming import jobs as sj
from . import ledger as _ledger  # noqa: F401  (defines shared tables)
from .base import ORACLES, add_base, query


def events(m):
    return sj.file_stream(m.spark, m.folder, "events.parquet")


#: Rows arrive up to two hours after their time; the watermark waits a little longer than that.
DISORDER_SECONDS, DELAY = 7200, "3 hours"


def arrivals(m):
    """The event table as it would arrive: each row delayed by up to two hours, in steps of six days of four files each,
    and one closing event of another type."""
    path = scratch_path(m.spark, "arrivals")
    late = F.make_dt_interval(secs=F.pmod(col("event_id") * 7919, F.lit(DISORDER_SECONDS)).cast("decimal(18,6)"))
    e = m.raw("events").withColumn("_step", F.floor(F.unix_micros((col("ts") + late).cast("timestamp")) / (6 * 86_400_000_000)))
    steps = sorted(r["_step"] for r in e.select("_step").distinct().collect())  # one per six days
    for step in steps:
        e.filter(col("_step") == step).drop("_step").repartition(4).write.mode("append").parquet(path)
    e.limit(1).withColumns({"event_type": F.lit("closing"), "ts": F.to_timestamp_ntz(F.lit("2100-01-01 00:00:00"))}).drop(
        "_step").write.mode("append").parquet(path)
    return sj.file_stream(m.spark, path, "*.parquet", per_trigger=4)


def ntz(df, *cols):
    return df.withColumns({c: col(c).cast("timestamp_ntz") for c in cols})


# The final watermark leaves windows open that end after the newest event minus the delay.
add_base("mark", "SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS wm FROM ticks")


@query("stream_bars", "symbol ts open:d high:d low:d close:d volume:d trades:i",
       "SELECT * FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT wm FROM mark)")
def _bars(m):
    return ntz(sj.run_to_table(sj.stream_bars(m.ticks(events(m))), "bars"), "ts")


@query("stream_mention_velocity_tumbling", "symbol ts n:i", """SELECT symbol, date_trunc('hour', ts) AS ts, count(*) AS n FROM ticks GROUP BY 1, 2
    HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT wm FROM mark)""")
def _tumbling(m):
    return ntz(sj.run_to_table(sj.stream_mention_counts(m.ticks(events(m))), "tumbling"), "ts")


@query("stream_mention_velocity_sliding", "symbol ts n:i", """SELECT symbol, t AS ts, count(*) AS n FROM (SELECT symbol, date_trunc('hour', ts) -
    to_hours(k) AS t FROM ticks, (SELECT unnest(range(0, 3)) AS k)) WHERE t + INTERVAL 3 HOUR <= (SELECT wm FROM mark) GROUP BY 1, 2""")
def _sliding(m):
    return ntz(sj.run_to_table(sj.stream_mention_counts(m.ticks(events(m)), "3 hours", "1 hour"), "sliding"), "ts")


@query("stream_sessions", "user_id:i start_ts end_ts events:i", """SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTE AS end_ts, count(*) AS
    events FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION
    BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE AS gap FROM ticks)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT wm FROM mark)""")
def _sessions(m):
    return ntz(sj.run_to_table(sj.stream_sessions(events(m), "user_id"), "sessions"), "start_ts", "end_ts")


@query("stream_sentiment_24h", "symbol source ts sentiment:d3 mentions:i", """SELECT symbol, source, t AS ts, sum(CAST(score *
    confidence AS DECIMAL(18, 9)))::DOUBLE / nullif(sum(CAST(confidence AS DECIMAL(18, 9)))::DOUBLE, 0) AS sentiment, sum(mentions) AS mentions FROM (SELECT *, date_trunc('hour', ts) + to_hours(k) AS t FROM sent,
    (SELECT unnest(range(1, 25)) AS k)) WHERE t <= (SELECT wm FROM mark) GROUP BY 1, 2, 3""")
def _sentiment(m):
    return ntz(sj.run_to_table(sj.stream_sentiment(m.sentiment(events(m))), "sentiment"), "ts")


@query("stream_positions", "trade_id:i position:d avg_price:d realized:d",
       "SELECT trade_id, position, CASE WHEN position = 0 THEN 0 ELSE avg_price END AS avg_price, realized FROM ledger_t")
def _positions(m):
    t = m.ticks(arrivals(m)).select(
        col("event_id").alias("trade_id"), "symbol", "ts", "price", "qty",
        F.when(col("event_id") % 7 < 4, "buy").otherwise("sell").alias("side"))
    return sj.run_to_table(sj.stream_positions(t, DELAY), "positions")


@query("stream_trailing_stops", "symbol is_long:b event_id:i entry:d stop:d exit:d pnl_pct:d", """WITH RECURSIVE n AS (SELECT symbol, event_id, price AS px,
      g, row_number() OVER (PARTITION BY symbol, g ORDER BY ts, event_id) AS rn FROM ticks, (SELECT unnest([1, -1]) AS g)),
    w AS (SELECT symbol, g, rn, event_id, px AS entry, px AS best, px * (1 - g * 0.05) AS stop, NULL::DOUBLE AS e0, NULL::DOUBLE AS s0, px FROM n WHERE rn = 1
      UNION ALL SELECT symbol, g, rn, event_id, CASE WHEN hit THEN px ELSE entry END, CASE WHEN hit THEN px ELSE nb END, CASE WHEN hit THEN px * (1 - g * 0.05)
      WHEN g * (px - entry) / entry >= 0.02 THEN (CASE WHEN g = 1 THEN greatest(stop, nb * 0.995) ELSE least(stop, nb * 1.005) END) ELSE stop END,
      CASE WHEN hit THEN entry END, CASE WHEN hit THEN stop END, px
      FROM (SELECT n.symbol, n.g, n.rn, n.event_id, n.px, w.entry, w.stop, n.g * n.px <= w.g * w.stop AS hit, CASE WHEN n.g = 1 THEN greatest(w.best, n.px) ELSE
        least(w.best, n.px) END AS nb FROM w JOIN n ON n.symbol = w.symbol AND n.g = w.g AND n.rn = w.rn + 1))
    SELECT symbol, g = 1 AS is_long, event_id, e0 AS entry, s0 AS stop, px AS exit, g * (px / e0 - 1) AS pnl_pct FROM w WHERE e0 IS NOT NULL""")
def _stops(m):
    return sj.run_to_table(sj.stream_stops(m.ticks(arrivals(m)).select("event_id", "symbol", "ts", "price"), DELAY), "stops")


@query("stream_alert_cooldown", "symbol event_id:i ts")
def _alerts(m):
    a = m.ticks(arrivals(m)).filter("qty > 60 OR symbol = 'CLOSING'").select("symbol", "event_id", "ts")
    return ntz(sj.run_to_table(sj.stream_alerts(a, ["symbol"], 60, delay=DELAY), "alerts"), "ts")


ORACLES["stream_alert_cooldown"] = ORACLES["account_alert_cooldown"]


@query("stream_dedupe", "event_id:i user_id:i", "SELECT event_id, user_id FROM ticks")
def _dedupe(m):
    e = events(m)
    return sj.run_to_table(sj.stream_dedupe(e.union(events(m)), ["event_id"]), "dedupe")


@query("stream_upsert_sink", "symbol source event_id:i score:d", """SELECT symbol, source, event_id, score FROM sent QUALIFY row_number() OVER (PARTITION BY
    symbol, source ORDER BY ts DESC, event_id DESC) = 1""")
def _upsert(m):
    path, keys, order = scratch_path(m.spark, "upserts"), ["symbol", "source"], ["ts", "event_id"]
    sj.drain(m.sentiment(arrivals(m)).filter("symbol <> 'CLOSING'"), sj.upsert_sink(path, keys, order, 4), "upserts")
    return sj.read_upserts(m.spark, path, keys, order)


def out_of_order(m, lateness):
    """Newer rows in two steps, then everything before 16 January, all of it behind the watermark by then."""
    path = scratch_path(m.spark, lateness)
    e = m.raw("events")
    for i, cond in enumerate(("ts >= timestamp_ntz'2024-01-16' AND ts < timestamp_ntz'2024-01-22'", "ts >= timestamp_ntz'2024-01-22'",
                              "ts < timestamp_ntz'2024-01-16'")):
        e.filter(cond).repartition(4).write.parquet(f"{path}/part={i}")
    return m.spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/*").withColumn("ts", col("ts").cast("timestamp"))


@query("stream_late_rows_dropped", "symbol ts trades:i", """SELECT symbol, ts, trades FROM bars WHERE ts >= TIMESTAMP '2024-01-16' AND ts + INTERVAL 1 HOUR <=
    (SELECT wm FROM mark)""")
def _late(m):
    return ntz(sj.run_to_table(sj.stream_bars(m.ticks(out_of_order(m, "late"))), "late-bars"), "ts")


@query("stream_late_rows", "symbol late:i first_ts last_ts", """SELECT symbol, count(*) AS late, min(ts) AS first_ts, max(ts) AS last_ts FROM ticks
    WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1""")
def _late_rows(m):
    path = scratch_path(m.spark, "late-rows")
    sj.drain(m.ticks(out_of_order(m, "late-side")), sj.late_channel(path, "10 minutes"), "late-rows")
    late = m.spark.read.parquet(f"{path}/late").groupBy("symbol").agg(F.count(F.lit(1)).alias("late"), F.min("ts").alias("first_ts"),
                                                                      F.max("ts").alias("last_ts"))
    return ntz(late, "first_ts", "last_ts")


@query("stream_alert_channel", "kind alerts:i", """SELECT CASE WHEN qty > 80 THEN 'size' ELSE 'price' END AS kind, count(*) AS alerts FROM ticks
    WHERE qty > 80 OR price > 101.5 GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM ticks WHERE qty > 80 OR price > 101.5""")
def _channel(m):
    path = scratch_path(m.spark, "alert-channel")

    def keep(name):
        return lambda batch, epoch: batch.select("event_id").withColumn("kind", F.lit(name)).write.mode("overwrite").parquet(
            f"{path}/{name}/epoch={epoch}")

    a = m.ticks(arrivals(m)).filter("symbol <> 'CLOSING' AND (qty > 80 OR price > 101.5)")
    a = a.select("event_id", F.when(col("qty") > 80, "size").otherwise("price").alias("kind"))
    sj.drain(a, sj.alert_channel({"size": keep("size"), "price": keep("price"), "*": keep("all")}), "alert-channel")
    kept = m.spark.read.option("recursiveFileLookup", "true").parquet(path)
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("alerts"))


@query("stream_nearby_views", "event_id:i n:i nearest:i", """SELECT l.event_id, count(r.event_id) AS n, arg_min(r.event_id, (abs(epoch_us(r.ts) - epoch_us(l.ts)) *
    10 + (r.ts > l.ts)::INT, r.event_id)) AS nearest FROM events l LEFT JOIN events r ON l.user_id % 20 = r.user_id % 20 AND r.event_type = 'view' AND r.ts BETWEEN l.ts -
    INTERVAL 2 MINUTE AND l.ts + INTERVAL 2 MINUTE WHERE l.event_type = 'purchase' GROUP BY 1""")
def _nearby(m):
    e = arrivals(m).select("event_id", "ts", "event_type", (col("user_id") % 20).alias("k"))
    left = e.filter("event_type = 'purchase'").drop("event_type")
    right = e.filter("event_type IN ('view', 'closing')").drop("event_type")
    return sj.run_to_table(sj.stream_nearby(left, right, "k", delay=DELAY), "nearby")


@query("stream_interval_join", "event_id:i r_event_id:i", """SELECT l.event_id, r.event_id AS r_event_id FROM events l JOIN events r ON l.user_id % 20 = r.user_id
    % 20 AND l.event_type = 'purchase' AND r.event_type = 'view' AND r.ts BETWEEN l.ts - INTERVAL 2 MINUTE AND l.ts + INTERVAL 2 MINUTE""")
def _join(m):
    e = events(m).select("event_id", "ts", "event_type", (col("user_id") % 20).alias("k"))
    left = e.filter("event_type = 'purchase'").drop("event_type")
    right = e.filter("event_type = 'view'").drop("event_type")
    return sj.run_to_table(sj.stream_interval_join(left, right, "k"), "join")
