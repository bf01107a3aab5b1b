"""Structured Streaming forms of the event-time operators.

Each function maps streaming DataFrames to a streaming DataFrame and holds no source or sink, so the same code runs on
Kafka, files or tests.  Event time is ``ts`` (timestamp); state is bounded by watermarks or by the number of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.timeseries import latest
from ..session import drop_path, list_path, scratch_path
from .ordered import cooldown_step, fold_in_order, nearby_flush, nearby_step, position_step, stop_step


def file_stream(spark: SparkSession, folder: str, name: str, ts: str = "ts", per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream with ``ts`` as event time."""
    schema = spark.read.parquet(f"{folder}/{name}").schema if "*" not in name else spark.read.parquet(folder).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(folder).withColumn("ts", F.col(ts).cast("timestamp"))


def run_to_table(df: DataFrame, label: str, mode: str = "append", timeout: int = 600) -> DataFrame:
    """Drain what is available into a parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    out = scratch_path(spark, label)
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", out)
         .option("checkpointLocation", scratch_path(spark, f"{label}-ck")).trigger(availableNow=True).start())
    if not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError(f"stream {label} did not finish in {timeout} s")
    return spark.read.schema(df.schema).parquet(out)


# ------------------------------------------------------------------ windows

def stream_bars(ticks: DataFrame, freq: str = "1 hour", delay: str = "10 minutes", tie: str = "event_id") -> DataFrame:
    at = F.struct("ts", tie)
    g = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", freq).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("trades"))
    return g.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "trades")


def stream_mention_counts(mentions: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = mentions.withWatermark("ts", delay).groupBy("symbol", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("symbol", F.col("w.start").alias("ts"), "n")


def stream_sessions(events: DataFrame, key: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("events"))
    return g.select(key, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "events")


def stream_sentiment(sent: DataFrame, size: str = "24 hours", slide: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    g = sent.withWatermark("ts", delay).groupBy("symbol", "source", F.window("ts", size, slide).alias("w")).agg(
        F.sum((F.col("score") * F.col("confidence")).cast("decimal(18,9)")).alias("_sc"),
        F.sum(F.col("confidence").cast("decimal(18,9)")).alias("_c"), F.sum("mentions").alias("mentions"))
    return g.select("symbol", "source", F.col("w.end").alias("ts"),  # sums in decimals: the same in any order
                    F.try_divide(F.col("_sc").cast("double"), F.col("_c").cast("double")).alias("sentiment"), "mentions")


def stream_dedupe(df: DataFrame, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def stream_interval_join(left: DataFrame, right: DataFrame, key: str, minutes: int = 2, delay: str = "10 minutes") -> DataFrame:
    """Two watermarked streams, rows of one key within +-minutes of each other; state is cut by the range condition.

    The join is on (key, time bin): a row is held against the rows of its bin, not against all of its key.  A left row has the
    bin of its time, a right row those of both ends of its interval, one or two as a bin is as long as the interval.
    """
    span = 2 * minutes * 60_000_000

    def place(shift: int):
        return F.floor((F.unix_micros("ts") + F.lit(shift * minutes * 60_000_000)) / span)

    a = left.withColumn("_bin", place(0)).withWatermark("ts", delay).alias("l")
    r = right.withColumn("_rbin", F.explode(F.array_distinct(F.array(place(-1), place(1))))).select("_rbin", F.col(key).alias("r_key"), F.col("ts").alias("r_ts"), *[F.col(c).alias(f"r_{c}") for c in right.columns
                                                                            if c not in (key, "ts")]).withWatermark("r_ts", delay)
    cond = F.expr(f"{key} = r_key AND _bin = _rbin AND r_ts BETWEEN ts - INTERVAL {minutes} MINUTES AND ts + INTERVAL {minutes} MINUTES")
    return a.join(r, cond).drop("r_key", "_bin", "_rbin")


# ------------------------------------------------------------------ keyed state

def stream_positions(fills: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Average-cost position after every fill (trade_id, side, qty, price), in event order whatever the arrival."""
    return fold_in_order(fills, ["symbol"], ["trade_id", "side", "qty", "price"], position_step, "q double, avg double, realized double",
                         (0.0, 0.0, 0.0), {"trade_id": "long", "position": "double", "avg_price": "double", "realized": "double"}, delay)


def stream_stops(ticks: DataFrame, delay: str = "10 minutes", initial: float = 0.05, trigger: float = 0.02, step: float = 0.005) -> DataFrame:
    """Exits of long and short positions with trailing stops, one of each per symbol (column ``is_long``)."""
    def one(state, *row):
        return stop_step(state, *row, initial=initial, trigger=trigger, step=step)

    both = ticks.withColumn("is_long", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("side", F.col("is_long"))
    return fold_in_order(both, ["symbol", "side"], ["event_id", "price", "is_long"], one, "entry double, best double, stop double",
                         (0.0, 0.0, 0.0), {"event_id": "long", "entry": "double", "stop": "double", "exit": "double",
                                           "pnl_pct": "double"}, delay).withColumnRenamed("side", "is_long")


def stream_alerts(alerts: DataFrame, keys: Sequence[str], minutes: float = 15, row_id: str = "event_id",
                  delay: str = "10 minutes") -> DataFrame:
    """Alert stream with cooldown relative to the last emitted alert; an instant of state per key, given up after twice the
    cooldown without alerts."""
    def one(state, *row):
        return cooldown_step(state, *row, minutes=minutes)

    made = fold_in_order(alerts, keys, [row_id], one, "emitted long", (-1,), {row_id: "long", "us": "long"}, delay,
                         idle_seconds=120 * minutes)
    return made.withColumn("ts", F.timestamp_micros("us")).drop("us")


def stream_nearby(left: DataFrame, right: DataFrame, key: str, row_id: str = "event_id", minutes: int = 2,
                  delay: str = "10 minutes") -> DataFrame:
    """For every left row the number of right rows of its key within +-minutes and the nearest one: no row per pair.

    One stream of both sides is folded in order; state is what the interval and the delay hold.
    """
    width = minutes * 60_000_000

    def one(state, *row):
        return nearby_step(state, *row, width_us=width)

    def flush(state, us):
        return nearby_flush(state, us, width)

    both = left.select(key, "ts", row_id, F.lit(True).alias("is_left")).unionByName(
        right.select(key, "ts", row_id, F.lit(False).alias("is_left")))
    state = "times array<bigint>, ids array<bigint>, lefts array<bigint>, left_ids array<bigint>"
    return fold_in_order(both, [key], ["is_left", row_id], one, state, ([], [], [], []),
                         {row_id: "long", "n": "long", "nearest": "long"}, delay, flush=flush, again_seconds=60 * minutes)


# ------------------------------------------------------------------ sinks and monitoring

def upsert_sink(path: str, keys: Sequence[str], order: Sequence[str], merge_every: int = 16) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: each micro-batch is reduced to its newest row per key and kept under its epoch, so a retried
    epoch overwrites itself; every ``merge_every`` epochs those that are closed are merged into one base, so a read takes
    the base and fewer than ``merge_every`` epochs."""
    def write(batch: DataFrame, epoch: int) -> None:
        latest(batch, list(keys), list(order)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        if epoch and epoch % merge_every == 0:
            merge_epochs(batch.sparkSession, path, keys, order, epoch - 1)

    return write


def _parts(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """(last epoch in the newest base, epochs behind it); folders without a success mark are not there."""
    names = [n for n in list_path(spark, path) if list_path(spark, f"{path}/{n}", "_SUCCESS")]
    bases = [int(n[5:]) for n in names if n.startswith("base=")]
    until = max(bases, default=None)
    epochs = [int(n[6:]) for n in names if n.startswith("epoch=")]
    return until, sorted(e for e in epochs if until is None or e > until)


def merge_epochs(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], until: int) -> None:
    """Merge the base and the epochs up to ``until`` into a new base; what it replaces is deleted afterwards."""
    base, epochs = _parts(spark, path)
    closed = [e for e in epochs if e <= until]
    if not closed:
        return
    old = ([] if base is None else [f"{path}/base={base}"]) + [f"{path}/epoch={e}" for e in closed]
    latest(spark.read.parquet(*old), list(keys), list(order)).write.mode("overwrite").parquet(f"{path}/base={until}")
    for folder in old:
        drop_path(spark, folder)


def read_upserts(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    base, epochs = _parts(spark, path)
    folders = ([] if base is None else [f"{path}/base={base}"]) + [f"{path}/epoch={e}" for e in epochs]
    return latest(spark.read.parquet(*folders), list(keys), list(order))


def late_channel(path: str, delay: str, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of the rows that arrive behind the watermark: the newest event time of all batches before,
    minus ``delay``.  Marks and rows are kept under their epoch, so a retried epoch writes the same again."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = [n for n in list_path(spark, f"{path}/marks") if n.startswith("epoch=") and int(n[6:]) < epoch]
        batch.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{path}/marks/epoch={epoch}")
        late = batch.limit(0)
        if before:
            newest = spark.read.parquet(*[f"{path}/marks/{n}" for n in before]).agg(F.max("newest").alias("newest"))
            late = batch.join(F.broadcast(newest), F.col(ts) < F.col("newest") - F.expr(f"INTERVAL {delay}")).drop("newest")  # one row
        late.write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")

    return write


def alert_channel(handlers: dict[str, Callable[[DataFrame, int], None]], kind: str = "kind") -> Callable[[DataFrame, int], None]:
    """foreachBatch dispatcher of alerts to callbacks: each handler gets the alerts of its kind, ``*`` gets all of them.

    A handler receives a DataFrame and the epoch, so it can write to any sink; a retried epoch calls it again with the same
    rows.  One failing handler does not keep the others from their alerts; the first error is raised when all have run.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            failed = None
            for name, handler in handlers.items():
                try:
                    handler(batch if name == "*" else batch.filter(F.col(kind) == name), epoch)
                except Exception as error:
                    failed = failed or error
            if failed:
                raise failed
        finally:
            batch.unpersist()

    return write


def drain(df: DataFrame, writer: Callable[[DataFrame, int], None], label: str, timeout: int = 600):
    """Run a foreachBatch writer over what is available; returns the finished query (its progress tells state sizes)."""
    q = df.writeStream.foreachBatch(writer).option("checkpointLocation", scratch_path(df.sparkSession, f"{label}-ck")).trigger(
        availableNow=True).start()
    if not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError(f"stream {label} did not finish in {timeout} s")
    return q


class LateRows(StreamingQueryListener):
    """Counts rows that arrived behind the watermark, per query id."""

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event):
        self.dropped[str(event.id)] = 0

    def onQueryProgress(self, event):
        n = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        key = str(event.progress.id)
        self.dropped[key] = self.dropped.get(key, 0) + n

    def onQueryTerminated(self, event):
        pass
