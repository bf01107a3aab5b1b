"""Table reads, upserts, retention and summaries over partitioned parquet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col
from ..operators.timeseries import latest
from ..session import cut_lineage, drop_path


def _window(df: DataFrame, ts: str, start, end, limit, newest_tie: Sequence[str]) -> DataFrame:
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast(df.schema[ts].dataType))
    if limit is not None:
        df = df.orderBy(F.col(ts).desc(), *newest_tie).limit(limit)
    return df


def read_bars(df: DataFrame, symbol: str | None = None, timeframe: str | None = None, start=None, end=None,
              limit: int | None = None, ts: str = "ts") -> DataFrame:
    """Equality on symbol and timeframe, inclusive range, newest-first limit."""
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol.upper())
    if timeframe is not None:
        df = df.filter(F.col("timeframe") == timeframe)
    return _window(df, ts, start, end, limit, ["symbol"])


def read_sentiment(df: DataFrame, symbol: str | None = None, sources: Sequence[str] = (), start=None, end=None,
                   limit: int | None = None, ts: str = "ts", tie: Sequence[str] = ("symbol", "source")) -> DataFrame:
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol.upper())
    if sources:
        df = df.filter(F.col("source").isin(list(sources)))
    return _window(df, ts, start, end, limit, list(tie))


def active_signals(df: DataFrame, as_of, symbol: str | None = None, types: Sequence[str] = ()) -> DataFrame:
    at = F.lit(as_of).cast("timestamp_ntz")
    df = df.filter(~F.coalesce("executed", F.lit(False)) & (F.col("expires_at").isNull() | (F.col("expires_at") > at)))
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol.upper())
    if types:
        df = df.filter(F.col("signal_type").isin(list(types)))
    return df


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write wins per key.  An aggregation, not a window: many versions of one key merge map-side."""
    both = target.unionByName(batch, allowMissingColumns=True)
    if "symbol" in both.columns:
        both = both.withColumn("symbol", F.upper("symbol"))
    return latest(both, list(keys), list(order))


def upsert_partitions(target_path: str, batch: DataFrame, keys: Sequence[str], order: Sequence[str],
                      partition: str) -> None:
    """Merge a batch into a partitioned table, rewriting only the partitions that hold its keys, before or after.

    A key whose partition value changes leaves its old partition; a partition that loses its last row is removed.
    """
    spark = batch.sparkSession
    existing = spark.read.parquet(target_path)
    held = existing.join(batch.select(*keys).distinct(), list(keys), "left_semi").select(partition)
    affected = cut_lineage(held.union(batch.select(partition)).distinct())
    touched = existing.join(affected, partition, "left_semi")
    merged = cut_lineage(upsert(touched, batch, keys, order))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(
        target_path)
    emptied = affected.join(merged.select(partition).distinct(), partition, "left_anti")
    for row in emptied.collect():  # values of the partition column, one per folder
        if row[0] is not None:
            drop_path(spark, f"{target_path}/{partition}={row[0]}")


def append_batch(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition).parquet(path)


def mark_executed(signals: DataFrame, executions: DataFrame) -> DataFrame:
    """Update by id: executed flag, price and time come from the execution when there is one."""
    e = executions.select("signal_id", F.col("price").alias("_p"), F.col("at").alias("_t"))
    j = signals.join(e, "signal_id", "left")
    return j.withColumns({
        "executed": F.col("executed") | F.col("_t").isNotNull(),
        "executed_price": F.coalesce("_p", "executed_price"), "executed_at": F.coalesce("_t", "executed_at"),
    }).drop("_p", "_t")


def expired(df: DataFrame, kind: str, as_of, days: int = 365, ts: str = "ts") -> Column:
    """True for rows that retention removes: intraday bars, sentiment, executed signals older than the cutoff."""
    old = F.col(ts) < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    extra = {"bars": lambda: F.col("timeframe").isin("1min", "5min", "15min"), "sentiment": lambda: F.lit(True),
             "signals": lambda: F.coalesce("executed", F.lit(False))}
    return F.coalesce(old & extra[kind](), F.lit(False))


def retain(df: DataFrame, kind: str, as_of, days: int = 365, ts: str = "ts") -> DataFrame:
    return df.filter(~expired(df, kind, as_of, days, ts))


def retention_report(tables: Mapping[str, tuple[DataFrame, str]], as_of, days: int = 365) -> DataFrame:
    parts = [df.agg(F.lit(name).alias("table"), F.count_if(expired(df, kind, as_of, days)).alias("deleted"),
                    F.count(F.lit(1)).alias("total")) for name, (df, kind) in tables.items()]
    return reduce(DataFrame.unionAll, parts)


def table_stats(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    parts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"),
                    F.max(ts).alias("last_ts")) for name, (df, ts) in tables.items()]
    return reduce(DataFrame.unionAll, parts)


def data_summary(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("records"), F.min("ts").alias("first_ts"),
                                      F.max("ts").alias("last_ts"), F.avg("close").alias("avg_close"))


def sentiment_summary(sent: DataFrame) -> DataFrame:
    return sent.groupBy("symbol", "source").agg(F.count(F.lit(1)).alias("records"), F.avg("score").alias("avg_score"))


def orders_summary(orders: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Counts by status, by symbol and overall in one pass."""
    return orders.groupingSets([["status"], [symbol], []], "status", symbol).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def write_feature_store(long: DataFrame, version: str, timeframe: str = "1hour") -> DataFrame:
    """(symbol, ts, name, value) to one map row per (symbol, ts) with total, missing and quality."""
    g = long.groupBy("symbol", "ts").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("features"),
        F.count(F.lit(1)).alias("total"), F.count_if(col("value").isNull() | F.isnan("value")).alias("missing"))
    return g.select("symbol", "ts", F.lit(timeframe).alias("timeframe"), F.lit(version).alias("feature_version"),
                    F.map_filter("features", lambda k, v: v.isNotNull() & ~F.isnan(v)).alias("features"),
                    "total", "missing", (1 - F.col("missing") / F.greatest("total", F.lit(1))).alias("quality_score"))


# --------------------------------------------------------------------------- landing data

# Column spellings of the upstream feeds.
FEEDS = {
    "bars_short": {"ts": "t", "open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"},
    "bars_numbered": {"ts": "timestamp", "open": "1. open", "high": "2. high", "low": "3. low", "close": "4. close",
                      "volume": "5. volume"},
    "bars_plain": {"ts": "timestamp", "open": "open", "high": "high", "low": "low", "close": "close",
                   "volume": "volume"},
    "price_series": {"ts": "time_ms", "close": "price", "volume": "total_volume"},
}


def standardize_ohlcv(df: DataFrame, feed: str, symbol: str | None = None) -> DataFrame:
    """Any feed to (symbol, ts, o, h, l, c, v, source): price-only feeds repeat the price, missing volume is 0."""
    names = FEEDS[feed]
    have = set(df.columns)

    def pick(n, default=None):
        src = names.get(n)
        if src in have:
            return F.expr(f"try_cast(`{src}` AS double)")
        return default

    close = pick("close")
    kind = df.schema[names["ts"]].dataType.typeName()
    raw = F.col(f"`{names['ts']}`")
    ts = F.timestamp_millis(raw.cast("long")).cast("timestamp_ntz") if kind in ("long", "integer", "double") else \
        F.expr(f"try_cast(`{names['ts']}` AS timestamp_ntz)")
    sym = F.upper(F.lit(symbol) if symbol else F.col("symbol"))
    return df.select(sym.alias("symbol"), ts.alias("ts"), pick("open", close).alias("open"),
                     pick("high", close).alias("high"), pick("low", close).alias("low"), close.alias("close"),
                     F.coalesce(pick("volume", F.lit(0.0)), F.lit(0.0)).alias("volume"),
                     F.lit(feed).alias("source")).filter("ts IS NOT NULL AND close IS NOT NULL")


def coalesce_sources(bars: DataFrame, priority: Sequence[str], keys=("symbol", "ts")) -> DataFrame:
    """Per key the row of the first source in preference order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in priority]), F.col("source"))
    d = bars.withColumn("_rank", -F.when(rank > 0, rank).otherwise(len(priority) + 1))
    return latest(d, list(keys), ["_rank", "source"]).drop("_rank")


def clean_fundamentals(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """'None', '-' and '' become NULL, the rest is cast where it parses."""
    out = {}
    for f in fields:
        v = F.trim(F.col(f).cast("string"))
        out[f] = F.when(~v.isin("None", "-", ""), v.try_cast("double"))
    return df.withColumns(out)


def economic_series(df: DataFrame) -> DataFrame:
    return df.select("indicator", F.col("date").try_cast("date").alias("date"),
                     F.col("value").try_cast("double").alias("value")).filter("date IS NOT NULL AND value IS NOT NULL")


def news_ticker_sentiment(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """Nested ticker scores to rows; with a symbol, the first match of each article."""
    d = df.select("id", F.posexplode("ticker_sentiment").alias("pos", "t"))
    d = d.select("id", "pos", F.upper("t.ticker").alias("ticker"), F.col("t.score").try_cast("double").alias("score"),
                 F.col("t.relevance").try_cast("double").alias("relevance"))
    if symbol is not None:
        d = d.filter(F.col("ticker") == symbol.upper())
    return d.groupBy("id", "ticker").agg(F.min_by("score", "pos").alias("score"),
                                         F.min_by("relevance", "pos").alias("relevance"))


def news_sentiment_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    s = F.col("score")
    return df.groupBy(*keys).agg(F.avg(s).alias("avg_score"), F.count_if(s > 0.1).alias("positive"),
                                 F.count_if(s < -0.1).alias("negative"),
                                 F.count_if(s.between(-0.1, 0.1)).alias("neutral"), F.count(s).alias("articles"))
