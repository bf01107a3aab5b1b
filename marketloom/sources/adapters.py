"""Domain tables (ticks, sentiment, posts, fills, positions ...) derived by Spark from the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip
from ..operators.timeseries import Ordered
from .bars import ohlcv_bars

# Words of the synthetic prose that stand for market vocabulary in posts and articles.
STAND_INS = {
    "the": "$AAPL", "and": "moon", "of": "calls", "on": "TSLA", "in": "🚀", "that": "earnings", "for": "squeeze",
    "is": "puts", "it": "revenue", "with": "crash", "le": "$TSLA", "la": "merger", "de": "breakout", "et": "📉",
    "en": "guidance", "que": "GME", "un": "valuation", "der": "$GME", "die": "rally", "und": "dump", "von": "yolo",
    "el": "$BTC", "los": "💎", "by": "dividend", "as": "lawsuit", "or": "bank",
}
SOURCES = ["reddit", "news", "twitter", "unusual_whales"]
SOURCE_HOSTS = ["reuters", "cnbc", "benzinga", "blogspot"]


class Market:
    """Lazy domain tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def texts(self, name: str) -> DataFrame:
        """Text tables, dealt anew only if the session says so in ``marketloom.text.partitions`` (a few small files)."""
        n = self.spark.conf.get("marketloom.text.partitions", None)
        return self.raw(name).repartition(int(n)) if n else self.raw(name)

    # -- market data
    def ticks(self, events: DataFrame | None = None) -> DataFrame:
        e = self.raw("events") if events is None else events
        return e.select(
            "event_id", "ts", "user_id", F.upper("event_type").alias("symbol"),
            (100 + F.col("value") / 50).alias("price"),
            F.get_json_object("props", "$.k").cast("double").alias("qty"),
        )

    def bars(self, freq: str = "1h") -> DataFrame:
        return ohlcv_bars(self.ticks(), freq)

    def by_user(self, df: DataFrame) -> DataFrame:
        """The same rows with every user as a symbol (many keys instead of five)."""
        return df.withColumn("symbol", F.concat(F.lit("U"), F.col("user_id").cast("string")))

    def bars_by_user(self, freq: str = "1h") -> DataFrame:
        return ohlcv_bars(self.by_user(self.ticks()), freq)

    def sentiment_by_user(self) -> DataFrame:
        return self.by_user(self.sentiment())

    def returns(self, freq: str = "1h") -> DataFrame:
        b = self.bars(freq)
        s = Ordered()
        return b.select("symbol", "ts", (F.col("close") / s.lag("close") - 1).alias("ret"), "close").filter(
            "ret IS NOT NULL")

    def positions(self) -> DataFrame:
        t = self.ticks()
        g = t.groupBy((F.col("user_id") % 10).alias("portfolio_id"), "symbol").agg(F.sum("qty").alias("q"))
        w = Window.partitionBy("portfolio_id")
        return g.select("portfolio_id", "symbol", (F.col("q") / F.sum("q").over(w)).alias("weight"))

    # -- sentiment
    def sentiment(self, events: DataFrame | None = None) -> DataFrame:
        e = self.raw("events") if events is None else events
        k = F.get_json_object("props", "$.k").cast("double")
        names = F.array(*[F.lit(s) for s in SOURCES])
        return e.select(
            F.upper("event_type").alias("symbol"), "ts", "event_id",
            F.get(names, (F.col("user_id") % 4).cast("int")).alias("source"),
            clip((F.col("value") - 50) / 50, -1, 1).alias("score"),
            (k / 100).alias("confidence"), k.alias("mentions"),
            (k % 7).alias("bullish"), (k % 5).alias("bearish"),
            (F.col("value") * k).alias("engagement"), F.col("user_id"),
        )

    # -- text
    def posts(self) -> DataFrame:
        d = self.texts("documents")
        swaps = F.create_map(*[F.lit(x) for kv in STAND_INS.items() for x in kv])
        words = F.transform(F.split("text", " "), lambda w: F.coalesce(swaps[F.lower(w)], w))
        i = F.col("doc_id")
        return d.select(
            # explode keeps the text from being inlined (and recomputed) in every expression that reads it
            i.alias("id"), F.explode(F.array(F.array_join(words, " "))).alias("text"), F.col("source").alias("subreddit"),
            F.concat(F.lit("u"), (i % 97).cast("string")).alias("author"),
            (F.col("n_chars") % 2000).alias("score"), ((i * 7) % 300).alias("comments"), "lang",
            F.timestamp_micros(F.lit(1704067200000000) + (i * 7919 % 172800) * 1000000).cast("timestamp_ntz")
            .alias("ts"),
        ).withColumn("title", F.split("text", "\n")[0])

    def mentions(self) -> DataFrame:
        """One row per (post, ticker) with the signed lexicon score of the post."""
        from ..operators.mentions import extract_tickers, momentum_score
        p = momentum_score(extract_tickers(self.posts()))
        return p.select("id", "author", "subreddit", "score", "comments", "ts", F.explode("tickers").alias("symbol"),
                        "momentum")

    def articles(self) -> DataFrame:
        d = self.texts("pages")
        i = F.col("page_id")
        swaps = F.create_map(*[F.lit(x) for kv in STAND_INS.items() for x in kv])
        def swapped(c):
            return F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(swaps[F.lower(w)], w)), " ")
        hosts = F.array(*[F.lit(s) for s in SOURCE_HOSTS])
        plain = F.regexp_replace(F.col("html"), r"<[^>]*>", " ")
        return d.select(
            i.alias("id"), F.inline(F.array(F.struct(
                swapped(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title"),
                swapped(plain).alias("summary")))), F.get(hosts, (i % 4).cast("int")).alias("source"),
            F.timestamp_micros(F.lit(1704067200000000) + (i * 7919 % 172800) * 1000000).cast("timestamp_ntz")
            .alias("ts"),
            ((i * 13) % 201 / 100.0 - 1).alias("score"), ((i % 10) / 10.0).alias("confidence"),
        )

    # -- execution
    def trades(self) -> DataFrame:
        """Executions: the ticks of one symbol in one six-hour slot form one parent order."""
        slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000)
        return self.ticks().select(
            F.col("event_id").alias("trade_id"), "symbol", "ts", "price", "qty",
            F.concat_ws("-", "symbol", slot.cast("string")).alias("order_id"),
            F.concat(F.lit("V"), (F.col("user_id") % 4).cast("string")).alias("venue"),
            F.get(F.array(F.lit("TWAP"), F.lit("VWAP"), F.lit("ICEBERG")), (slot % 3).cast("int")).alias("algorithm"),
            F.when(slot % 2 == 0, "buy").otherwise("sell").alias("side"), slot.alias("slot"),
        )

    def parents(self) -> DataFrame:
        """Parent orders with their arrival quote and requested size."""
        g = self.trades().groupBy("order_id", "symbol", "side", "algorithm", "slot").agg(
            F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
            F.min_by("price", F.struct("ts", "trade_id")).alias("arrival_price"),
            (F.sum("qty") * (1 + F.max("slot") % 5 * 0.02)).alias("order_qty"))
        return g.withColumn("urgency", F.get(F.array(F.lit("low"), F.lit("normal"), F.lit("high")),
                                              F.pmod("slot", F.lit(3)).cast("int")))

    def fills(self) -> DataFrame:
        li = self.raw("lineitem")
        price = F.col("l_extendedprice") / F.col("l_quantity")
        return li.select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("symbol"),
            F.concat(F.lit("V"), (F.col("l_suppkey") % 4).cast("string")).alias("venue"),
            F.col("l_quantity").alias("qty"), price.alias("price"),
            F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
            (price * F.col("l_quantity") * F.col("l_tax")).alias("commission"), F.col("l_shipdate").alias("ts"),
            F.col("l_linenumber").cast("long").alias("line"), F.col("l_suppkey").alias("supp"),
        )

    def orders(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("account"),
            F.when(F.col("o_orderstatus") == "F", "filled").when(F.col("o_orderstatus") == "O", "open")
            .otherwise("partial").alias("status"),
            F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("ts"),
            F.col("o_orderpriority").alias("priority"))

    def accounts(self) -> DataFrame:
        """Account snapshots: one per order, equity drifting around the opening balance."""
        o, c = self.raw("orders"), self.raw("customer")
        j = o.join(c, o.o_custkey == c.c_custkey)
        return j.select(
            F.col("o_custkey").alias("account"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("snap"),
            (20000 + F.col("c_acctbal") + (F.col("o_orderkey") % 101 - 50) * 40).alias("equity"),
            (F.col("o_totalprice") % 15000).alias("margin_used"),
            (F.col("c_acctbal") - F.col("o_orderkey") % 3000).alias("buying_power"),
            (F.col("o_orderkey") % 6).alias("day_trades"))

    def books(self) -> DataFrame:
        """Order-book snapshots: five levels a side around the tick price, sizes from the tick quantity."""
        t = self.ticks()
        lv = F.sequence(F.lit(1), F.lit(5))
        tick = F.lit(0.01) * (1 + F.col("qty") % 5)
        def side(sign, salt):
            return F.transform(lv, lambda i: F.struct(
                (F.col("price") + sign * tick * i).alias("price"),
                (F.pmod(F.col("qty") * salt + i * 17, F.lit(90.0)) + 10).alias("size"),
                (i % 3 + 1).cast("long").alias("orders")))
        return t.select("event_id", "symbol", "ts", "price", "qty", side(-1, 3).alias("bids"), side(1, 7).alias("asks"))
