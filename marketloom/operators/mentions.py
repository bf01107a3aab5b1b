"""Post and mention mining.  Word lists are literals of fixed size; texts are scanned whole, once per list."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as wd
from ..functions.numeric import clip, col, div
from ..session import cut_lineage
from .timeseries import exact_percentiles, join_on, latest


def literal_map(d: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def strings(xs: Iterable[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def any_of(xs: Iterable[str]) -> str:
    return "|".join(re.escape(x).replace(r"\ ", " ") for x in sorted(xs, key=len, reverse=True))


def weighted_hits(text, weights: Mapping[str, float]) -> Column:
    """Sum of weights over whole-word occurrences: one regex pass, then a map lookup per hit."""
    hits = F.regexp_extract_all(F.lower(col(text)), F.lit(rf"\b({any_of(weights)})\b"), F.lit(1))
    table = literal_map({k: float(v) for k, v in weights.items()})
    return F.aggregate(hits, F.lit(0.0), lambda a, w: a + table[w])


def count_of(text, token: str) -> Column:
    """Non-overlapping occurrences of a literal token."""
    t = col(text)
    return (F.length(t) - F.length(F.replace(t, F.lit(token), F.lit("")))) / len(token)


def full_text(p: DataFrame) -> Column:
    return F.concat_ws(" ", "title", "text")


# ------------------------------------------------------------------ symbols

def mentions_symbol(df: DataFrame, symbols: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """Rows per (text, symbol) where the word, $sym, #sym or (sym) occurs (also BRK.B or BF-B); an equi-join on tokens.

    Distinct tokens per text keep the exploded side linear in the text; the symbol side decides its own join
    strategy by size, so no symbols x texts product arises.
    """
    upper = F.upper(col(text))
    tokens = F.array_union(F.regexp_extract_all(upper, F.lit("([A-Z0-9]+)"), F.lit(1)),
                           F.regexp_extract_all(upper, F.lit(r"([A-Z0-9]+(?:[.-][A-Z0-9]+)+)"), F.lit(1)))
    words = df.select(key, F.explode(tokens).alias("symbol"))
    return words.join(symbols.select(F.upper("symbol").alias("symbol")).distinct(), "symbol")


def extract_tickers(df: DataFrame, text: str = "text", out: str = "tickers") -> DataFrame:
    cash = F.regexp_extract_all(col(text), F.lit(r"\$([A-Z]{1,5})\b"), F.lit(1))
    coins = F.transform(F.regexp_extract_all(col(text), F.lit(rf"(?i)\b({'|'.join(wd.CRYPTO)})\b"), F.lit(1)), F.upper)
    return df.withColumn(out, F.array_except(F.array_union(cash, coins), strings(wd.NOT_TICKERS)))


def extract_symbols_scored(df: DataFrame, text: str = "text", key: str = "id", floor: float = 0.3) -> DataFrame:
    """(key, symbol, confidence) from seven patterns; confidence depends on the symbol and its whole text."""
    t = col(text)
    found = F.array_distinct(F.flatten(F.array(*[
        F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in wd.SYMBOL_PATTERNS])))
    lower = F.lower(t)
    context = sum((F.when(F.contains(lower, F.lit(w)), 1).otherwise(0) for w in wd.CONTEXT_WORDS), F.lit(0))
    cash = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\$([A-Z]+)"), F.lit(1)))
    d = df.select(key, F.explode(F.array_except(found, strings(wd.NOT_TICKERS))).alias("symbol"),
                  F.least(context * 0.05, F.lit(0.2)).alias("_ctx"), cash.alias("_cash"))
    n = F.length("symbol")
    d = d.filter(n.between(2, 5))
    dollar = F.exists("_cash", lambda x: F.startswith(x, F.col("symbol")))
    conf = (0.5 + F.when(F.col("symbol").isin(*wd.KNOWN_TICKERS), 0.3).otherwise(0.0) + F.col("_ctx")
            + F.when(dollar, 0.2).otherwise(0.0) - F.when(n == 2, 0.1).otherwise(0.0))
    return d.select(key, "symbol", F.least(conf, F.lit(1.0)).alias("confidence")).filter(F.col("confidence") > floor)


# ------------------------------------------------------------------ per-item signals

def emoji_signals(df: DataFrame, text: str = "text") -> DataFrame:
    bull = sum((count_of(text, e) * w for e, w in wd.BULLISH_EMOJI.items()), F.lit(0.0))
    bear = sum((count_of(text, e) * w for e, w in wd.BEARISH_EMOJI.items()), F.lit(0.0))
    return df.withColumns({"bullish": bull, "bearish": bear, "rockets": count_of(text, "🚀"),
                           "diamonds": count_of(text, "💎")})


def emoji_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("bullish", "bearish", "rockets", "diamonds")])
    return g.withColumn("net_signal", (col("bullish") - col("bearish")) / F.greatest(
        col("bullish") + col("bearish"), F.lit(1.0)))


def option_signals(df: DataFrame, text: str = "text") -> DataFrame:
    def n(p):
        return F.regexp_count(col(text), F.lit(rf"(?i)\b{p}\b"))
    return df.withColumns({"calls": n("calls?"), "puts": n("puts?"), "yolo": n("yolo"),
                           "option_words": n(f"({any_of(wd.OPTION_WORDS)})")})


def option_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("calls", "puts", "yolo", "option_words")])
    total = col("calls") + col("puts")
    return g.withColumns({"call_put_ratio": col("calls") / F.greatest("puts", F.lit(1)), "activity": total,
                          "options_bias": (col("calls") - col("puts")) / F.greatest(total, F.lit(1))})


def is_dd(df: DataFrame, title: str = "title") -> DataFrame:
    t = F.lower(col(title))
    hit = F.lit(False)
    for w in wd.DD_TITLE_WORDS:
        hit = hit | F.contains(t, F.lit(w))
    return df.withColumn("is_dd", hit)


def dd_quality(df: DataFrame) -> DataFrame:
    score = weighted_hits(full_text(df), wd.DD_WORDS) * F.log1p((col("score") + col("comments")).cast("double")) / 5
    return df.withColumn("dd_quality", score)


def dd_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    q = col("dd_quality")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("dd_count"), F.avg(q).alias("avg_dd_quality"),
                                 F.count_if(q > 10).alias("high"), F.count_if((q > 5) & (q <= 10)).alias("medium"),
                                 F.count_if(q <= 5).alias("low"))


def dd_quality_text(df: DataFrame, text: str = "text", awards: str | None = None) -> DataFrame:
    t, low = col(text), F.lower(col(text))
    n_words = F.size(F.split(F.trim(t), r"\s+"))
    kw = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in wd.DD_SHORT_WORDS), F.lit(0))
    prize = F.least(col(awards) / 10, F.lit(1.0)) if awards else F.lit(0.0)
    return df.withColumns({"word_count": n_words, "dd_words": kw, "dd_quality_text": (
        F.least(n_words / 1000, F.lit(1.0)) * 0.3 + F.when(t.rlike(r"\d+"), 0.2).otherwise(0.0)
        + F.when(t.rlike(r"https?://"), 0.1).otherwise(0.0) + prize * 0.2 + kw / len(wd.DD_SHORT_WORDS) * 0.2)})


def momentum_score(df: DataFrame, text: str = "text") -> DataFrame:
    boost = F.greatest(F.log1p((col("score") + col("comments")).cast("double")) / 3, F.lit(0.5))
    return df.withColumn("momentum", weighted_hits(text, wd.MOMENTUM) * boost)


def strength_class(m: Column) -> Column:
    return F.when(m > 2, "very_strong").when(m > 1, "strong").when(m > 0.3, "moderate").when(
        m > -0.3, "weak").otherwise("negative")


def momentum_summary(df: DataFrame, keys: Sequence[str], conviction: float = 5.0) -> DataFrame:
    g = df.groupBy(*keys).agg(F.avg("momentum").alias("momentum_score"), F.count(F.lit(1)).alias("items"),
                              F.count_if(F.abs("momentum") > conviction).alias("high_conviction"))
    return g.withColumns({"strength": strength_class(col("momentum_score")),
                          "direction": F.when(col("momentum_score") > 0, "bullish").otherwise("bearish")})


# ------------------------------------------------------------------ scoring hook

def lexicon_sentiment(df: DataFrame, text: str = "text") -> DataFrame:
    """Default scorer: lexicon weight squashed to [-1, 1], label by sign, confidence by strength."""
    s = F.tanh(weighted_hits(text, wd.MOMENTUM) / 5)
    return df.withColumns({
        "sentiment": s, "label": F.when(s > 0.1, "positive").when(s < -0.1, "negative").otherwise("neutral"),
        "confidence": F.least(0.5 + F.abs(s) / 2, F.lit(1.0))})


def model_sentiment(df: DataFrame, make_scorer, text: str = "text") -> DataFrame:
    """Plug in a model: ``make_scorer()`` runs once per Python worker and maps a list of texts to (label, score).

    The model gets whole texts, Arrow batch by batch; the signed score is +score, -score or 0.
    """
    @F.pandas_udf("label string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for b in batches:
            yield pd.DataFrame(scorer(b.fillna("").tolist()), columns=["label", "score"])

    signed = F.when(col("_r.label") == "positive", col("_r.score")).when(
        col("_r.label") == "negative", -col("_r.score")).otherwise(0.0)
    return df.withColumn("_r", run(text)).withColumns({"label": col("_r.label"), "confidence": col("_r.score"),
                                                       "sentiment": signed}).drop("_r")


# ------------------------------------------------------------------ aggregates

def weighted_post_sentiment(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of score x (engagement x credibility x confidence x kind); the divisor is the item count, as named.

    ``ratio`` divides by the weights instead.
    """
    kind = F.when(col("is_comment"), 0.5).when(col("is_dd"), 2.0).otherwise(1.0)
    w = col("engagement_weight") * col("credibility") * col("confidence") * kind
    return df.groupBy(*keys).agg(F.avg(col("sentiment") * w).alias("weighted"),
                                 div(F.sum(col("sentiment") * w), F.sum(w)).alias("ratio"),
                                 F.avg("confidence").alias("confidence"))


def sentiment_distribution(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(*[(F.count_if(col("label") == x) / n).alias(x)
                                   for x in ("positive", "negative", "neutral")])


def engagement(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    e = col("score") + col("comments")
    return df.groupBy(*keys).agg(F.sum(e).alias("total_engagement"), F.avg(e).alias("avg_engagement"),
                                 F.countDistinct("author").alias("unique_users"))


def viral_posts(df: DataFrame, keys: Sequence[str], floor: float = 1000.0) -> DataFrame:
    """Posts at or above the larger of the group's exact 90th percentile and the floor."""
    p90 = exact_percentiles(df, keys, "score", {"p90": 0.9})
    j = join_on(df, p90, list(keys))
    return j.filter(col("score") >= F.greatest("p90", F.lit(floor)))


def user_credibility(df: DataFrame) -> DataFrame:
    """Users with karma, account age and mean scores to one capped score."""
    def part(c, cap, w):
        return F.least(col(c) / cap, F.lit(1.0)) * w
    return df.withColumn("credibility", part("comment_karma", 10000, 0.3) + part("link_karma", 5000, 0.2)
                         + part("age_days", 365, 0.2) + part("avg_post_score", 100, 0.15)
                         + part("avg_comment_score", 10, 0.15))


def credibility_distribution(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    c, s = col("credibility"), col("sentiment")
    g = df.groupBy(*keys).agg(F.avg(c).alias("avg_credibility"), F.var_pop(c).alias("credibility_variance"),
                              (F.count_if(c > 0.7) / F.count(c)).alias("high_share"),
                              (F.sum(s * c) / F.greatest(F.sum(c), F.lit(1.0))).alias("weighted_sentiment"))
    a, h = col("avg_credibility"), col("high_share")
    return g.withColumn("reliability", F.when((a > 0.7) & (h > 0.3), "very_high").when(
        (a > 0.6) & (h > 0.2), "high").when(a > 0.5, "medium").otherwise("low"))


def hourly(df: DataFrame, keys: Sequence[str], bucket: str = "hour") -> DataFrame:
    return df.groupBy(*keys, F.date_trunc(bucket, "ts").cast("timestamp_ntz").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))


def mention_velocity(df: DataFrame, keys: Sequence[str], recent: int = 3) -> DataFrame:
    """Counts per hour first (bounded by the time span), then recent against earlier hours."""
    keys = list(keys)
    h = hourly(df, keys).withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(col("bucket").desc())))
    g = h.groupBy(*keys).agg(
        F.avg("n").alias("per_hour"), F.count(F.lit(1)).alias("hours"),
        F.avg(F.when(col("r") <= recent, col("n"))).alias("_new"),
        F.avg(F.when(col("r") > recent, col("n"))).alias("_old"), F.min_by("n", "bucket").alias("_first"),
        F.max_by("bucket", F.struct(col("n"), -F.unix_micros(col("bucket").cast("timestamp")))).alias("peak_hour"),
        F.max("n").alias("peak"), F.max_by("n", "bucket").alias("current"))
    old = F.coalesce("_old", "_first")
    acc = F.when(col("hours") >= 2, (col("_new") - old) / F.greatest(old, F.lit(1.0))).otherwise(0.0)
    return g.withColumn("acceleration", acc).withColumn(
        "trend", F.when(acc > 0.5, "accelerating").when(acc < -0.3, "decelerating").otherwise("stable")).drop(
            "_new", "_old", "_first")


def mention_velocity_12h(df: DataFrame, keys: Sequence[str], as_of) -> DataFrame:
    at = F.lit(as_of).cast("timestamp_ntz")
    def n(h):
        return F.count_if((col("ts") > at - F.expr(f"interval {h} hours")) & (col("ts") <= at))
    return df.groupBy(*keys).agg(F.greatest(2 * n(12) - n(24), F.lit(0)).alias("velocity_12h"))


def trending_symbols(df: DataFrame, limit: int = 10, min_count: int = 3) -> DataFrame:
    g = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("engagement"),
                                 F.countDistinct("subreddit").alias("subs")).filter(col("n") >= min_count)
    g = g.withColumn("trend_score", col("n") * col("subs") * F.log1p(col("engagement").cast("double")))
    return g.withColumn("avg_engagement", col("engagement") / col("n")).orderBy(
        col("trend_score").desc(), "symbol").limit(limit)


def ticker_sentiment_emoji(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items with score, bullish and bearish emoji counts."""
    w = 1 + col("score") / 100
    e = (col("bullish") - col("bearish")) / F.greatest(col("bullish") + col("bearish"), F.lit(1.0))
    s = e * 0.7 + F.when(col("score") > 0, 0.3).otherwise(-0.3)
    return df.groupBy(*keys).agg(
        (F.sum(s * w) / F.greatest(F.sum(w), F.lit(1.0))).alias("sentiment"),
        F.least(F.count(F.lit(1)) / 20, F.lit(1.0)).alias("confidence"), F.count(F.lit(1)).alias("mentions"),
        F.sum("bullish").alias("bullish"), F.sum("bearish").alias("bearish"))


def symbol_profile(mentions: DataFrame, posts: DataFrame) -> DataFrame:
    """Velocity, momentum, credibility, emoji and option measures per symbol in one row.

    Signals are read off each post once and only they are joined; the mentions with them are written, as six aggregations read them.
    """
    signals = option_signals(emoji_signals(posts.select("id", "text"))).drop("text")
    m = cut_lineage(mentions.join(signals, "id"))
    p = mention_velocity(m, ["symbol"]).join(momentum_summary(m, ["symbol"]), "symbol")
    p = p.join(emoji_summary(m, ["symbol"]), "symbol").join(option_summary(m, ["symbol"]), "symbol")
    c = m.withColumns({"credibility": F.least(col("score") / 1000, F.lit(1.0)),
                       "sentiment": F.tanh(col("momentum") / 5)})
    return p.join(credibility_distribution(c, ["symbol"]), "symbol").join(engagement(m, ["symbol"]), "symbol")


def social_alerts(p: DataFrame, velocity: float = 3.0, momentum: float = 2.0, credibility: float = 0.6) -> DataFrame:
    """Five alert rules over symbol profiles; HIGH before MEDIUM, then by confidence."""
    def alert(cond, kind, priority, conf):
        return F.when(cond, F.struct(F.lit(kind).alias("type"), priority.alias("priority"), conf.alias("confidence")))
    med = F.lit("MEDIUM")
    rules = [
        alert(col("per_hour") > velocity, "VELOCITY_SPIKE", F.lit("HIGH"),
              F.when(col("trend") == "accelerating", 0.9).otherwise(0.7)),
        alert(F.abs("momentum_score") > momentum, "MOMENTUM_SURGE",
              F.when(col("strength").isin("strong", "very_strong"), "HIGH").otherwise("MEDIUM"),
              F.when(col("high_conviction") > 2, 0.95).otherwise(0.8)),
        alert(col("reliability").isin("high", "very_high") & (col("avg_credibility") > credibility),
              "HIGH_CREDIBILITY_SIGNAL", med, col("avg_credibility")),
        alert((col("rockets") > 10) | (col("bullish") > 20), "MEME_STOCK_ACTIVITY", med, F.lit(0.7)),
        alert(col("activity") > 10, "OPTIONS_FLOW_SURGE", med, F.lit(0.8)),
    ]
    d = p.select("symbol", F.inline(F.array_compact(F.array(*rules))))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(
        F.when(col("priority") == "HIGH", 0).otherwise(1), col("confidence").desc(), "type")))


def risk_adjusted_sentiment(p: DataFrame, base: str = "weighted_sentiment", conf: str = "avg_credibility") -> DataFrame:
    def pick(c, table):
        e = F.lit(1.0)
        for k, v in table.items():
            e = F.when(col(c) == k, v).otherwise(e)
        return e
    factor = (pick("reliability", {"very_high": 1.2, "high": 1.1, "low": 0.7})
              * pick("trend", {"accelerating": 1.15, "decelerating": 0.9})
              * pick("strength", {"very_strong": 1.2, "strong": 1.1, "weak": 0.8})
              * F.when(col("total_engagement") > 10000, 1.1).when(col("total_engagement") < 1000, 0.9).otherwise(1.0))
    p = p.withColumn("factor", clip(factor, 0.5, 2.0))
    return p.withColumns({"risk_adjusted": clip(col(base) * col("factor"), -1, 1),
                          "confidence_level": col(conf) * col("factor")})


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order, by aggregation: a key with a third of all copies merges map-side."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*order)
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("_r"))
    return g.select(*keys, *[col(f"_r.{c}").alias(c) for c in rest])


def clean_text(c) -> Column:
    t = F.regexp_replace(col(c), r"https?://\S+|www\.\S+", "")
    t = F.regexp_replace(t, r"[@#]\w+", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def discover_symbols(mentions: DataFrame, universe: DataFrame, as_of, market: DataFrame | None = None,
                     min_count: int = 5, threshold: float = 50, min_confidence: float = 0.7, daily: int = 5,
                     caps=(1e9, 1e6, 0.01)) -> DataFrame:
    """Mentions (symbol, source, ts, sentiment, confidence, volume) of the last 48 h to ranked new symbols."""
    at = F.lit(as_of).cast("timestamp_ntz")
    m = mentions.filter((col("ts") > at - F.expr("interval 48 hours")) & (col("ts") <= at))
    w = col("confidence") * col("volume")
    n = F.count(F.lit(1))
    g = m.groupBy("symbol").agg(
        n.alias("n"), F.sum("volume").alias("mentions"), F.coalesce(div(F.sum(col("sentiment") * w), F.sum(w)),
                                                                     F.lit(0.0)).alias("sentiment"),
        F.avg("confidence").alias("confidence"), F.countDistinct("source").alias("sources"),
        (F.count_if(col("ts") > at - F.expr("interval 6 hours")) / n).alias("trending"), F.max("ts").alias("last_seen"))
    hours = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(col("last_seen").cast("timestamp"))) / 3.6e9
    final = F.least(F.lit(1.0), F.least(col("mentions") / 100, F.lit(1.0)) + 0.3 * F.greatest(F.lit(0.0), "sentiment")
                    + 0.2 * F.greatest(F.lit(0.0), 1 - hours / 24) + 0.1 * col("sources") / 4 + 0.4 * col("confidence"))
    g = g.withColumn("final_score", final).filter(
        (col("n") >= min_count) & (col("mentions") >= threshold) & (col("confidence") >= min_confidence))
    if market is not None:
        g = g.join(market.filter((col("market_cap") >= caps[0]) & (col("avg_volume") >= caps[1])
                                 & (col("spread") <= caps[2])).select("symbol"), "symbol", "left_semi")
    g = g.join(universe.select("symbol"), "symbol", "left_anti")
    return g.orderBy(col("final_score").desc(), "symbol").limit(daily)
