"""News impact, credibility and velocity; political trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as wd
from ..functions.numeric import col, div
from .mentions import any_of, hourly, literal_map


def source_credibility(c="source") -> Column:
    s = F.lower(col(c))
    out = F.when(F.lit(False), 0.0)
    for tier, names in wd.SOURCE_TIERS.items():
        out = out.when(s.rlike(any_of(names)), tier)
    return out.otherwise(wd.OTHER_TIER)


def news_impact(df: DataFrame) -> DataFrame:
    """Sum of the weights of the words present, times source credibility, and one flag per sector."""
    t = F.lower(F.concat_ws(" ", "title", "summary"))
    df = df.withColumn("_t", t)
    hits = sum((F.when(F.contains("_t", F.lit(k)), w).otherwise(0) for k, w in wd.IMPACT.items()), F.lit(0))
    sectors = {f"sector_{s}": col("_t").rlike(any_of(ws)) for s, ws in wd.SECTOR_WORDS.items()}
    return df.withColumns({"impact": hits * source_credibility(), **sectors}).drop("_t")


def impact_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        F.avg("impact").alias("raw_impact"), F.least(F.avg("impact") / 10, F.lit(1.0)).alias("impact_score"),
        F.max("impact").alias("max_impact"), F.count_if(col("impact") >= 5).alias("high_impact"),
        F.count_if(col("impact") >= 3).alias("impact_events"),
        *[(F.count_if(f"sector_{s}") / n).alias(f"share_{s}") for s in wd.SECTOR_WORDS])


def news_relevance(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    s = F.lower(col(symbol))
    r = (F.when(F.contains(F.lower("title"), s), 0.5).otherwise(0.0)
         + F.when(F.contains(F.lower("summary"), s), 0.3).otherwise(0.0)
         + F.when(F.length(col(symbol)) <= 4, 0.2).otherwise(0.0))
    return df.withColumn("relevance", F.least(r, F.lit(1.0)))


def hours_before(as_of, ts="ts") -> Column:
    at = F.unix_micros(F.lit(as_of).cast("timestamp_ntz").cast("timestamp"))
    return (at - F.unix_micros(col(ts).cast("timestamp"))) / 3.6e9


def news_weighted_sentiment(df: DataFrame, keys: Sequence[str], as_of) -> DataFrame:
    w = source_credibility() * F.exp(-hours_before(as_of) / 12) * col("relevance") * col("confidence")
    return df.groupBy(*keys).agg(F.coalesce(div(F.sum(col("score") * w), F.sum(w)), F.lit(0.0)).alias("weighted"))


def activity_spike(df: DataFrame, keys: Sequence[str], bucket: str = "hour", min_rows: int = 0) -> DataFrame:
    """Last two active buckets against the earlier ones; needs three buckets.  Counting comes before the window."""
    keys = list(keys)
    h = hourly(df, keys, bucket).withColumn(
        "r", F.row_number().over(Window.partitionBy(*keys).orderBy(col("bucket").desc())))
    g = h.groupBy(*keys).agg(F.avg(F.when(col("r") <= 2, col("n"))).alias("recent"),
                             F.avg(F.when(col("r") > 2, col("n"))).alias("baseline"),
                             F.count(F.lit(1)).alias("buckets"), F.sum("n").alias("total"))
    ratio = col("recent") / F.greatest(F.coalesce("baseline", F.lit(0.0)), F.lit(1.0))
    ready = (col("buckets") >= 3) & (col("total") >= min_rows)
    return g.withColumns({"intensity": F.when(ready, ratio).otherwise(0.0),
                          "has_spike": F.coalesce(ready & (ratio > 2), F.lit(False))})


def velocity_span(df: DataFrame, keys: Sequence[str], unit: str = "hour") -> DataFrame:
    lo, hi, n = F.min("ts"), F.max("ts"), F.count(F.lit(1))
    if unit == "hour":
        span = (F.unix_micros(hi.cast("timestamp")) - F.unix_micros(lo.cast("timestamp"))) / 3.6e9
        v = F.when(n < 2, 0.0).otherwise(F.coalesce(div(n, span), n.cast("double")))
    else:
        v = F.when(n < 2, 0.0).otherwise(n / (F.floor((F.unix_micros(hi.cast("timestamp")) - F.unix_micros(
            lo.cast("timestamp"))) / 8.64e10) + 1))
    return df.groupBy(*keys).agg(v.alias("velocity"))


# ------------------------------------------------------------------ political trades

DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "M/d/yy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")


def parse_date(c, as_of) -> Column:
    """Seven written formats, or "n days|weeks|months ago" relative to as_of."""
    t = F.trim(col(c))
    shape = {"yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
             "M/d/yy": r"^\d{1,2}/\d{1,2}/\d{2}$", "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
             "MMMM d, yyyy": r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
             "d MMMM yyyy": r"^\d{1,2} [A-Za-z]{4,} \d{4}$"}
    out = F.when(F.lit(False), F.lit(None).cast("date"))
    for fmt in DATE_FORMATS:
        day = F.to_date(F.try_to_timestamp(t, F.lit(fmt)))
        if fmt == "M/d/yy":  # two-digit years from 69 on belong to the 1900s
            day = F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day)
        out = out.when(t.rlike(shape[fmt]), day)
    n = F.regexp_extract(t, r"(\d+)", 1).try_cast("int")
    unit = F.when(F.lower(t).contains("day"), 1).when(F.lower(t).contains("week"), 7).when(
        F.lower(t).contains("month"), 30)
    ago = F.when(F.lower(t).contains("ago") & n.isNotNull(), F.date_sub(F.lit(as_of).cast("date"), n * unit))
    return F.coalesce(out, ago)


def parse_amount(c) -> Column:
    """Midpoint of a range, or one amount with an optional K, M or B suffix."""
    t = F.upper(F.regexp_replace(col(c), r"[,$]", ""))
    nums = F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?[KMB]?)"), F.lit(1))
    def value(x):
        scale = F.when(F.endswith(x, F.lit("K")), 1e3).when(F.endswith(x, F.lit("M")), 1e6).when(
            F.endswith(x, F.lit("B")), 1e9).otherwise(1.0)
        return F.regexp_replace(x, "[KMB]", "").try_cast("double") * scale
    v = F.transform(nums, value)
    return F.when(F.size(v) >= 2, (F.get(v, F.lit(0)) + F.get(v, F.lit(1))) / 2).when(
        F.size(v) == 1, F.get(v, F.lit(0))).otherwise(0.0)


def normalize_trades(df: DataFrame, as_of, min_value: float = 0.0, days: int | None = None,
                     rejects: bool = False) -> DataFrame:
    """Raw filings (reporter, txn_type, amounts, transaction_date, symbol, notes) to typed trades.

    A filing under ``min_value``, older than ``days`` (if given) or, with ``days``, without a readable date is rejected;
    ``rejects=True`` returns all of them with the reason in ``reject`` (null for trades that stay).
    """
    party = literal_map({k: v[0] for k, v in wd.POLITICIANS.items()})
    power = literal_map({k: v[1] for k, v in wd.POLITICIANS.items()})
    seat = literal_map({k: v[2] for k, v in wd.POLITICIANS.items()})
    who = F.lower("reporter")
    kind = F.lower("txn_type")
    note = F.regexp_extract(F.upper("notes"), r"\(([A-Z]{2,5})\)", 1)
    sym = F.coalesce(F.nullif(F.upper("symbol"), F.lit("")), F.nullif(note, F.lit("")), F.lit("UNKNOWN"))
    d = df.withColumns({
        "trade_date": parse_date("transaction_date", as_of), "value": parse_amount("amounts"), "symbol": sym,
        "party": F.coalesce(party[who], F.lit("Unknown")), "influence": F.coalesce(power[who], F.lit(1)),
        "seat": F.coalesce(seat[who], F.lit("Unknown")),
        "trade_type": F.when(kind.contains("buy") | kind.contains("purchase"), "buy").otherwise("sell")})
    reason = F.when(col("value") < min_value, "value")
    if days is not None:
        reason = reason.when(col("trade_date").isNull(), "date").when(
            col("trade_date") < F.date_sub(F.lit(as_of).cast("date"), days), "age")
    d = d.withColumn("reject", reason)
    return d if rejects else d.filter(col("reject").isNull()).drop("reject")


def political_sentiment(df: DataFrame, keys: Sequence[str], insider: str = "is_insider") -> DataFrame:
    i, buy = col(insider), col("trade_type") == "buy"
    def net(who):
        n = F.count_if(who)
        return (F.count_if(who & buy) - F.count_if(who & ~buy)) / F.greatest(n, F.lit(1))
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        net(~i).alias("congress_sentiment"), net(i).alias("insider_sentiment"),
        net(F.lit(True)).alias("overall_sentiment"), F.least(n / 10, F.lit(1.0)).alias("interest"),
        F.least(F.coalesce(F.avg(F.when(i, col("value"))) / 1e6, F.lit(0.0)), F.lit(1.0)).alias("insider_confidence"))


def influence_metrics(df: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """Overall influence, and the ``top`` strongest reporters by influence x log1p(value in millions)."""
    whole = df.agg(F.count_if(col("influence") >= 4).alias("high_influence"), F.avg("influence").alias("avg_influence"))
    g = df.groupBy("reporter").agg(F.max("influence").alias("influence"), F.sum("value").alias("total_value"),
                                   F.count(F.lit(1)).alias("trades"))
    g = g.withColumn("combined", col("influence") * F.log1p(col("total_value") / 1e6))
    return whole, g.orderBy(col("combined").desc(), "reporter").limit(top)


def party_divergence(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    s = F.when(col("trade_type") == "buy", 1.0).otherwise(-1.0)
    names = ("Republican", "Democrat", "Independent")
    g = df.groupBy(*keys).agg(*[F.avg(F.when(col("party") == p, s)).alias(p) for p in names])
    active = sum((F.when(col(p).isNotNull(), 1).otherwise(0) for p in names), F.lit(0))
    g = g.withColumn("bipartisan", active / 3).fillna(0.0, list(names))
    gap = F.abs(col("Republican") - col("Democrat"))
    return g.withColumns({"divergence": gap, "agreement": 1 - gap})


def sector_exposure(df: DataFrame) -> DataFrame:
    g = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"))
    sector = F.coalesce(literal_map(wd.SYMBOL_SECTOR)[col("symbol")], F.lit("unknown"))
    g = g.withColumns({"sector": sector, "relevance": F.least(col("trades") / 5, F.lit(1.0))})
    themes = F.coalesce(literal_map(wd.SECTOR_THEMES)[col("sector")], F.lit(0))
    return g.withColumn("exposure", col("relevance") * themes / 4)


def source_sentiment_average(df: DataFrame, weights: dict[str, float], keys: Sequence[str]) -> DataFrame:
    """Mean class scores per source, dominant class, and the source-weighted mean."""
    g = df.groupBy(*keys, "source").agg(*[F.avg(c).alias(c) for c in ("positive", "negative", "neutral")])
    top = F.greatest("positive", "negative", "neutral")
    g = g.withColumn("dominant", F.when(col("positive") == top, "positive").when(
        col("negative") == top, "negative").otherwise("neutral"))
    w = F.coalesce(literal_map(weights)[col("source")], F.lit(0.25))
    return g.withColumn("w", w)
