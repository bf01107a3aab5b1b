"""Data-quality rules.  Each check returns (symbol, rule, severity, field, n_bad) rows with n_bad > 0."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, col, let
from .timeseries import Ordered

# Default limits of the rules.
MIN_PRICE, MAX_PRICE, MAX_CHANGE_PCT = 0.001, 1e6, 50.0
MAX_VOLUME, ZERO_VOLUME_SHARE = 1e12, 0.1
OHLC_TOLERANCE, MAX_GAP_HOURS = 0.001, 24
MAX_MENTIONS, MAX_FEATURE, MAX_MISSING, MAX_DUPLICATES, OUTLIER_Z = 1_000_000, 1e6, 0.3, 0.1, 5.0
VALID_SOURCES = ("reddit", "twitter", "news", "unusual_whales")
PRICES = ("open", "high", "low", "close")
ISSUE_COLUMNS = ("symbol", "rule", "severity", "field", "n_bad")


@dataclass(frozen=True)
class Rule:
    rule: str
    severity: str
    field: str
    count: Column


def _report(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """One aggregation for all rules of a check, then unpivoted; counts combine map-side."""
    agg = df.groupBy(*keys).agg(*[r.count.cast("long").alias(f"_r{i}") for i, r in enumerate(rules)])
    items = F.array(*[F.struct(F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity"),
                               F.lit(r.field).alias("field"), F.col(f"_r{i}").alias("n_bad"))
                      for i, r in enumerate(rules)])
    return agg.select(*keys, F.inline(items)).filter("n_bad > 0")


def check_required(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Columns absent from the schema: no data is read."""
    return [c for c in required if c not in df.columns]


def required_issues(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = check_required(df, required)
    rows = F.array(*[F.lit(m) for m in missing]) if missing else F.expr("cast(array() AS array<string>)")
    keys = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    return keys.select("symbol", F.lit("missing_column").alias("rule"), F.lit("ERROR").alias("severity"),
                       F.explode(rows).alias("field"), F.lit(1).cast("long").alias("n_bad"))


def check_timestamps(df: DataFrame, seq: str | None = None, max_gap_hours: float = MAX_GAP_HOURS) -> DataFrame:
    """Null and unsorted timestamps (against an arrival sequence) and gaps; input is one row per symbol and bar."""
    s = Ordered()
    gap = (F.col("ts").cast("timestamp").cast("double") - s.lag("ts").cast("timestamp").cast("double")) / 3600
    d = df.withColumn("_gap", F.when(F.col("ts").isNotNull(), gap))
    rules = [Rule("null_timestamp", "ERROR", "ts", F.count_if(F.col("ts").isNull())),
             Rule("time_gap", "WARNING", "ts", F.count_if(F.col("_gap") > max_gap_hours))]
    if seq is not None:
        d = d.withColumn("_back", F.col("ts") < Ordered("symbol", seq).lag("ts"))
        rules.append(Rule("unsorted", "WARNING", "ts", F.count_if("_back")))
    return _report(d, ["symbol"], rules)


def check_ohlc(df: DataFrame, tol: float = OHLC_TOLERANCE) -> DataFrame:
    rules = []
    for p in PRICES:
        rules += [Rule("null_price", "ERROR", p, F.count_if(col(p).isNull())),
                  Rule("non_positive_price", "ERROR", p, F.count_if(col(p) <= 0)),
                  Rule("price_out_of_range", "WARNING", p,
                       F.count_if((col(p) > 0) & ~col(p).between(MIN_PRICE, MAX_PRICE)))]
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    hi, lo = F.col("high"), F.col("low")
    rules += [Rule("high_below_body_or_low", "ERROR", "high", F.count_if((hi < top - tol) | (hi < lo - tol))),
              Rule("low_above_body", "ERROR", "low", F.count_if((lo > bottom + tol) | (lo > hi + tol)))]
    return _report(df, ["symbol"], rules)


def check_volume(df: DataFrame) -> DataFrame:
    v = F.col("volume")
    zeros, n = F.count_if(v == 0), F.count(F.lit(1))
    return _report(df, ["symbol"], [
        Rule("negative_volume", "ERROR", "volume", F.count_if(v < 0)),
        Rule("volume_too_large", "WARNING", "volume", F.count_if(v > MAX_VOLUME)),
        Rule("zero_volume_share", "WARNING", "volume", F.when(zeros > n * ZERO_VOLUME_SHARE, zeros).otherwise(0))])


def check_price_change(df: DataFrame, max_pct: float = MAX_CHANGE_PCT) -> DataFrame:
    prev = Ordered().lag("close")
    d = df.withColumn("_chg", F.abs(F.try_divide(F.col("close") - prev, prev)) * 100)
    return _report(d, ["symbol"], [Rule("price_jump", "WARNING", "close", F.count_if(F.col("_chg") > max_pct))])


def check_duplicates(df: DataFrame, max_ratio: float = MAX_DUPLICATES) -> DataFrame:
    """Full-row copies.  Identical rows merge map-side, so a row repeated a billion times is one partial count."""
    dup = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    g = dup.groupBy("symbol").agg(F.sum(F.col("_c") - 1).alias("n_bad"), F.sum("_c").alias("_n"))
    return g.filter("n_bad > 0").select(
        "symbol", F.lit("duplicate_rows").alias("rule"),
        F.when(F.col("n_bad") / F.col("_n") > max_ratio, "ERROR").otherwise("WARNING").alias("severity"),
        F.lit("*").alias("field"), "n_bad")


def check_range(df: DataFrame, field: str, lo: float, hi: float) -> DataFrame:
    return _report(df, ["symbol"], [Rule("out_of_range", "ERROR", field, F.count_if(~col(field).between(lo, hi)))])


def check_mentions(df: DataFrame, field: str = "mentions") -> DataFrame:
    return _report(df, ["symbol"], [
        Rule("negative_count", "ERROR", field, F.count_if(col(field) < 0)),
        Rule("count_too_large", "WARNING", field, F.count_if(col(field) > MAX_MENTIONS))])


def check_sources(df: DataFrame, valid: Sequence[str] = VALID_SOURCES) -> DataFrame:
    seen = df.groupBy("symbol", "source").agg(F.count(F.lit(1)).alias("n_bad"))
    return seen.filter(~F.col("source").isin(list(valid))).select(
        "symbol", F.lit("unknown_source").alias("rule"), F.lit("WARNING").alias("severity"),
        F.col("source").alias("field"), "n_bad")


def check_symbol_present(requested: DataFrame, df: DataFrame) -> DataFrame:
    """Requested symbols that the data lacks."""
    return requested.select("symbol").distinct().join(df.select("symbol").distinct(), "symbol", "left_anti").select(
        "symbol", F.lit("symbol_absent").alias("rule"), F.lit("ERROR").alias("severity"),
        F.lit("symbol").alias("field"), F.lit(1).cast("long").alias("n_bad"))


def check_features(df: DataFrame, features: str = "features") -> DataFrame:
    """Rules over a feature map per row: null, NaN/inf, range, missing share, bad names."""
    inf = float("inf")
    v = F.map_values(features)
    def n(pred):
        return F.size(F.filter(v, pred))
    bad_name = F.size(F.filter(F.map_keys(features), lambda k: ~k.rlike(r"^[A-Za-z0-9_.\-]{1,100}$")))
    missing = n(lambda x: x.isNull() | F.isnan(x))
    d = df.withColumns({
        "_missing": missing,
        "_inf": n(lambda x: (x == inf) | (x == -inf)),
        "_range": n(lambda x: ~F.isnan(x) & (F.abs(x) > MAX_FEATURE) & (F.abs(x) != inf)),
        "_names": bad_name,
        "_share": F.when(missing > MAX_MISSING * F.size(features), 1).otherwise(0)})
    return _report(d, ["symbol"], [
        Rule("null_feature", "WARNING", features, F.sum("_missing")),
        Rule("infinite_feature", "ERROR", features, F.sum("_inf")),
        Rule("feature_out_of_range", "WARNING", features, F.sum("_range")),
        Rule("too_many_missing", "ERROR", features, F.sum("_share")),
        Rule("bad_feature_name", "WARNING", features, F.sum("_names"))])


def row_z_stats(features: str = "features") -> Column:
    """(n, mean, sd) over the finite values of the row's feature map, population sigma; use through ``let``."""
    inf = float("inf")
    ok = F.filter(F.map_values(features), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf))

    def with_mean(v, mean):
        ss = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        return F.struct(F.size(v).alias("n"), mean.alias("mean"), F.sqrt(F.try_divide(ss, F.size(v))).alias("sd"))

    return let(ok, lambda v: let(F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), F.size(v)),
                                 lambda mean: with_mean(v, mean)))


def feature_outliers(df: DataFrame, features: str = "features", z: float = OUTLIER_Z) -> DataFrame:
    """Features more than z sigmas away inside their own row; rows need more than ten features."""
    keep = [c for c in df.columns if c != features]
    far = let(row_z_stats(features), lambda st: F.filter(
        F.transform(F.map_entries(features), lambda e: F.struct(
            e["key"].alias("name"), e["value"].alias("value"),
            F.when((st["n"] > 10) & (st["sd"] > 0), (e["value"] - st["mean"]) / F.nullif(st["sd"], F.lit(0.0)))
            .alias("z"))), lambda e: F.abs(e["z"]) > z))
    return df.select(*keep, F.inline(far))


def _issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("symbol").agg(F.count_if(F.col("severity").isin("ERROR", "CRITICAL")).alias("errors"),
                                        F.count_if(F.col("severity") == "WARNING").alias("warnings"))


def quality_score(issues: DataFrame, symbols: DataFrame, kind: str, missing_columns: int = 0,
                  has_volume: bool = True) -> DataFrame:
    """Score in [0,1] and validity per symbol.  ``symbols`` carries the extras a kind needs:
    sentiment: n_sources, avg_confidence; features: missing_ratio, outlier_ratio."""
    j = symbols.join(_issue_counts(issues), "symbol", "left").fillna(0, ["errors", "warnings"])
    e, w = F.col("errors"), F.col("warnings")
    if kind == "market":
        raw = 1 - 0.2 * F.lit(missing_columns) - 0.1 * e - 0.05 * w + (0.1 if has_volume else 0.0)
    elif kind == "sentiment":
        raw = 1 - 0.15 * e - 0.05 * w + F.least(F.lit(0.2), F.col("n_sources") * 0.05) + F.col("avg_confidence") * 0.1
    elif kind == "features":
        raw = 1 - 0.2 * e - 0.3 * F.col("missing_ratio") - 0.2 * F.col("outlier_ratio")
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return j.select("symbol", "errors", "warnings", clip(raw, 0, 1).alias("score"), (e == 0).alias("is_valid"))


def market_issues(bars: DataFrame) -> DataFrame:
    checks = [check_timestamps(bars), check_ohlc(bars), check_volume(bars), check_price_change(bars),
              check_duplicates(bars)]
    return reduce(DataFrame.unionByName, checks)


def sentiment_issues(sent: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [check_range(sent, "score", -1, 1), check_range(sent, "confidence", 0, 1),
                                          check_mentions(sent), check_sources(sent)])
