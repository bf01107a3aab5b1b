"""Cleaning steps in their order: dedupe, repair, impute, outliers, gaps; each keeps the row's identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, col, let
from .quality import MAX_FEATURE, OUTLIER_Z, row_z_stats
from .timeseries import BIG, Ordered, exact_percentiles, join_on, ordered_running, time_grid

# Spellings of a source and its canonical name.
SOURCE_SYNONYMS = {
    "reddit": "reddit", "wsb": "reddit", "wallstreetbets": "reddit", "twitter": "twitter", "tweet": "twitter",
    "news": "news", "article": "news", "unusual_whales": "unusual_whales", "unusualwhales": "unusual_whales",
}


def drop_dupes(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def repair_ohlc(df: DataFrame) -> DataFrame:
    """Widen high and low to contain the body; rows with a missing price stay as they are."""
    cols = ["open", "high", "low", "close"]
    full = F.lit(True)
    for p in cols:
        full = full & col(p).isNotNull()
    hi, lo = F.when(full, F.greatest(*cols)).otherwise(col("high")), F.when(full, F.least(*cols)).otherwise(col("low"))
    fixed = full & ((hi != col("high")) | (lo != col("low")))
    return df.withColumns({"high": hi, "low": lo, "ohlc_fixed": fixed})


def repair_low_values(df: DataFrame, drop_zero_volume: bool = False) -> DataFrame:
    out = {p: F.when(col(p) >= 0.001, col(p)) for p in ("open", "high", "low", "close")}
    out["volume"] = F.when(col("volume") < 0, 0.0).otherwise(col("volume"))
    df = df.withColumns(out)
    return df.filter("volume <> 0 OR volume IS NULL") if drop_zero_volume else df


def canonical_source(c="source") -> Column:
    names = F.create_map(*[F.lit(x) for kv in SOURCE_SYNONYMS.items() for x in kv])
    return F.coalesce(names[F.lower(col(c))], col(c))


def clean_sentiment(df: DataFrame) -> DataFrame:
    return df.withColumns({"score": clip("score", -1, 1), "confidence": clip("confidence", 0, 1),
                           "mentions": F.greatest(col("mentions"), F.lit(0)), "source": canonical_source()})


# ------------------------------------------------------------------ missing values

def impute(df: DataFrame, cols: Sequence[str], strategy: str, s: Ordered = Ordered(),
           max_run: int | None = None) -> DataFrame:
    """drop | ffill | bfill | median | interpolate over one row per (symbol, ts).

    Interpolation is positional between the neighbouring values; with ``max_run`` a series whose longest null run
    exceeds it is left alone.
    """
    if strategy == "drop":
        return df.dropna(subset=list(cols))
    if strategy == "ffill":
        return df.withColumns({c: F.last(c, ignorenulls=True).over(s.running) for c in cols})
    if strategy == "bfill":
        ahead = s.w.rowsBetween(0, Window.unboundedFollowing)
        return df.withColumns({c: F.first(c, ignorenulls=True).over(ahead) for c in cols})
    if strategy == "median":
        for c in cols:
            med = exact_percentiles(df, s.keys, c, {"_med": 0.5})
            df = join_on(df, med, s.keys, "left").withColumn(c, F.coalesce(c, "_med")).drop("_med")
        return df
    if strategy != "interpolate":
        raise ValueError(f"unknown strategy {strategy!r}")
    d = df.withColumn("_pos", s.row())
    ahead = s.w.rowsBetween(0, Window.unboundedFollowing)
    for c in cols:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(c).alias("v")))
        d = d.withColumn("_k", known)
        d = d.withColumns({"_a": F.last("_k", ignorenulls=True).over(s.running),
                           "_z": F.first("_k", ignorenulls=True).over(ahead)})
        gap = F.col("_z.p") - F.col("_a.p")
        line = F.col("_a.v") + (F.col("_z.v") - F.col("_a.v")) * F.try_divide(F.col("_pos") - F.col("_a.p"), gap)
        value = F.coalesce(F.col(c), line, F.col("_a.v"))
        if max_run is not None:
            run = F.coalesce("_z.p", F.max("_pos").over(Window.partitionBy(*s.keys)) + 1) - F.coalesce(
                "_a.p", F.lit(0)) - 1
            d = d.withColumn("_run", F.when(F.col(c).isNull(), run).otherwise(0))
            worst = F.max("_run").over(Window.partitionBy(*s.keys))
            value = F.when(worst <= max_run, value).otherwise(F.col(c))
        d = d.withColumn(c, value)
    return d.drop("_pos", "_k", "_a", "_z", "_run")


# ------------------------------------------------------------------ outliers

def outliers(df: DataFrame, c: str, method: str, keys=("symbol",), z: float = OUTLIER_Z, min_n: int = 10,
             share: float = 0.01, resolution: int = 4096) -> DataFrame:
    """remove | clip | cap | winsorize; a group without any |z| over the limit is left alone."""
    keys = list(keys)
    st = df.groupBy(*keys).agg(F.avg(c).alias("_m"), F.stddev_samp(c).alias("_s"), F.count(c).alias("_n"),
                               F.max(c).alias("_hi"), F.min(c).alias("_lo"))
    m, sd = F.col("_m"), F.col("_s")
    worst = F.greatest(F.col("_hi") - m, m - F.col("_lo")) / F.nullif(sd, F.lit(0.0))
    st = st.withColumn("_act", F.coalesce((F.col("_n") >= min_n) & (worst > z), F.lit(False)))
    if method == "remove":
        d = join_on(df, st, keys)
        far = F.coalesce(F.col("_act") & (F.abs(F.col(c) - m) / F.nullif(sd, F.lit(0.0)) > z), F.lit(False))
        d = d.filter(~far)
    elif method == "clip":
        d = join_on(df, st, keys).withColumn(c, F.when(F.col("_act") & F.col(c).isNotNull(), F.least(F.greatest(
            F.col(c), m - z * sd), m + z * sd)).otherwise(F.col(c)))
    elif method == "cap":
        lim = exact_percentiles(df, keys, c, {"_p1": 0.01, "_p99": 0.99}, resolution)
        d = join_on(df, join_on(st, lim, keys, "left"), keys).withColumn(
            c, F.when(F.col("_act") & F.col(c).isNotNull(), F.least(F.greatest(F.col(c), "_p1"), "_p99"))
            .otherwise(F.col(c))).drop("_p1", "_p99")
    elif method == "winsorize":
        run = ordered_running(df, keys, c, {"_k": F.lit(1)}, resolution)
        cut = F.floor(F.lit(share) * F.col("all__k"))
        low = F.min(F.when(F.col("cum__k") > cut, F.col(c)))
        high = F.max(F.when(F.col("all__k") - F.col("cum__k") + F.col("_k") > cut, F.col(c)))
        lim = run.groupBy(*keys).agg(low.alias("_wl"), high.alias("_wh"))
        d = join_on(df, join_on(st, lim, keys, "left"), keys).withColumn(
            c, F.when(F.col("_act") & F.col(c).isNotNull(), F.least(F.greatest(F.col(c), "_wl"), "_wh"))
            .otherwise(F.col(c))).drop("_wl", "_wh")
    else:
        raise ValueError(f"unknown method {method!r}")
    return d.drop("_m", "_s", "_n", "_hi", "_lo", "_act")


def clip_feature_outliers(df: DataFrame, features: str = "features", z: float = OUTLIER_Z) -> DataFrame:
    def fix(st, v):
        inside = F.least(F.greatest(v, st["mean"] - z * st["sd"]), st["mean"] + z * st["sd"])
        return F.when(v.isNull() | F.isnan(v) | ~((st["n"] > 10) & (st["sd"] > 0)), v).otherwise(inside)

    return df.withColumn(features, let(row_z_stats(features), lambda st: F.transform_values(
        features, lambda k, v: fix(st, v))))


# ------------------------------------------------------------------ gaps, scaling, features

def fill_gaps(df: DataFrame, cols: Sequence[str], freq: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Reindex to a regular grid between each symbol's first and last row and interpolate the given columns."""
    grid = time_grid(df, "symbol", ts, freq)
    d = grid.join(df.withColumn("_seen", F.lit(True)), ["symbol", ts], "left")
    d = impute(d, cols, "interpolate", Ordered("symbol", ts))
    return d.withColumn("filled", F.col("_seen").isNull()).drop("_seen")


def scale(train: DataFrame, df: DataFrame, cols: Sequence[str], method: str = "standard") -> DataFrame:
    """Fit on the train split, apply to any split; adds ``scaled_<col>``.  The fit is one row, read as scalars."""
    for c in cols:
        if method == "standard":
            fit = train.agg(F.avg(c).alias("mid"), F.stddev_pop(c).alias("width"))
        elif method == "minmax":
            fit = train.agg(F.min(c).alias("mid"), (F.max(c) - F.min(c)).alias("width"))
        elif method == "robust":
            q = exact_percentiles(train, [], c, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
            fit = q.select(F.col("q2").alias("mid"), (F.col("q3") - F.col("q1")).alias("width"))
        else:
            raise ValueError(f"unknown method {method!r}")
        one = fit.select(F.struct("mid", "width")).scalar()
        width = F.when(one["width"] == 0, 1.0).otherwise(one["width"])
        df = df.withColumn(f"scaled_{c}", (F.col(c) - one["mid"]) / width)
    return df


def clean_features(df: DataFrame, features: str = "features", drop_invalid: bool = False) -> DataFrame:
    """NULL, NaN and infinities become 0 (or leave the map), the rest is clipped to +-1e6."""
    inf = float("inf")
    def bad(v):
        return v.isNull() | F.isnan(v) | (F.abs(v) == inf)
    m = F.map_filter(features, lambda k, v: ~bad(v)) if drop_invalid else col(features)
    return df.withColumn(features, F.transform_values(m, lambda k, v: F.when(bad(v), 0.0).otherwise(
        F.least(F.greatest(v, F.lit(-MAX_FEATURE)), F.lit(MAX_FEATURE)))))


def clean_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    inf = float("inf")
    out = {}
    for c in cols:
        v = F.col(c).cast("double")
        out[c] = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == inf), 0.0).otherwise(
            F.least(F.greatest(v, F.lit(-MAX_FEATURE)), F.lit(MAX_FEATURE)))
    return df.withColumns(out)


def select_top_features(df: DataFrame, n: int, features: str = "features") -> DataFrame:
    """The n entries of the largest magnitude, inside the row: a map never leaves its row."""
    entries = F.transform(F.map_entries(features), lambda e: F.struct(
        (-F.abs(e["value"])).alias("r"), e["key"].alias("k"), e["value"].alias("v")))
    top = F.slice(F.sort_array(entries), 1, n)  # native order; array_sort calls a comparator
    return df.withColumn(features, F.map_from_entries(F.transform(top, lambda e: F.struct(e["k"], e["v"]))))


def clean_market(bars: DataFrame, freq: str = "1 hour") -> DataFrame:
    """Dedupe, repair, interpolate short null runs, clip close outliers, fill the grid."""
    prices = ["open", "high", "low", "close"]
    d = repair_ohlc(drop_dupes(bars))
    d = repair_low_values(d)
    d = impute(d, prices + ["volume"], "interpolate", max_run=5)
    d = outliers(d, "close", "clip")
    return fill_gaps(d, prices + ["volume"], freq)


def clean_report(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Per symbol: rows in, duplicates removed, OHLC fixes, null prices before, rows added by the grid."""
    before = raw.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col("close").isNull()).alias("null_close"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"))
    after = cleaned.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows_out"), F.count_if("filled").alias("filled"),
        F.count_if(F.coalesce("ohlc_fixed", F.lit(False))).alias("ohlc_fixed"))
    return before.join(after, "symbol", "left")
