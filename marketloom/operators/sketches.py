"""Mergeable sketches: quantiles (KLL) and distinct counts (HyperLogLog) as binary partial aggregates.

Exact results are the default everywhere; sketches are an explicit choice (``approx=True``).  A sketch is made once per
key and day, kept as a column of a table and merged on read, so a year of percentiles reads some hundred short rows
instead of the ticks.  Null, NaN and infinite values are left out; a null key or day is a group of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col, finite
from .timeseries import exact_percentiles, join_on

# k = 800: rank error below 0.4 percent at 99 percent confidence.  2^12 registers: 1.6 percent standard error.
QUANTILE_K, DISTINCT_LG = 800, 12
RANK_ERROR, DISTINCT_ERROR = 0.01, 0.06


def _value(c) -> Column:
    return finite(col(c).cast("double"))


def day_sketches(df: DataFrame, keys: Sequence[str], ts: str, value: str, distinct: str) -> DataFrame:
    """(keys, day, n, lo, hi, quantiles, uniques): one row per key and day, combined map-side."""
    v = _value(value)
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(
        F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.kll_sketch_agg_double(v, QUANTILE_K).alias("quantiles"),
        F.hll_sketch_agg(col(distinct).cast("string"), DISTINCT_LG).alias("uniques"))


def refresh_days(path: str, sketches: DataFrame) -> None:
    """Write day sketches; the days of ``sketches`` are replaced, all others stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def merge_sketches(sketches: DataFrame, keys: Sequence[str], start=None, end=None) -> DataFrame:
    """Merge the days of [start, end] (dates; open where None) to one row per key."""
    d = sketches
    if start is not None:
        d = d.filter(col("day") >= F.lit(start).cast("date"))
    if end is not None:
        d = d.filter(col("day") <= F.lit(end).cast("date"))
    return d.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("days"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.kll_merge_agg_double("quantiles", QUANTILE_K).alias("quantiles"), F.hll_union_agg("uniques").alias("uniques"))


def sketch_percentiles(merged: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Percentiles of merged sketches; null for a group without values, the exact ends at 0 and 1."""
    def at(p: float) -> Column:
        inner = F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p)))
        return col("lo") if p <= 0 else col("hi") if p >= 1 else F.when(col("n") > 0, inner)
    return merged.select(*keys, *[at(p).alias(name) for name, p in probs.items()])


def sketch_distinct(merged: DataFrame, keys: Sequence[str], out: str = "distinct_count") -> DataFrame:
    return merged.select(*keys, F.hll_sketch_estimate("uniques").alias(out))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], approx: bool = False) -> DataFrame:
    """Percentiles per key: exact, or from one sketch per key."""
    if not approx:
        return exact_percentiles(df, list(keys), value, probs)
    v = _value(value)
    one = df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"),
                                F.kll_sketch_agg_double(v, QUANTILE_K).alias("quantiles"))
    return sketch_percentiles(one, keys, probs)


def distinct_count(df: DataFrame, keys: Sequence[str], value: str, approx: bool = False, out: str = "distinct_count") -> DataFrame:
    """Distinct non-null values per key: exact, or estimated from one sketch per key."""
    if approx:
        return sketch_distinct(df.groupBy(*keys).agg(F.hll_sketch_agg(col(value).cast("string"), DISTINCT_LG).alias("uniques")), keys, out)
    # distinct pairs first, so that a key with many values is counted in many tasks
    return df.groupBy(*keys, value).agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count(value).alias(out))


def rank_errors(df: DataFrame, estimates: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """(keys, rank_error): the largest distance of an estimate's true ranks from the asked rank, over all ``probs``."""
    v = _value(value)
    j = join_on(df.select(*keys, v.alias("_v")), estimates.select(*keys, F.struct(*probs).alias("_e")), list(keys)).filter("_v IS NOT NULL")
    counts = [F.struct(F.lit(float(p)).alias("p"), (F.count_if(col("_v") < col(f"_e.{n}")) / F.count(F.lit(1))).alias("below"),
                       (F.count_if(col("_v") <= col(f"_e.{n}")) / F.count(F.lit(1))).alias("upto")) for n, p in probs.items()]
    far = F.transform(F.array(*counts), lambda s: F.greatest(s["below"] - s["p"], s["p"] - s["upto"], F.lit(0.0)))
    return j.groupBy(*keys).agg(F.array_max(far).alias("rank_error"))
