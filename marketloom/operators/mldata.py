"""Model data: lags, sequences, splits, folds, selection, classifiers and perturbation tests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col, div, normal_hash, unit_hash
from .timeseries import Ordered, exact_percentiles, index_rows, micros, ordered_running

S = Ordered()


def lag_features(df: DataFrame, c: str, lags=(1, 5, 10, 20), windows=(7, 30), s: Ordered = S) -> DataFrame:
    return df.withColumns({**{f"{c}_lag_{n}": s.lag(c, n) for n in lags}, **{f"{c}_mean_{n}": s.mean(c, n) for n in windows},
                           **{f"{c}_std_{n}": s.std(c, n) for n in windows}})


def sequences(df: DataFrame, c: str, length: int = 60, stride: int = 1, horizon: int = 1, s: Ordered = S) -> DataFrame:
    """Windows of ``length`` values with the value ``horizon`` bars later, every ``stride`` bars."""
    d = df.withColumns({"seq": F.collect_list(c).over(s.rows(1 - length)), "target": s.lead(c, horizon), "_n": s.row()})
    d = d.filter((F.size("seq") == length) & col("target").isNotNull() & (F.pmod(col("_n") - length, F.lit(stride)) == 0))
    return d.drop("_n")


def temporal_split(df: DataFrame, order: Sequence[str], train: float = 0.7, val: float = 0.15, block: str = "day") -> DataFrame:
    """Ordered train/val/test labels by row share, without sorting everything in one task."""
    total = df.agg(F.count(F.lit(1))).scalar()
    d = index_rows(df.withColumn("_all", F.lit(0)), "_all", list(order), F.date_trunc(block, order[0]))
    a, b = F.floor(total * train), F.floor(total * (train + val))
    return d.withColumn("split", F.when(col("_i") <= a, "train").when(col("_i") <= b, "val").otherwise("test")).drop("_all", "_i")


def walk_forward_folds(df: DataFrame, ts: str = "ts", train: int = 24, val: int = 3, test: int = 1, step: int = 1, month_days: int = 30,
                       min_train: int = 1000, expanding: bool = True) -> DataFrame:
    """Fold table with row counts.  Rows are first counted per day since the start; folds join that small table."""
    one = df.agg(F.struct(F.min(ts).alias("lo"), F.max(ts).alias("hi"))).scalar()
    us = 86_400_000_000
    def micros(c):
        return F.unix_micros(c.cast("timestamp"))
    day = F.floor((micros(col(ts)) - micros(one["lo"])) / us)
    days = df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    span = (micros(one["hi"]) - micros(one["lo"])) / us
    d = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(span / (step * month_days)).cast(
        "int")))).alias("fold"), span.alias("span"))
    t1 = (F.lit(train) + col("fold") * step) * month_days
    d = d.withColumns({"train_end": t1, "val_end": t1 + val * month_days, "test_end": t1 + (val + test) * month_days,
                       "train_start": F.lit(0) if expanding else col("fold") * step * month_days}).filter(col("test_end") <= col("span"))
    slots = d.withColumn("day", F.explode(F.sequence(col("train_start").cast("long"), (col("test_end") - 1).cast("long"))))
    x = col("day")
    g = slots.join(days, "day").groupBy("fold", "train_start", "train_end", "val_end", "test_end").agg(
        F.sum(F.when(x < col("train_end"), col("n")).otherwise(0)).alias("train_rows"),
        F.sum(F.when(x.between(col("train_end"), col("val_end") - 1), col("n")).otherwise(0)).alias("val_rows"),
        F.sum(F.when(x >= col("val_end"), col("n")).otherwise(0)).alias("test_rows"))
    return g.filter((col("train_rows") >= min_train) & (col("val_rows") > 0) & (col("test_rows") > 0))


def summarise_configs(results: DataFrame, patience: int = 3) -> DataFrame:
    """(config, fold, score) to mean, best and worst score and the fold at which early stopping would end."""
    s = Ordered("config", "fold")
    best = F.max("score").over(s.running)
    d = results.withColumn("_best", best).withColumn("_new", F.when(
        (col("score") >= col("_best")) & (col("score") > F.coalesce(s.lag("_best"), F.lit(float("-inf")))), col("fold")))
    d = d.withColumn("_at", F.last("_new", ignorenulls=True).over(s.running))
    return d.groupBy("config").agg(F.avg("score").alias("mean_score"), F.max("score").alias("best"), F.min("score").alias("worst"),
                                   F.count(F.lit(1)).alias("folds"), F.min(F.when(col("fold") - col("_at") >= patience, col("fold")))
                                   .alias("stopped_at"))


def select_k_best(df: DataFrame, features: str, label: str, k: int, kind: str = "anova") -> DataFrame:
    """anova (continuous features) or chi2 (categorical features), both on Spark ML."""
    from pyspark.ml.feature import UnivariateFeatureSelector
    sel = UnivariateFeatureSelector(featuresCol=features, labelCol=label, outputCol="selected", selectionMode="numTopFeatures")
    sel.setFeatureType("continuous" if kind == "anova" else "categorical").setLabelType("categorical").setSelectionThreshold(k)
    return sel.fit(df).transform(df)


def selection_scores(df: DataFrame, features: str, label: str, k: int) -> DataFrame:
    """(feature, f_value, chosen): one-way ANOVA of every place of an array column, and the k largest."""
    long = df.select(col(label).alias("_c"), F.posexplode(features).alias("feature", "_x")).filter("_x IS NOT NULL AND _c IS NOT NULL")
    per = long.groupBy("feature", "_c").agg(F.count("_x").alias("n"), F.avg("_x").alias("m"), F.var_pop("_x").alias("v"))
    per = per.withColumn("_all", F.sum(col("n") * col("m")).over(Window.partitionBy("feature")) / F.sum("n").over(
        Window.partitionBy("feature")))
    g = per.groupBy("feature").agg(F.sum(col("n") * F.pow(col("m") - col("_all"), F.lit(2))).alias("b"), F.sum(col("n") * col("v")).alias(
        "w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"))
    g = g.withColumn("f_value", div(col("b") / (col("c") - 1), col("w") / (col("n") - col("c"))))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(col("f_value").desc(), "feature"))  # one row per feature
    return g.select("feature", "f_value", (place <= k).alias("chosen"))


def chi2_scores(df: DataFrame, features: str, label: str, k: int) -> DataFrame:
    """(feature, chi2, chosen): chi-squared statistic of every categorical place of an array column against the label."""
    long = df.select(col(label).alias("_c"), F.posexplode(features).alias("feature", "_x")).filter("_x IS NOT NULL AND _c IS NOT NULL")
    joint = long.groupBy("feature", "_x", "_c").agg(F.count(F.lit(1)).alias("n"))
    rows, columns = (joint.groupBy("feature", c).agg(F.sum("n").alias(f"_{c}n")) for c in ("_x", "_c"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("_t"))
    # every category meets every class, also where no row does: two small tables per feature
    grid = rows.join(columns, "feature").join(total, "feature").join(joint, ["feature", "_x", "_c"], "left")
    want = col("__xn") * col("__cn") / col("_t")
    chi2 = grid.groupBy("feature").agg(F.sum(F.pow(F.coalesce("n", F.lit(0)) - want, F.lit(2)) / want).alias("chi2"))
    best = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("chi2", 9).desc(), "feature"))  # one row per feature
    return chi2.select("feature", "chi2", (best <= k).alias("chosen"))


def mutual_information(df: DataFrame, features: str, label: str, k: int, bins: int = 10) -> DataFrame:
    """(feature, mi, chosen): mutual information of every place of an array column with the label, and the k largest.

    Values are cut into bins of equal frequency by their exact rank, all places at once; equal values share a bin.  One
    aggregation makes the joint histograms.
    """
    long = df.select(col(label).alias("_c"), F.posexplode(features).alias("feature", "_x")).filter("_x IS NOT NULL AND _c IS NOT NULL")
    long = long.select("feature", "_c", col("_x").cast("double").alias("_x")).filter(~F.isnan("_x"))
    per = long.groupBy("feature", "_x", "_c").agg(F.count(F.lit(1)).alias("_m"))
    ranks = ordered_running(long, ["feature"], "_x", {"n": F.lit(1)})
    place = F.floor((col("cum_n") - col("n")) * bins / col("all_n")).alias("_bin")
    joint = per.join(ranks.select("feature", "_x", place, "all_n"), ["feature", "_x"]).groupBy("feature", "_bin", "_c").agg(
        F.sum("_m").alias("n"), F.first("all_n").alias("all"))
    row, column = Window.partitionBy("feature", "_bin"), Window.partitionBy("feature", "_c")  # at most bins x classes rows of a feature
    joint = joint.withColumns({"_r": F.sum("n").over(row), "_k": F.sum("n").over(column)})
    mi = joint.groupBy("feature").agg(F.sum(col("n") / col("all") * F.ln(col("n") * col("all") / (col("_r") * col("_k")))).alias("mi"))
    best = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("mi", 12).desc(), "feature"))  # one row per feature
    return mi.select("feature", "mi", (best <= k).alias("chosen"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (classes * n_class)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    one = c.agg(F.struct(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return df.join(c.select(label, (one["n"] / (one["k"] * col("_n"))).alias("class_weight")), label)


def fit_stages(train: DataFrame, features: Sequence[str], estimator, before: Sequence = (), vector: str = "fv"):
    """Fit any Spark ML estimator (or transformer) behind a vector of ``features``; rows with a missing feature are skipped.

    Every model of this library goes through here, so another estimator is another argument.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    vectors = VectorAssembler(inputCols=list(features), outputCol=vector, handleInvalid="skip")
    return Pipeline(stages=[*before, vectors, estimator]).fit(train)


# ------------------------------------------------------------------ purged folds, permutation importance

def fold_bounds(df: DataFrame, ts: str = "ts", folds: int = 5) -> list[int]:
    """Times (microseconds) that cut the rows into ``folds + 1`` parts of equal count, and the end: one short list."""
    us = micros(ts)
    low = df.agg(F.min(us)).first()[0]
    if low is None:
        return []
    probs = {f"b{i}": i / (folds + 1) for i in range(1, folds + 1)}
    cuts = exact_percentiles(df.select((us - low).cast("double").alias("_t")), [], "_t", probs).first()
    return [low + round(c) for c in cuts] + [2 ** 63 - 1]


def purged_folds(df: DataFrame, ts: str = "ts", folds: int = 5, embargo_seconds: float = 0.0) -> list[tuple[DataFrame, DataFrame]]:
    """(train, test) per fold: tests are consecutive parts of equal count, trains all rows before them but for the embargo gap.

    Rows of one instant are never parted.  Rows without a time are in no fold.
    """
    bounds, us = fold_bounds(df, ts, folds), micros(ts)
    gap = round(embargo_seconds * 1_000_000)
    return [(df.filter(us < lo - gap), df.filter((us >= lo) & (us < hi))) for lo, hi in zip(bounds, bounds[1:])]


def fold_sizes(df: DataFrame, ts: str = "ts", folds: int = 5, embargo_seconds: float = 0.0) -> DataFrame:
    """(fold, train_rows, test_rows, first_test), counted in one pass."""
    bounds, us = fold_bounds(df, ts, folds), micros(ts)
    gap = round(embargo_seconds * 1_000_000)
    spec = "fold long, train_rows long, test_rows long, first_test timestamp_ntz"
    if not bounds:
        return df.sparkSession.createDataFrame([], spec)
    parts = [F.struct(F.lit(k).cast("long").alias("fold"), F.count_if(us < lo - gap).alias("train_rows"),
                      F.count_if((us >= lo) & (us < hi)).alias("test_rows"), F.min(F.when((us >= lo) & (us < hi), col(ts))).alias("first_test"))
             for k, (lo, hi) in enumerate(zip(bounds, bounds[1:]), 1)]
    return df.agg(F.array(*parts).alias("_f")).select(F.inline("_f"))


def cross_validate(df: DataFrame, fit: Callable, label: str, ts: str = "ts", folds: int = 5, embargo_seconds: float = 0.0) -> DataFrame:
    """(fold, test_rows, mae, rmse) over purged folds; ``fit(train)`` returns a model whose ``transform`` adds ``prediction``."""
    out = None
    for k, (train, test) in enumerate(purged_folds(df, ts, folds, embargo_seconds), 1):
        e = col("prediction") - col(label)
        row = fit(train).transform(test).agg(F.lit(k).cast("long").alias("fold"), F.count(e).alias("test_rows"), F.avg(F.abs(e)).alias("mae"),
                                             F.sqrt(F.avg(e * e)).alias("rmse"))
        out = row if out is None else out.unionByName(row)
    return out


RANK_ROWS = 100_000


def hash_rank(df: DataFrame, ids: Sequence[str], seed: int, parts: int, out: str) -> DataFrame:
    """1-based rank of every row in the order of a seeded hash of its ids, sorted in ``parts`` separate buckets."""
    h = F.xxhash64(F.lit(seed), *ids)
    d = df.withColumns({"_h": h, "_part": F.pmod(F.xxhash64(F.lit(seed + 1), *ids), F.lit(parts))})
    before = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per bucket
    before = before.select("_part", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_h", *ids))
    return d.withColumn(out, place).join(before, "_part").withColumn(out, col(out) + col("_before")).drop("_h", "_part", "_before")


def absolute_error(label: str) -> Column:
    return F.abs(col("prediction") - col(label))


def zero_one_error(label: str) -> Column:
    return (col("prediction") != col(label)).cast("double")


def permutation_importance(model, test: DataFrame, features: Sequence[str], label: str, ids: Sequence[str],
                           error: Callable[[str], Column] = absolute_error, seed: int = 7) -> DataFrame:
    """(feature, base_error, error, importance): what the error gains when one feature is permuted among the test rows.

    A seeded permutation pairs the rank of a row under one hash with the rank under another, so it is exact (every value is
    used once), repeatable, and one join for all features.  All permuted copies are scored in one pass.  ``ids`` name a row.
    """
    d = test.dropna(subset=[*features, label])
    parts = max(1, -(-d.count() // RANK_ROWS))
    own = hash_rank(d.select(*ids, label, *features), ids, seed, parts, "_rank")
    other = hash_rank(d.select(*ids, *features), ids, seed + 2, parts, "_rank").select("_rank", F.struct(*features).alias("_other"))
    j = own.join(other, "_rank")
    def with_other(swap: str | None) -> Column:
        return F.struct(F.lit(swap or "").alias("feature"), *[(col(f"_other.{f}") if f == swap else col(f)).alias(f) for f in features])
    long = j.select(col(label), F.inline(F.array(*[with_other(f) for f in (None, *features)])))
    g = model.transform(long).groupBy("feature").agg(F.avg(error(label)).alias("error"))
    base = F.max(F.when(col("feature") == "", col("error"))).over(Window.partitionBy(F.lit(0)))  # one row per feature
    return g.withColumn("base_error", base).filter("feature <> ''").withColumn("importance", col("error") - col("base_error"))


def regime_classifier(df: DataFrame, features: Sequence[str], split_ts, label: str = "regime", trees: int = 20, seed: int = 7,
                      estimator=None):
    """A classifier (random forest unless given) with class-balanced weights and a time split; returns (model, test predictions)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    cut = F.lit(split_ts).cast("timestamp_ntz")
    d = df.dropna(subset=list(features))
    train = class_weights(d.filter(col("ts") < cut), label)
    pipe = Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="label", handleInvalid="keep"), VectorAssembler(inputCols=list(features), outputCol="fv"),
        estimator or RandomForestClassifier(featuresCol="fv", labelCol="label", weightCol="class_weight", numTrees=trees, maxDepth=5, seed=seed)])
    model = pipe.fit(train)
    return model, model.transform(d.filter(col("ts") >= cut))


def stacked_meta(wide: DataFrame, models: Sequence[str], split: str = "is_train", kind: str = "logistic", estimator=None):
    """Meta-learner over base scores (one column per model): logistic, boosted trees, or any given estimator."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import GBTRegressor
    last = estimator or (LogisticRegression(featuresCol="fv", labelCol="actual", maxIter=20) if kind == "logistic" else GBTRegressor(
        featuresCol="fv", labelCol="actual", maxIter=10, maxDepth=3, seed=7))
    model = fit_stages(wide.filter(split), [f"score_{m}" for m in models], last)
    return model, model.transform(wide.filter(f"NOT {split}"))


def robustness_perturb(df: DataFrame, c: str, noise: Sequence[float] = (0.01, 0.05, 0.1), missing: Sequence[float] = (0.05, 0.1, 0.2),
                       s: Ordered = S, seed: int = 11) -> DataFrame:
    """(scenario, symbol, ts, value): noisy and gappy copies; noise comes from a hash of the row, so it is reproducible."""
    sd = F.stddev_samp(c).over(Window.partitionBy(*s.keys))
    row = (F.length(s.keys[0]), F.ascii(s.keys[0]), F.ascii(F.substring(s.keys[0], -1, 1)), micros(s.order[0]) / 1_000_000)
    d = df.withColumns({"_g": normal_hash(seed, *row) * sd, "_v": unit_hash(seed + 2, *row)})
    d = d.withColumns({f"_m{int(x * 100)}": F.when(col("_v") >= x, col(c)) for x in missing})
    d = d.withColumns({f"_m{int(x * 100)}": F.last(f"_m{int(x * 100)}", ignorenulls=True).over(s.running) for x in missing})
    items = [F.struct(F.lit(f"noise_{x}").alias("scenario"), (col(c) + col("_g") * x).alias("value")) for x in noise]
    items += [F.struct(F.lit(f"missing_{x}").alias("scenario"), col(f"_m{int(x * 100)}").alias("value")) for x in missing]
    items.append(F.struct(F.lit("base").alias("scenario"), col(c).alias("value")))
    return d.select(*s.keys, *s.order, F.inline(F.array(*items)))


def degradation(perturbed: DataFrame) -> DataFrame:
    """Mean-over-sigma of each scenario and its loss against the base."""
    g = perturbed.groupBy("symbol", "scenario").agg(div(F.avg("value"), F.stddev_samp("value")).alias("score"))
    base = g.filter("scenario = 'base'").select("symbol", col("score").alias("base"))
    return g.filter("scenario <> 'base'").join(base, "symbol").withColumn("loss", div(col("base") - col("score"), F.abs("base")))
