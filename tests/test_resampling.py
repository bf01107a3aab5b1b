"""Bootstrap of any statistic, mergeable sketches, purged folds, permutation importances, swappable models."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions.numeric import mixed_hash
from marketloom.operators import evaluate, impact, mldata, sketches, tca

T0 = dt.datetime(2024, 1, 1)


def resamples(ids, x, reps, seed):
    w = evaluate.resample_weights(np.asarray(ids), np.arange(reps), seed).astype(int)
    return [np.repeat(x, w[:, r]) for r in range(reps)]


def test_mixed_hash_is_uniform_and_independent():
    u = mixed_hash(42, np.arange(2000)[:, None], np.arange(50)[None, :])
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.005
    c = np.corrcoef(u.T) - np.eye(50)
    assert np.abs(c).max() < 0.12  # repetitions are not shifts of each other
    w = evaluate.resample_weights(np.arange(20000), np.arange(20), 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("values", ["spread", "ties", "one"])
def test_quantile_of_every_resample_is_exact(spark, p, values):
    rng = np.random.default_rng(3)
    n = 400
    x = {"spread": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "one": np.full(n, 7.0)}[values]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": x})).repartition(3)
    got = {r.rep: r.stat for r in evaluate.bootstrap_quantiles(df, "x", "id", p, 20, 5).collect()}
    want = [np.quantile(s, p) for s in resamples(np.arange(n), x, 20, 5)]
    assert [got[r] for r in range(20)] == pytest.approx(want)


def test_bootstrap_edges(spark):
    spec = "id long, x double"
    none = spark.createDataFrame([], spec)
    for stat in ("mean", "median", lambda v, w: 1.0):
        r = evaluate.bootstrap_ci(none, "x", "id", stat, 10).first()
        assert r.boot_mean is None and r.low is None
    odd = spark.createDataFrame([(1, None), (2, float("nan")), (3, float("inf")), (None, 1.0)] + [(2 ** 40 + i, float(i)) for i in range(50)], spec)
    assert 15 < evaluate.bootstrap_ci(odd, "x", "id", "median", 50).first().boot_mean < 35
    assert evaluate.bootstrap_ci(odd, "x", "id", "mean", 50).first().boot_std == pytest.approx(14.4 / np.sqrt(50), rel=0.3)


def test_callable_statistic(spark):
    df = spark.range(5000).select("id", F.sqrt("id").alias("x"))
    def spread(v, w):
        m = (v * w).sum() / w.sum()
        return float(np.sqrt((w * (v - m) ** 2).sum() / w.sum()))
    got = {r.rep: r.stat for r in evaluate.bootstrap_callable(df, "x", spread, 200).collect()}
    x = np.sqrt(np.arange(5000))
    assert got[-1] == pytest.approx(x.std(), rel=1e-3)  # 5,000 values in 4,096 cells
    own = [np.random.default_rng(i).choice(x, 5000).std() for i in range(200)]
    assert np.std([got[i] for i in range(200)]) == pytest.approx(np.std(own), rel=0.25)
    again = {r.rep: r.stat for r in evaluate.bootstrap_callable(df.repartition(5), "x", spread, 200).collect()}
    assert again == pytest.approx(got)


def test_sketches_merge_within_their_errors(spark, tmp_path):
    df = spark.range(60000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 20).cast("timestamp_ntz").alias("ts"),
        F.pmod(F.col("id") * 7919, F.lit(60013)).cast("double").alias("x"), (F.col("id") % 5000).alias("who"))
    path = str(tmp_path / "s")
    days = sketches.day_sketches(df, ["k"], "ts", "x", "who")
    sketches.refresh_days(path, days)
    # a day is made again: its rows are replaced, the others stay
    sketches.refresh_days(path, sketches.day_sketches(df.filter("to_date(ts) = '2024-01-05'"), ["k"], "ts", "x", "who"))
    stored = spark.read.parquet(path)
    assert stored.count() == days.count()
    merged = sketches.merge_sketches(stored, ["k"])
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    errors = sketches.rank_errors(df, sketches.sketch_percentiles(merged, ["k"], probs), ["k"], "x", probs)
    assert [r.rank_error < sketches.RANK_ERROR for r in errors.collect()] == [True, True]
    exact = {r.k: r.distinct_count for r in sketches.distinct_count(df, ["k"], "who").collect()}
    for r in sketches.sketch_distinct(merged, ["k"]).collect():
        assert r.distinct_count == pytest.approx(exact[r.k], rel=sketches.DISTINCT_ERROR)
    assert {r.n for r in merged.collect()} == {20000, 40000}


def test_sketch_edges(spark):
    spec = "k string, ts timestamp_ntz, x double, who string"
    rows = [(None, T0, 1.0, "a"), ("n", None, None, None), ("n", T0, float("nan"), None), ("s", T0, 5.0, "b")]
    df = spark.createDataFrame(rows, spec)
    merged = sketches.merge_sketches(sketches.day_sketches(df, ["k"], "ts", "x", "who"), ["k"])
    got = {r.k: r.p for r in sketches.sketch_percentiles(merged, ["k"], {"p": 0.5}).collect()}
    assert got == {None: 1.0, "n": None, "s": 5.0}
    assert {r.k: r.distinct_count for r in sketches.sketch_distinct(merged, ["k"]).collect()} == {None: 1, "n": 0, "s": 1}
    for approx in (False, True):
        got = {r.k: r.p for r in sketches.percentiles(df, ["k"], "x", {"p": 0.5}, approx).collect()}
        assert got[None] == 1.0 and got["s"] == 5.0 and got.get("n") is None
        assert {r.k: r.distinct_count for r in sketches.distinct_count(df, ["k"], "who", approx).collect()} == {None: 1, "n": 0, "s": 1}
    assert sketches.merge_sketches(sketches.day_sketches(df.limit(0), ["k"], "ts", "x", "who"), ["k"]).count() == 0


@pytest.fixture(scope="module")
def known(spark):
    rng = np.random.default_rng(1)
    n = 3000
    a, b, c = rng.normal(size=(3, n))
    pdf = pd.DataFrame({"id": np.arange(n), "ts": [T0 + dt.timedelta(minutes=i) for i in range(n)], "a": a, "b": b, "c": c,
                        "y": 3 * a + 0.5 * b + rng.normal(scale=0.1, size=n)})
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_purged_folds_keep_their_gap(spark, known):
    sizes = mldata.fold_sizes(known, folds=4, embargo_seconds=3600).orderBy("fold").collect()
    assert [r.test_rows for r in sizes] == [600] * 4
    assert [r.train_rows for r in sizes] == [540, 1140, 1740, 2340]
    for (train, test), r in zip(mldata.purged_folds(known, folds=4, embargo_seconds=3600), sizes):
        last, first = train.agg(F.max("ts")).first()[0], test.agg(F.min("ts")).first()[0]
        assert first - last > dt.timedelta(hours=1) and (train.count(), test.count()) == (r.train_rows, r.test_rows)
    assert mldata.fold_sizes(known.limit(0)).count() == 0
    same = known.withColumn("ts", F.lit(T0).cast("timestamp_ntz"))
    assert sum(r.test_rows for r in mldata.fold_sizes(same, folds=4).collect()) == 3000


def test_importances_of_a_known_model(spark, known):
    from pyspark.ml.regression import LinearRegression
    fit = tca.slippage_fit(["a", "b", "c"], "y", estimator=LinearRegression(featuresCol="features", labelCol="y"))
    train, test = mldata.purged_folds(known, folds=1)[0]
    got = {r.feature: r for r in mldata.permutation_importance(fit(train), test, ["a", "b", "c"], "y", ["id"]).collect()}
    assert got["a"].importance > 2.5 and 0.2 < got["b"].importance < 0.8 and abs(got["c"].importance) < 0.02
    again = mldata.permutation_importance(fit(train), test.repartition(5), ["a", "b", "c"], "y", ["id"]).collect()
    assert {r.feature: r.error for r in again} == pytest.approx({f: r.error for f, r in got.items()})
    errors = mldata.cross_validate(known, fit, "y", folds=3, embargo_seconds=60).collect()
    assert sorted(r.fold for r in errors) == [1, 2, 3] and all(0.05 < r.rmse < 0.15 for r in errors)


def test_hash_rank_is_a_permutation(spark, known):
    for parts in (1, 7):
        ranks = [r._r for r in mldata.hash_rank(known, ["id"], 3, parts, "_r").select("_r").collect()]
        assert sorted(ranks) == list(range(1, 3001)) and ranks != sorted(ranks)


def test_impact_models_can_be_added(spark):
    orders = spark.createDataFrame([(1, "A", 100.0, 0)], "order_id long, symbol string, size double, latency_ms long")
    kyle = spark.createDataFrame([("A", 1e-6, 100)], "symbol string, lam double, n long")
    params = spark.createDataFrame([("A", 0.2, 1000.0, 1e-6, 1e-7)], "symbol string, volatility double, avg_volume double, eta double, gamma double")
    impact.register_impact_model("flat", lambda: F.lit(0.001))
    try:
        with pytest.raises(ValueError):
            impact.register_impact_model("flat", lambda: F.lit(0.0))
        r = impact.impact_estimate(orders, kyle, params, {"flat": 1.0}).first()
        assert r.impact_bps == pytest.approx(10) and r.risk_class == "medium"
        assert impact.impact_estimate(orders, kyle, params).first().impact_bps == pytest.approx((0.4 * 1e-4 + 0.6 * 1.1e-7) * 1e4)
    finally:
        del impact.IMPACT_MODELS["flat"]
    b = spark.createDataFrame([(4.9,), (5.0,), (20.0,), (60.0,), (None,)], "s double")
    assert [r[0] for r in b.select(tca.slippage_bucket("s")).collect()] == ["very_low", "low", "high", "very_high", None]
