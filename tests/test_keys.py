"""Null keys and times, NaN, hot keys, nulls inside recurrences, products that vanish."""

import datetime as dt

from pyspark.sql import functions as F

from marketloom.operators import cleaning
from marketloom.operators import timeseries as ts
from marketloom.streaming import ordered

T0 = dt.datetime(2024, 1, 1)


def test_null_keys_and_times_keep_their_rows(spark):
    rows = [("a", T0, 1), (None, T0, 2), ("a", None, 3), (None, None, 4)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq int")
    got = {r.seq: r._i for r in ts.index_rows(df, "symbol", ["ts", "seq"], F.date_trunc("hour", "ts")).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 1}
    joined = ts.asof_join(df, df.withColumnRenamed("seq", "other"), "symbol", ["other"]).collect()
    assert {r.seq: r.other for r in joined} == {1: 1, 2: None, 3: None, 4: None}


def test_outliers_keep_rows_without_symbol(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("a", 3.0), (None, 4.0)], "symbol string, price double")
    for method in ("remove", "clip", "cap", "winsorize"):
        assert cleaning.outliers(df, "price", method).count() == 4


def test_percentiles_leave_nan_out_and_keep_the_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 2.0), (None, 7.0)], "k string, x double")
    assert {r.k: r.m for r in ts.exact_percentiles(df, "k", "x", {"m": 0.5}).collect()} == {"a": 1.5, None: 7.0}


def test_a_hot_key_is_cut_by_its_counts(spark):
    n, limit = 40_000, 1000
    df = spark.range(n).select(F.lit("one").alias("k"), F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 1000).cast(
        "timestamp_ntz").alias("ts"))
    sizes = [r["count"] for r in ts.sized_blocks(df, "k", "ts", F.date_trunc("day", "ts"), limit=limit).groupBy("_b").count().collect()]
    assert sum(sizes) == n and max(sizes) <= limit
    small = spark.createDataFrame([("one", T0 + dt.timedelta(seconds=i), i) for i in range(50)], "k string, ts timestamp_ntz, i int")
    cut = ts.sized_blocks(small, "k", "ts", F.date_trunc("day", "ts"), limit=5).groupBy("_b").count()
    assert cut.agg(F.max("count")).first()[0] <= 5


def test_recurrence_holds_over_a_null(spark):
    rows = [("a", T0 + dt.timedelta(hours=i), None if i in (0, 5) else float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")
    got = [r.y for r in ts.ewm_scan(df, [ts.ema("y", "x", 3, seeded=False)], ts.Ordered()).orderBy("ts").collect()]
    want, y = [], None
    for _, _, x in rows:
        y = y if x is None else x if y is None else 0.5 * x + 0.5 * y
        want.append(y)
    assert [None if g is None else round(g, 12) for g in got] == [None if w is None else round(w, 12) for w in want]


def test_ledger_survives_products_that_vanish(spark):
    from marketloom.operators.ledger import build_positions

    fills, q = [("s", T0, "buy", 1000.0, 10.0, 0)], 1
    for i in range(60):
        fills.append(("s", T0 + dt.timedelta(minutes=q), "sell", 999.999, 11.0 + i, q))
        fills.append(("s", T0 + dt.timedelta(minutes=q + 1), "buy", 999.999, 9.0 + i, q + 1))
        q += 2
    df = spark.createDataFrame(fills, "symbol string, ts timestamp_ntz, side string, qty double, price double, trade_id int")
    got = build_positions(df, ["ts", "trade_id"], F.date_trunc("hour", "ts")).orderBy("trade_id").collect()
    state = (0.0, 0.0, 0.0)
    for r in got:
        state, made = ordered.position_step(state, 0, r.trade_id, r.side, r.qty, r.price)
        assert abs(r.realized - made[0][3]) <= 1e-6 * max(1, abs(made[0][3])) and abs(r.avg_price - made[0][2]) < 1e-4

