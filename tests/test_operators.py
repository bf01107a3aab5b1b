"""Hand fixtures with known answers, metamorphic checks and the shared state machines."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import cleaning, evaluate, ledger, machines, mentions, news, quality, risk, technical
from marketloom.operators import sentiment as sent
from marketloom.sources import bars as bar_source
from marketloom.sources import store
from marketloom.streaming import ordered

T0 = dt.datetime(2024, 1, 1)
BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, closes, symbol="A"):
    rows = [(symbol, T0 + dt.timedelta(hours=i), c - 0.5, c + 1.0, c - 1.0, float(c), 10.0 + i % 3) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


def test_unknown_timeframe(spark):
    with pytest.raises(ValueError):
        bar_source.ohlcv_bars(spark.createDataFrame([], "symbol string, ts timestamp_ntz, event_id long, price double, qty double"), "7m")


def test_constant_prices_have_no_z_score(spark):
    b = bars(spark, [100.0] * 60)
    d = technical.bollinger(technical.price_z(b)).filter("z_10 IS NOT NULL")
    assert d.count() == 0
    r = technical.rsi(b).orderBy(F.desc("ts")).first()
    assert r.rsi_14 is None  # no gain and no loss


def test_no_look_ahead(spark):
    rng = random.Random(2)
    closes = [100 + rng.gauss(0, 2) for _ in range(150)]
    full, part = bars(spark, closes), bars(spark, closes[:100])
    groups = (technical.sma, technical.cci, technical.candle_patterns, technical.adx, technical.macd, technical.peaks_sr)
    a = technical.with_technical(full, groups=groups).filter(F.col("ts") < T0 + dt.timedelta(hours=100))
    b = technical.with_technical(part, groups=groups)
    left = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in a.orderBy("ts").collect()]
    right = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in b.orderBy("ts").collect()]
    assert left == right


def test_other_symbols_do_not_matter(spark):
    one, two = bars(spark, [100 + i % 7 for i in range(80)]), bars(spark, [50 + i % 5 for i in range(80)], "B")
    a = technical.rsi(one).orderBy("ts").collect()
    b = technical.rsi(one.unionByName(two)).filter("symbol = 'A'").orderBy("ts").collect()
    assert a == b


def test_peaks_by_brute_force(spark):
    rng = random.Random(9)
    highs = [100 + rng.gauss(0, 5) for _ in range(90)]
    rows = [("A", T0 + dt.timedelta(hours=i), h - 1, h, h - 2 - (i % 4), h - 1, 1.0) for i, h in enumerate(highs)]
    got = technical.peaks_sr(spark.createDataFrame(rows, BAR)).orderBy("ts").collect()
    for i in range(90):
        w = highs[max(0, i - 49):i + 1]
        peaks = [j for j in range(1, len(w) - 1) if w[j] > w[j - 1] and w[j] > w[j + 1]]
        kept = []
        for j in sorted(peaks, key=lambda j: (w[j], j), reverse=True):
            if all(abs(j - k) >= 5 for k in kept):
                kept.append(j)
        want = (w[max(kept)] - (highs[i] - 1)) / (highs[i] - 1) if kept and len(w) >= 20 else None
        v = got[i].resistance_dist
        assert (v is None) == (want is None) and (want is None or v == pytest.approx(want))


# ------------------------------------------------------------------ quality and cleaning

def test_ohlc_rules_fire_once(spark):
    ok = ("A", T0, 10.0, 11.0, 9.0, 10.5, 5.0)
    bad = [("A", T0, 10.0, 9.5, 9.0, 10.5, 5.0), ("A", T0, 10.0, 11.0, 10.8, 10.5, 5.0), ("A", T0, None, 11.0, 9.0, 10.5, 5.0),
           ("A", T0, -1.0, 11.0, -2.0, 10.5, 5.0)]
    got = {(r.rule, r.field): r.n_bad for r in quality.check_ohlc(spark.createDataFrame([ok, *bad], BAR)).collect()}
    assert got[("high_below_body_or_low", "high")] == 1 and got[("low_above_body", "low")] == 1
    assert got[("null_price", "open")] == 1 and got[("non_positive_price", "open")] == 1 and got[("non_positive_price", "low")] == 1


@pytest.mark.parametrize("zeros,fires", [(9, False), (10, False), (11, True)])
def test_zero_volume_share(spark, zeros, fires):
    rows = [("A", T0, 1.0, 1.0, 1.0, 1.0, 0.0 if i < zeros else 1.0) for i in range(100)]
    rules = {r.rule for r in quality.check_volume(spark.createDataFrame(rows, BAR)).collect()}
    assert ("zero_volume_share" in rules) == fires


def test_gap_of_25_hours(spark):
    rows = [("A", T0, 1.0, 1.0, 1.0, 1.0, 1.0), ("A", T0 + dt.timedelta(hours=25), 1.0, 1.0, 1.0, 1.0, 1.0)]
    assert [r.rule for r in quality.check_timestamps(spark.createDataFrame(rows, BAR)).collect()] == ["time_gap"]


@pytest.mark.parametrize("run,filled", [(5, True), (6, False)])
def test_interpolation_run_limit(spark, run, filled):
    xs = [1.0] + [None] * run + [float(run + 2)]
    df = spark.createDataFrame([("A", T0 + dt.timedelta(hours=i), x) for i, x in enumerate(xs)], "symbol string, ts timestamp_ntz, x double")
    got = [r.x for r in cleaning.impute(df, ["x"], "interpolate", max_run=5).orderBy("ts").collect()]
    assert got == ([float(i + 1) for i in range(run + 2)] if filled else xs)


def test_empty_and_single_row(spark):
    empty = spark.createDataFrame([], BAR)
    assert technical.with_technical(empty, groups=(technical.sma, technical.rsi)).count() == 0
    assert quality.market_issues(empty).count() == 0
    one = technical.with_technical(bars(spark, [5.0]), groups=(technical.returns, technical.rsi)).collect()
    assert len(one) == 1 and one[0].ret_1 is None and one[0].rsi_14 is None


# ------------------------------------------------------------------ text

def test_amounts_and_dates(spark):
    rows = [("$1,001 - $15,000", "2023-12-25", 8000.5, "2023-12-25"), ("1.5M", "12/25/2023", 1.5e6, "2023-12-25"), ("$20K", "12/25/23", 2e4, "2023-12-25"),
            ("2B", "Dec 25, 2023", 2e9, "2023-12-25"), ("500", "December 25, 2023", 500.0, "2023-12-25"), ("n/a", "25 Dec 2023", 0.0, "2023-12-25"),
            (None, "25 December 2023", 0.0, "2023-12-25"), ("1", "3 days ago", 1.0, "2023-12-29"), ("1", "2 weeks ago", 1.0, "2023-12-18"),
            ("1", "1 month ago", 1.0, "2023-12-02"), ("1", "soon", 1.0, None), ("1", "1/2/85", 1.0, "1985-01-02")]
    df = spark.createDataFrame([(i, a, d) for i, (a, d, _, _) in enumerate(rows)], "i int, a string, d string")
    got = df.select("i", news.parse_amount("a").alias("v"), news.parse_date("d", "2024-01-01").alias("t")).orderBy("i").collect()
    for r, (_, _, v, t) in zip(got, rows):
        assert r.v == pytest.approx(v) and (str(r.t) if r.t else None) == t


def test_symbols_emoji_options(spark):
    text = "$GME to the moon 🚀🚀💎, AMC: yolo calls! (TSLA) THE puts put \U0001F4C9 🌙"
    df = spark.createDataFrame([(1, text, "My DD", 10, 5)], "id int, text string, title string, score long, comments long")
    conf = {r.symbol: r.confidence for r in mentions.extract_symbols_scored(df).collect()}
    assert set(conf) == {"GME", "AMC", "TSLA"} and conf["GME"] == pytest.approx(1.0) and conf["TSLA"] < conf["GME"]
    e = mentions.emoji_signals(df).first()
    assert (e.bullish, e.bearish, e.rockets, e.diamonds) == (3 * 2 + 2 + 2, 2, 2, 1)
    o = mentions.option_signals(df).first()
    assert (o.calls, o.puts, o.yolo) == (1, 2, 1)
    assert mentions.is_dd(df).first().is_dd
    m = mentions.momentum_score(df).first().momentum
    assert m == pytest.approx(2.5 * max(np.log1p(15) / 3, 0.5))


def test_model_hook_sees_whole_texts(spark):
    from marketloom.catalog.text import length_scorer
    df = spark.createDataFrame([(1, "x" * 5001), (2, None)], "id int, text string")
    r = {x.id: x for x in mentions.model_sentiment(df, length_scorer).collect()}
    assert r[1].label == "positive" and r[1].sentiment == pytest.approx(1.0) and r[2].label == "negative"


def test_fusion_prefers_agreement(spark):
    def case(sym, scores):
        return [(sym, s, v, 0.8, 100.0, 50.0, T0) for s, v in zip(("reddit", "news", "twitter"), scores)]
    df = spark.createDataFrame(case("SAME", (0.7, 0.75, 0.8)) + case("MIX", (0.9, -0.8, 0.1)) + [("ONE", "news", 0.9, 0.05, 1.0, 1.0, T0)],
                               "symbol string, source string, score double, confidence double, mentions double, engagement double, ts timestamp_ntz")
    out = {r.symbol: r for r in sent.fuse_sentiment(df, "2024-01-01 01:00:00").collect()}
    assert "ONE" not in out and out["SAME"].agreement > out["MIX"].agreement and out["SAME"].confidence > out["MIX"].confidence
    assert out["SAME"].signal.endswith("BUY") and out["MIX"].signal == "HOLD"
    assert all(-1 <= r.calibrated <= 1 and 0 <= r.confidence <= 1 for r in out.values())


# ------------------------------------------------------------------ ledger and machines

FILLS = [("buy", 10, 100.0), ("buy", 10, 110.0), ("sell", 5, 120.0), ("sell", 15, 100.0), ("buy", 4, 50.0), ("sell", 10, 60.0), ("buy", 6, 55.0)]


def test_ledger_open_add_reduce_close_flip(spark):
    rows = [(i, "A", T0 + dt.timedelta(minutes=i), p, float(q), s) for i, (s, q, p) in enumerate(FILLS)]
    df = spark.createDataFrame(rows, "trade_id long, symbol string, ts timestamp_ntz, price double, qty double, side string")
    out = ledger.build_positions(df, ["ts", "trade_id"], F.date_trunc("hour", "ts")).orderBy("trade_id").collect()
    assert [r.event for r in out] == ["open", "increase", "reduce", "close", "open", "flip", "close"]
    assert [r.position for r in out] == [10, 20, 15, 0, 4, -6, 0]
    assert [round(r.avg_price, 9) for r in out] == [100, 105, 105, 0, 50, 60, 0]
    assert [round(r.realized, 9) for r in out] == [0, 0, 75, -75, 0, 40, 30]
    state = (0.0, 0.0, 0.0)
    for r, (s, q, p) in zip(out, FILLS):
        state, made = ordered.position_step(state, 0, r.trade_id, s, float(q), p)
        assert made[0][1:] == pytest.approx((r.position, r.avg_price, r.realized))


def test_fills_of_quantity_zero_change_nothing(spark):
    fills = [("buy", 0, 90.0), ("buy", 10, 100.0), ("sell", 0, 130.0), ("buy", 10, 110.0), ("sell", 20, 120.0), ("sell", 0, 50.0), ("sell", 5, 80.0)]
    rows = [(i, "A", T0 + dt.timedelta(minutes=i), p, float(q), s) for i, (s, q, p) in enumerate(fills)]
    df = spark.createDataFrame(rows, "trade_id long, symbol string, ts timestamp_ntz, price double, qty double, side string")
    out = ledger.build_positions(df, ["ts", "trade_id"], F.date_trunc("hour", "ts")).orderBy("trade_id").collect()
    assert [r.event for r in out] == ["none", "open", "none", "increase", "close", "none", "open"]
    assert [(r.position, r.avg_price, r.realized) for r in out] == [(0, 0, 0), (10, 100, 0), (10, 100, 0), (20, 105, 0), (0, 0, 300), (0, 0, 0), (-5, 80, 0)]
    state = (0.0, 0.0, 0.0)
    for r, (s, q, p) in zip(out, fills):
        state, made = ordered.position_step(state, 0, r.trade_id, s, float(q), p)
        assert made[0][1:] == pytest.approx((r.position, r.avg_price, r.realized))


def test_ledger_hot_symbol_over_chunks(spark):
    rng = random.Random(4)
    rows = [(i, "A", T0 + dt.timedelta(seconds=i * 7), 100 + rng.gauss(0, 5), float(rng.randint(1, 9)), rng.choice(["buy", "sell"])) for i in range(900)]
    df = spark.createDataFrame(rows, "trade_id long, symbol string, ts timestamp_ntz, price double, qty double, side string")
    out = ledger.build_positions(df, ["ts", "trade_id"], F.date_trunc("minute", "ts")).orderBy("trade_id").collect()
    state = (0.0, 0.0, 0.0)
    for r, x in zip(out, rows):
        state, made = ordered.position_step(state, 0, x[0], x[5], x[4], x[3])
        assert (r.position, r.avg_price, r.realized) == pytest.approx(made[0][1:], rel=1e-9, abs=1e-7)


def test_cooldown_relative_to_last_emitted(spark):
    minutes = [0, 14, 16, 29, 31, 60]
    df = spark.createDataFrame([("k", T0 + dt.timedelta(minutes=m), m) for m in minutes], "key string, ts timestamp_ntz, m int")
    assert sorted(r.m for r in machines.alert_cooldown(df, ["key"], 15).collect()) == [0, 16, 31, 60]


def test_drawdown_periods_with_open_tail(spark):
    rets = [0.1, -0.05, 0.2, -0.1, -0.1]
    df = spark.createDataFrame([(1, T0 + dt.timedelta(hours=i), r) for i, r in enumerate(rets)], "portfolio_id int, ts timestamp_ntz, ret double")
    p = risk.drawdown_periods(risk.drawdown_series(df)).orderBy("start_ts").collect()
    assert [(r.bars, r.ongoing) for r in p] == [(1, False), (2, True)]
    assert p[1].depth == pytest.approx(0.9 * 0.9 - 1)


def test_pair_moments_pairwise_complete(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = [("ABCD"[j], T0 + dt.timedelta(days=i), float(x[i, j])) for i in range(400) for j in range(4) if not np.isnan(x[i, j])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double")
    import pandas as pd
    want = pd.DataFrame(x, columns=list("ABCD"))
    for r in risk.pair_moments(df).collect():
        assert r.corr == pytest.approx(want.corr().loc[r.a, r.b], abs=1e-9)
        assert r.cov == pytest.approx(want.cov().loc[r.a, r.b], abs=1e-9)


def test_bootstrap_is_independent_of_partitioning(spark):
    df = spark.range(3000).select("id", (F.col("id") % 17).cast("double").alias("x"))
    a = evaluate.bootstrap_ci(df.repartition(3), "x", "id", "mean", 200).first()
    b = evaluate.bootstrap_ci(df.coalesce(1), "x", "id", "mean", 200).first()
    assert a == pytest.approx(b)
    assert a.low < 8.0 < a.high and a.boot_std == pytest.approx(np.arange(3000).__mod__(17).std() / np.sqrt(3000), rel=0.2)


def test_upsert_partitions_touches_only_its_days(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("A", "d1", 1, 1.0), ("A", "d2", 1, 1.0), ("B", "d2", 1, 1.0)]
    spec = "symbol string, day string, version int, v double"
    spark.createDataFrame(rows, spec).write.partitionBy("day").parquet(path)
    store.upsert_partitions(path, spark.createDataFrame([("a", "d2", 2, 9.0), ("C", "d2", 1, 3.0)], spec), ["symbol", "day"], ["version"], "day")
    got = sorted((r.day, r.symbol, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("d1", "A", 1.0), ("d2", "A", 9.0), ("d2", "B", 1.0), ("d2", "C", 3.0)]
