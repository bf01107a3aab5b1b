"""Pointer chains, finite machines and tiled matrices against plain loops."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import machines, risk, scans

T0 = dt.datetime(2024, 1, 1)
R = random.Random(8)


def test_cooldown_of_one_key_with_very_many_alerts(spark):
    n, minutes = 200_000, 15
    df = spark.range(n).select(F.lit("hot").alias("key"), F.col("id").alias("m"), (
        F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") * 37).cast("decimal(18,6)"))).alias("ts"))
    want, last = [], None
    for i in range(n):
        if last is None or 37 * (i - last) >= 60 * minutes:
            want.append(i)
            last = i
    assert sorted(r.m for r in machines.alert_cooldown(df, ["key"], minutes).select("m").collect()) == want


def test_cooldown_with_null_keys_ties_and_nothing(spark):
    rows = [(k, T0 + dt.timedelta(minutes=m), i) for i, (k, m) in enumerate([("a", 0), ("a", 0), (None, 3), (None, 5), ("a", 20), (None, 40), ("b", 1)])]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, m int")
    assert sorted(r.m for r in machines.alert_cooldown(df, ["key"], 15, ["m"]).collect()) == [0, 2, 4, 5, 6]
    assert machines.alert_cooldown(df.limit(0), ["key"]).count() == 0


def test_risk_off_against_a_loop(spark):
    rows = [(p, T0 + dt.timedelta(hours=3 * i), -R.choice([0.0, 0.004, 0.009, 0.02]), R.choice([0.0, 0.0, -0.01])) for p in (1, 2, None) for i in range(150)]
    df = spark.createDataFrame(rows, "portfolio_id int, ts timestamp_ntz, drawdown double, velocity double")
    want, since = {}, {}
    for p, ts, dd, v in rows:
        event = None
        if since.get(p) is None:
            if abs(dd) >= 0.015 or v < -0.005:
                since[p], event = ts, "enter"
        elif ts - since[p] >= dt.timedelta(hours=24) and abs(dd) <= 0.0075:
            since[p], event = None, "exit"
        want[p, ts] = (since.get(p) is not None, event)
    got = {(r.portfolio_id, r.ts): (r.risk_off, r.event) for r in machines.risk_off_state(df).collect()}
    assert got == want


def persistence(rows, min_bars=5, floor=0.7, damping=0.8):
    now, bars, out = None, 0, []
    for new, conf in rows:
        young = now is not None and new != now and bars < min_bars and conf * (1 - damping) < floor
        kept = now if young else new if conf >= floor else "normal"
        bars = bars + 1 if kept == now else 1
        now = kept
        out.append(kept)
    return out


@pytest.mark.parametrize("chunk", [3, 64])
def test_persistence_over_chunks_and_levels(spark, monkeypatch, chunk):
    monkeypatch.setattr(scans, "CHUNK", chunk)
    series = {s: [(R.choice(machines.REGIMES[:6]), R.random()) for _ in range(n)] for s, n in (("A", 90), ("B", 1), ("C", 29), (None, 10))}
    rows = [(s, T0 + dt.timedelta(hours=i), *x) for s, xs in series.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, regime string, confidence double").repartition(4)
    got = {(r.symbol, r.ts): r.regime_kept for r in machines.regime_persistence(df).collect()}
    assert got == {(s, T0 + dt.timedelta(hours=i)): k for s, xs in series.items() for i, k in enumerate(persistence(xs))}


def returns(spark, symbols=11, steps=140):
    rows = [(f"s{k:02d}", T0 + dt.timedelta(hours=i), R.gauss(0, 1) + (i % 5) * (k % 3)) for k in range(symbols) for i in range(steps) if R.random() < 0.8]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double"), pd.DataFrame(rows, columns=["symbol", "ts", "ret"])


def test_tiles_agree_with_whole_matrices(spark, monkeypatch):
    monkeypatch.setattr(risk, "GROUP", 3)
    df, pdf = returns(spark)
    wide = pdf.pivot(index="ts", columns="symbol", values="ret").sort_index()
    for windows, frames in (((), {None: wide}), ((10, 60), {10: wide.tail(10), 60: wide.tail(60)})):
        got = {(r.a, r.b, r["window"] if windows else None): r for r in risk.pair_moments(df, "day", windows).collect()}
        for w, frame in frames.items():
            cov, n = frame.cov(min_periods=2), frame.notna().astype(int).T @ frame.notna().astype(int)
            for i, a in enumerate(frame.columns):
                for b in frame.columns[i:]:
                    r = got.pop((a, b, w), None)
                    assert (r is None) == (n.loc[a, b] < 2)
                    if r is not None:
                        assert r.n == n.loc[a, b] and r["cov"] == pytest.approx(cov.loc[a, b], abs=1e-9)
                        assert r["corr"] == pytest.approx(frame[a].corr(frame[b]), abs=1e-9)
        assert not got
    held = spark.createDataFrame([("s01",), ("s07",)], "symbol string")
    assert {(r.a, r.b) for r in risk.pair_moments(df, held=held).collect()} == {("s01", "s01"), ("s01", "s07"), ("s07", "s07")}


def test_rolling_correlation_agrees_with_pairs(spark, monkeypatch):
    monkeypatch.setattr(risk, "GROUP", 4)
    df, pdf = returns(spark, 7, 90)
    wide = pdf.pivot(index="ts", columns="symbol", values="ret").sort_index()
    rolled = [wide[a].rolling(20, min_periods=2).corr(wide[b]).abs() for i, a in enumerate(wide) for b in wide.columns[i + 1:]]
    want = pd.concat(rolled, axis=1).replace([np.inf, -np.inf], np.nan).mean(axis=1).iloc[19:]
    got = risk.correlation_regime(df, window=20, chunk=25).orderBy("ts").collect()
    assert [r.ts for r in got] == list(want.index) and [r.avg_corr for r in got] == pytest.approx(list(want), abs=1e-9)
