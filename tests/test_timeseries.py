"""Helpers against brute force on small fixtures, with chunk sizes that force every carry path."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import timeseries as ts

T0 = dt.datetime(2024, 1, 1)


def frame(spark, rows, cols):
    return spark.createDataFrame(rows, cols)


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(3)
    rows = [(k, T0 + dt.timedelta(minutes=17 * i + (5 if k == "B" else 0)), i, 100 + rng.gauss(0, 3))
            for k, n in (("A", 700), ("B", 60), ("C", 1)) for i in range(n)]
    return rows, frame(spark, rows, "symbol string, ts timestamp_ntz, seq long, x double")


def test_ewm_scan_equals_recursion(walk, spark, monkeypatch):
    rows, df = walk
    monkeypatch.setattr(ts, "_chunk_rows", lambda decay: 64)  # several chunks; decay**64 is small for these spans
    terms = [ts.ema("e5", "x", 5), ts.wilder("w3", "x", 3), ts.ema("f4", "x", 4, seeded=False)]
    got = {(r.symbol, r.seq): r for r in ts.ewm_scan(df, terms, ts.Ordered("symbol", "ts")).collect()}
    for k in "ABC":
        xs = [x for s, _, _, x in rows if s == k]
        for name, n, a, seed in (("e5", 5, 2 / 6, 5), ("w3", 3, 1 / 3, 3), ("f4", 4, 2 / 5, 1)):
            y = None
            for i, x in enumerate(xs):
                if i + 1 == seed:
                    y = sum(xs[:seed]) / seed
                elif i + 1 > seed:
                    y = (1 - a) * y + a * x
                v = got[(k, i)][name]
                assert (v is None) == (y is None)
                if y is not None:
                    assert v == pytest.approx(y, rel=1e-9)


def test_chunk_rows_bounds():
    assert ts._chunk_rows(1 / 3) == 512 and ts._chunk_rows(199 / 201) == 8192
    with pytest.raises(ValueError):
        ts._chunk_rows(1 - 1e-9)


def test_index_rows_and_totals(walk):
    rows, df = walk
    out = ts.index_rows(df, "symbol", ["ts", "seq"], F.date_trunc("hour", "ts"), totals={"run": "x"}).collect()
    for r in out:
        assert r._i == r.seq + 1
        assert r.run == pytest.approx(sum(x for s, _, i, x in rows if s == r.symbol and i <= r.seq))


@pytest.mark.parametrize("rows", [16, 50])
def test_halo_windows_equal_plain_windows(walk, rows):
    _, df = walk
    d = ts.index_rows(df, "symbol", ["ts", "seq"], F.date_trunc("day", "ts"))
    d = ts.chunk_with_halo(d, 10, rows)
    s = ts.Ordered(["symbol", "_chunk"], "_i")
    a = {(r.symbol, r.seq): r.m for r in d.withColumn("m", s.mean("x", 10)).filter("_own").collect()}
    b = {(r.symbol, r.seq): r.m for r in df.withColumn("m", ts.Ordered().mean("x", 10)).collect()}
    assert a.keys() == b.keys()
    assert all((a[k] is None and b[k] is None) or a[k] == pytest.approx(b[k]) for k in a)


@pytest.mark.parametrize("levels", [0, 1])
def test_affine_scan(spark, levels):
    rng = random.Random(5)
    rows = [(k, i + 1, rng.choice([1.0, 1.0, 0.9, 0.5, 0.0]), rng.gauss(0, 1)) for k, n in (("A", 300), ("B", 3)) for i in range(n)]
    df = frame(spark, rows, "k string, _i long, a double, b double")
    got = {(r.k, r._i): r for r in ts.affine_scan(df, "k", "a", "b", "y", "p", rows=8, levels=levels).collect()}
    for k in "AB":
        y = 0.0
        for _, i, a, b in [r for r in rows if r[0] == k]:
            assert got[(k, i)].p == pytest.approx(y, abs=1e-9)
            y = a * y + b
            assert got[(k, i)].y == pytest.approx(y, abs=1e-9)


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_against_pandas(spark, strict):
    rng = random.Random(7)
    def times(n):
        return sorted(T0 + dt.timedelta(minutes=rng.randrange(0, 6000)) for _ in range(n))
    left = [(k, t, i) for k in "AB" for i, t in enumerate(times(80))]
    right = [(k, t, i, float(i)) for k in "AC" for i, t in enumerate(times(40))]
    a = frame(spark, left, "k string, ts timestamp_ntz, id long")
    b = frame(spark, right, "k string, ts timestamp_ntz, tie long, v double")
    got = {(r.k, r.id): r.v for r in ts.asof_join(a, b, "k", ["v"], right_tie=["tie"], block="hour", strict=strict).collect()}
    assert len(got) == len(left)
    for k, t, i in left:
        hits = [r for r in right if r[0] == k and (r[1] < t if strict else r[1] <= t)]
        want = max(hits, key=lambda r: (r[1], r[2]))[3] if hits else None
        assert got[(k, i)] == want


def test_interval_join(spark):
    spans = [(1, "A", T0, T0 + dt.timedelta(hours=5)), (2, "A", T0 + dt.timedelta(hours=4), T0 + dt.timedelta(hours=4))]
    pts = [("A", T0 + dt.timedelta(hours=h)) for h in range(7)] + [("B", T0)]
    s = frame(spark, spans, "id int, k string, lo timestamp_ntz, hi timestamp_ntz")
    p = frame(spark, pts, "k string, t timestamp_ntz")
    got = sorted((r.id, r.t.hour) for r in ts.interval_join(p, s, "k", "t", "lo", "hi", 3600).collect())
    assert got == [(1, h) for h in range(6)] + [(2, 4)]


@pytest.mark.parametrize("resolution", [1, 4096])
def test_exact_percentiles(spark, resolution):
    rng = np.random.default_rng(1)
    data = {"A": np.r_[rng.normal(0, 5, 501), np.full(300, 1.0)], "B": np.array([3.0]), "C": rng.integers(-3, 4, 100).astype(float)}
    df = frame(spark, [(k, float(v)) for k, xs in data.items() for v in xs] + [("D", None)], "k string, x double")
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in ts.exact_percentiles(df, "k", "x", probs, resolution).collect()}
    assert set(got) == {"A", "B", "C"}
    for k, xs in data.items():
        for n, p in probs.items():
            assert got[k][n] == pytest.approx(np.percentile(xs, p * 100), abs=1e-12)
    whole = ts.exact_percentiles(df, [], "x", {"m": 0.5}).first().m
    assert whole == pytest.approx(np.median(np.concatenate(list(data.values()))))


def test_islands(spark):
    flags = [True, True, False, None, True, False, True]
    df = frame(spark, [("A", T0 + dt.timedelta(hours=i), f) for i, f in enumerate(flags)], "symbol string, ts timestamp_ntz, f boolean")
    out = [r.island for r in ts.islands(df, F.col("f"), ts.Ordered()).orderBy("ts").collect()]
    assert out == [1, 1, None, None, 2, None, 3]


def test_repartition_does_not_change_results(walk):
    _, df = walk
    a = ts.index_rows(df.repartition(7), "symbol", ["ts", "seq"], F.date_trunc("hour", "ts")).select("symbol", "seq", "_i")
    assert a.filter("_i <> seq + 1").count() == 0
