"""Edges found by the review of round 4: each failed before its query was mended."""

import pytest

from marketloom.functions.numeric import rounded
from tests.test_findings_r03 import parity, put


def events(folder, rows):
    """One event a row (user, seconds after midnight, value, k)."""
    put(folder, "events", " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS event_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds({s}::BIGINT) AS ts, {u}::BIGINT AS user_id, 'view' AS event_type, "
        f"{v}::DOUBLE AS value, '{{\"k\": {k}}}' AS props" for i, (u, s, v, k) in enumerate(rows)))


def test_rounding_is_that_of_sql(spark):
    import duckdb
    values = [108.16499999999999, -108.16499999999999, 0.0640625, 1.005, 2.5, -2.5, 0.49999999999999994, 4503599627370497.5, 1.7e308, float("inf"), float("nan"), None]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for places in (2, 4, 6):
        got = [r[0] for r in d.orderBy("i").select(rounded("v", places)).collect()]
        want = [r[0] for r in duckdb.connect().execute(f"SELECT round(v, {places}) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()]
        assert list(map(str, got)) == list(map(str, want))


def test_clipped_features_round_like_their_sql(spark, tmp_path):
    events(tmp_path, [(1, i, v, k) for i, (v, k) in enumerate([(408.25, 51), (408.25, 53), (420.75, 53), (433.25, 57), (458.25, 98), (7.5, 9), (7.5, 10)])])
    got, want = parity(spark, tmp_path, "clean_feature_outliers_clip")
    assert got == want and len(got) == 84


def test_events_without_a_finite_feature_have_no_rows(spark, tmp_path):
    events(tmp_path, [(1, 0, 5.0, 10), (1, 1, "NULL", "null"), (1, 2, "'nan'", "null"), (1, 3, "NULL", 3), (1, 4, 5.0, "null")])
    got, want = parity(spark, tmp_path, "clean_feature_outliers_clip")
    assert got == want and {r[0] for r in got} == {0, 3, 4}


@pytest.mark.parametrize("name", ["quality_feature_outliers", "clean_feature_outliers_clip", "quality_features"])
def test_remainders_keep_the_sign_of_their_dividend(spark, tmp_path, name):
    events(tmp_path, [(1, k + 40, 5.0, k) for k in range(-40, 1)])
    got, want = parity(spark, tmp_path, name)
    assert got == want and got


@pytest.mark.parametrize("name", ["tech_returns", "tech_momentum_roc"])
def test_ratios_on_half_a_unit_round_like_their_sql(spark, tmp_path, name):
    """Prices of 102.4 and the like make ratios that end on half a unit of the sixth place."""
    values = {0: 29.12, 5: 68.41, 6: 120.0, 11: 30.48, 2: 120.0, 12: 19.44}
    events(tmp_path, [(1, 3600 * h, values.get(h, 50 + h), 7) for h in range(24)])
    got, want = parity(spark, tmp_path, name)
    assert got == want and len(got) == 24


def test_range_positions_are_scaled_before_they_are_divided(spark, tmp_path):
    values = [147.53, 4.17, *range(20, 31), 55.41]
    events(tmp_path, [(1, 3600 * h, v, 7) for h, v in enumerate(values)])
    got, want = parity(spark, tmp_path, "tech_williams_r")
    assert got == want and -64.257813 in {r[-1] for r in got}


def test_channel_index_sums_from_the_newest_bar(spark):
    import datetime as dt
    from fractions import Fraction
    from marketloom.operators.technical import cci
    prices = [100 + (i * 7919 % 1000) / 500 for i in range(20)]
    d = spark.createDataFrame([("A", dt.datetime(2024, 1, 1, i), p, p, p) for i, p in enumerate(prices)], "symbol string, ts timestamp_ntz, high double, low double, close double")
    tp = [(p + p + p) / 3 for p in prices]
    mean = avg = mad = 0.0
    for old, new in zip(tp, reversed(tp)):
        avg, mean = avg + old, mean + new
    for x in reversed(tp):
        mad += abs(x - avg / 20)
    got = [r.cci for r in cci(d).orderBy("ts").collect()]
    assert got[:19] == [None] * 19 and got[19] == (tp[19] - mean / 20) / (0.015 * (mad / 20))
    exact = [Fraction(x) for x in tp]
    mu = sum(exact) / 20
    assert got[19] == pytest.approx(float((exact[19] - mu) / (Fraction(15, 1000) * sum(abs(x - mu) for x in exact) / 20)), rel=1e-9)
