"""Stateful streams: state that is given up, merged epochs, alert callbacks and late rows."""

import datetime as dt

import pytest

from marketloom.session import list_path, scratch_path
from marketloom.streaming import jobs, ordered

T0 = dt.datetime(2024, 1, 1)


def feed(spark, batches, schema, per_trigger=1):
    path = scratch_path(spark, "feed")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return jobs.file_stream(spark, path, "*.parquet", per_trigger=per_trigger)


def test_state_is_given_up_behind_the_watermark(spark):
    """Rows out of order within the delay are folded in order; afterwards neither waiting rows nor idle keys are held."""
    minute = dt.timedelta(minutes=1)
    alerts = [("k", T0 + m * minute, m) for m in (3, 0, 20, 17, 14, 40, 31)] + [("other", T0, 99)]
    late = [("k", T0 + 1000 * minute, 1000)], [("end", T0 + dt.timedelta(days=9), 7)]
    stream = feed(spark, [alerts[:4], alerts[4:], *late], "symbol string, ts timestamp_ntz, event_id long")
    out, rows = jobs.stream_alerts(stream, ["symbol"], 15, delay="1 hour"), []
    q = jobs.drain(out, lambda batch, epoch: rows.extend((r.symbol, r.event_id) for r in batch.collect()), "alerts-state")
    assert sorted(rows) == [("k", 0), ("k", 17), ("k", 40), ("k", 1000), ("other", 99)]
    last = q.recentProgress[-1]["stateOperators"][0]
    assert last["numRowsTotal"] <= 4  # the closing row, its timers; every other key is gone


def test_long_and_short_stops_mirror_each_other():
    for is_long, prices, stop in ((True, (100.0, 103.0, 102.4), 103 * 0.995), (False, (100.0, 97.0, 97.6), 97 * 1.005)):
        state, out = (0.0, 0.0, 0.0), []
        for i, p in enumerate(prices):
            state, made = ordered.stop_step(state, i, i, p, is_long)
            out += made
        assert out == [(2, 100.0, pytest.approx(stop), prices[-1], pytest.approx(0.024))]
        state, out = (0.0, 0.0, 0.0), []
        for i, p in enumerate((100.0, 100.0 - 4 if is_long else 104.0, 94.9 if is_long else 105.1)):  # never gained: 5 % away
            state, made = ordered.stop_step(state, i, i, p, is_long)
            out += made
        assert [r[0] for r in out] == [2] and state[0] == (94.9 if is_long else 105.1)


def test_epochs_are_merged_and_reads_stay_small(spark):
    path, keys, order = scratch_path(spark, "ups"), ["k"], ["v"]
    write = jobs.upsert_sink(path, keys, order, merge_every=3)
    for epoch in range(8):
        write(spark.createDataFrame([("a", epoch), (f"only{epoch}", epoch)], "k string, v long"), epoch)
    write(spark.createDataFrame([("a", 7), ("only7", 7)], "k string, v long"), 7)  # a retried epoch
    got = {r.k: r.v for r in jobs.read_upserts(spark, path, keys, order).collect()}
    assert got == {"a": 7, **{f"only{e}": e for e in range(8)}}
    assert len(list_path(spark, path)) <= 4


def test_alert_handlers_do_not_keep_each_other_from_their_alerts(spark):
    seen = []

    def broken(batch, epoch):
        raise ValueError("no sink")

    write = jobs.alert_channel({"x": broken, "y": lambda b, e: seen.append(b.count()), "*": lambda b, e: seen.append(b.count())})
    with pytest.raises(ValueError):
        write(spark.createDataFrame([("x",), ("y",), ("y",)], "kind string"), 0)
    assert seen == [2, 3]


def test_nearby_counts_without_pairs():
    state, made = ([], [], [], []), []
    for us, left, i in ((0, False, 1), (60, True, 2), (170, False, 3), (400, True, 4)):
        state, new = ordered.nearby_step(state, us * 1_000_000, left, i)
        made += new
    state, new = ordered.nearby_flush(state, 10**12)
    assert made + new == [(2, 2, 1), (4, 0, None)] and state == ([], [], [], [])
