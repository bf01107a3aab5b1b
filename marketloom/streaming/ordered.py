"""Keyed folds in event order on ``transformWithState``.

Rows wait in map state under (key, block of event time), one entry per block, so adding a row touches its block alone.  A
timer at the end of each block fires once the watermark has passed it: rows behind the watermark have been dropped by then,
so the block is complete and is folded in order and removed.  With an idle time a key without rows for that long gives up
its fold as well.  The state lives in RocksDB, outside the heap; it holds the rows of the delay and one fold per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedFold(StatefulProcessor):
    """``step(state, *row) -> (state, [rows])`` over the rows of a key, sorted by their first columns (event time first)."""

    def __init__(self, keys: Sequence[str], cols: Sequence[str], kinds: Sequence[str], step: Callable, state: str, first: tuple,
                 out: Sequence[str], block_ms: int, idle_ms: int | None, flush: Callable | None, again_ms: int):
        self.keys, self.cols, self.step, self.state, self.first, self.out = list(keys), list(cols), step, state, first, list(out)
        self.block_ms, self.idle_ms, self.flush, self.again_ms = block_ms, idle_ms, flush, again_ms
        self.row = ", ".join(f"{c}: {k}" for c, k in zip(cols, kinds))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", self.state + ", _last long")
        self.waiting = handle.getMapState("waiting", "block long", f"rows array<struct<{self.row}>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list[tuple]] = {}
        for pdf in rows:
            columns = [pdf[c].tolist() for c in self.cols]
            for row in zip(*columns):
                fresh.setdefault(row[0] // 1000 // self.block_ms, []).append(row)
        for block, more in fresh.items():
            if self.waiting.containsKey((block,)):
                more = [tuple(r) for r in self.waiting.getValue((block,))[0]] + more
            else:
                self.handle.registerTimer((block + 1) * self.block_ms)
            self.waiting.updateValue((block,), (more,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        *state, last = self.fold.get() if self.fold.exists() else (*self.first, None)
        block, made, again = due // self.block_ms - 1, [], []
        ready = due % self.block_ms == 0 and self.waiting.containsKey((block,))
        if ready:  # timers fire in the order of their times, so blocks are folded in order
            for row in sorted(tuple(r) for r in self.waiting.getValue((block,))[0]):
                state, new = self.step(tuple(state), *row)
                made += [(*key, *r) for r in new]
                last = row[0]
            self.waiting.removeKey((block,))
        if self.flush and last is not None:  # everything up to the end of this block has been folded
            state, new = self.flush(tuple(state), due // self.block_ms * self.block_ms * 1000)
            made += [(*key, *r) for r in new]
            if ready:
                when = ((last // 1000 + self.again_ms) // self.block_ms + 1) * self.block_ms
                if when > timerValues.getCurrentWatermarkInMs():
                    again.append(when)
                elif not any(self.waiting.containsKey((b,)) for b in range(block + 1, when // self.block_ms)):
                    # a timer set for a time already passed would wait for a batch that may never come
                    state, new = self.flush(tuple(state), when * 1000)
                    made += [(*key, *r) for r in new]
        if ready or self.flush:
            self.fold.update((*state, last))
        if self.idle_ms is not None and last is not None:
            if ready:
                again.append((last // 1000 + self.idle_ms) // self.block_ms * self.block_ms + self.block_ms + 1)
            elif last // 1000 + self.idle_ms < due:
                self.fold.clear()
        for when in again:
            self.handle.registerTimer(when)
        if made:
            yield pd.DataFrame(made, columns=[*self.keys, *self.out])

    def close(self) -> None:
        pass


def fold_in_order(df: DataFrame, keys: Sequence[str], cols: Sequence[str], step: Callable, state: str, first: tuple,
                  out: dict[str, str], delay: str = "10 minutes", block_seconds: int = 3600, idle_seconds: float | None = None,
                  flush: Callable | None = None, again_seconds: int = 0) -> DataFrame:
    """Fold a stream with event time ``ts``; ``step`` gets the event time in microseconds and then ``cols``.

    ``flush(state, us) -> (state, [rows])`` is called when everything before ``us`` has been folded, for steps whose answers
    wait for time to pass; a timer ``again_seconds`` after a key's last row calls it when the key gets no more rows.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    us = df.withWatermark("ts", delay).withColumn("at_us", F.unix_micros("ts"))
    spec = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{n}` {t}" for n, t in out.items()])
    names = ["at_us", *cols]
    return us.groupBy(*keys).transformWithStateInPandas(
        OrderedFold(keys, names, ["bigint", *(kinds[c] for c in cols)], step, state, first, list(out), block_seconds * 1000,
                    None if idle_seconds is None else int(idle_seconds * 1000), flush, again_seconds * 1000), spec, "append", "EventTime")


# ------------------------------------------------------------------ steps

def position_step(state, us, trade_id, side, qty, price):
    """(quantity, average, realised) after one fill; a flip closes the position and opens at the fill price, a fill of
    quantity zero changes nothing."""
    q, avg, total = state
    dq = qty if side == "buy" else -qty
    new, gain = q + dq, 0.0
    if dq == 0:
        return state, [(trade_id, q, avg, 0.0)]
    if q * dq >= 0:
        avg = (q * avg + dq * price) / new
    else:
        gain = (price - avg) * min(abs(dq), abs(q)) * (1 if q > 0 else -1)
        if abs(new) < 1e-8:
            new, avg = 0.0, 0.0
        elif abs(dq) > abs(q):
            avg = price
    return (new, avg, total + gain), [(trade_id, new, avg, gain)]


def stop_step(state, us, event_id, price, is_long, initial=0.05, trigger=0.02, step=0.005):
    """(entry, extreme, stop): a position with a trailing stop, re-entered at the price that stopped it.

    The stop starts ``initial`` away from the entry; once the price has gained ``trigger`` it follows the best price at
    ``step`` and never moves back.  A short position is the mirror image.
    """
    entry, best, stop = state
    sign = 1.0 if is_long else -1.0
    if entry == 0.0:
        return (price, price, price * (1 - sign * initial)), []
    if sign * price <= sign * stop:
        return (price, price, price * (1 - sign * initial)), [(event_id, entry, stop, price, sign * (price / entry - 1))]
    best = max(best, price) if is_long else min(best, price)
    if sign * (price - entry) / entry >= trigger:
        moved = best * (1 - sign * step)
        stop = max(stop, moved) if is_long else min(stop, moved)
    return (entry, best, stop), []


def cooldown_step(state, us, row_id, minutes=15.0):
    """Emit unless the previous *emitted* alert of the key is younger than the cooldown; state: its time or -1."""
    if state[0] < 0 or us - state[0] >= minutes * 60_000_000:
        return (us,), [(row_id, us)]
    return state, []


def nearby_flush(state, us, width_us=120_000_000):
    """Left rows with the count of right rows within ``width_us`` and the nearest of them; one row per left row.

    State: times and ids of right rows that may still matter, left rows whose interval is still open.  A left row is
    answered by two binary searches once the order has passed the end of its interval.
    """
    from bisect import bisect_left, bisect_right

    times, ids, lefts, left_ids = (list(x) for x in state)
    made = []
    for t, i in zip(lefts, left_ids):
        if t + width_us >= us:
            break
        a, b = bisect_left(times, t - width_us), bisect_right(times, t + width_us)
        near = min(((abs(x - t), x, k) for x, k in zip(times[a:b], ids[a:b])), default=None)
        made.append((i, b - a, near and near[2]))
    lefts, left_ids = lefts[len(made):], left_ids[len(made):]
    old = bisect_left(times, (lefts[0] if lefts else us) - width_us)
    return (times[old:], ids[old:], lefts, left_ids), made


def nearby_step(state, us, is_left, event_id, width_us=120_000_000):
    (times, ids, lefts, left_ids), made = nearby_flush(state, us, width_us)
    if is_left:
        return (times, ids, [*lefts, us], [*left_ids, event_id]), made
    return ([*times, us], [*ids, event_id], lefts, left_ids), made
