"""State machines that windows cannot express, on the scans of ``scans``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scans import chain, finite_scan, next_index, stream_machine
from .timeseries import Ordered, index_rows, join_on


# ------------------------------------------------------------------ risk-off

def risk_off_state(dd: DataFrame, enter: float = 0.015, fast: float = -0.005, hold_hours: float = 24.0, recover: float = 0.5) -> DataFrame:
    """Enter on a deep or fast drawdown; leave after the minimum time once the drawdown is back under half the limit.

    An entry points to the first calm row from ``hold_hours`` on (its exit) and that to the first alarming row behind it (the
    next entry); the entries that really happen are the chain from the first alarming row.
    """
    key = ["portfolio_id"]
    d = cut_lineage(dd.select("portfolio_id", "ts", "drawdown", "velocity"))  # read by every step below
    depth = F.abs("drawdown")
    alarms, calm = (cut_lineage(index_rows(d.filter(rows).select(*key, "ts"), key, "ts", F.date_trunc("month", "ts"))) for rows in (
        (depth >= enter) | (F.col("velocity") < fast), depth <= enter * recover))
    until = alarms.withColumn("_until", F.col("ts") + F.make_dt_interval(secs=F.lit(hold_hours * 3600).cast("decimal(18,6)")))
    exits = next_index(until, calm, key, "_until", out="_calm")
    exits = join_on(exits, calm.select(*key, F.col("_i").alias("_calm"), F.col("ts").alias("exit_ts")), [*key, "_calm"], "left")
    # an entry without an exit points behind the last alarm: its chain ends there
    away = F.coalesce("exit_ts", F.lit("9999-01-01").cast(d.schema["ts"].dataType))
    linked = cut_lineage(next_index(exits.withColumn("_away", away), alarms, key, "_away", strict=True))
    on = join_on(linked.select(*key, "_i", "ts", "exit_ts"), chain(linked, key), [*key, "_i"], "left_semi")
    events = on.select(*key, "ts", F.lit("enter").alias("event")).unionByName(
        on.filter("exit_ts IS NOT NULL").select(*key, F.col("exit_ts").alias("ts"), F.lit("exit").alias("event")))
    s = Ordered("portfolio_id")
    told = join_on(d, events, [*key, "ts"], "left")
    return told.withColumn("risk_off", F.coalesce(F.last("event", ignorenulls=True).over(s.running) == "enter", F.lit(False)))


# ------------------------------------------------------------------ alert cooldown

def alert_cooldown(alerts: DataFrame, keys: Sequence[str], minutes: float = 15, tie: Sequence[str] = ()) -> DataFrame:
    """Suppress repeats by key relative to the last emitted alert; exact timestamps are compared.

    Alerts of one key and instant are first reduced map-side to the first by ``tie``.  Each instant points to the first one
    at least the cooldown later; what is emitted is the chain from the first.
    """
    keys = list(keys)
    rest = [c for c in alerts.columns if c not in (*keys, "ts")]
    d = alerts.groupBy(*keys, "ts").agg(F.min_by(F.struct(*rest), F.struct("ts", *tie)).alias("_r"))
    at = cut_lineage(index_rows(d, keys, "ts", F.date_trunc("day", "ts")))
    wait = F.make_dt_interval(secs=F.lit(minutes * 60).cast("decimal(18,6)"))
    on = chain(next_index(at.select(*keys, "ts", "_i").withColumn("_until", F.col("ts") + wait), at, keys, "_until"), keys)
    return join_on(at, on, [*keys, "_i"], "left_semi").select(*keys, "ts", *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*alerts.columns)


# ------------------------------------------------------------------ regime persistence

REGIMES = ("normal", "bull_trending", "bear_trending", "high_volatility", "low_volatility", "crisis", "recovery", "volatile", "bull",
           "bear", "neutral", "high_vol", "low_vol")


def regime_persistence(df: DataFrame, min_bars: int = 5, floor: float = 0.7, damping: float = 0.8,
                       regimes: Sequence[str] = REGIMES) -> DataFrame:
    """A young regime resists change; low confidence means normal.

    States: none (0) or (regime, bars in force up to ``min_bars``), so the machine is finite and is scanned by maps.
    """
    names = list(regimes)
    code = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("regime")).cast("int") - 1
    normal = names.index("normal")
    d = index_rows(df.select("symbol", "ts", "regime", "confidence").withColumn("_new", code), "symbol", "ts", F.date_trunc("month", "ts"))

    def step(state: Column, row: Column) -> Column:
        now, bars = F.floor((state - 1) / min_bars).cast("int"), F.pmod(state - 1, F.lit(min_bars)) + 1
        sure = F.coalesce(row["confidence"] >= floor, F.lit(False))
        young = F.coalesce((state > 0) & (row["_new"] != now) & (bars < min_bars) & (row["confidence"] * (1 - damping) < floor), F.lit(False))
        kept = F.when(young, now).when(sure, row["_new"]).otherwise(F.lit(normal))
        length = F.when((state > 0) & (kept == now), F.least(bars + 1, F.lit(min_bars))).otherwise(F.lit(1))
        return (kept * min_bars + length).cast("int")

    out = finite_scan(d, ["symbol"], step, len(names) * min_bars + 1)
    kept = F.get(F.array(*[F.lit(n) for n in names]), F.floor((F.col("_state") - 1) / min_bars).cast("int"))
    return out.withColumn("regime_kept", kept).select("symbol", "ts", "regime", "confidence", "regime_kept")


# ------------------------------------------------------------------ rule trades

def rule_step(state, close, dip, enter, target, stop):
    """state: (cash, shares, entry price).  Enter on a dip, leave on target or stop; 95 % of cash, one position."""
    cash, held, entry = state
    if held == 0:
        if dip is not None and dip == dip and dip <= -enter:
            n = int(cash * 0.95 / close)
            if n > 0:
                return (cash - n * close, n, close), ("buy", n, cash - n * close)
    else:
        gain = close / entry - 1
        if gain >= target or gain <= -stop:
            return (cash + held * close, 0, 0.0), ("sell", held, cash + held * close)
    return state, (None, held, cash)


def rule_trades(bars: DataFrame, params: DataFrame, capital: float = 10000.0) -> DataFrame:
    """Every symbol x parameter set at once; ``params`` (param_id, enter, target, stop) is the sweep to run."""
    s = Ordered()
    d = bars.select("symbol", "ts", "close", (F.col("close") / F.max("close").over(s.rows(-19)) - 1).alias("dip"))
    sweep = params.agg(F.collect_list(F.struct("param_id", "enter", "target", "stop")).alias("p")).scalar()
    d = d.select("*", F.inline(sweep))
    out = stream_machine(d, ["symbol", "param_id"], ["ts"], rule_step, lambda: (capital, 0, 0.0),
                         ["close", "dip", "enter", "target", "stop"], {"action": "string", "shares": "long", "cash": "double"})
    return out.filter("action IS NOT NULL")
