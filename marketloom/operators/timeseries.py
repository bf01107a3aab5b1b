"""Ordered-data building blocks: windows, recurrences, as-of and interval joins, islands, exact ranks.

Two kinds of ordered input are told apart throughout the package.

* *Bars* are one row per (symbol, bucket).  Whatever the tick volume of a symbol, its bar count is bounded by
  time span / frequency, so a window partitioned by symbol is safe even for a symbol holding a third of all ticks.
* *Ticks, fills, posts* are unbounded per key.  They never go through a window over the bare key: they are
  split by (key, time block), (key, row chunk) or (key, value cell), and a small table of per-block totals
  carries state between the pieces.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col, correlation

BIG = Window.unboundedPreceding


class Ordered:
    """Window vocabulary over one ordering: lags, trailing frames that stay NULL until full, running totals."""

    def __init__(self, keys="symbol", order="ts"):
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.order = [order] if isinstance(order, str) else list(order)

    @property
    def w(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def lag(self, c, n: int = 1) -> Column:
        return F.lag(col(c), n).over(self.w)

    def lead(self, c, n: int = 1) -> Column:
        return F.lead(col(c), n).over(self.w)

    def rows(self, lo: int, hi: int = 0):
        return self.w.rowsBetween(lo, hi)

    @property
    def running(self):
        return self.w.rowsBetween(BIG, 0)

    def roll(self, fn, c, n: int, full: bool = True) -> Column:
        c, frame = col(c), self.rows(1 - n)
        out = fn(c).over(frame)
        return F.when(F.count(c).over(frame) == n, out) if full else out

    def roll2(self, fn, a, b, n: int) -> Column:
        a, b, frame = col(a), col(b), self.rows(1 - n)
        both = a.isNotNull() & b.isNotNull()
        a, b = F.when(both, a), F.when(both, b)
        return F.when(F.count(a).over(frame) == n, fn(a, b).over(frame))

    def corr(self, a, b, n: int) -> Column:
        frame = self.rows(1 - n)
        return F.when(F.count(F.when(col(b).isNotNull(), col(a))).over(frame) == n, correlation(a, b, frame))

    def mean(self, c, n):
        return self.roll(F.avg, c, n)

    def std(self, c, n):
        return self.roll(F.stddev_samp, c, n)

    def pstd(self, c, n):
        return self.roll(F.stddev_pop, c, n)

    def max(self, c, n):
        return self.roll(F.max, c, n)

    def min(self, c, n):
        return self.roll(F.min, c, n)

    def sum(self, c, n):
        return self.roll(F.sum, c, n)

    def cum(self, c) -> Column:
        return F.sum(col(c)).over(self.running)

    def row(self) -> Column:
        return F.row_number().over(self.w).cast("long")


def latest(df: DataFrame, keys, order) -> DataFrame:
    """Newest row per key by aggregation, so a hot key is reduced map-side first."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    rank = F.struct(*[F.col(c) for c in order])
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r"))
    return packed.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


# --------------------------------------------------------------------------- constant-decay recurrences

class Ewm:
    """One recurrence y = decay*y_prev + gain*x, seeded at the n-th value by the mean (or sum) of the first n."""

    def __init__(self, out: str, x, decay: float, gain: float, seed: int = 1, seed_sum: bool = False):
        self.out, self.x, self.decay, self.gain, self.seed, self.seed_sum = out, x, decay, gain, seed, seed_sum


def ema(out, x, n, seeded=True) -> Ewm:
    a = 2.0 / (n + 1)
    return Ewm(out, x, 1 - a, a, n if seeded else 1)


def wilder(out, x, n) -> Ewm:
    return Ewm(out, x, (n - 1) / n, 1.0 / n, n)


def _chunk_rows(decay: float) -> int:
    # decay**rows < 1e-17 lets the carry stop at the previous chunk; decay**-rows must not overflow.
    for rows in (512, 8192, 131072):
        if -rows * math.log(decay) > 40:
            return rows
    raise ValueError(f"decay {decay} is too close to one")


def ewm_scan(df: DataFrame, terms: Sequence[Ewm], s: Ordered) -> DataFrame:
    """Exponential recurrences as prefix sums: within a row chunk y = d^pos * (sum(b*d^-pos) + carry).

    The carry is the previous chunk's end value; anything older has been multiplied by less than 1e-17.
    Everything happens in windows over one partitioning, so all terms together need no extra shuffle and no
    Python.  A null input is no step: the value is held (null until the seed).
    """
    row = df.withColumn("_row", s.row())
    for i, t in enumerate(terms):
        x = col(t.x).cast("double")
        row = row.withColumn(f"_x{i}", x)
    row = row.select(
        "*",
        *[F.count(f"_x{i}").over(s.running).alias(f"_k{i}") for i in range(len(terms))],
        *[(F.sum if t.seed_sum else F.avg)(f"_x{i}").over(s.running).alias(f"_m{i}") for i, t in enumerate(terms)],
    )
    groups: dict[tuple[int, str], list[int]] = {}
    for i, t in enumerate(terms):
        groups.setdefault((_chunk_rows(t.decay), str(t.x)), []).append(i)
    for (rows, _), members in groups.items():
        k = F.col(f"_k{members[0]}")  # one series: chunks and places count its values, not the rows
        real = F.col(f"_x{members[0]}").isNotNull()
        row = row.withColumn("_chunk", F.floor((k - 1) / rows)).withColumn("_pos", F.pmod(k - 1, F.lit(rows)) + 1)
        wc = Window.partitionBy(*s.keys, "_chunk").orderBy(*s.order).rowsBetween(BIG, 0)
        local = []
        for i in members:
            t = terms[i]
            b = F.when(~real | (k < t.seed), 0.0).when(k == t.seed, F.col(f"_m{i}")).otherwise(F.col(f"_x{i}") * t.gain)
            local.append(F.sum(b * F.pow(F.lit(t.decay), -F.col("_pos"))).over(wc).alias(f"_s{i}"))
        row = row.select("*", *local)
        carries = [
            F.last(
                F.when(real & (F.col("_pos") == rows), F.col(f"_s{i}") * (terms[i].decay ** rows)), ignorenulls=True
            ).over(s.rows(BIG, -1)).alias(f"_c{i}")
            for i in members
        ]
        row = row.select("*", *carries)
        for i in members:
            t = terms[i]
            y = F.pow(F.lit(t.decay), F.col("_pos")) * (F.col(f"_s{i}") + F.coalesce(f"_c{i}", F.lit(0.0)))
            row = row.withColumn(f"_y{i}", F.when(real & (k >= t.seed), y))
        row = row.select("*", *[F.last(f"_y{i}", ignorenulls=True).over(s.running).alias(terms[i].out) for i in members])
        row = row.drop("_chunk", "_pos")
    return row.drop(*[c for c in row.columns if c.startswith("_")])


# --------------------------------------------------------------------------- unbounded keys: index, chunks, halo

#: Rows of one key and block from which the block is cut into finer stretches of time.
BLOCK_ROWS = 250_000


def join_on(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join in which null keys equal each other; the right side's keys are dropped."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    names = {k: f"_right_{k}" for k in keys}
    cond = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]
    return left.join(right.withColumnsRenamed(names), reduce(lambda a, b: a & b, cond), how).drop(*names.values())


def micros(c) -> Column:
    """Microseconds since 1970 of a wall-clock time, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col(c).cast("timestamp_ntz"))


def sized_blocks(df: DataFrame, keys, ts: str, block: Column, out: str = "_b", limit: int = BLOCK_ROWS) -> DataFrame:
    """Adds the block as struct(block, part), monotone in ``ts``; a block with more than ``limit`` rows gets parts.

    Counts come from one map-side aggregation; only heavy blocks are joined back.  Parts are even in time, eight times
    as many as the count asks for, so that uneven stretches stay near the limit; rows of one instant stay together.
    The heavy blocks are broadcast: there are at most rows / ``limit`` of them.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    d = df.withColumn("_block", block).withColumn("_us", micros(ts))
    heavy = d.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_size"), F.min("_us").alias("_from"),
                                           F.max("_us").alias("_to")).filter(F.col("_size") > limit)
    parts = 8 * F.ceil(F.col("_size") / limit)
    heavy = heavy.select(*keys, "_block", "_from", F.greatest(F.lit(1), F.ceil((F.col("_to") - F.col("_from") + 1) / parts))
                         .alias("_width"))
    part = F.coalesce(F.floor((F.col("_us") - F.col("_from")) / F.col("_width")), F.lit(0)).cast("long")
    return join_on(d, F.broadcast(heavy), [*keys, "_block"], "left").withColumn(
        out, F.struct(F.col("_block").alias("block"), part.alias("part"))).drop("_block", "_us", "_from", "_width")


def index_rows(df: DataFrame, keys, order, block: Column, out: str = "_i",
               totals: dict[str, str] | None = None, size: str | None = None) -> DataFrame:
    """Exact 1-based row index per key without sorting a whole key in one task.

    ``block`` must be monotone in the leading order column, a timestamp (for instance the day); heavy blocks are cut
    further by their counts.  Rows are numbered inside (key, block) and shifted by the running block counts, a table of
    one row per key and block.  Null keys are a key, null times come first.  ``totals`` maps new columns to value
    columns and adds their running sums the same way.  ``size`` names a column for the rows of the key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    sums = {"_rows": F.lit(1), **{f"_t_{o}": F.col(v) for o, v in (totals or {}).items()}}
    # one struct is the key of windows and join (nulls in it are equal), so the rows are shuffled once
    d = sized_blocks(df, keys, order[0], block).withColumn("_g", F.struct(*keys, "_b")).drop("_b")
    blocks = d.groupBy("_g").agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    wk = Window.partitionBy(*[f"_g.{k}" for k in keys]).orderBy("_g._b").rowsBetween(BIG, -1)
    all_rows = [F.sum("_rows").over(Window.partitionBy(*[f"_g.{k}" for k in keys])).alias(size)] if size else []
    blocks = blocks.select("_g", *all_rows, *[F.coalesce(F.sum(n).over(wk), F.lit(0)).alias(n) for n in sums])
    wb = Window.partitionBy("_g").orderBy(*order).rowsBetween(BIG, 0)
    inner = d.withColumns({"_rn": F.row_number().over(Window.partitionBy("_g").orderBy(*order)),
                           **{o: F.sum(v).over(wb) for o, v in (totals or {}).items()}})
    j = inner.join(blocks, "_g").withColumn(out, F.col("_rn") + F.col("_rows"))
    j = j.withColumns({o: F.col(o) + F.col(f"_t_{o}") for o in (totals or {})}) if totals else j
    return j.drop("_rn", "_g", *sums)


def chunk_with_halo(df: DataFrame, halo: int, rows: int = 65536, index: str = "_i") -> DataFrame:
    """Give every row a chunk and copy the last ``halo`` rows of each chunk to the next one.

    Frames of at most ``halo`` preceding rows over (key, _chunk) then equal the frames over the bare key.
    Keep ``_own`` rows after the windows.
    """
    if rows < halo:
        raise ValueError("a chunk must hold at least one halo")
    pos = F.pmod(F.col(index) - 1, F.lit(rows))
    home = F.floor((F.col(index) - 1) / rows)
    both = F.when(pos >= rows - halo, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_home", home).withColumn("_chunk", F.explode(both)).withColumn(
        "_own", F.col("_chunk") == F.col("_home")
    ).drop("_home")


def affine_scan(df: DataFrame, keys, a, b, out: str, prev: str, index: str = "_i",
                rows: int = 128, levels: int = 1, size: str | None = None) -> DataFrame:
    """y = a*y_prev + b with per-row coefficients (a >= 0) over an unbounded key.

    Inside a chunk of ``rows`` rows the maps (a, b) are composed by doubling the reach (nothing is divided, so products
    may become as small as they like); each chunk leaves one (A, B) and the table of chunks is scanned the same way.  Only keys with more
    than one chunk reach the next level; what is left at the top, n / rows^(levels+1) per key (a billion rows leave about
    sixty thousand), is folded in a task.  The input is read once per level and side: cut its lineage first.
    Coefficients given as expressions are computed after the shuffle.  ``size`` names a column with the rows of the key:
    then keys of one chunk are shuffled once only.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    wc = Window.partitionBy("_kc").orderBy(index)

    def composed(d):
        # one struct is the key of windows and join: nulls in it are equal
        chunk = F.struct(*keys, F.floor((F.col(index) - 1) / rows).cast("long").alias("_ck"))
        d = d.withColumn("_kc", chunk).drop(*keys).repartition("_kc")
        d = d.withColumns({"_m": col(a).cast("double"), "_y": col(b).cast("double")})
        reach = 1
        while reach < rows:
            d = d.withColumns({"_m0": F.lag("_m", reach, 1.0).over(wc), "_y0": F.lag("_y", reach, 0.0).over(wc)})
            d = d.withColumns({"_y": F.col("_m") * F.col("_y0") + F.col("_y"), "_m": F.col("_m") * F.col("_m0")}).drop("_m0", "_y0")
            reach *= 2
        return d

    d = composed(df)
    ends = (composed(df.filter(F.col(size) > rows)) if size else d).groupBy("_kc").agg(F.max_by(F.struct("_m", "_y"), index).alias("_e"))
    ends = ends.select("_kc.*", "_e").select(*keys, "_ck", F.col("_e._m").alias("_A"), F.col("_e._y").alias("_B"), (F.col("_ck") + 1).alias("_ci"))
    home = f"_home{levels}"
    multi = ends.withColumn("_top", F.max("_ck").over(Window.partitionBy(*keys))).filter("_top > 0").drop("_top")
    multi = multi.withColumnRenamed("_ck", home)
    if levels > 0:
        scanned = affine_scan(multi, keys, "_A", "_B", "_end", "_end_prev", "_ci", rows, levels - 1)
    else:
        def replay(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_ci")
            y, ys = 0.0, []
            for ca, cb in zip(pdf["_A"], pdf["_B"]):
                y = ca * y + cb
                ys.append(y)
            return pdf[[*keys, home]].assign(_end=ys)

        spec = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
        scanned = multi.groupBy(*keys).applyInPandas(replay, f"{spec}, {home} long, _end double")
    carry = scanned.select(F.struct(*keys, (F.col(home) + 1).alias("_ck")).alias("_kc"), F.col("_end").alias("_carry"))
    d = d.join(carry, "_kc", "left").withColumn("_carry", F.coalesce("_carry", F.lit(0.0)))
    d = d.withColumn(out, F.col("_y") + F.col("_m") * F.col("_carry"))
    d = d.withColumn(prev, F.coalesce(F.lag(out).over(wc), F.col("_carry")))
    return d.withColumns({k: F.col("_kc")[k] for k in keys}).drop("_kc", "_y", "_m", "_carry")


# --------------------------------------------------------------------------- joins on time

def asof_join(left: DataFrame, right: DataFrame, keys, cols: Sequence[str], left_ts: str = "ts",
              right_ts: str = "ts", right_tie: Sequence[str] = (), block: str = "day",
              strict: bool = False) -> DataFrame:
    """Latest right row at or before each left row, per key.  Linear: union, then last value in order.

    The ordered window runs per (key, block), heavy blocks being cut further by the counts of both sides; the last right
    row of every earlier block enters through a carry table of one row per key and block, so no key is ever sorted
    whole.  Every left row stays; a null key or time matches nothing.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    payload = F.struct(F.col(right_ts).alias("_rts"), *[F.col(c) for c in cols])
    rank = F.struct(F.col(right_ts), *[F.col(c) for c in right_tie])
    r = right.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, right_ts)])).select(
        *keys, F.col(right_ts).alias("_t"), payload.alias("_p"), rank.alias("_o"))
    lcols = [c for c in left.columns if c not in keys]
    lft = left.select(*keys, F.col(left_ts).alias("_t"), F.struct(*lcols).alias("_l"))
    both = sized_blocks(r.unionByName(lft, allowMissingColumns=True), keys, "_t", F.date_trunc(block, "_t"))
    r = both.filter("_l IS NULL").drop("_l")
    lft = both.filter("_l IS NOT NULL").drop("_p", "_o")

    ends = r.groupBy(*keys, "_b").agg(F.max_by("_p", "_o").alias("_p"))
    needs = lft.select(*keys, "_b").distinct().withColumn("_p", F.lit(None).cast(ends.schema["_p"].dataType))
    wk = Window.partitionBy(*keys).orderBy("_b", "_side").rowsBetween(BIG, -1)
    carry = (
        ends.withColumn("_side", F.lit(1)).unionByName(needs.withColumn("_side", F.lit(0)))
        .withColumn("_c", F.last("_p", ignorenulls=True).over(wk))
        .filter("_side = 0 AND _c IS NOT NULL")
        .select(*keys, "_b", F.lit(None).cast(r.schema["_t"].dataType).alias("_t"), F.col("_c").alias("_p"))
    )
    side = 2 if not strict else 0
    none_l = F.lit(None).cast(lft.schema["_l"].dataType)
    none_p = F.lit(None).cast(ends.schema["_p"].dataType)
    none_o = F.lit(None).cast(r.schema["_o"].dataType)
    stacked = (
        carry.select(*keys, "_b", "_t", "_p", none_o.alias("_o"), none_l.alias("_l"), F.lit(-1).alias("_side"))
        .unionByName(r.select(*keys, "_b", "_t", "_p", "_o", none_l.alias("_l"), F.lit(1).alias("_side")))
        .unionByName(lft.select(*keys, "_b", "_t", none_p.alias("_p"), none_o.alias("_o"), "_l",
                                F.lit(side).alias("_side")))
    )
    wb = Window.partitionBy(*keys, "_b").orderBy("_t", "_side", "_o").rowsBetween(BIG, 0)
    hit = stacked.withColumn("_m", F.last("_p", ignorenulls=True).over(wb)).filter(F.col("_l").isNotNull())
    return hit.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in lcols], F.col("_m._rts").alias("asof_ts"),
                      *[F.col(f"_m.{c}").alias(c) for c in cols])


def interval_join(points: DataFrame, spans: DataFrame, keys, point_ts: str, start: str, end: str,
                  bin_seconds: int, how: str = "inner") -> DataFrame:
    """Points inside [start, end] of spans with the same key, through equi-join on time bins.

    A span is repeated once per bin it touches and a point sits in one bin, so each match appears once and
    no nested-loop join is planned.  Choose ``bin_seconds`` near the usual span length.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    def bin_of(c):
        return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (bin_seconds * 1_000_000)).cast("long")
    p = points.withColumn("_bin", bin_of(point_ts))
    s = spans.withColumn("_bin", F.explode(F.sequence(bin_of(start), bin_of(end))))
    hit = s.join(p, [*keys, "_bin"]).filter(F.col(point_ts).between(F.col(start), F.col(end)))
    return hit.drop("_bin")


def range_totals(points: DataFrame, spans: DataFrame, keys, point_ts: str, tie: str, start: str, end: str, value: str,
                 block: str = "hour") -> DataFrame:
    """Spans with the count ``n`` and the sum ``total`` of their points, without a row per pair.

    Points and the two bounds of every span are numbered in one order (start, points, end at one instant); a span has
    what the running count and sum gain between its bounds.  Linear in points and spans however many points a span
    covers.  A span with a null key or bound has no points.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    none = F.lit(None)
    rows = points.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])).select(
        *keys, F.col(point_ts).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("string").alias("_tie"), F.lit(1).alias("_one"),
        F.col(value).cast("double").alias("_v"))
    span = F.struct(*spans.columns)
    bounds = [spans.select(*keys, F.col(c).alias("_t"), F.lit(side).alias("_side"), none.cast("string").alias("_tie"),
                           F.lit(0).alias("_one"), F.lit(0.0).alias("_v"), span.alias("_span")) for c, side in ((start, -1), (end, 1))]
    both = rows.unionByName(bounds[0].unionByName(bounds[1]), allowMissingColumns=True)
    run = index_rows(both, keys, ["_t", "_side", "_tie"], F.date_trunc(block, "_t"), totals={"_n": "_one", "_sum": "_v"}).filter(
        "_side <> 0")
    gain = run.groupBy("_span").agg(F.sum(F.col("_side") * F.col("_n")).alias("n"), F.sum(F.col("_side") * F.col("_sum")).alias("total"),
                                    (F.count(F.lit(1)) / 2).cast("long").alias("copies"))
    known = F.col(f"_span.{start}").isNotNull() & F.col(f"_span.{end}").isNotNull()
    n = F.when(known, (F.col("n") / F.col("copies")).cast("long")).otherwise(0)
    one = gain.select("_span.*", n.alias("n"), F.when(known, F.col("total") / F.col("copies")).alias("total"),
                      F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"))
    return one.drop("_copy")


# --------------------------------------------------------------------------- islands, grids

def islands(df: DataFrame, flag: Column, s: Ordered, out: str = "island") -> DataFrame:
    """Number maximal runs of true flags; rows outside a run get NULL."""
    f = F.coalesce(flag, F.lit(False))
    d = df.withColumn("_f", f)
    starts = F.when(F.col("_f") & ~F.coalesce(s.lag("_f"), F.lit(False)), 1).otherwise(0)
    d = d.withColumn("_st", starts)
    return d.withColumn(out, F.when(F.col("_f"), F.sum("_st").over(s.running))).drop("_f", "_st")


def time_grid(df: DataFrame, keys, ts: str, freq: str) -> DataFrame:
    """Regular grid of timestamps between the first and the last row of each key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    span = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    return span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(f"interval {freq}"))).alias(ts))


# --------------------------------------------------------------------------- exact order statistics

def value_cell(c, resolution: int) -> Column:
    """Fixed monotone cell of a double: about 1/resolution wide near zero, relative width beyond one."""
    c = col(c).cast("double")
    return F.floor(F.signum(c) * F.log1p(F.abs(c)) * resolution).cast("long")


def _cells(df: DataFrame, keys, value, sums: dict[str, Column], resolution: int):
    merged = df.filter(col(value).isNotNull() & ~F.isnan(col(value).cast("double"))).groupBy(*keys, col(value).cast("double").alias("_v")).agg(
        *[F.sum(e).alias(n) for n, e in sums.items()])
    merged = merged.withColumn("_cell", value_cell("_v", resolution))
    totals = merged.groupBy(*keys, "_cell").agg(*[F.sum(n).alias(n) for n in sums])
    return merged, totals


def ordered_running(df: DataFrame, keys, value: str, sums: dict[str, Column], resolution: int = 4096,
                    descending: bool = False) -> DataFrame:
    """Running sums in value order, one row per distinct value: columns ``cum_<n>`` and ``all_<n>``.

    Equal values are merged first, cells of the value axis are summed, and only the cell table (bounded by the
    range of doubles times the resolution) is scanned per key.  Rows are ordered inside one cell only.  Null and NaN
    values are left out; a null key is a group.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    d, made = (df, False) if keys else (df.withColumn("_all", F.lit(0)), True)
    k = keys or ["_all"]
    merged, totals = _cells(d, k, value, sums, resolution)
    order = F.col("_cell").desc() if descending else F.col("_cell").asc()
    wk = Window.partitionBy(*k)
    wo = wk.orderBy(order).rowsBetween(BIG, -1)
    offs = totals.select(*k, "_cell", *[F.coalesce(F.sum(n).over(wo), F.lit(0)).alias(f"_o_{n}") for n in sums],
                         *[F.sum(n).over(wk).alias(f"all_{n}") for n in sums])
    inner = Window.partitionBy(*k, "_cell").orderBy(F.col("_v").desc() if descending else F.col("_v").asc())
    run = join_on(merged, offs, [*k, "_cell"]).select(
        *k, F.col("_v").alias(value), *sums,
        *[(F.sum(n).over(inner.rowsBetween(BIG, 0)) + F.col(f"_o_{n}")).alias(f"cum_{n}") for n in sums],
        *[f"all_{n}" for n in sums])
    return run.drop("_all") if made else run


def exact_percentiles(df: DataFrame, keys, value: str, probs: dict[str, float], resolution: int = 4096) -> DataFrame:
    """Linear-interpolation percentiles per key for groups of any size (see ``ordered_running``)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    run = ordered_running(df, keys, value, {"n": F.lit(1)}, resolution)
    picks, outs = [], []
    for name, p in probs.items():
        r = F.lit(p) * (F.col("all_n") - 1)
        for side, at in (("lo", F.floor(r)), ("hi", F.ceil(r))):
            inside = (at >= F.col("cum_n") - F.col("n")) & (at < F.col("cum_n"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{name}_{side}"))
        picks.append(F.max(r - F.floor(r)).alias(f"_{name}_f"))
        lo, hi, f = (F.col(f"_{name}_{s}") for s in ("lo", "hi", "f"))
        outs.append((lo + (hi - lo) * f).alias(name))
    if keys:
        return run.groupBy(*keys).agg(*picks).select(*keys, *outs)
    return run.agg(*picks).select(*outs)
