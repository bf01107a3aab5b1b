"""Portfolio risk for many portfolios at once: returns, VaR, drawdowns, limits, correlation, sizing, stops.

Series are one row per (portfolio, bar), bounded by the time span, so per-portfolio windows are safe.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, col, div, normal_hash
from ..session import cut_lineage
from .components import connected_components
from .timeseries import BIG, Ordered, islands

YEAR = 252
# Quantile and density of the standard normal at the VaR levels.
NORMAL = {0.01: (-2.3263478740408408, 0.02665214220345808), 0.05: (-1.6448536269514729, 0.10313564037537128),
          0.1: (-1.2815515655446004, 0.17549833193248680)}
LIMITS = {"var_limit": 0.02, "position_limit": 0.10, "leverage_limit": 1.0, "drawdown_limit": 0.20}
P = Ordered("portfolio_id", "ts")


def portfolio_returns(positions: DataFrame, returns: DataFrame) -> DataFrame:
    """Sum of normalised weight x return per (portfolio, ts); a symbol without a return counts as zero."""
    total = F.sum(F.abs("weight")).over(Window.partitionBy("portfolio_id"))
    w = positions.select("portfolio_id", "symbol", (col("weight") / F.nullif(total, F.lit(0.0))).alias("w"))
    return w.join(returns.select("symbol", "ts", "ret"), "symbol").groupBy("portfolio_id", "ts").agg(
        F.sum(col("w") * F.coalesce("ret", F.lit(0.0))).alias("ret"))


def recent(df: DataFrame, n: int, key="portfolio_id", ts="ts") -> DataFrame:
    """Newest n rows per key; the rank filter is pushed below the shuffle."""
    w = Window.partitionBy(key).orderBy(col(ts).desc())
    return df.withColumn("_r", F.row_number().over(w)).filter(col("_r") <= n).drop("_r")


# ------------------------------------------------------------------ value at risk

def var_historical(pr: DataFrame, levels: Sequence[float] = (0.01, 0.05, 0.1), lookback: int = YEAR,
                   min_obs: int = 30) -> DataFrame:
    """Percentile of the newest ``lookback`` returns (a fixed bound per group), expected shortfall, extremes."""
    d = recent(pr, lookback)
    q = d.groupBy("portfolio_id").agg(F.percentile("ret", F.array(*[F.lit(x) for x in levels])).alias("_q"),
                                      F.count("ret").alias("n"), F.min("ret").alias("worst"), F.max("ret").alias("best"))
    q = q.filter(col("n") >= min_obs).select("*", F.posexplode("_q").alias("_i", "var")).drop("_q")
    q = q.withColumn("level", F.get(F.array(*[F.lit(x) for x in levels]), col("_i"))).drop("_i")
    tail = d.select("portfolio_id", "ret").join(q.select("portfolio_id", "level", "var"), "portfolio_id").filter(
        col("ret") <= col("var")).groupBy("portfolio_id", "level").agg(F.avg("ret").alias("cvar"))
    return q.join(tail, ["portfolio_id", "level"], "left")


def var_parametric(pr: DataFrame, lookback: int = YEAR, compat: bool = False) -> DataFrame:
    d = recent(pr, lookback).groupBy("portfolio_id").agg(F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd"))
    table = F.array(*[F.struct(F.lit(a).alias("level"), F.lit(z).alias("z"), F.lit(f).alias("f"))
                      for a, (z, f) in NORMAL.items()])
    d = d.select("*", F.inline(table))
    tail = col("sd") * col("f") / col("level")
    return d.select("portfolio_id", "level", (col("mu") + col("z") * col("sd")).alias("var"),
                    (col("mu") + tail if compat else col("mu") - tail).alias("cvar"))


def var_monte_carlo(pr: DataFrame, draws: int = 10_000, seed: int = 42, lookback: int = YEAR) -> DataFrame:
    """Normal draws per portfolio generated on the executors from (seed, portfolio, draw); the draw count bounds each group."""
    d = recent(pr, lookback).groupBy("portfolio_id").agg(F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd"))
    sims = d.select("portfolio_id", "mu", "sd", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("i"))
    sims = sims.withColumn("r", col("mu") + col("sd") * normal_hash(seed, "portfolio_id", "i"))
    qs = list(NORMAL)
    q = sims.groupBy("portfolio_id").agg(F.percentile("r", F.array(*[F.lit(x) for x in qs])).alias("_q"))
    return q.select("portfolio_id", F.posexplode("_q").alias("_i", "var")).withColumn(
        "level", F.get(F.array(*[F.lit(x) for x in qs]), col("_i"))).drop("_i")


# ------------------------------------------------------------------ pair moments

#: Symbols of a group; a tile holds two groups.
GROUP = 64


def packed_groups(rows: DataFrame, at: str, block: str, classed: bool = False) -> DataFrame:
    """(_g, block, symbols, at, cls, values): the series of a group of symbols in a stretch of time as one matrix.

    Groups come from a hash of the symbol, as many as keep about ``GROUP`` symbols in each; ``rows`` holds symbol, ret and the
    columns named (``at`` a whole number), with ``cls`` where ``classed``.
    """
    groups = max(1, -(-rows.agg(F.approx_count_distinct("symbol")).first()[0] // GROUP))
    cls = col("cls") if classed else F.lit(0)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=at, columns="symbol", values="ret", aggfunc="last", dropna=False).sort_index().sort_index(axis=1)
        kind = pdf.groupby(at)["cls"].first().loc[wide.index]
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], block: [pdf[block].iloc[0]], "symbols": [wide.columns.tolist()],
                             at: [wide.index.tolist()], "cls": [kind.tolist()], "values": [wide.to_numpy(float).tobytes()]})

    d = rows.select(F.pmod(F.xxhash64("symbol"), F.lit(groups)).cast("int").alias("_g"), block, col("symbol").cast("string").alias("symbol"),
                    at, cls.cast("int").alias("cls"), "ret")
    kind = rows.schema[block].dataType.simpleString()
    packed = d.groupBy("_g", block).applyInPandas(pack, f"_g int, {block} {kind}, symbols array<string>, {at} array<bigint>, "
                                                        "cls array<int>, values binary")
    tiles = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda h: F.struct(
        F.least(col("_g"), h).alias("i"), F.greatest(col("_g"), h).alias("j")))
    return packed.withColumn("tile", F.explode(tiles))


def tile_sides(pdf: pd.DataFrame, at: str):
    """(symbols, symbols, places, classes, matrix, matrix, whether both sides are one group) of the one or two groups of a tile."""
    def unpack(row):
        return list(row["symbols"]), np.array(row[at]), np.array(row["cls"]), np.frombuffer(row["values"]).reshape(
            len(row[at]), len(row["symbols"]))

    sides = [unpack(row) for _, row in pdf.sort_values("_g").iterrows()]
    (sa, ta, ca, xa), (sb, tb, cb, xb) = sides[0], sides[-1]
    both, ia, ib = np.intersect1d(ta, tb, return_indices=True)
    return sa, sb, both, ca[ia], xa[ia], xb[ib], len(sides) == 1


MOMENTS = ("n", "sa", "sb", "saa", "sbb", "sab")


def pair_sums(returns: DataFrame, block: str = "month", windows: Sequence[int] = ()) -> DataFrame:
    """Pairwise-complete sums for every symbol pair a <= b, and trailing window where ``windows`` counts newest timestamps.

    A tiled Gram matrix: groups of symbols are packed to matrices per time block, each tile (two groups, one block) is
    multiplied in its task, partial sums are added up.  All windows come from one pass: each timestamp belongs to the
    shortest window that holds it, and longer windows add up the shorter ones.
    """
    d = returns.select("symbol", "ts", "ret").filter("ret IS NOT NULL").withColumn("_b", F.date_trunc(block, "ts"))
    windows = sorted(windows)
    if windows:
        newest = returns.select("ts").distinct().orderBy(col("ts").desc()).limit(windows[-1])
        edges = newest.agg(F.sort_array(F.collect_list("ts"), False).alias("_t"))  # at most the longest window, a constant
        d = d.join(F.broadcast(edges))  # one row
        cls = F.lit(len(windows))
        for k in range(len(windows) - 1, -1, -1):
            cls = F.when(col("ts") >= F.get("_t", F.least(F.lit(windows[k]), F.size("_t")) - 1), k).otherwise(cls)
        d = d.withColumn("cls", cls).filter(col("cls") < len(windows)).drop("_t")
    d = d.withColumn("_at", F.unix_micros(col("ts").cast("timestamp")))
    tiles = packed_groups(d, "_at", "_b", bool(windows))

    def gram(pdf: pd.DataFrame) -> pd.DataFrame:
        sa, sb, _, cls, xa, xb, same = tile_sides(pdf, "_at")
        pick = np.triu_indices(len(sa)) if same else tuple(x.ravel() for x in np.indices((len(sa), len(sb))))
        a, b = np.array(sa, object)[pick[0]], np.array(sb, object)[pick[1]]
        swap = a > b
        out = []
        for k in np.unique(cls):
            x, y = xa[cls == k], xb[cls == k]
            p, q = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
            x, y = np.nan_to_num(x), np.nan_to_num(y)
            m = {"n": p.T @ q, "sa": x.T @ q, "sb": p.T @ y, "saa": (x * x).T @ q, "sbb": p.T @ (y * y), "sab": x.T @ y}
            v = {n: z[pick] for n, z in m.items()}
            for u, w in (("sa", "sb"), ("saa", "sbb")):
                v[u], v[w] = np.where(swap, v[w], v[u]), np.where(swap, v[u], v[w])
            got = pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "cls": int(k), **v})
            out.append(got[got["n"] > 0])
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "cls": [], **{n: [] for n in MOMENTS}})

    spec = "a string, b string, cls int, " + ", ".join(f"{n} double" for n in MOMENTS)
    m = tiles.groupBy("tile", "_b").applyInPandas(gram, spec)
    keys = ["a", "b"]
    if windows:
        m = m.withColumn("window", F.explode(F.slice(F.array(*[F.lit(w) for w in windows]), col("cls") + 1, len(windows))))
        keys = [*keys, "window"]
    return m.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in MOMENTS])


def pair_moments(returns: DataFrame, block: str = "month", windows: Sequence[int] = (), held: DataFrame | None = None) -> DataFrame:
    """Covariance and correlation of every symbol pair a <= b with two common values or more (and per trailing window).

    With ``held`` (symbol) only pairs of its symbols are made.
    """
    if held is not None:
        returns = returns.join(held.select("symbol").distinct(), "symbol", "left_semi")
    g = pair_sums(returns, block, windows)
    n = col("n")
    cov = div(col("sab") - col("sa") * col("sb") / n, n - 1)
    va, vb = col("saa") - col("sa") * col("sa") / n, col("sbb") - col("sb") * col("sb") / n
    moves = (va > 1e-12 * col("saa")) & (vb > 1e-12 * col("sbb"))  # a constant series has no correlation
    corr = F.when(moves, (col("sab") - col("sa") * col("sb") / n) / F.sqrt(va * vb))
    return g.filter("n > 1").select("a", "b", *(["window"] if windows else []), "n", cov.alias("cov"), corr.alias("corr"))


#: Stripes at least, symbols of a stripe at least, values of a stripe at most, and symbols of a side that are multiplied at once.
STRIPES, STRIPE_SYMBOLS, STRIPE_VALUES, SIDE = 16, 64, 4_000_000, 512


def correlation_summary(returns: DataFrame, min_n: int = 2) -> DataFrame:
    """(symbol, pairs, avg_corr, max_corr) over the absolute correlations with all other symbols; no pair leaves its task.

    ``returns`` has one row per (symbol, ts).  A symbol's series is one row, dealt to a stripe; a task holds two stripes, multiplies
    them by sides of ``SIDE`` symbols and keeps three sums per symbol.  Each series is sent once per stripe: ``STRIPES`` times until
    a stripe would hold more than ``STRIPE_VALUES`` values.  Work is quadratic in the symbols, memory and partial results are not.
    """
    at = F.unix_micros(col("ts").cast("timestamp"))
    rows = returns.filter("ret IS NOT NULL").groupBy(col("symbol").cast("string").alias("symbol")).agg(
        F.sort_array(F.collect_list(F.struct(at.alias("at"), col("ret").cast("double").alias("ret")))).alias("_s"))
    rows = cut_lineage(rows.select("symbol", F.transform("_s", lambda x: x["at"]).alias("at"), F.transform("_s", lambda x: x["ret"]).alias("ret")))
    size = rows.agg(F.count(F.lit(1)), F.sum(F.size("at"))).first()
    stripes = max(1, min(STRIPES, -(-size[0] // STRIPE_SYMBOLS)), -(-(size[1] or 0) // STRIPE_VALUES))
    own = F.pmod(F.xxhash64("symbol"), F.lit(stripes)).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.lit(stripes - 1)), lambda h: F.struct(
        F.least(col("_g"), h).alias("i"), F.greatest(col("_g"), h).alias("j")))
    dealt = rows.withColumn("_g", own).withColumn("tile", F.explode(tiles))

    def matrix(pdf: pd.DataFrame, times: np.ndarray):
        x = np.full((len(pdf), len(times)), np.nan)
        if len(pdf):
            lens = pdf["at"].map(len).to_numpy()
            x[np.repeat(np.arange(len(pdf)), lens), np.searchsorted(times, np.concatenate(pdf["at"].tolist()))] = np.concatenate(pdf["ret"].tolist())
        p = (~np.isnan(x)).astype(float)
        x = np.nan_to_num(x)
        return x, p, x * x

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf["tile"].iloc[0]
        same = one["i"] == one["j"]
        a, b = pdf[pdf["_g"] == one["i"]], pdf[pdf["_g"] == one["j"]]
        times = np.unique(np.concatenate(pdf["at"].tolist()))
        out = [np.zeros((3, len(a))), np.zeros((3, len(b)))]
        right = [(t, matrix(b.iloc[t:t + SIDE], times)) for t in range(0, len(b), SIDE)] if len(b) * len(times) <= STRIPE_VALUES else None
        for s in range(0, len(a), SIDE):
            x, p, xx = matrix(a.iloc[s:s + SIDE], times)
            for t, side in right or ((t, None) for t in range(0, len(b), SIDE)):
                if same and t < s:
                    continue
                y, q, yy = side or matrix(b.iloc[t:t + SIDE], times)
                n = p @ q.T
                sa, sb, saa, sbb = x @ q.T, p @ y.T, xx @ q.T, p @ yy.T
                with np.errstate(divide="ignore", invalid="ignore"):
                    va, vb = saa - sa * sa / n, sbb - sb * sb / n
                    ok = (n >= min_n) & (va > 1e-12 * saa) & (vb > 1e-12 * sbb)  # a constant series has no correlation
                    if same and t == s:
                        ok &= np.triu(np.ones(ok.shape, bool), 1)
                    r = np.where(ok, np.abs((x @ y.T - sa * sb / n) / np.sqrt(va * vb)), 0.0)
                for k, ax, part in ((0, 1, slice(s, s + len(x))), (1, 0, slice(t, t + len(y)))):
                    out[k][0, part] += ok.sum(ax)
                    out[k][1, part] += r.sum(ax)
                    out[k][2, part] = np.maximum(out[k][2, part], r.max(ax))
        both = np.concatenate(out, axis=1)
        got = pd.DataFrame({"symbol": pd.concat([a["symbol"], b["symbol"]]).to_numpy(), "n": both[0].astype("int64"), "t": both[1], "m": both[2]})
        return got[got["n"] > 0]

    # two partitions a tile: few tasks get more than one, and adaptive execution shall not put them together
    made = dealt.repartition(stripes * (stripes + 1), "tile").groupBy("tile").applyInPandas(tile, "symbol string, n long, t double, m double")
    return made.groupBy("symbol").agg(F.sum("n").alias("pairs"), div(F.sum("t"), F.sum("n")).alias("avg_corr"), F.max("m").alias("max_corr"))


def trailing_dates(returns: DataFrame, n: int) -> DataFrame:
    """Rows of the newest n timestamps: n is a constant, so the date list may be broadcast."""
    last = returns.select("ts").distinct().orderBy(col("ts").desc()).limit(n)
    return returns.join(F.broadcast(last), "ts", "left_semi")


def corr_pairs(returns: DataFrame, windows: Sequence[int] = (30, 90, 252)) -> DataFrame:
    return pair_moments(returns, windows=windows).filter("a < b")


def both_ways(pairs: DataFrame) -> DataFrame:
    """(a, b) and (b, a) for a < b, diagonal once."""
    flipped = pairs.filter("a < b").withColumns({"a": col("b"), "b": col("a")})
    return pairs.unionByName(flipped)


def corr_summary(pairs: DataFrame, limit: float = 0.7, keys: Sequence[str] = ()) -> DataFrame:
    """Statistics of |rho| with every pair counted once; the pair table is symbols^2 / 2 rows."""
    r = F.abs("corr")
    q = F.percentile(r, F.array(F.lit(0.25), F.lit(0.75)))
    g = pairs.filter("a < b").groupBy(*keys).agg(
        F.avg(r).alias("avg_corr"), F.max(r).alias("max_corr"), F.min(r).alias("min_corr"),
        F.stddev_samp(r).alias("sd_corr"), q.alias("_q"), F.count_if(r > limit).alias("violations"))
    return g.withColumns({"p25": F.get("_q", F.lit(0)), "p75": F.get("_q", F.lit(1))}).drop("_q")


def portfolio_cov(positions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(Sigma w)_a per portfolio and symbol, from the pair table."""
    p = positions.select("portfolio_id", "symbol", "weight")
    sw = p.join(both_ways(pairs).select(col("b").alias("symbol"), "a", "cov"), "symbol").groupBy(
        "portfolio_id", "a").agg(F.sum(col("weight") * col("cov")).alias("sw"))
    return p.join(sw.withColumnRenamed("a", "symbol"), ["portfolio_id", "symbol"])


def portfolio_risk(positions: DataFrame, returns: DataFrame, pairs: DataFrame, rf: float = 0.0) -> DataFrame:
    sw = portfolio_cov(positions, pairs).groupBy("portfolio_id").agg(
        F.sqrt(F.sum(col("weight") * col("sw")) * YEAR).alias("volatility"), F.max(F.abs("weight")).alias("max_weight"),
        F.sum(F.abs("weight")).alias("leverage"), F.sum(col("weight") * col("weight")).alias("hhi"),
        F.count(F.lit(1)).alias("positions"))
    mu = returns.groupBy("symbol").agg((F.avg("ret") * YEAR).alias("mu"))
    er = positions.join(mu, "symbol").groupBy("portfolio_id").agg(F.sum(col("weight") * col("mu")).alias(
        "expected_return"))
    return sw.join(er, "portfolio_id").withColumns({
        "sharpe": div(col("expected_return") - rf, "volatility"), "effective_n": div(F.lit(1.0), "hhi")})


def marginal_risk(positions: DataFrame, pairs: DataFrame, returns: DataFrame | None = None) -> DataFrame:
    d = portfolio_cov(positions, pairs)
    var = F.sum(col("weight") * col("sw")).over(Window.partitionBy("portfolio_id"))
    return d.select("portfolio_id", "symbol", "weight", (col("sw") / F.sqrt(var)).alias("marginal"),
                    (col("weight") * col("sw") / var).alias("risk_share"))


def diversification_ratio(pairs: DataFrame) -> DataFrame:
    """Mean sigma over the sigma of the equal-weight portfolio."""
    one = F.when(col("a") == col("b"), 1.0)
    g = pairs.agg(F.avg(one * F.sqrt("cov")).alias("mean_sd"), F.count(one).alias("n"),
                  F.sum(F.when(col("a") == col("b"), col("cov")).otherwise(2 * col("cov"))).alias("total"))
    return g.select((col("mean_sd") / (F.sqrt(col("total")) / col("n"))).alias("diversification_ratio"))


def position_correlation(positions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Weighted mean |rho| of each position with the other positions of its portfolio."""
    p = positions.select("portfolio_id", "symbol", "weight")
    o = p.select("portfolio_id", col("symbol").alias("b"), F.abs("weight").alias("wb"))
    j = p.join(both_ways(pairs).filter("a <> b").select(col("a").alias("symbol"), "b", "corr"), "symbol").join(
        o, ["portfolio_id", "b"])
    return j.groupBy("portfolio_id", "symbol").agg(div(F.sum(col("wb") * F.abs("corr")), F.sum("wb")).alias("avg_corr"))


def corr_penalty(positions: DataFrame, pairs: DataFrame, method: str = "exponential", limit: float = 0.7,
                 strength: float = 2.0, floor: float = 0.1) -> DataFrame:
    p = positions.select("portfolio_id", "symbol")
    o = positions.select("portfolio_id", col("symbol").alias("b"), F.abs("weight").alias("wb"))
    over = F.abs("corr") - limit
    pen = {"linear": 1 - over * strength, "exponential": F.exp(-strength * over), "threshold": F.lit(0.5)}[method]
    j = p.join(both_ways(pairs).filter("a <> b").select(col("a").alias("symbol"), "b", "corr"), "symbol").join(
        o, ["portfolio_id", "b"])
    one = F.when(over > 0, 1 - (1 - pen) * col("wb")).otherwise(1.0)
    return j.groupBy("portfolio_id", "symbol").agg(F.greatest(F.min(one), F.lit(floor)).alias("penalty"))


def sector_concentration(positions: DataFrame, sectors: DataFrame, limit: float = 0.4, floor: float = 0.1) -> DataFrame:
    d = positions.join(sectors.select("symbol", "sector"), "symbol")
    w = F.sum(F.abs("weight")).over(Window.partitionBy("portfolio_id", "sector"))
    d = d.withColumn("sector_weight", w)
    return d.withColumn("penalty", F.when(col("sector_weight") > limit, F.greatest(
        1 - 2 * (col("sector_weight") - limit), F.lit(floor))).otherwise(1.0))


def corr_clusters(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Connected components of |rho| > threshold, run until nothing changes; a symbol alone is its own cluster."""
    edges = pairs.filter("a < b").filter(F.abs("corr") > threshold).select("a", "b")
    found = connected_components(edges)
    nodes = pairs.filter("a = b").select(col("a").alias("symbol"))
    return nodes.join(found, col("symbol") == col("node"), "left").select(
        "symbol", F.coalesce("component", "symbol").alias("cluster"))


def cluster_quality(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    ca = clusters.select(col("symbol").alias("a"), col("cluster").alias("ca"))
    cb = clusters.select(col("symbol").alias("b"), col("cluster").alias("cb"))
    j = pairs.filter("a < b").join(ca, "a").join(cb, "b")
    same = col("ca") == col("cb")
    return j.agg(F.avg(F.when(same, F.abs("corr"))).alias("within"), F.avg(F.when(~same, F.abs("corr"))).alias("between"))


def cluster_penalty(positions: DataFrame, clusters: DataFrame, max_size: int = 3) -> DataFrame:
    d = positions.join(clusters, "symbol")
    w = Window.partitionBy("portfolio_id", "cluster")
    d = d.withColumns({"cluster_weight": F.sum(F.abs("weight")).over(w), "cluster_size": F.count(F.lit(1)).over(w)})
    k = d.groupBy("portfolio_id").agg(F.countDistinct("cluster").alias("k"))
    heavy = (col("cluster_weight") > 1.5 / col("k")) & (col("cluster_size") > max_size)
    return d.join(k, "portfolio_id").withColumn("penalty", F.when(
        heavy, 1 - F.least(F.lit(0.5), col("cluster_weight") * 0.5)).otherwise(1.0))


def apply_penalties(positions: DataFrame, *penalties: DataFrame) -> DataFrame:
    d = positions
    names = []
    for i, p in enumerate(penalties):
        names.append(f"_p{i}")
        d = d.join(p.select("portfolio_id", "symbol", col("penalty").alias(f"_p{i}")), ["portfolio_id", "symbol"], "left")
    best = F.least(F.lit(1.0), *[F.coalesce(n, F.lit(1.0)) for n in names])
    return d.withColumn("adjusted", col("weight") * best).drop(*names)


def correlation_alerts(summary: DataFrame, sectors: DataFrame, max_corr: float = 0.75, max_sector: float = 0.4,
                       high: float = 0.8) -> DataFrame:
    s = summary.agg(F.max("max_corr").alias("m"), F.max("avg_corr").alias("a"))
    rules = F.array_compact(F.array(
        F.when(col("m") > max_corr, F.struct(F.lit("HIGH_CORRELATION").alias("type"), F.lit("HIGH").alias("severity"),
                                             col("m").alias("value"))),
        F.when(col("a") > high, F.struct(F.lit("CORRELATION_REGIME").alias("type"), F.lit("HIGH").alias("severity"),
                                         col("a").alias("value")))))
    sec = sectors.groupBy("portfolio_id").agg(F.max("sector_weight").alias("value")).filter(col("value") > max_sector)
    return s.select(F.lit(None).cast("long").alias("portfolio_id"), F.inline(rules)).unionByName(
        sec.select("portfolio_id", F.lit("SECTOR_CONCENTRATION").alias("type"), F.lit("MEDIUM").alias("severity"), "value"))


def correlation_regime(returns: DataFrame, window: int = 90, high: float = 0.8, chunk: int = 2048) -> DataFrame:
    """Mean |rho| over all pairs in a trailing window per timestamp.

    Time is cut into chunks with a halo, symbols into groups; a tile (two groups, one chunk) keeps the matrices of its
    window's sums, to which the newest timestamp is added and from which the oldest is taken, and leaves one row per
    timestamp.  Pairs without a defined correlation in the window are left out.
    """
    size = max(chunk, window)
    dates = returns.select("ts").distinct()
    days = dates.groupBy(F.date_trunc("day", "ts").alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    off = days.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.partitionBy(F.lit(0)).orderBy("_d").rowsBetween(BIG, -1)), F.lit(0)))
    idx = dates.withColumn("_d", F.date_trunc("day", "ts")).join(off, "_d").withColumn(
        "_i", F.row_number().over(Window.partitionBy("_d").orderBy("ts")) + col("_off")).select("ts", "_i")
    from .timeseries import chunk_with_halo
    d = chunk_with_halo(returns.select("symbol", "ts", "ret").filter("ret IS NOT NULL").join(idx, "ts"), window, size)
    tiles = packed_groups(d, "_i", "_chunk")

    def roll(pdf: pd.DataFrame) -> pd.DataFrame:
        sa, sb, at, _, xa, xb, same = tile_sides(pdf, "_i")
        own = np.triu(np.ones((len(sa), len(sb)), bool), 1) if same else np.ones((len(sa), len(sb)), bool)
        middle_a, middle_b = (np.nan_to_num(np.nanmean(x, 0)) if len(x) else 0.0 for x in (xa, xb))
        p, q = (~np.isnan(xa)).astype(float), (~np.isnan(xb)).astype(float)
        x, y = np.where(p > 0, xa - middle_a, 0.0), np.where(q > 0, xb - middle_b, 0.0)
        parts = (p, q), (x, q), (p, y), (x * x, q), (p, y * y), (x, y)
        chunk = int(pdf["_chunk"].iloc[0])
        sums, first, seen, out = [np.zeros((len(sa), len(sb))) for _ in parts], 0, 0, []
        for i in range(chunk * size + 1, (chunk + 1) * size + 1):  # every timestamp, also those without a row of this tile
            while seen < len(at) and at[seen] <= i:  # what enters the window is added, what leaves it is taken off
                for m, (u, v) in zip(sums, parts):
                    m += np.outer(u[seen], v[seen])
                seen += 1
            while first < seen and at[first] <= i - window:
                for m, (u, v) in zip(sums, parts):
                    m -= np.outer(u[first], v[first])
                first += 1
            n, ma, mb, maa, mbb, mab = sums
            with np.errstate(all="ignore"):
                va, vb = maa - ma * ma / n, mbb - mb * mb / n
                r = (mab - ma * mb / n) / np.sqrt(va * vb)
            good = own & (n > 1.5) & (va > 1e-12 * maa) & (vb > 1e-12 * mbb) & np.isfinite(r)
            out.append((i, float(np.abs(r[good]).sum()), int(good.sum())))
        return pd.DataFrame(out, columns=["_i", "total", "pairs"])

    sums = tiles.groupBy("tile", "_chunk").applyInPandas(roll, "_i long, total double, pairs long").filter(col("_i") >= window)
    mean = sums.groupBy("_i").agg(F.sum("total").alias("t"), F.sum("pairs").alias("k"))
    out = mean.join(idx, "_i").select("ts", F.when(col("k") > 0, col("t") / col("k")).alias("avg_corr"))
    return out.withColumn("high", col("avg_corr") > high)


# ------------------------------------------------------------------ drawdown

def drawdown_series(pr: DataFrame, s: Ordered = P) -> DataFrame:
    d = pr.withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(s.running)))
    d = d.withColumn("peak", F.max("equity").over(s.running))
    return d.withColumn("drawdown", col("equity") / col("peak") - 1)


def drawdown_periods(dd: DataFrame, s: Ordered = P) -> DataFrame:
    """Under-water runs: start, end, depth, length, whether still open, the peak to regain."""
    d = islands(dd, col("drawdown") < 0, s, "run").withColumn("_last", F.max("ts").over(Window.partitionBy(*s.keys)))
    return d.filter("run IS NOT NULL").groupBy(*s.keys, "run").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.min("drawdown").alias("depth"),
        F.count(F.lit(1)).alias("bars"), F.max("peak").alias("peak"),
        (F.max("ts") == F.max("_last")).alias("ongoing"))


def drawdown_stats(dd: DataFrame, periods: DataFrame) -> DataFrame:
    a = dd.groupBy("portfolio_id").agg(
        F.min("drawdown").alias("max_drawdown"), F.max_by("drawdown", "ts").alias("current_drawdown"),
        F.sqrt(F.avg(col("drawdown") * col("drawdown"))).alias("ulcer"), F.max_by("equity", "ts").alias("_end"),
        F.count(F.lit(1)).alias("_n"))
    b = periods.groupBy("portfolio_id").agg(F.avg("depth").alias("avg_drawdown"), F.count(F.lit(1)).alias("periods"),
                                            F.avg("bars").alias("avg_bars"), F.max("bars").alias("max_bars"))
    return a.join(b, "portfolio_id", "left").withColumns({
        "recovery_factor": div(col("_end") - 1, F.abs("max_drawdown")), "frequency": col("periods") / col("_n")}).drop(
            "_end", "_n")


def recovery_metrics(periods: DataFrame, dd: DataFrame) -> DataFrame:
    """Bars are back at the prior peak when the run ends; an open run has no recovery."""
    s = Ordered("portfolio_id", "ts")
    nxt = dd.select("portfolio_id", "ts", s.lead("ts").alias("recovered_ts"))
    p = periods.join(nxt.withColumnRenamed("ts", "end_ts"), ["portfolio_id", "end_ts"])
    return p.withColumns({
        "required_gain": 1 / (1 + col("depth")) - 1, "recovered": ~col("ongoing"),
        "hours_to_recover": F.when(~col("ongoing"), (F.unix_micros(col("recovered_ts").cast("timestamp")) - F.unix_micros(
            col("start_ts").cast("timestamp"))) / 3.6e9)})


def drawdown_state(dd: DataFrame) -> DataFrame:
    """Drawdown from the day, week and month high, velocity per hour, severity, size multiplier, breaker."""
    def high(span):
        return F.expr(f"max(equity) OVER (PARTITION BY portfolio_id ORDER BY ts RANGE BETWEEN INTERVAL {span} "
                      "PRECEDING AND CURRENT ROW)")
    s = P
    hours = (F.unix_micros(col("ts").cast("timestamp")) - F.unix_micros(s.lag("ts").cast("timestamp"))) / 3.6e9
    d = dd.withColumns({f"dd_{n}": col("equity") / high(span) - 1 for n, span in
                        (("day", "1 DAY"), ("week", "7 DAYS"), ("month", "30 DAYS"))})
    d = d.withColumn("velocity", F.coalesce(div(col("drawdown") - s.lag("drawdown"), hours), F.lit(0.0)))
    a = F.abs("drawdown")
    return d.withColumns({
        "severity": F.when(a >= 0.018, "critical").when(a >= 0.015, "caution").when(a >= 0.01, "warning").otherwise("normal"),
        "size_multiplier": F.when(a <= 0.01, 1.0).otherwise(F.greatest(
            F.lit(0.1), 1 - 0.8 * F.least(F.lit(1.0), (a - 0.01) / 0.19))),
        "circuit_breaker": (F.abs("dd_day") >= 0.02) | (F.abs("dd_week") >= 0.05) | (F.abs("dd_month") >= 0.10) | (a >= 0.20)})


# ------------------------------------------------------------------ limits and score

def limit_utilisation(m: DataFrame, limits: dict[str, float] = LIMITS, warn: float = 0.8) -> DataFrame:
    """(portfolio, limit, current, limit value, use, status) from var, max_weight, leverage, drawdown columns."""
    src = {"var_limit": "var", "position_limit": "max_weight", "leverage_limit": "leverage", "drawdown_limit": "drawdown"}
    items = F.array(*[F.struct(F.lit(k).alias("limit_name"), F.abs(col(src[k])).alias("current"), F.lit(v).alias("limit_value"))
                      for k, v in limits.items()])
    d = m.select("portfolio_id", F.inline(items)).withColumn("utilisation", col("current") / col("limit_value"))
    return d.withColumn("status", F.when(col("current") > col("limit_value"), "BREACH").when(
        col("utilisation") > warn, "APPROACH").otherwise("OK"))


def risk_score(m: DataFrame) -> DataFrame:
    def part(cap, e):
        return F.least(F.lit(float(cap)), e)
    s = (part(30, F.abs("var") / 0.02 * 30) + part(20, col("volatility") * 100) + part(20, col("hhi") * 20)
         + part(20, F.abs("drawdown") / 0.2 * 20) + part(10, col("leverage") * 10))
    return m.withColumn("risk_score", F.least(s, F.lit(100.0)))


# ------------------------------------------------------------------ sizing

def kelly_single(returns: DataFrame, lookback: int = 100, fraction: float = 0.25) -> DataFrame:
    d = recent(returns, lookback, "symbol")
    r = col("ret")
    g = d.groupBy("symbol").agg(
        (F.count_if(r > 0) / F.count(r)).alias("win_rate"), F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.abs(F.avg(F.when(r < 0, r))), F.lit(0.0)).alias("avg_loss"), F.avg(r).alias("_m"),
        F.stddev_samp(r).alias("_s"), F.count(r).alias("n")).filter(col("n") >= lookback)
    b, p = div("avg_win", "avg_loss"), col("win_rate")
    g = g.withColumn("kelly", F.coalesce(div(b * p - (1 - p), b), F.lit(0.0)))
    return g.withColumns({"kelly_adj": col("kelly") * fraction, "sharpe": div("_m", "_s")}).drop("_m", "_s")


def kelly_growth(returns: DataFrame, kelly: DataFrame, lookback: int = 100) -> DataFrame:
    d = recent(returns, lookback, "symbol").join(kelly.select("symbol", "kelly_adj"), "symbol")
    g = 1 + col("kelly_adj") * col("ret")
    return d.groupBy("symbol").agg(F.avg(F.when(g > 0, F.ln(g))).alias("growth"))


def inverse_vol_weights(returns: DataFrame, target: float = 0.15) -> DataFrame:
    g = returns.groupBy("symbol").agg((F.stddev_samp("ret") * F.sqrt(F.lit(YEAR))).alias("vol"))
    g = g.withColumn("_w", F.coalesce(div(F.lit(target), "vol"), F.lit(0.0)))
    total = g.agg(F.sum(F.abs("_w"))).scalar()
    return g.withColumn("weight", div("_w", total)).drop("_w")


def size_adjust(sizes: DataFrame, returns: DataFrame, penalties: DataFrame | None = None, base_conf: float = 0.6,
                target_vol: float = 0.15, max_exposure: float = 1.0) -> DataFrame:
    """Base sizes with confidence to scaled, bounded sizes per portfolio."""
    r30 = recent(returns, 30, "symbol").groupBy("symbol").agg(F.stddev_samp("ret").alias("_s"), F.count("ret").alias("_n"))
    r20 = recent(returns, 20, "symbol").groupBy("symbol").agg(F.avg("ret").alias("_m"))
    d = sizes.join(r30, "symbol", "left").join(r20, "symbol", "left")
    conf = F.pow(col("confidence") / base_conf, F.lit(2.0))
    vol = F.when(col("_n") >= 30, F.coalesce(clip(div(F.lit(target_vol), col("_s") * F.sqrt(F.lit(YEAR))), 0.1, 3),
                                             F.lit(1.0))).otherwise(1.0)
    mom = F.coalesce(clip(1 + col("_m") * 2520, 1 / 1.5, 1.5), F.lit(1.0))
    d = d.withColumn("size", col("size") * conf * vol * mom)
    a = F.abs("size")
    d = d.withColumn("size", F.when(a < 0.005, 0.0).when(a > 0.10, F.signum("size") * 0.10).otherwise(col("size")))
    total = F.sum(F.abs("size")).over(Window.partitionBy("portfolio_id"))
    d = d.withColumn("_t", total).withColumn("size", F.when(col("_t") > max_exposure, col("size") * max_exposure / col("_t"))
                                             .otherwise(col("size")))
    if penalties is not None:
        d = d.join(penalties.select("portfolio_id", "symbol", "penalty"), ["portfolio_id", "symbol"], "left").withColumn(
            "size", col("size") * F.coalesce("penalty", F.lit(1.0)))
    return d.drop("_s", "_n", "_m", "_t", "penalty")


def sizing_metrics(sizes: DataFrame) -> DataFrame:
    a = F.abs("size")
    return sizes.groupBy("portfolio_id").agg(F.sum(a).alias("total_allocation"), F.max(a).alias("max_position"),
                                             F.count_if(col("size") != 0).alias("positions"),
                                             F.sum(col("size") * col("size")).alias("hhi"))


# ------------------------------------------------------------------ stops

def support_resistance(bars: DataFrame, window: int = 20, touches: int = 2, tol: float = 0.02) -> DataFrame:
    """Local extrema clustered within 2 %, kept when at least two prices come within 1 %."""
    s = Ordered()
    around = s.rows(-window, window)
    b = bars.select("symbol", "ts", "close", F.min("close").over(around).alias("_lo"), F.max("close").over(around)
                    .alias("_hi"), F.count("close").over(around).alias("_n"))
    full = col("_n") == 2 * window + 1
    ext = b.filter(full & ((col("close") == col("_lo")) | (col("close") == col("_hi")))).select(
        "symbol", "ts", col("close").alias("level"),
        F.when(col("close") == col("_lo"), "support").otherwise("resistance").alias("kind"))
    o = Ordered(["symbol", "kind"], ["level", "ts"])
    new = F.when(col("level") / o.lag("level") - 1 <= tol, 0).otherwise(1)
    ext = ext.withColumn("_new", new).withColumn("_g", F.sum("_new").over(o.running))
    lv = ext.groupBy("symbol", "kind", "_g").agg(F.avg("level").alias("level"), F.count(F.lit(1)).alias("members"))
    width = 0.0101
    def bin_of(c):
        return F.floor(F.ln(col(c)) / width)
    near = lv.withColumn("_b", F.explode(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: bin_of("level") + k)))
    prices = bars.groupBy("symbol", "close").agg(F.count(F.lit(1)).alias("k")).withColumn("_b", bin_of("close"))
    hit = near.join(prices, ["symbol", "_b"]).filter(F.abs(col("close") - col("level")) / col("level") < 0.01)
    return hit.groupBy("symbol", "kind", "level", "members").agg(F.sum("k").alias("touches")).filter(col("touches") >= touches)


def regime_simple(bars: DataFrame, n: int = 50) -> DataFrame:
    s = Ordered()
    b = bars.withColumn("_r", col("close") / s.lag("close") - 1)
    m, sd = s.mean("_r", n), s.std("_r", n)
    t = F.coalesce(div(F.abs(m), sd), F.lit(0.0))
    return b.withColumn("regime", F.when(m.isNull(), "neutral").when((m > 0.001) & (t > 0.1), "bull").when(
        (m < -0.001) & (t > 0.1), "bear").when(sd > 0.02, "volatile").otherwise("neutral")).drop("_r")


REGIME_STOP = {"bull": 1.2, "bear": 0.8, "volatile": 1.5}


def optimal_stop(positions: DataFrame, latest: DataFrame, levels: DataFrame | None = None, base: float = 0.05) -> DataFrame:
    """Positions (symbol, entry, size, is_long) with latest (symbol, atr_pct, regime) to a stop price."""
    d = positions.join(latest.select("symbol", "atr_pct", "regime"), "symbol", "left")
    pct = F.lit(base) * F.coalesce(clip(col("atr_pct") * 2.0 / base, 0.5, 3.0), F.lit(1.0))
    if levels is not None:
        j = d.join(levels.select("symbol", "kind", "level"), "symbol", "left")
        sup = F.max(F.when(col("is_long") & (col("kind") == "support") & (col("level") < col("entry")), col("level")))
        res = F.min(F.when(~col("is_long") & (col("kind") == "resistance") & (col("level") > col("entry")), col("level")))
        best = j.groupBy("symbol", "entry", "is_long").agg(sup.alias("_sup"), res.alias("_res"))
        d = d.join(best, ["symbol", "entry", "is_long"], "left")
        sr = F.when(col("is_long"), (col("entry") - col("_sup") * (1 - 0.002)) / col("entry")).otherwise(
            (col("_res") * (1 + 0.002) - col("entry")) / col("entry"))
        pct = F.coalesce(F.when(sr > 0, sr), pct)
    mult = F.lit(1.0)
    for k, v in REGIME_STOP.items():
        mult = F.when(col("regime") == k, v).otherwise(mult)
    d = d.withColumn("stop_pct", clip(pct * mult, 0.01, 0.15))
    side = F.when(col("is_long"), -1).otherwise(1)
    return d.withColumns({"stop_price": col("entry") * (1 + side * col("stop_pct")),
                          "risk_amount": F.abs(col("size") * col("entry") * col("stop_pct"))}).drop("_sup", "_res")


def trailing_stop(path: DataFrame, trigger: float = 0.02, step: float = 0.005) -> DataFrame:
    """Prices since entry (position_id, ts, close, entry, stop0, is_long) to the monotone trailing stop."""
    s = Ordered("position_id", "ts")
    hi = F.greatest(col("entry"), F.max("close").over(s.running))
    lo = F.least(col("entry"), F.min("close").over(s.running))
    gain = F.when(col("is_long"), col("close") / col("entry") - 1).otherwise(1 - col("close") / col("entry"))
    cand = F.when(gain >= trigger, F.when(col("is_long"), hi * (1 - step)).otherwise(lo * (1 + step)))
    d = path.withColumn("_c", cand)
    up = F.greatest(col("stop0"), F.max("_c").over(s.running))
    down = F.least(col("stop0"), F.min("_c").over(s.running))
    return d.withColumn("stop", F.when(col("is_long"), up).otherwise(down)).drop("_c")


def stop_triggers(path: DataFrame, per_day: int = 3) -> DataFrame:
    """First crossing of the stop in force before the bar, at most three exits per day."""
    s = Ordered("position_id", "ts")
    d = path.withColumn("_p", F.coalesce(s.lag("stop"), "stop0"))
    hit = F.when(col("is_long"), col("close") <= col("_p")).otherwise(col("close") >= col("_p"))
    g = d.filter(hit).groupBy("position_id", "entry", "is_long").agg(
        F.min("ts").alias("ts"), F.min_by("close", "ts").alias("exit"), F.min_by("_p", "ts").alias("stop"))
    pnl = F.when(col("is_long"), col("exit") / col("entry") - 1).otherwise(1 - col("exit") / col("entry"))
    w = Window.partitionBy(F.to_date("ts")).orderBy("ts", "position_id")
    return g.withColumn("pnl_pct", pnl).withColumn("n", F.row_number().over(w)).filter(col("n") <= per_day)
