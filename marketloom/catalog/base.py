"""Query registry: one Spark callable plus, where it can be said in SQL, one independent oracle text.

``cols`` names and types the output of both sides ("name", or "name:i" integer, ":d" double rounded to six
places, ":d2" to two, ":b" boolean), so that engines are compared on the same schema.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..sources.adapters import SOURCE_HOSTS, SOURCES, STAND_INS, Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _spec(cols: str):
    out = []
    for item in cols.split():
        name, _, kind = item.partition(":")
        out.append((name, kind))
    return out


def shape(df: DataFrame, cols: str) -> DataFrame:
    picks = []
    for name, kind in _spec(cols):
        c = F.col(name)
        if kind == "i":
            c = c.cast("long")
        elif kind == "b":
            c = c.cast("boolean")
        elif kind.startswith("d"):
            c = rounded(c, int(kind[1:] or 6)) + F.lit(0.0)
        picks.append(c.alias(name))
    return df.select(*picks)


def _values(items):
    return ", ".join("('" + "', '".join(i) + "')" for i in items)


_map = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in STAND_INS.items()) + "}"


def _swap(expr: str) -> str:
    return (f"array_to_string(list_transform(string_split({expr}, ' '), "
            f"lambda w: coalesce({_map}[lower(w)], w)), ' ')")


_sources = "[" + ", ".join(f"'{s}'" for s in SOURCES) + "]"
_hosts = "[" + ", ".join(f"'{s}'" for s in SOURCE_HOSTS) + "]"
_epoch = "TIMESTAMP '2024-01-01' + to_seconds({}::BIGINT * 7919 % 172800)"

BASE_SQL = {
    "ticks": """SELECT event_id, ts, user_id, upper(event_type) AS symbol, 100 + value / 50 AS price,
        CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty FROM events""",
    "bars": """SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, ts) AS open, max(price) AS high,
        min(price) AS low, arg_max(price, ts) AS "close", sum(qty) AS volume, sum(price * qty) / nullif(sum(qty), 0) AS vwap,
        count(*) AS trades FROM ticks GROUP BY 1, 2""",
    "rets": """SELECT symbol, ts, ret, "close" FROM (SELECT symbol, ts, "close",
        "close" / lag("close") OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars) WHERE ret IS NOT NULL""",
    "positions": """SELECT portfolio_id, symbol, q / sum(q) OVER (PARTITION BY portfolio_id) AS weight
        FROM (SELECT user_id % 10 AS portfolio_id, symbol, sum(qty) AS q FROM ticks GROUP BY 1, 2)""",
    "sent": f"""SELECT upper(event_type) AS symbol, ts, event_id, ({_sources})[user_id % 4 + 1] AS source,
        least(greatest((value - 50) / 50, -1), 1) AS score, k / 100 AS confidence, k AS mentions, k % 7 AS bullish,
        k % 5 AS bearish, value * k AS engagement, user_id
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""",
    "posts": f"""SELECT *, string_split("text", chr(10))[1] AS title FROM (SELECT doc_id AS id,
        {_swap('"text"')} AS "text", source AS subreddit, 'u' || (doc_id % 97) AS author, n_chars % 2000 AS score,
        (doc_id * 7) % 300 AS comments, lang, {_epoch.format('doc_id')} AS ts FROM documents)""",
    "articles": f"""SELECT page_id AS id, {_swap("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title,
        {_swap("regexp_replace(html, '<[^>]*>', ' ', 'g')")} AS summary,
        ({_hosts})[page_id % 4 + 1] AS source, {_epoch.format('page_id')} AS ts,
        ((page_id * 13) % 201) / 100.0 - 1 AS score, (page_id % 10) / 10.0 AS confidence FROM pages""",
    "trades": """SELECT event_id AS trade_id, symbol, ts, price, qty, symbol || '-' || slot AS order_id,
        'V' || (user_id % 4) AS venue, (['TWAP', 'VWAP', 'ICEBERG'])[slot % 3 + 1] AS algorithm,
        CASE WHEN slot % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, slot
        FROM (SELECT *, epoch_us(ts) // 21600000000 AS slot FROM ticks)""",
    "parents": """SELECT order_id, symbol, side, algorithm, slot, min(ts) AS start_ts, max(ts) AS end_ts,
        arg_min(price, ts) AS arrival_price, sum(qty) * (1 + max(slot) % 5 * 0.02) AS order_qty,
        (['low', 'normal', 'high'])[slot % 3 + 1] AS urgency FROM trades GROUP BY ALL""",
    "fills": """SELECT l_orderkey AS order_id, l_partkey AS symbol, 'V' || (l_suppkey % 4) AS venue,
        l_quantity AS qty, l_extendedprice / l_quantity AS price,
        CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
        l_extendedprice / l_quantity * l_quantity * l_tax AS commission, l_shipdate AS ts,
        CAST(l_linenumber AS BIGINT) AS line, l_suppkey AS supp FROM lineitem""",
    "ords": """SELECT o_orderkey AS order_id, o_custkey AS account, CASE o_orderstatus WHEN 'F' THEN 'filled'
        WHEN 'O' THEN 'open' ELSE 'partial' END AS status, o_totalprice AS value, o_orderdate AS ts,
        o_orderpriority AS priority FROM orders""",
    "accounts": """SELECT o_custkey AS account, o_orderdate AS ts, o_orderkey AS snap,
        20000 + c_acctbal + (o_orderkey % 101 - 50) * 40 AS equity, o_totalprice % 15000 AS margin_used,
        c_acctbal - o_orderkey % 3000 AS buying_power, o_orderkey % 6 AS day_trades
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "levels": """SELECT event_id, symbol, ts, price AS tick_price, qty, side, i,
        price + (CASE side WHEN 'bid' THEN -1 ELSE 1 END) * 0.01 * (1 + qty % 5) * i AS price,
        (qty * (CASE side WHEN 'bid' THEN 3 ELSE 7 END) + i * 17) % 90 + 10 AS size, i % 3 + 1 AS orders
        FROM ticks, (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(['bid', 'ask']) AS side)""",
}


def unit_sql(seed: int, *cols: str) -> str:
    """SQL of the reproducible unit hash."""
    m, h = 2147483647, str(seed)
    for c in cols:
        h = f"((({h}) * 48271 + ((({c})::BIGINT % {m}) + {m}) % {m}) * 16807 + 12345) % {m}"
    return f"(((({h}) * 69621) % {m} + 1) / 2147483649.0::DOUBLE)"


def normal_sql(seed: int, *cols: str) -> str:
    return f"(sqrt(-2 * ln({unit_sql(seed, *cols)})) * cos(6.283185307179586 * {unit_sql(seed + 1, *cols)}))"


def mixed_sql(rel: str, seed: int, *parts: str, out: str = "u") -> str:
    """SQL of a relation with the column ``out``: the repeatable hash ``mixed_hash`` of whole-number columns, in steps."""
    m = 2147483647
    rel = f"SELECT *, {seed % m}::BIGINT AS _x FROM {rel}"
    for p in parts:
        rel = f"SELECT * REPLACE ((_x * 48271 + ({p})::BIGINT % {m}) % {m} AS _x) FROM ({rel})"
        rel = f"SELECT * REPLACE ((_s * _s % {m}) * _x % {m} AS _x) FROM (SELECT *, _x * _x % {m} AS _s FROM ({rel}))"
        rel = f"SELECT * EXCLUDE (_s) FROM ({rel})"
    return f"(SELECT * EXCLUDE (_x), (_x + 0.5::DOUBLE) / {m} AS {out} FROM ({rel}))"


def add_base(name: str, sql: str) -> None:
    BASE_SQL[name] = sql


def _needed(sql: str, done: dict[str, None], open_: frozenset[str] = frozenset()) -> dict[str, None]:
    for name, body in BASE_SQL.items():
        if name in done or name in open_:
            continue
        if re.search(rf"(?:\bFROM|\bJOIN|,)\s+{name}\b", sql):
            _needed(body, done, open_ | {name})
            done[name] = None
    return done


def oracle(cols: str, sql: str) -> str:
    picks = []
    for name, kind in _spec(cols):
        ref = f'"{name}"'
        if kind == "i":
            picks.append(f"CAST({ref} AS BIGINT) AS {ref}")
        elif kind == "b":
            picks.append(f"CAST({ref} AS BOOLEAN) AS {ref}")
        elif kind.startswith("d"):
            picks.append(f"round(CAST({ref} AS DOUBLE), {int(kind[1:] or 6)}) + 0.0 AS {ref}")
        else:
            picks.append(ref)
    ctes = ",\n".join(f"{n} AS ({BASE_SQL[n]})" for n in _needed(sql, {}))
    head = f"WITH RECURSIVE {ctes},\n" if ctes else "WITH RECURSIVE "
    return f"{head}result_rows AS ({sql})\nSELECT {', '.join(picks)} FROM result_rows"


def query(name: str, cols: str, sql: str | None = None):
    def wrap(fn: Callable[[Market], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: shape(fn(Market(spark, folder)), cols)
        if sql is not None:
            ORACLES[name] = oracle(cols, sql)
        return fn
    return wrap
