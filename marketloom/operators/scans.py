"""State machines over unbounded keys without a task per key.

* ``next_index`` and ``chain``: machines that wait for the next row from some time on.  Each row points to its successor, found
  by running counts; the rows that are reached from the first one are marked by doubling the pointers, in as many joins as the
  chain's length has binary digits.
* ``finite_scan``: machines with a known number of states.  A chunk of rows becomes a map from entry state to exit state, maps
  are composed in a tree, and every chunk is replayed from its entry state by itself.  Built-in functions only.
* ``stream_machine``: any other machine, as a stream: rows of a key pass through one task in order, nothing is held but the
  state.  For series that are bounded per key (bars).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_path, written
from .timeseries import index_rows, join_on

#: Rows of a chunk and chunks of a group.
CHUNK = 64


# ------------------------------------------------------------------ successor pointers

def next_index(probes: DataFrame, targets: DataFrame, keys: Sequence[str], at: str, ts: str = "ts", strict: bool = False,
               block: str = "day", out: str = "_next") -> DataFrame:
    """Probes with the 1-based place among the key's targets (by ``ts``) of the first one at or after ``at`` (after, if strict).

    Linear: both are numbered in one order, a probe's place is the number of targets before it plus one.  That place may lie
    one behind the last target.
    """
    keys = list(keys)
    rows = F.struct(*probes.columns)
    p = probes.select(*keys, F.col(at).alias("_t"), F.lit(1 if strict else -1).alias("_side"), F.lit(0).alias("_one"), rows.alias("_p"))
    t = targets.select(*keys, F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.lit(1).alias("_one"))
    both = index_rows(p.unionByName(t, allowMissingColumns=True), keys, ["_t", "_side"], F.date_trunc(block, "_t"), totals={"_n": "_one"})
    return both.filter("_side <> 0").select("_p.*", (F.col("_n") + 1).alias(out))


def chain(pointers: DataFrame, keys: Sequence[str], node: str = "_i", to: str = "_next") -> DataFrame:
    """(keys, node) of all rows that are reached from each key's first row (``node`` = its least).

    Round k joins the marked rows with pointers over 2^k rows and the pointers with themselves; what is marked doubles, so
    a chain of a million rows takes twenty rounds.
    """
    keys = list(keys)
    first = pointers.groupBy(*keys).agg(F.min(node).alias(node))
    jump, path = written(pointers.select(*keys, node, to), "pointers")
    # a pointer past the last row leads nowhere
    jump, _ = written(join_on(jump, jump.select(*keys, F.col(node).alias(to)), [*keys, to], "left_semi"), "pointers")
    marked, last = written(first, "marked")
    while True:
        ahead = join_on(marked, jump, [*keys, node]).select(*keys, F.col(to).alias(node))
        more, where = written(ahead, "ahead")
        if more.isEmpty():
            drop_path(more.sparkSession, where)
            return marked
        grown, new = written(marked.unionByName(more), "marked")
        twice = join_on(jump, jump.select(*keys, F.col(node).alias(to), F.col(to).alias("_far")), [*keys, to])
        farther, far = written(twice.select(*keys, node, F.col("_far").alias(to)), "pointers")
        for old in (last, where, path):
            drop_path(marked.sparkSession, old)
        marked, last, jump, path = grown, new, farther, far


# ------------------------------------------------------------------ finite machines

def _folded(items: Column, start: Column, step: Callable[[Column, Column], Column], label: Callable[[Column], Column]) -> Column:
    """Array of (label of the item, state before it, state after it), in order."""
    none = F.array().cast("array<struct<item:int,before:int,after:int>>")

    def go(acc: Column, x: Column) -> Column:
        def on(after: Column) -> Column:
            return F.struct(after.alias("s"), F.concat(acc["seen"], F.array(F.struct(
                label(x).cast("int").alias("item"), acc["s"].alias("before"), after.alias("after")))).alias("seen"))

        return F.transform(F.array(step(acc["s"], x)), on)[0]

    return F.aggregate(items, F.struct(start.alias("s"), none.alias("seen")), go, lambda acc: acc["seen"])


def _entries(maps: DataFrame, keys: list[str], states: int, first: int) -> DataFrame:
    """(keys, _ck, _entry) of every chunk from (keys, _ck, _map)."""
    top = maps.agg(F.max("_ck")).first()[0] or 0
    groups = maps.withColumn("_pk", F.floor(F.col("_ck") / CHUNK).cast("long")).groupBy(*keys, "_pk").agg(
        F.sort_array(F.collect_list(F.struct("_ck", "_map"))).alias("_list"))  # at most CHUNK short arrays
    groups, _ = written(groups, "state-maps")

    def through(s: Column, m: Column) -> Column:
        return F.get(m["_map"], s)

    if top < CHUNK:
        placed = groups.withColumn("_in", F.lit(first))
    else:
        every = F.sequence(F.lit(0), F.lit(states - 1))
        whole = groups.select(*keys, F.col("_pk").alias("_ck"), F.transform(every, lambda s: F.aggregate("_list", s, through)).alias("_map"))
        up = _entries(whole, keys, states, first).select(*keys, F.col("_ck").alias("_pk"), F.col("_entry").alias("_in"))
        placed = join_on(groups, up, [*keys, "_pk"])
    seen = _folded(F.col("_list"), F.col("_in"), through, lambda m: m["_ck"] % CHUNK)
    return placed.select(*keys, "_pk", F.explode(seen).alias("_e")).select(
        *keys, (F.col("_pk") * CHUNK + F.col("_e.item")).alias("_ck"), F.col("_e.before").alias("_entry"))


def finite_scan(df: DataFrame, keys: Sequence[str], step: Callable[[Column, Column], Column], states: int, first: int = 0,
                out: str = "_state", index: str = "_i") -> DataFrame:
    """Adds the state after each row of a machine with states 0 .. ``states`` - 1 (an int) that starts in ``first``.

    ``step(state, row)`` is an expression over the state and the row's struct; ``index`` numbers a key's rows from 1.
    """
    keys = list(keys)
    d = df.withColumn("_ck", F.floor((F.col(index) - 1) / CHUNK).cast("long"))
    rows = F.sort_array(F.collect_list(F.struct(index, *[c for c in df.columns if c != index])))
    chunks, _ = written(d.groupBy(*keys, "_ck").agg(rows.alias("_rows")), "machine-chunks")
    every = F.sequence(F.lit(0), F.lit(states - 1))
    maps = chunks.select(*keys, "_ck", F.transform(every, lambda s: F.aggregate("_rows", s, step)).alias("_map"))
    placed = join_on(chunks, _entries(maps, keys, states, first), [*keys, "_ck"])
    seen = _folded(F.col("_rows"), F.col("_entry"), step, lambda r: (r[index] - 1) % CHUNK)
    both = placed.select(F.explode(F.arrays_zip(F.col("_rows").alias("r"), seen.alias("s"))).alias("_z"))
    return both.select("_z.r.*", F.col("_z.s.after").alias(out)).select(*df.columns, out)


# ------------------------------------------------------------------ other machines

def stream_machine(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable, start: Callable, inputs: Sequence[str],
                   out: dict[str, str]) -> DataFrame:
    """Adds what ``step(state, *inputs) -> (state, values)`` gives for each row, in order; the state lives for a key."""
    import pyarrow as pa

    keys, inputs, names = list(keys), list(inputs), list(out)
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    spec += "".join(f", `{n}` {t}" for n, t in out.items())
    kinds = {"double": pa.float64(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches):
        mine, state = None, None
        for batch in batches:
            made = []
            columns = [batch.column(c).to_pylist() for c in (*keys, *inputs)]
            for row in zip(*columns):
                if row[: len(keys)] != mine:
                    mine, state = row[: len(keys)], start()
                state, values = step(state, *row[len(keys):])
                made.append(values)
            new = [pa.array(v, kinds[t]) for v, t in zip(zip(*made), out.values())] if made else [pa.array([], kinds[t]) for t in out.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, spec)
