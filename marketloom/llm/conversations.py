"""Conversation structure repair: shortest paths by auction over the lattice (rows consumed, role state).

A conversation's rows, in order, are consumed one by one in one of four states (start, after system, after user, after
assistant).  Keep, Rerole and Delete consume a row, Insert does not; the goal is the start or the state after an
assistant.  The auction keeps a price for each node and one path from the source: the last node either raises its price to
the best (arc cost + price of the next node) and gives up its place (contraction) or is followed by that next node
(extension).  When the path reaches the goal, every cheapest path consists of tight arcs only (price = cost + next price);
among the tight arcs that lead to the goal the one with the least initial is followed, which gives the ASCII-least audit.

Work at scale: equal rows of one turn are one lattice step with a count.  Rows are placed by (conversation, block of turns)
and, where such a block is heavy, by (turn, first byte of the content's digest), so that one conversation with a third of
all rows is spread over tasks; a task cuts its rows into units of ``UNIT`` steps.  Conversations of several units are joined
up by the costs from each entry state to each exit state of a unit (one auction per pair): a scan from the end gives the
prices behind each unit, every unit is then traced for each entry state by itself, and a scan from the start picks the
entry.  Only the final pass reads a conversation in order in one task, as a stream, because a checksum is sequential; it
holds one row at a time and the audit.

Damage and faults follow fixed rules (``damaged``, ``lattice_rows``).  Edges: null texts, roles and the null parts of the
key are one space; a null conv_id is a conversation of its own; a null turn comes first and counts for no gap; rows of one
turn follow the md5 of role and text; repeated rows are duplicates; other roles than system, user and assistant count by
their first letter; conversations that lose all rows have zeros, an empty audit and the checksum of the empty text; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import records

#: Steps of a unit, bits of the turns of a block, and rows from which a block is placed by turn and digest.
UNIT, TURN_BITS, HEAVY = 64, 6, 1024

#: Rows that the final pass turns into Python values at once.
READ = 512

#: Costs of the edits and of leaving a truncated row in place (fixed values).
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: States, and a cost that no path has.
START, SYSTEM, USER, ASSISTANT, FAR = 0, 1, 2, 3, 1 << 60
BLANKS = " \t\n\x0b\x0c\r"
KEYS = ["nc", "c", "nt", "t", "d"]
UNITS = ("nc boolean, c long, nt boolean, t long, d binary, steps binary, copies array<long>, blank long, duplicate long, "
         "truncated long, illegal long, head int, tail int")
TRACED = UNITS + ", exits array<int>, ops array<string>, costs array<long>"


# rows

def damaged(conv: DataFrame) -> DataFrame:
    """conv_id and turn as sortable pairs, role, text, n (0: dropped, 2: repeated) and d, the digest of role and text."""
    def say(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn")).cast("binary")) % 20
    rows = conv.select(
        F.col("conv_id").isNotNull().alias("nc"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("c"),
        F.col("turn").isNotNull().alias("nt"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("t"),
        F.when(fault == 4, "user").otherwise(say("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(say("text"), "[.!?]", "")).otherwise(say("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("n"))
    return rows.withColumn("d", F.unhex(F.md5(F.concat_ws("\0", "role", "text").cast("binary"))))


def lattice_rows(rows: DataFrame) -> DataFrame:
    """One row per (conversation, turn, content): initial, whether it is blank, repeated before, cut off, and its count."""
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    light = (rows.filter("n > 0").select(
        *KEYS, "n", F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in zip("sua", (1, 2, 3)) for v in p]),
                                            F.substring("role", 1, 1)), F.lit(0)).alias("initial"),
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
        .groupBy(*KEYS, "initial", "blank", "cut").agg(F.sum("n").alias("n")))
    first = light.groupBy("nc", "c", "d").agg(F.min(F.struct("nt", "t")).alias("first"))
    return light.join(first, ["nc", "c", "d"]).withColumn("seen", F.col("first") != F.struct("nt", "t")).drop("first")


def placed(light: DataFrame) -> DataFrame:
    """Spread by (conversation, block of turns); heavy blocks by (turn, first byte of the digest)."""
    block = light.withColumn("b", F.shiftright("t", TURN_BITS))
    heavy = (block.groupBy("nc", "c", "nt", "b").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > HEAVY)
             .select("nc", "c", "nt", "b", F.lit(True).alias("heavy")))
    marked = block.join(heavy, ["nc", "c", "nt", "b"], "left")
    byte = F.hex(F.substring("d", 1, 1))
    return (marked.withColumn("p", F.when(F.col("heavy"), F.concat_ws(":", F.col("t"), byte)).otherwise(F.lit("")))
            .repartition("nc", "c", "nt", "b", "p").sortWithinPartitions("nc", "c", "nt", "b", "p", "t", "d")
            .select(*KEYS, "initial", "blank", "cut", "seen", "n", "b", "p"))


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((1, 2), (2, 3), (3, 2))


def cut_units(batches):
    """Sorted lattice rows -> units: a byte per step (initial + 4 * kind), counts, and the sums of the report."""
    import pyarrow as pa

    schema = _schema(UNITS)
    unit: dict | None = None
    place, out = None, {f: [] for f in schema.names}

    def close():
        for name in out:
            out[name].append(bytes(unit[name]) if name == "steps" else unit[name])

    for batch in batches:
        for nc, c, nt, t, d, initial, blank, cut, seen, n, b, p in zip(*(col.to_pylist() for col in batch.columns)):
            here = (nc, c, nt, b, p)
            if unit is None or here != place or len(unit["steps"]) >= UNIT:
                if unit is not None:
                    close()
                unit = dict(nc=nc, c=c, nt=nt, t=t, d=d, steps=bytearray(), copies=[], blank=0, duplicate=0, truncated=0,
                            illegal=0, head=initial, tail=None)
                place = here
            kind = 1 if blank or seen else 2 if cut else 0
            unit["steps"].append(initial + 4 * kind)
            unit["copies"].append(n)
            unit["blank"] += n if blank else 0
            unit["duplicate"] += 0 if blank else n if seen else n - 1
            unit["truncated"] += kind == 2
            unit["illegal"] += n - 1 + (unit["tail"] is not None and not _legal(unit["tail"], initial))
            unit["tail"] = initial
        if out["c"]:
            yield records(schema, out)
            out = {f: [] for f in schema.names}
    if unit is not None:
        close()
        yield records(schema, out)


def _schema(text: str):
    import pyarrow as pa

    types = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(),
             "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, types[kind]) for name, kind in (part.split() for part in text.split(", "))])


# lattice and auction

def arcs_of(steps: bytes, copies: list[int], after: list[int], last: bool) -> tuple[list[list[tuple[int, str, int]]], list[int]]:
    """Arcs (cost, initial, head) of every node 4 * i + state and lower bounds of the distance to the goal as first prices.

    ``after`` holds the cost from each state behind the unit; only the last unit may insert behind its last row.
    """
    n = len(steps)
    goal = 4 * (n + 1)
    arcs: list[list[tuple[int, str, int]]] = [[] for _ in range(goal + 1)]
    prices = [0] * (goal + 1)
    floor = min(after)
    for state in range(4):
        if after[state] < FAR:
            arcs[4 * n + state].append((after[state], "", goal))
        prices[4 * n + state] = floor
    for i in range(n, -1, -1):
        if i < n or last:
            for state in range(4):
                then = ASSISTANT if state == USER else USER
                arcs[4 * i + state].append((INSERT, "I", 4 * i + then))
        if i == n:
            continue
        initial, kind = steps[i] % 4, steps[i] // 4
        more, stay = DELETE * (copies[i] - 1), TRUNCATED if kind == 2 else 0
        floor += more + (DELETE if kind else 0)
        for state in range(4):
            node = 4 * i + state
            prices[node] = floor
            arcs[node].append((more + DELETE, "D", node + 4))
            if kind == 1:
                continue
            then = ASSISTANT if state == USER else USER
            if initial == then or (initial == SYSTEM and state == START):
                arcs[node].append((more + stay, "K", 4 * i + 4 + initial))
            if initial != then:
                arcs[node].append((more + stay + REROLE, "R", 4 * i + 4 + then))
    return arcs, prices


def auction(arcs: list[list[tuple[int, str, int]]], prices: list[int], source: int, limit: int) -> int:
    """Raises ``prices`` until a path of tight arcs joins the source to the goal (the last node); returns its length.

    No path is as long as ``limit``: a source whose price gets there is cut off from the goal.
    """
    goal, path = len(arcs) - 1, [source]
    while path[-1] != goal:
        node = path[-1]
        best, head = limit, -1
        for cost, _, to in arcs[node]:
            if cost + prices[to] < best:
                best, head = cost + prices[to], to
        if prices[node] < best:
            prices[node] = best
            if len(path) > 1:
                path.pop()
        elif best >= limit:
            return FAR
        else:
            path.append(head)
    return prices[source]


def least_trace(arcs: list[list[tuple[int, str, int]]], prices: list[int], source: int) -> tuple[str, int]:
    """(initials, exit state) of the ASCII-least path of tight arcs from the source to the goal."""
    goal = len(arcs) - 1
    leads = [False] * goal + [True]
    for i in range(goal // 4 - 1, -1, -1):
        for _ in range(3):
            for node in range(4 * i, 4 * i + 4):
                leads[node] = leads[node] or any(leads[to] and prices[node] == cost + prices[to] for cost, _, to in arcs[node])
    ops, node = [], source
    while True:
        label, to = min((label, to) for cost, label, to in arcs[node] if leads[to] and prices[node] == cost + prices[to])
        if to == goal:
            return "".join(ops), node % 4
        ops.append(label)
        node = to


def longest(copies: list[int], after: list[int]) -> int:
    """Above the cost of any cheapest path: delete all rows, or all but one and two insertions."""
    return DELETE * sum(copies) + TRUNCATED + REROLE + 2 * INSERT + max(a for a in after if a < FAR) + 1


CLOSED = [0, FAR, FAR, 0]
#: Cost of ending a conversation in each state, insertions included.
ENDING = [0, 2 * INSERT, INSERT, 0]


def unit_costs(steps: bytes, copies: list[int]) -> list[int]:
    """Cost from each entry state (rows) to each exit state (columns), without insertions behind the last row."""
    found = [FAR] * 16
    for out in range(4):
        after = [0 if s == out else FAR for s in range(4)]
        arcs, prices = arcs_of(steps, copies, after, False)
        for state in range(4):
            if out >= USER or state <= out:
                found[4 * state + out] = auction(arcs, prices, state, longest(copies, after))
    return found


def trace_unit(steps: bytes, copies: list[int], after: list[int] | None, entries: Iterable[int]):
    """(exits, ops, costs) for the entry states; ``after`` is None for the last unit."""
    exits, ops, costs = [0] * 4, [""] * 4, [FAR] * 4
    arcs, prices = arcs_of(steps, copies, after or CLOSED, after is None)
    for state in entries:
        costs[state] = auction(arcs, prices, state, longest(copies, after or CLOSED))
        if costs[state] < FAR:
            ops[state], exits[state] = least_trace(arcs, prices, state)
    return exits, ops, costs


def _with(batches, text: str, add):
    schema = _schema(text)
    for batch in batches:
        rows = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        rows.update(add(rows))
        yield records(schema, rows)


def traced_units(units: DataFrame) -> DataFrame:
    """Every unit with exits, ops and costs; index 0 of each array belongs to the entry state that is taken."""
    key = ["nc", "c"]
    many = units.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")

    def alone(batches):
        def add(rows):
            found = [trace_unit(s, k, None, (START,)) for s, k in zip(rows["steps"], rows["copies"])]
            return dict(zip(("exits", "ops", "costs"), ([f[i][:1] for f in found] for i in range(3))))
        return _with(batches, TRACED, add)

    def costs(batches):
        return _with(batches, UNITS + ", m array<long>", lambda rows: {
            "m": [unit_costs(s, k) for s, k in zip(rows["steps"], rows["copies"])]})

    def backward(batches):
        mine, price = None, ENDING

        def add(rows):
            nonlocal mine, price
            found = []
            for nc, c, m in zip(rows["nc"], rows["c"], rows["m"]):
                if (nc, c) != mine:
                    mine, price = (nc, c), ENDING
                    found.append(None)
                else:
                    found.append(price)
                price = [min(FAR, *(m[4 * s + x] + price[x] for x in range(4))) for s in range(4)]
            return {"after": found}
        return _with(batches, UNITS + ", after array<long>", add)

    def choices(batches):
        def add(rows):
            found = [trace_unit(s, k, a, range(4)) for s, k, a in zip(rows["steps"], rows["copies"], rows["after"])]
            return dict(zip(("exits", "ops", "costs"), ([f[i] for f in found] for i in range(3))))
        return _with(batches, TRACED, add)

    def forward(batches):
        mine, state = None, START

        def add(rows):
            nonlocal mine, state
            taken = {"exits": [], "ops": [], "costs": []}
            for i, place in enumerate(zip(rows["nc"], rows["c"])):
                if place != mine:
                    mine, state = place, START
                for name, picked in taken.items():
                    picked.append([rows[name][i][state]])
                state = rows["exits"][i][state]
            return taken
        return _with(batches, TRACED, add)

    long = units.join(many, key, "left_semi").select(*units.columns).mapInArrow(costs, UNITS + ", m array<long>")
    down = [F.col(k).desc() for k in KEYS]
    priced = long.repartition(*key).sortWithinPartitions(*down).mapInArrow(backward, UNITS + ", after array<long>")
    chosen = priced.repartition(*KEYS).mapInArrow(choices, TRACED).repartition(*key).sortWithinPartitions(*KEYS)
    single = units.join(many, key, "left_anti").select(*units.columns).mapInArrow(alone, TRACED)
    return single.unionByName(chosen.mapInArrow(forward, TRACED))


# report

REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
SPELLED = {USER: "user", ASSISTANT: "assistant"}


class _Conversation:
    """Reads one conversation's units and rows in order."""

    def __init__(self, conv_id: int | None):
        from hashlib import sha256

        self.conv_id, self.sums, self.cost, self.audit = conv_id, [0, 0, 0, 0], None, []
        self.sha, self.empty, self.state, self.tail = sha256(), True, START, None
        self.low = self.high = None
        self.turns, self.ops, self.at, self.key = 0, "", 0, None

    def unit(self, sums: list[int], head: int, tail: int, ops: str, cost: int) -> None:
        self.sums = [a + b for a, b in zip(self.sums, sums)]
        if self.tail is not None and not _legal(self.tail, head):
            self.sums[3] += 1
        self.tail, self.ops, self.at = tail, ops, 0
        self.cost = cost if self.cost is None else self.cost

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def inserts(self) -> None:
        while self.ops[self.at : self.at + 1] == "I":
            self.state = ASSISTANT if self.state == USER else USER
            self.line(SPELLED[self.state], "")
            self.audit.append("I")
            self.at += 1

    def row(self, turn: int | None, key: tuple, role: str, text: str, n: int) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        if key != self.key:
            self.key = key
            self.inserts()
            op = self.ops[self.at]
            self.at += 1
            self.audit.append(op)
            n -= 1
            if op == "K":
                self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
                self.line(role, text)
            elif op == "R":
                self.state = ASSISTANT if self.state == USER else USER
                self.line(SPELLED[self.state], text)
        self.audit.append("D" * n)

    def report(self) -> tuple:
        self.inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.sums, self.cost or 0, "".join(self.audit), self.sha.hexdigest())


def read_in_order(batches) -> Iterator:
    schema = _schema(REPORT)
    now, mine, out = None, None, []
    for batch in (b.slice(i, READ) for b in batches for i in range(0, b.num_rows, READ)):
        names = batch.schema.names
        for row in zip(*(batch.column(name).to_pylist() for name in names)):
            r = dict(zip(names, row))
            if (r["nc"], r["c"]) != mine:
                if now is not None:
                    out.append(now.report())
                mine = r["nc"], r["c"]
                now = _Conversation(r["c"] if r["nc"] else None)
            if r["ops"] is not None:
                now.unit(r["sums"], r["head"], r["tail"], r["ops"], r["cost"])
            elif r["n"]:
                now.row(r["t"] if r["nt"] else None, (r["nt"], r["t"], r["d"]), r["role"], r["text"], r["n"])
        if out:
            yield records(schema, dict(zip(schema.names, zip(*out))))
            out = []
    if now is not None:
        out.append(now.report())
        yield records(schema, dict(zip(schema.names, zip(*out))))


def repair(conv: DataFrame) -> DataFrame:
    """One row per conv_id of the input: faults after damage, cheapest edits and the checksum of the repaired rows."""
    rows = damaged(conv)
    light = lattice_rows(rows)
    units, _ = written(placed(light).mapInArrow(cut_units, UNITS), "conversation-units")
    traced = traced_units(units)

    def none(kind: str, name: str) -> Column:
        return F.lit(None).cast(kind).alias(name)

    told = traced.select(*KEYS, F.lit(0).alias("kind"), none("string", "role"), none("string", "text"), none("long", "n"),
                         F.array("blank", "duplicate", "truncated", "illegal").alias("sums"), "head", "tail",
                         F.col("ops")[0].alias("ops"), F.col("costs")[0].alias("cost"))
    kept = F.col("n") > 0
    spoken = rows.select(*KEYS, F.lit(1).alias("kind"), F.when(kept, F.col("role")).alias("role"),
                         F.when(kept, F.col("text")).alias("text"), "n", none("array<long>", "sums"), none("int", "head"),
                         none("int", "tail"), none("string", "ops"), none("long", "cost"))
    return (told.unionByName(spoken).repartition("nc", "c").sortWithinPartitions(*KEYS, "kind")
            .mapInArrow(read_in_order, REPORT))
