"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests, in built-in functions only.

A text's lines are its paragraphs; long ones are cut after full stops, question and exclamation marks and after
``PIECE`` characters, so that an edit touches few pieces.  A piece is its md5, shortened to 60 bits.  A sketch has three
tables of ``2^bits`` cells; each digest falls into one cell of each table (three 20-bit fields of the digest), a cell holds
(count, xor of digests, xor of their checks).  Two sketches of one size subtract cell by cell; what they share vanishes.
Peeling then takes cells that hold a single digest (count of 1 or -1 and the right check), notes the digest and removes it
from its other cells, table after table.  When cells remain the peeling has failed and both texts are sketched anew with
more cells; the sizes end at 2^20 cells a table, beyond that the digests are compared themselves.  Likeness is the share of
common digests, (a + b - d) / (a + b + d) for d recovered ones; 1.0 for two texts without pieces.  The fingerprint is the
smallest sketch (``BASE_BITS``), written out; it depends on nothing but the text.

Work at scale: each text is shuffled once, to a block of the order of ids (below).  The first comparison of every pair is
a stream of its occupied cells, grouped by (block, row, pair, cell): the blocks are already where they must be, so the
sketches, the subtraction and all rounds of peeling are hash aggregations without a further exchange, linear in the
pieces.  Its results come back as one array per block.  The few pairs that fail are sketched larger inside their row.

The next document: rows are ordered by id, nulls first, then by the md5 of the text; equal rows follow each other, so the
next of all but the last of them is an equal row.  The order is cut into blocks at percentiles of the id (an id that is
several percentiles is cut by the md5), at most ``BLOCKS`` of them.  The first row of a block goes to the block before it
as well, so a window inside the block sees every next row.

Edges: a null text is empty; an only row follows itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a piece; bits of the cell index of the fingerprint and of the largest sketch; step of the larger sketches.
PIECE, BASE_BITS, LAST_BITS, STEP = 48, 3, 20, 2

#: Passes over a table in the first comparison and rounds of the later ones; what is not empty after them has failed.
PASSES, ROUNDS = 9, 24

#: Rows of a block and of a task that are aimed at, and the most blocks whose first rows are told to every task.  A task
#: groups some 1,500 cells of each of its rows, which must fit into its memory.
BLOCK_ROWS, TASK_ROWS, BLOCKS = 64, 512, 65536

#: Check of a digest: a product modulo a prime (fixed values).
CHECK_PRIME, CHECK_FACTOR = 2147483647, 1103515245


def pieces(text: Column) -> Column:
    """Distinct 60-bit digests of a text's pieces."""
    found = F.regexp_extract_all(text, F.lit(rf"[^\n.!?]{{0,{PIECE - 1}}}[^\n]"), F.lit(0))
    return F.array_distinct(F.transform(found, digest))


def digest(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def check(key: Column) -> Column:
    return key % CHECK_PRIME * CHECK_FACTOR % CHECK_PRIME


def _shift(way: str, value: Column, bits: Column) -> Column:
    return F.call_function(f"shift{way}", value, bits)


def _field(key: Column, table: int, bits: Column) -> Column:
    return F.shiftright(key, 20 * table).bitwiseAND(_shift("left", F.lit(1).cast("long"), bits) - 1)


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _spread(items: Column, key, table: int, bits: Column, cell) -> Column:
    """One table: items go to 2^(bits/2) rows and inside a row to its cells; ``cell`` makes a cell of its items."""
    low = F.floor(bits / 2).cast("int")
    rows, columns = (_shift("left", F.lit(1), b) - 1 for b in (bits - low, low))

    def row(r: Column) -> Column:
        mine = F.filter(items, lambda x: _shift("right", _field(key(x), table, bits), low) == r)
        return F.transform(F.array(mine), lambda mine: F.transform(F.sequence(F.lit(0), columns), lambda c: cell(
            F.filter(mine, lambda x: _field(key(x), table, low) == c))))[0]

    return F.flatten(F.transform(F.sequence(F.lit(0), rows), row))


def sketch(digests: Column, bits: Column) -> Column:
    """Array of three tables of cells (n, k, h): count, xor of digests, xor of checks."""
    def cell(found: Column) -> Column:
        return F.struct(F.size(found).alias("n"), _xor(found).alias("k"), _xor(F.transform(found, check)).alias("h"))

    return F.array(*[_spread(digests, lambda x: x, t, bits, cell) for t in range(3)])


def subtract(a: Column, b: Column) -> Column:
    def cells(x: Column, y: Column) -> Column:
        return F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h"))

    return F.zip_with(a, b, lambda s, t: F.zip_with(s, t, cells))


def _left(cells: Column) -> Column:
    """Cells that hold something."""
    return F.filter(F.flatten(cells), lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["h"] != 0))


def _single(cells: Column) -> Column:
    """(n, k) of the digests that stand alone in some cell, each once."""
    alone = F.filter(F.flatten(cells), lambda c: (F.abs(c["n"]) == 1) & (c["h"] == check(c["k"])))
    return F.array_distinct(F.transform(alone, lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"))))


def _without(cells: Column, gone: Column, bits: Column) -> Column:
    """Cells after the digests of ``gone`` have been taken out of their cell in each table."""
    def cell(found: Column) -> Column:
        return F.struct(F.aggregate(found, F.lit(0), lambda a, x: a + x["n"]).alias("n"),
                        _xor(F.transform(found, lambda x: x["k"])).alias("k"),
                        _xor(F.transform(found, lambda x: check(x["k"]))).alias("h"))

    return subtract(cells, F.array(*[_spread(gone, lambda x: x["k"], t, bits, cell) for t in range(3)]))


def peel(cells: Column, bits: Column) -> Column:
    """How many digests the difference of two sketches holds; null where it cannot be peeled to the end."""
    def state(cells: Column, alone: Column, n: Column) -> Column:
        return F.struct(cells.alias("cells"), alone.alias("alone"), n.alias("n"))

    def again(s: Column, _: Column) -> Column:
        def on(rest: Column) -> Column:
            return state(rest, _single(rest), s["n"] + F.size(s["alone"]))

        # a lambda's argument holds the new cells, so that they are computed once
        more = F.transform(F.array(_without(s["cells"], s["alone"], bits)), on)[0]
        return F.when(F.size(s["alone"]) > 0, more).otherwise(s)

    def end(s: Column) -> Column:
        return F.when((F.size(s["alone"]) == 0) & (F.size(_left(s["cells"])) == 0), s["n"])

    first = F.transform(F.array(cells), lambda c: state(c, _single(c), F.lit(0)))[0]
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, again, end)


def differing(a: Column, b: Column, tried: Column) -> Column:
    """Number of digests in one of two sets only: sketches of more bits than ``tried``, larger after each failure."""
    def again(found: Column, i: Column) -> Column:
        bits = tried + i * STEP
        return F.coalesce(found, F.when(bits <= LAST_BITS, peel(subtract(sketch(a, bits), sketch(b, bits)), bits)))

    levels = F.sequence(F.lit(1), F.lit((LAST_BITS - BASE_BITS) // STEP + 1))
    return F.coalesce(F.aggregate(levels, F.lit(None).cast("int"), again),
                      F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)))


# the first comparison

def first_bits(a: Column, b: Column) -> Column:
    """Bits of the first comparison: at least as many cells in each table as both sets have digests."""
    digits = F.length(F.bin((F.size(a) + F.size(b)).cast("long")))
    return F.least(F.lit(LAST_BITS), F.greatest(F.lit(BASE_BITS), digits)).cast("int")


def _cell(table: int, n: Column, k: Column, h: Column) -> Column:
    """The cell of digest k in a table, as one number over all tables."""
    return F.struct((F.lit(table << LAST_BITS) + _field(k, table, F.col("bits"))).cast("int").alias("cell"), n.alias("n"), k.alias("k"), h.alias("h"))


def first_comparison(rows: DataFrame, pairs: list[tuple[str, str]], sketched: list[str]) -> DataFrame:
    """block, found: array by row number of struct(rn, d of each pair, whether its peeling failed, the smallest sketches).

    ``rows``: block, rn and the arrays of digests; partitioned by block, which every grouping here contains.
    """
    zero, one, least = F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(BASE_BITS)
    keys, marker = ["block", "rn", "pair", "bits"], F.lit(-1).cast("long")

    def side(pair: int, bits: Column, sign: int, digests: Column) -> Column:
        return F.struct(F.lit(pair).alias("pair"), bits.alias("bits"), F.lit(sign).cast("long").alias("sign"), digests.alias("keys"))

    # digests with their sign; the key -1 stands for the pair itself, so that pairs without digests are there too
    sides = []
    for i, (a, b) in enumerate(pairs):
        bits = first_bits(F.col(a), F.col(b))
        sides += [side(i, bits, 1, F.concat(F.array(marker), F.col(a))), side(i, bits, -1, F.col(b))]
    sides += [side(len(pairs) + i, least, 1, F.col(c)) for i, c in enumerate(sketched)]
    signed = (rows.select("block", "rn", F.explode(F.array(*sides)).alias("s"))
              .select("block", "rn", "s.pair", "s.bits", "s.sign", F.explode("s.keys").alias("k")))
    hashed = F.array(*[_cell(t, F.col("sign"), F.col("k"), check(F.col("k"))) for t in range(3)])
    nothing = F.struct(F.lit(-1).alias("cell"), zero.alias("n"), zero.alias("k"), zero.alias("h"))

    def grouped(df: DataFrame, entries: Column) -> DataFrame:
        cells = df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.cell", "e.n", "e.k", "e.h")
        return (cells.groupBy(*keys, "cell").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
                .filter("cell < 0 or n <> 0 or k <> 0 or h <> 0"))

    cells = grouped(signed, F.when(F.col("k") < 0, F.array(nothing)).otherwise(hashed))
    own = F.struct("cell", "n", "k", "h")
    for turn in range(PASSES):
        table = turn % 3
        single = ((F.col("pair") < len(pairs)) & (F.shiftright("cell", LAST_BITS) == table) & (F.abs("n") == 1) &
                  (F.col("h") == check(F.col("k"))))
        noted = F.struct(F.lit(-1).alias("cell"), one.alias("n"), zero.alias("k"), zero.alias("h"))
        gone = F.array(noted, *[_cell(t, -F.col("n"), F.col("k"), F.col("h")) for t in range(3) if t != table])
        cells = grouped(cells, F.when(single, gone).otherwise(F.array(own)))
    wide = []
    for i in range(len(pairs)):
        mine = F.col("pair") == i
        wide += [F.sum(F.when(mine & (F.col("cell") < 0), F.col("n")).otherwise(0)).alias(f"d{i}"),
                 F.max(mine & (F.col("cell") >= 0)).alias(f"failed{i}")]
    wide += [F.sort_array(F.collect_list(F.when(F.col("pair") == len(pairs) + i, own))).alias(f"s{i}") for i in range(len(sketched))]
    found = cells.groupBy("block", "rn").agg(*wide).withColumns({f"s{i}": written_out(F.col(f"s{i}")) for i in range(len(sketched))})
    names = [f"{n}{i}" for i in range(len(pairs)) for n in ("d", "failed")] + [f"s{i}" for i in range(len(sketched))]
    return found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("rn", *names))).alias("found"))


def likenesses(found: Column, pairs: list[tuple[str, str]]) -> Column:
    """Array with the likeness of every pair, from the first comparison or from larger sketches where that failed."""
    def one(p: Column) -> Column:
        d = F.when(p["failed"], differing(p["a"], p["b"], first_bits(p["a"], p["b"]))).otherwise(p["d"])
        both = F.size(p["a"]) + F.size(p["b"])
        return F.transform(F.array(F.struct(d.alias("d"), both.alias("both"))), lambda x: F.when(x["both"] == 0, 1.0).otherwise(
            (x["both"] - x["d"]) / (x["both"] + x["d"]).cast("double")))[0]

    return F.transform(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b"), found[f"d{i}"].alias("d"),
                                          found[f"failed{i}"].alias("failed")) for i, (a, b) in enumerate(pairs)]), one)


def written_out(cells: Column) -> Column:
    """The occupied cells of a sketch as text: place, then hexadecimal count, digest and check."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws("-", *[F.lower(F.hex(c[part])) for part in (
        "cell", "n", "k", "h")])), " ")


# the next document

def _block(order: list[int], doc_id: Column, tie: Column) -> Column:
    """Number of percentiles below the id (binary search), plus the tie's share of those that equal it."""
    bounds, n = _texts(order).cast("array<long>"), len(order)

    def below(strict: bool) -> Column:
        def step(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            at = F.get(bounds, mid)
            right = (at < doc_id) if strict else (at <= doc_id)
            open_ = s["lo"] < s["hi"]
            return F.struct(F.when(open_ & right, mid + 1).otherwise(s["lo"]).alias("lo"),
                            F.when(open_ & ~right, mid).otherwise(s["hi"]).alias("hi"))

        start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), start, step, lambda s: s["lo"])

    low = below(True)
    return F.when(doc_id.isNull(), -1).otherwise(
        low + F.floor(tie / float(1 << 60) * (below(False) - low))).cast("int")


def _texts(values: list) -> Column:
    """One literal array of numbers as texts, however long; nothing is the empty text."""
    return F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",")


def placed(docs: DataFrame, block_rows: int = BLOCK_ROWS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, tie, text, block, sentinel: every row in its block, and the first row of a block also in the one before."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    parts = max(1, min(blocks, n // block_rows))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, 20 * parts).alias("q")).first()["q"] or [0]
    keyed = (rows.withColumn("tie", digest(F.col("text")))
             .withColumn("block", _block(bounds, F.col("doc_id"), F.col("tie")) + 1))
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("first")
    firsts = {r["block"]: r["first"] for r in keyed.groupBy("block").agg(least).collect()}  # at most len(bounds) + 2 rows
    there = sorted(firsts)
    before = dict(zip(there, [there[-1], *there[:-1]])) if there else {}
    every = range(len(bounds) + 2)
    ids = _texts([firsts[b]["doc_id"] if b in firsts else None for b in every])
    ties = _texts([firsts[b]["tie"] if b in firsts else None for b in every])
    back = F.get(_texts([before.get(b, 0) for b in every]), F.col("block")).cast("int")
    here = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    is_first = (F.get(ids, F.col("block")) == here) & (F.get(ties, F.col("block")) == F.col("tie").cast("string"))
    stay = F.struct(F.col("block").alias("block"), F.lit(False).alias("sentinel"))
    ahead = F.struct(back.alias("block"), F.lit(True).alias("sentinel"))
    return (keyed.withColumn("to", F.explode(F.when(is_first, F.array(stay, ahead)).otherwise(F.array(stay))))
            .select("doc_id", "tie", "text", "to.block", "to.sentinel").repartition(n // TASK_ROWS + 1, "block"))


def fingerprint_documents(docs: DataFrame, block_rows: int = BLOCK_ROWS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per input row."""
    w = Window.partitionBy("block").orderBy("sentinel", F.col("doc_id").asc_nulls_first(), "tie")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = (placed(docs, block_rows, blocks).withColumn("next", F.lead("text").over(w)).withColumn("rn", F.row_number().over(w))
            .withColumn("n_chars", F.length("text"))
            .withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - half),
                                           F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)))
            .select("doc_id", "tie", "block", "sentinel", "rn", F.col("n_chars").cast("long").alias("n_chars"),
                    F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), pieces(F.col("text")).alias("own"),
                    pieces(F.col("edited")).alias("changed"))
            .withColumn("following", F.lead("own").over(w)).filter(~F.col("sentinel")))
    pairs = [("own", "changed"), ("own", "following")]
    compared = first_comparison(rows, pairs, ["own", "changed"]).hint("merge")  # grows with the table: never broadcast
    # taken out of the block's array beside the join, before anything that is not compiled
    at = F.coalesce(F.get("found", F.col("rn") - 1), F.get("found", F.lit(0)))
    near = F.col("near")
    return (rows.join(compared, "block").withColumn("at", at).withColumn("near", likenesses(F.col("at"), pairs))
            .select("doc_id", "n_chars", "edited_sha256", F.col("at.s0").alias("fingerprint"),
                    F.col("at.s1").alias("edited_fingerprint"), near[0].alias("near_edited"), near[1].alias("near_next")))


def duckdb_sql() -> str:
    """The same with sets of digests compared directly."""
    pieces_ = rf"""list_distinct(list_transform(regexp_extract_all({{0}}, '[^\n.!?]{{{{0,{PIECE - 1}}}}}[^\n]'),
        lambda p: ('0x' || substr(md5(p), 1, 15))::BIGINT))"""
    return f"""WITH said AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
      ordered AS (SELECT r, doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next FROM said
        WINDOW w AS (ORDER BY doc_id NULLS FIRST, substr(md5(text), 1, 15) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
      edits AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next, length(text) // 2) AS edited FROM ordered),
      sets AS (SELECT r, doc_id, text, edited, {pieces_.format('text')} AS own, {pieces_.format('edited')} AS changed,
        {pieces_.format('next')} AS following FROM edits),
      cells AS (SELECT r, which, t * 1048576 + ((k >> (20 * t)) & {(1 << BASE_BITS) - 1}) AS cell, count(*) AS n, bit_xor(k) AS k,
        bit_xor(k % {CHECK_PRIME} * {CHECK_FACTOR} % {CHECK_PRIME}) AS h FROM (SELECT r, 0 AS which, unnest(own) AS k FROM sets
        UNION ALL SELECT r, 1, unnest(changed) FROM sets) CROSS JOIN range(3) x(t) GROUP BY ALL),
      told AS (SELECT r, which, string_agg(lower(hex(cell)) || '-' || lower(hex(n)) || '-' || lower(hex(k)) || '-' || lower(hex(h)),
        ' ' ORDER BY cell) AS s FROM cells GROUP BY ALL)
      SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, coalesce(a.s, '') AS fingerprint,
        coalesce(b.s, '') AS edited_fingerprint,
        CASE WHEN len(own) + len(changed) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(own, changed)) /
          (len(own) + len(changed) - len(list_intersect(own, changed)))::DOUBLE END AS near_edited,
        CASE WHEN len(own) + len(following) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(own, following)) /
          (len(own) + len(following) - len(list_intersect(own, following)))::DOUBLE END AS near_next
      FROM sets LEFT JOIN told a ON a.r = sets.r AND a.which = 0 LEFT JOIN told b ON b.r = sets.r AND b.which = 1"""
