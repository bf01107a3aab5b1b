"""Packing by best-fit decreasing, planned on the histogram of piece lengths and applied to the pieces in parallel.

Overlong documents are first cut into full windows and a rest. Best-fit decreasing looks only at lengths, so its whole
course follows from how many pieces have each length: at most ``capacity`` numbers, whatever the size of the corpus. A
segment tree over the remaining capacity finds the tightest open window; windows that are filled alike are handled as
one range. The outcome is the one of piece-by-piece best-fit decreasing. Spark then numbers the pieces of a length
(in sub-groups, so that no length is one task) and looks every number up in the plan, whose size the capacity bounds.

Edges: a null text is empty and gives one piece that holds the end id; equal rows are packed once each; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import parallelism, slices

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """Full windows and the rest of every document, with the checksum of their ids."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()),
                        ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def cut(batches):
        from zlib import crc32

        from .common import records
        from .tokens import encoder

        enc, end, step = encoder(tokenizer), end_id.to_bytes(4, "little"), 4 * capacity
        for part, texts in slices(batches, owner="tokens"):
            rows = {k: [] for k in schema.names}
            for doc_id, raw in zip(part.column(0).to_pylist(), enc.encode(texts)):
                raw += end
                for i in range(0, len(raw), step):
                    ids = raw[i : i + step]
                    for k, v in zip(schema.names, (doc_id, i // 4, len(ids) // 4, crc32(ids), len(raw) // 4)):
                        rows[k].append(v)
            yield records(schema, rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        cut, PIECES)


class CapacityTree:
    """Segment tree over remaining capacities: which ones some open window has, and the tightest that still fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.leaves)

    def set(self, room: int, value: bool) -> None:
        i = self.leaves + room
        self.some[i] = value
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest room of at least ``need`` that is present."""
        i = self.leaves + need
        if self.some[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first window, pieces per window, offset of the first piece there)."""
    tree, open_, plan, windows = CapacityTree(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, fits = capacity, capacity // length
                first, n = windows, -(-left // fits)
                windows += n
            else:
                fits = room // length
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    tree.set(room, False)
            full = min(n, left // fits)
            per, used = (fits, full) if full else (left, 1)
            plan.append((length, rank, rank + per * used, first, per, capacity - room))
            put(room - per * length, first, used)
            rank, left = rank + per * used, left - per * used
            if used < n:
                put(room, first + used, n - used)
    return plan


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces, _ = written(token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    sub = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parallelism(spark))).alias("sub")
    sizes = pieces.groupBy("length", sub).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(best_fit_plan(counts, capacity),
                                 "p_length int, lo long, hi long, first long, per long, base long")
    by = Window.partitionBy("length").orderBy("sub")
    before = sizes.select("length", "sub", (F.sum("n").over(by) - F.col("n")).alias("before"))
    own = Window.partitionBy("length", "sub").orderBy("doc_id", "start", "ids_crc32")
    ranked = (pieces.withColumn("sub", sub).withColumn("rn", F.row_number().over(own)).join(before, ["length", "sub"])
              .withColumn("rank", F.col("before") + F.col("rn") - 1))
    k = F.col("rank") - F.col("lo")
    return (ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (k >= 0) & (F.col("rank") < F.col("hi")))
            .select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
                    (F.col("first") + F.expr("(rank - lo) div per")).alias("sequence_id"),
                    (F.col("base") + k % F.col("per") * F.col("length")).alias("offset")))
