"""Sharding by jump consistent hashing, in built-in functions only.

The key and the number of shards decide the shard (law ``key``): the published generator (a 64-bit linear congruence)
jumps ahead until it passes the number of shards; with one more shard a row stays or moves to the new one. The 64-bit
product is done on two 32-bit halves, because Spark's arithmetic raises on overflow. A chain of jumps takes about ln(n)
steps; a fixed number is applied to every row and the rest of the chain only to the rows that need it.

Rows that agree in id, size and checksum are counted before the shuffle and numbered as one block. Slots are numbered in
sub-groups of a shard, so no shard is one task. Edges: a null id hashes as 0, a null text has size 16 and checksum 0, an
empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The generator's multiplier, 2862933555777941757, as high and low 32 bits, the low ones again as 16 + 16 bits.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_LOW1, _LOW0 = _LOW >> 16, _LOW & 0xFFFF
_MASK = 0xFFFFFFFF

#: Sub-groups in which the slots of a shard are numbered.
SPREAD = 256

#: Jumps made for every row; longer chains go on in a second expression.
USUAL = 16


def _times(half: Column) -> tuple[Column, Column]:
    """(low 32 bits, carry) of a 32-bit half times the multiplier's low half."""
    p1 = half * F.lit(_LOW1)
    low = half * F.lit(_LOW0) + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16)
    return low, F.shiftright(p1, 16)


def _jump(s: Column, shards: int) -> Column:
    """One step of the published loop; a chain that has passed ``shards`` stays as it is."""
    hi, lo, j = s["hi"], s["lo"], s["j"]
    low, carry = _times(lo)
    low = low + F.lit(1)
    high = (F.shiftright(low, 32) + carry + (lo * F.lit(_HIGH)).bitwiseAND(F.lit(_MASK)) +
            _times(hi)[0].bitwiseAND(F.lit(_MASK))).bitwiseAND(F.lit(_MASK))
    low = low.bitwiseAND(F.lit(_MASK))
    ahead = F.floor((j + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double")))
    on = j < F.lit(shards)
    return F.struct(F.when(on, high).otherwise(hi).alias("hi"), F.when(on, low).otherwise(lo).alias("lo"),
                    F.when(on, j).otherwise(s["b"]).alias("b"), F.when(on, ahead).otherwise(j).alias("j"))


def jump_chain(key: Column, shards: int) -> Column:
    """struct(hi, lo, b, j): b is the shard, j the next place the chain would jump to (``shards`` or beyond)."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(F.shiftright(key, 32).bitwiseAND(F.lit(_MASK)).alias("hi"), key.bitwiseAND(F.lit(_MASK)).alias("lo"),
                     (zero - 1).alias("b"), zero.alias("j"))

    def go(state: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, lambda s, _: _jump(s, shards))

    return go(start, min(USUAL, shards + 1))


def jump_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Adds shard and grown_shard (the shard when there is one more)."""
    def go(state: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), state, lambda s, _: _jump(s, shards))

    first = df.withColumn("_chain", jump_chain(F.col(key), shards))
    s = F.when(F.col("_chain.j") >= shards, F.col("_chain")).otherwise(go(F.col("_chain")))
    return (first.withColumn("_end", s)
            .withColumn("shard", F.col("_end.b").cast("int"))
            .withColumn("grown_shard", F.when(F.col("_end.j") == shards, F.lit(shards)).otherwise(F.col("shard")).cast("int"))
            .drop("_chain", "_end"))


def shard_documents(docs: DataFrame, shards: int = 40, spread: int = SPREAD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per input row, slots gapless per shard.

    Slots follow (id mod ``spread``, id), whatever the cluster.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    placed = jump_shards(counted, "doc_id", shards).withColumn(
        "sub", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(spread)))
    sizes = placed.groupBy("shard", "sub").agg(F.sum("n").alias("t"))
    before = sizes.select("shard", "sub", (F.sum("t").over(Window.partitionBy("shard").orderBy("sub")) - F.col("t"))
                          .alias("before"))
    own = Window.partitionBy("shard", "sub").orderBy("doc_id", "size", "text_crc32")
    first = F.col("before") + F.sum("n").over(own) - F.col("n")
    return (placed.join(before, ["shard", "sub"]).withColumn("first", first)
            .withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"))


def duckdb_sql(shards: int = 40, spread: int = SPREAD) -> str:
    """The same by 128-bit arithmetic and a recursive walk; crc32 by its table, byte after byte."""
    return f"""WITH RECURSIVE steps AS (SELECT 0 AS k, i AS entry, i::BIGINT AS c FROM range(256) t(i) UNION ALL
        SELECT k + 1, entry, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
      lookup AS (SELECT list(c ORDER BY entry) AS t FROM steps WHERE k = 8),
      docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
      sums AS (SELECT doc_id, strlen(text) + 16 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM docs, lookup),
      walk AS (SELECT DISTINCT doc_id, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616 AS key,
        -1::BIGINT AS b, 0::BIGINT AS j FROM docs UNION ALL
        SELECT doc_id, next AS key, j AS b, floor((j + 1) * (2147483648.0::DOUBLE / ((next // 8589934592) + 1)::DOUBLE))::BIGINT AS j
        FROM (SELECT doc_id, j, (key * {MULTIPLIER} + 1) % 18446744073709551616 AS next FROM walk WHERE j < {shards})),
      placed AS (SELECT doc_id, b::INTEGER AS shard, (CASE WHEN j = {shards} THEN {shards} ELSE b END)::INTEGER AS grown_shard
        FROM walk WHERE j >= {shards})
      SELECT s.doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY
        (coalesce(s.doc_id, 0) % {spread} + {spread}) % {spread}, s.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
      FROM sums s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id"""
