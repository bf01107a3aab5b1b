"""What the operators share: reading a table, held-out rows, bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

#: Characters of text that a Python worker turns into strings at once (a longer text is a slice of its own).
SLICE = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(doc_id: str | Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def held_out(modulus: int, remainder: int, doc_id: str | Column = "doc_id") -> Column:
    return crc_of_id(doc_id) % modulus == remainder


def bounded_sample(docs: DataFrame, keys: DataFrame, label: str, cap: int, labels: int) -> DataFrame:
    """doc_id, label, text: at most ``cap`` distinct (doc_id, text) of each of the ``labels`` most frequent labels, by a hash.

    ``keys`` holds doc_id, label and the hash of the text (``text_key``) of the rows that may be taken; a row that stands many
    times counts once.  Keys are counted per label and kept below a hash bound that leaves about twice the cap; these fall into
    256 ranges of the hash, of which only the one where the cap is reached is ranked, so no task sees a whole label.  Texts are
    joined to the at most ``cap * labels`` keys that stay and never shuffled otherwise.
    """
    keys, _ = written(keys.select("doc_id", label, "_h").distinct(), "sample-keys")
    counts = keys.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), label).limit(labels)
    share = F.pmod(F.xxhash64("doc_id", "_h"), F.lit(1 << 30)) / float(1 << 30) * F.col("_n") / float(2 * cap + 64)
    few = keys.join(F.broadcast(counts), label).withColumn("_s", share).filter("_s < 1").withColumn(  # at most ``labels`` rows
        "_range", F.floor(F.col("_s") * 256).cast("int")).drop("_n")
    few, _ = written(few, "sample-few")
    sums = few.groupBy(label, "_range").agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy(label).orderBy("_range")  # at most 256 rows of a label
    sums = sums.withColumn("_before", F.sum("_n").over(up) - F.col("_n")).filter(F.col("_before") < cap)
    near = few.join(F.broadcast(sums), [label, "_range"])  # at most 256 rows for each label
    rank = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_s", "doc_id", "_h"))
    picks = near.withColumn("_r", F.col("_before") + rank).filter(F.col("_r") <= cap).select("doc_id", label, "_h")
    return (docs.select("doc_id", "text").withColumn("_h", text_key()).join(F.broadcast(picks), ["doc_id", "_h"])
            .groupBy("doc_id", label, "_h").agg(F.first("text").alias("text")).drop("_h"))


def text_key() -> Column:
    """Hash by which ``bounded_sample`` tells texts apart."""
    return F.xxhash64("text").alias("_h")


#: What a Python worker remembers between tasks, and how to forget it.
_memories: dict[str, Callable[[], None]] = {}


def remember(owner: str, forget: Callable[[], None]) -> None:
    _memories[owner] = forget


def slices(batches, text: str = "text", budget: int = SLICE, owner: str = "") -> Iterator[tuple]:
    """(record batch, its texts) in slices of bounded length; a null text is None.

    A worker serves one operator after another: what operators other than ``owner`` remember is given up first.
    """
    import pyarrow.compute as pc

    for name, forget in _memories.items():
        if name != owner:
            forget()
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(at)), 0).cast("int64")).to_numpy()
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(ends.searchsorted(base + budget, "right")))
            part = batch.slice(start, stop - start)
            yield part, part.column(at).to_pylist()
            start, base = stop, int(ends[stop - 1])


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def records(schema, columns: dict):
    """A record batch from columns by name."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
