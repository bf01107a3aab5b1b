"""Token-ID output: Arrow files of equal-length sequences with masks, read back by position without copying.

A shard is one Arrow IPC file with two fixed-size-list columns, ``ids`` and ``mask``. Documents follow each other in
ascending id order, each closed by the end id, and the stream of a shard is cut into sequences of ``length`` ids; only
the last one is padded (mask false). Fixed-size lists have no offsets: sequence i of a memory-mapped file is a slice.
Shards are ranges of the id, so the order of the files is the order of the documents.

Edges: a null text is an empty one (only the end id); equal ids are ordered by a hash of their text; a null id comes
first; an empty table gives no shard and no rows; other columns of the input are ignored. A task writes under a name of
its own and renames it at the end, so a repeated attempt replaces the same content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, written
from .common import parallelism, slices

#: Sequences in one record batch of a file.
BATCH = 256

INDEX = "shard int, ordinal long, doc_id long, local_start long, n_tokens long"


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, length: int = 2048,
                    shards: int | None = None) -> DataFrame:
    """Write the files to ``folder`` (shared by all executors) and return their index, one row per document."""
    import pyarrow as pa

    shards = shards or parallelism(docs.sparkSession)
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
               .withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))
    index_schema = pa.schema([("shard", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()),
                              ("local_start", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches):
        import numpy as np
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        from .common import records
        from .tokens import encoder

        task, enc = TaskContext.get(), encoder(tokenizer)
        kind = np.dtype("<u2") if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.dtype("<u4")
        schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        fs, root = FileSystem.from_uri(folder)
        shard = task.partitionId()
        own, final = f"{root}/.shard-{shard:06d}-{task.taskAttemptId()}", f"{root}/shard-{shard:06d}.arrow"
        sink = writer = None
        waiting, held, total, ordinal = [], 0, 0, 0

        def put(ids, real):
            lists = pa.FixedSizeListArray.from_arrays
            mask = np.arange(len(ids)) < real
            writer.write_batch(pa.RecordBatch.from_arrays([lists(pa.array(ids), length), lists(pa.array(mask), length)],
                                                          schema=schema))

        for part, texts in slices(batches, owner="tokens"):
            if writer is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(own)
                writer = pa.ipc.new_file(sink, schema)
            starts, sizes = [], []
            for raw in enc.encode(texts):
                ids = np.append(np.frombuffer(raw, "<u4").astype(kind), kind.type(end_id))
                starts.append(total)
                sizes.append(len(ids))
                total += len(ids)
                waiting.append(ids)
                held += len(ids)
                if held >= BATCH * length:
                    flat = np.concatenate(waiting)
                    full = held // (BATCH * length) * (BATCH * length)
                    for i in range(0, full, BATCH * length):
                        put(flat[i : i + BATCH * length], BATCH * length)
                    waiting, held = [flat[full:]], held - full
            n = len(texts)
            yield records(index_schema, {"shard": [shard] * n, "ordinal": range(ordinal, ordinal + n),
                                         "doc_id": part.column(0), "local_start": starts, "n_tokens": sizes})
            ordinal += n
        if writer is not None:
            if held:
                flat = np.concatenate(waiting)
                put(np.pad(flat, (0, -held % length)), held)
            writer.close()
            sink.close()
            fs.move(own, final)

    return ordered.mapInArrow(write, INDEX)


class ShardReader:
    """Random access to the files of a folder; local files are mapped, others are read by record batch."""

    def __init__(self, folder: str):
        from pyarrow.fs import FileSystem

        self.fs, self.root = FileSystem.from_uri(folder)
        self.shard = self.batch = None

    def _open(self, shard: int):
        import pyarrow as pa
        from pyarrow.fs import LocalFileSystem

        if shard != self.shard:
            path = f"{self.root}/shard-{shard:06d}.arrow"
            source = pa.memory_map(path) if isinstance(self.fs, LocalFileSystem) else self.fs.open_input_file(path)
            self.file, self.shard, self.batch = pa.ipc.open_file(source), shard, None
            self.length = self.file.schema.field("ids").type.list_size
        return self.file

    def ids(self, shard: int, start: int, n: int):
        """The ids [start, start + n) of a shard's stream; padding is never part of it."""
        import numpy as np

        file = self._open(shard)
        per, out = BATCH * self.length, []
        while n:
            k, at = divmod(start, per)
            if k != self.batch:
                b = file.get_batch(k)
                self.flat = b.column(0).flatten().to_numpy()
                self.real = b.column(1).flatten().true_count
                self.batch = k
            take = min(n, per - at)
            if at + take > self.real:
                raise ValueError(f"shard {shard} ends before {start + take}")
            out.append(self.flat[at : at + take])
            start, n = start + take, n - take
        return np.concatenate(out)


def read_sequences(index: DataFrame, folder: str) -> DataFrame:
    """The index with ``ids_crc32`` and ``n_tokens`` taken from the files."""
    import pyarrow as pa

    schema = pa.schema([("shard", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()),
                        ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        from zlib import crc32

        reader = ShardReader(folder)
        for batch in batches:
            sizes, sums = [], []
            for r in zip(*(batch.column(c).to_pylist() for c in ("shard", "local_start", "n_tokens"))):
                ids = reader.ids(*r)
                sizes.append(len(ids))
                sums.append(crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                                             schema=schema)

    return index.select("shard", "ordinal", "doc_id", "local_start", "n_tokens").mapInArrow(read, INDEX + ", ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 2048,
                shards: int | None = None) -> DataFrame:
    """Write, read back and place every document in the whole stream (one row per input row).

    Columns: doc_id, start (ids of all documents before), n_tokens, ids_crc32, shard, local_start, folder.
    """
    folder = scratch_path(docs.sparkSession, "token-files")
    index, _ = written(write_sequences(docs, folder, tokenizer, end_id, length, shards), "token-index")
    before = index.groupBy("shard").agg(F.sum("n_tokens").alias("t")).select(
        F.col("shard").alias("s"), (F.sum("t").over(Window.orderBy("shard")) - F.col("t")).alias("before"))
    return (read_sequences(index, folder).join(before, F.col("shard") == F.col("s"))
            .select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32",
                    "shard", "local_start", F.lit(folder).alias("folder")))
