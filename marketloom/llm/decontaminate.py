"""Benchmark decontamination as a prefix-filtered set join with exact verification over item-sized windows.

An item is cut into windows of 13 consecutive words (a shorter item is one window). Containment of a whole window needs
every one of its words, so in the order of rarity one prefix word is enough: the rarest, by counts over all documents.
A document meets a window only at its occurrences of that word; the word's place in the window gives the one possible
start (positional bound), which must lie in the document with all of the window (length bound), and the words there are
compared in full. The benchmark is handled in blocks of a bounded number of windows; every block meets all documents.

Edges: null and wordless texts have no words and no hits; items without words have no windows; an item without id marks
words but is not listed; repeated items count once by id; rows that agree in id and text are each returned; an empty
benchmark gives no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Words of a window; windows of the benchmark in one broadcast block.
WINDOW, BLOCK = 13, 200_000

_blank = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; such bytes never cut a UTF-8 character."""
    return text.lower().translate(_blank).split() if text else []


def window_blocks(items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> Iterator[dict[tuple, set]]:
    """{words of a window: ids of its items as text}, at most ``block`` windows at a time."""
    found: dict[tuple, set] = {}
    for row in items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).toLocalIterator():
        words = words_of(row["t"])
        for s in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[s : s + window]), set()).add(row["i"])
            if len(found) >= block:
                yield found
                found = {}
    if found:
        yield found


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"),
                       F.col("text").cast("binary").alias("text"))


def rarity(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Occurrences of the given words in all documents."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        from collections import Counter

        from .common import records

        known, n = shared.value, Counter()
        for _, texts in slices(batches):
            for t in texts:
                n.update([w for w in words_of(t) if w in known])
        yield records(schema, {"word": list(n), "n": list(n.values())})

    counts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def prefix_index(windows: dict[tuple, set], counts: dict[bytes, int]) -> dict[bytes, dict[tuple, dict]]:
    """{rarest word: {(its place, length of the window): {words: items}}}."""
    index: dict[bytes, dict[tuple, dict]] = {}
    for words, items in windows.items():
        rare = min(words, key=lambda w: (counts.get(w, 0), w))
        if counts.get(rare, 0):
            index.setdefault(rare, {}).setdefault((words.index(rare), len(words)), {})[words] = items
    return index


def find_windows(words: list[bytes], index: dict[bytes, dict[tuple, dict]]) -> tuple[list[list[int]], set]:
    """Merged [start, end) stretches of the document under windows, and the items of these windows."""
    stretches, items, n = [], set(), len(words)
    for at in [i for i, w in enumerate(words) if w in index]:
        for (place, size), table in index[words[at]].items():
            s = at - place
            if s >= 0 and s + size <= n:
                hit = table.get(tuple(words[s : s + size]))
                if hit:
                    stretches.append([s, s + size])
                    items |= hit
    merged: list[list[int]] = []
    for s, e in sorted(stretches):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return merged, items


HITS = "doc_id long, tie long, n_words long, block int, stretches array<array<int>>, items array<string>"


def _block_hits(docs: DataFrame, block: int, index: dict) -> DataFrame:
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_words", pa.int64()), ("block", pa.int32()),
                        ("stretches", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])

    def search(batches):
        from .common import records

        known = shared.value
        for part, texts in slices(batches):
            sizes, stretches, items = [], [], []
            for t in texts:
                words = words_of(t)
                at, ids = find_windows(words, known)
                sizes.append(len(words))
                stretches.append(at)
                items.append(sorted(i for i in ids if i is not None))
            yield records(schema, {"doc_id": part.column(0), "tie": part.column(1), "n_words": sizes,
                                   "block": [block] * len(sizes), "stretches": stretches, "items": items})

    return _texts(docs).mapInArrow(search, HITS)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, tie (hash of the text), n_words, n_hit, stretches, items, contaminated: one row per input row."""
    parts = []
    for k, windows in enumerate(window_blocks(items, window, block)):
        counts = rarity(docs, {w for words in windows for w in words})
        parts.append(_block_hits(docs, k, prefix_index(windows, counts)))
    hits = reduce(DataFrame.unionAll, parts or [_block_hits(docs, 0, {})])
    whole = hits.groupBy("doc_id", "tie", "n_words").agg(
        F.count_if(F.col("block") == 0).alias("rows"),
        F.array_sort(F.flatten(F.collect_set("stretches"))).alias("stretches"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    zero = F.lit(0)
    covered = F.aggregate("stretches", F.struct(zero.alias("n"), zero.alias("end")), lambda s, x: F.struct(
        (s["n"] + F.greatest(zero, x[1] - F.greatest(x[0], s["end"]))).alias("n"), F.greatest(s["end"], x[1]).alias("end")),
        lambda s: s["n"].cast("long"))
    return (whole.withColumn("n_hit", covered).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
            .select("doc_id", "tie", "n_words", "n_hit", "stretches", "items",
                    ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = contamination(docs, items).filter("contaminated").select(F.col("doc_id").alias("_bad"), F.col("tie").alias("_tie"))
    return docs.join(bad.distinct(), F.col("doc_id").eqNullSafe(F.col("_bad")) & (F.xxhash64("text") == F.col("_tie")),
                     "left_anti")
