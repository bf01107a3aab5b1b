"""MinHash near-dedup with fast similarity sketching, banding and exact verification on full shingle sets.

Sketch: in round i every shingle goes to a hashed bin with the value i + hash; in the rounds after the first t, round
t + j sends every shingle to bin j, so each of the t coordinates is filled after 2t rounds at the latest and mostly
after one or two; the estimate concentrates as for independent permutations. Coordinates are hashed in bands; documents
that share a band value meet in its bucket. With 40 bands of 5 a pair at 0.75 is missed with probability 2e-5.

Texts with equal sets are one node (named by a 128-bit digest). Links between nodes are confirmed on the full sets, and
no pair is emitted that is not a link: first every node is compared with the best hub of its buckets, the node that meets
most others. Buckets that still hold several components are searched by sketch: pairs of different components whose estimate is at least ``ESTIMATE`` (a pair at 0.75 falls below
with probability 1e-5) join components to candidate clusters; then the full sets of a cluster's nodes meet and are
compared across components until these merge. What is connected needs no further comparison, everything else that meets
is compared: components come out as if all pairs had been. A hub with many members is salted; large buckets and clusters
are dealt out as pairs of blocks. Sets are rebuilt from the texts for the nodes of a step only (found through a bitmap
of fixed size).

Edges: a text of fewer than five words is one shingle; null, empty and blank texts have no set and link with nothing;
rows with equal text are one node, with equal id or not; a null id never names a component that has another id; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import written
from .common import parallelism, remember, slices

#: Words of a shingle; bands and rows of a band; least similarity in hundredths; members of a hub in one salt.
SHINGLE, BANDS, ROWS, PERCENT, SALT = 5, 40, 5, 75, 2000
#: Least estimated similarity of a candidate; nodes in a block of a large bucket or cluster.
ESTIMATE, BLOCK = 0.62, 1000
#: Bits of the filter that finds the texts of a step; words whose hash a worker remembers.
FILTER_BITS, REMEMBERED = 1 << 24, 300_000

_A, _B, _C = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB  # multipliers of the splitmix64 generator


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        h = self[word] = xxh3_64_intdigest(word)
        return h


_words = WordHashes()
remember("words", _words.clear)


def mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(_B)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_C)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, size: int = SHINGLE):
    """Sorted distinct 64-bit hashes of the shingles of the lower-cased (A-Z) words of a text."""
    import numpy as np

    words = text.lower().split() if text else []
    if len(_words) > REMEMBERED:
        _words.clear()
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    k = min(size, len(w))
    s = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        s = s * np.uint64(_A) + w[i : len(w) - k + 1 + i]
    return np.unique(mix(s))


def fast_sketch(shingles, t: int = BANDS * ROWS):
    """t coordinates (round and hash of the smallest shingle that fell into the bin)."""
    import numpy as np

    n = len(shingles)
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 1024 // n)
    done = 0
    while done < 2 * t:
        rounds = np.arange(done, min(done + step, 2 * t), dtype=np.uint64)[:, None]
        h = mix(shingles[None, :] + (rounds + np.uint64(1)) * np.uint64(_A))
        value = (rounds << np.uint64(48)) | (h >> np.uint64(16))
        bins = np.where(rounds < t, mix(h + np.uint64(_C)) % np.uint64(t), rounds - np.uint64(t))
        np.minimum.at(out, bins.ravel().astype(np.intp), value.ravel())
        done += step
        if int(out.max()) != 0xFFFFFFFFFFFFFFFF:  # later rounds hold larger values only
            break
    return out


def band_hashes(sketch, bands: int = BANDS, rows: int = ROWS):
    import numpy as np

    x = sketch.reshape(bands, rows)
    h = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        h = mix(h * np.uint64(_A) + x[:, i])
    return h.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, tie (hash of the text), n_shingles, node (digest of the set; null without words), bands, sketch (16 bits of
    each coordinate): one row per input row."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()),
                        ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches):
        from xxhash import xxh3_128_digest

        from .common import records

        for part, texts in slices(batches, owner="words"):
            rows = {k: [] for k in schema.names}
            for t in texts:
                s = shingle_set(t)
                rows["n_shingles"].append(len(s))
                rows["node"].append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketch = fast_sketch(s) if len(s) else None
                rows["bands"].append(band_hashes(sketch) if len(s) else None)
                rows["sketch"].append(sketch.astype("<u2").tobytes() if len(s) else None)
            rows["doc_id"], rows["tie"] = part.column(0), part.column(1)
            yield records(schema, rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"),
                       F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, tie long, n_shingles long, node binary, bands array<long>, sketch binary")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and set (sorted hashes) of the texts behind ``nodes`` (node, first_id); a few more may come along."""
    import pyarrow as pa

    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    marks = nodes.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits")).collect()
    wanted = docs.sparkSession.sparkContext.broadcast({r["k"] - 1: bytes(r["bits"]) for r in marks})
    schema = pa.schema([("s_id", pa.int64()), ("s_node", pa.binary()), ("set", pa.binary())])

    def run(batches):
        from xxhash import xxh3_128_digest

        from .common import records

        bits = wanted.value
        for batch in batches:
            keep = []
            for b in batch.column("bit").to_pylist():
                page, at = bits.get(b // 32768), b % 32768
                keep.append(page is not None and bool(page[at // 8] >> at % 8 & 1))
            for part, texts in slices([batch.filter(pa.array(keep, pa.bool_()))], owner="words"):
                sets = [shingle_set(t) for t in texts]
                yield records(schema, {"s_id": part.column(0), "set": [s.tobytes() for s in sets],
                                       "s_node": [xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]})

    return (docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
            .withColumn("bit", bit).mapInArrow(run, "s_id long, s_node binary, set binary"))


def verified(docs: DataFrame, pairs: DataFrame, first_ids: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (node, hub) of ``pairs`` whose full sets are similar enough; written."""
    import pyarrow as pa

    many = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts"))
    members = pairs.join(many, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"),
                                             "node", F.lit(1).alias("member"))
    hubs = many.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("node"),
                       F.lit(0).alias("member"))
    places, _ = written(members.unionByName(hubs).join(first_ids, "node"), "near-places")
    needed = places.select("node", F.col("first_id").alias("id")).distinct()
    sets = shingle_sets(docs, needed)
    n = parallelism(docs.sparkSession)
    rows = (places.join(sets, (F.col("node") == F.col("s_node")) & F.col("first_id").eqNullSafe(F.col("s_id")))
            .select("hub", "salt", "member", "node", "set").repartition(n, "hub", "salt")
            .sortWithinPartitions("hub", "salt", "member"))
    schema = pa.schema([("node", pa.binary()), ("hub", pa.binary())])

    def compare(batches):
        import numpy as np

        key = own = None
        for batch in batches:
            nodes, hubs = [], []
            for h, salt, member, node, raw in zip(*(batch.column(c).to_pylist() for c in
                                                    ("hub", "salt", "member", "node", "set"))):
                if not member:
                    key, own = (h, salt), np.frombuffer(raw, np.uint64)
                elif (h, salt) == key:
                    x = np.frombuffer(raw, np.uint64)
                    at = np.searchsorted(own, x)
                    at[at == len(own)] = 0
                    both = int((own[at] == x).sum())
                    if 100 * both >= percent * (len(own) + len(x) - both):
                        nodes.append(node)
                        hubs.append(h)
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hubs, pa.binary())], schema=schema)

    return written(rows.mapInArrow(compare, "node binary, hub binary"), "near-links")[0]


def across(rows: DataFrame, keys: list[str], percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): components of one group (bucket or cluster) that candidates join, or links if ``rows`` hold full sets.

    Rows: keys, node, c (component), n, sketch and perhaps set. Groups of many rows are dealt out as pairs of blocks. A
    task emits a pair of components only when it joins two that were not joined before in it, so fewer rows leave than
    enter.
    """
    import pyarrow as pa

    full = "set" in rows.columns
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    group = [*keys, "lo", "hi"]
    dealt = (rows.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")))
    columns = [*group, "own", "c", "n", "sketch", *(["set"] if full else [])]
    ordered = dealt.select(*columns).repartition(parallelism(rows.sparkSession), *group).sortWithinPartitions(*group)
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def search(batches):
        import numpy as np

        def compare(key, own):
            lo, hi = key[-2:]
            left = [r for r in own if r["own"] == lo]
            right = left if lo == hi else [r for r in own if r["own"] == hi]
            if not left or not right:
                return
            root: dict[bytes, bytes] = {}

            def find(x):
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            sketches = np.stack([np.frombuffer(r["sketch"], "<u2") for r in right])
            n = np.array([r["n"] for r in right])
            names = {c: i for i, c in enumerate(dict.fromkeys(r["c"] for r in own))}
            label = np.array([names[r["c"]] for r in right])
            for i, r in enumerate(left):
                ok = (label != names[r["c"]]) & (100 * np.minimum(n, r["n"]) >= percent * np.maximum(n, r["n"]))
                if lo == hi:
                    ok[: i + 1] = False
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                same = (sketches[at] == np.frombuffer(r["sketch"], "<u2")).mean(1)
                for j in at[same >= ESTIMATE]:
                    x, y = find(r["c"]), find(right[j]["c"])
                    if x == y:
                        continue
                    if full:
                        both = len(np.intersect1d(np.frombuffer(r["set"], np.uint64), np.frombuffer(right[j]["set"], np.uint64),
                                                  assume_unique=True))
                        if 100 * both < percent * (r["n"] + int(n[j]) - both):
                            continue
                    root[y] = x
                    yield r["c"], right[j]["c"]

        def emit(key, own):
            found = list(compare(key, own))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)

        key, own = None, []
        for batch in batches:
            for r in batch.to_pylist():
                k = tuple(r[c] for c in group)
                if k != key:
                    if len(own) > 1:
                        yield from emit(key, own)
                    key, own = k, []
                own.append(r)
        if len(own) > 1:
            yield from emit(key, own)

    return ordered.mapInArrow(search, "a binary, b binary")


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of every node, a node without links being its own; written."""
    parts = connected_components(links, "node", "hub").withColumnRenamed("node", "m")
    return written(nodes.select("node").join(parts, F.col("node") == F.col("m"), "left").select(
        "node", F.coalesce("component", "node").alias("component")), "near-components")[0]


def _with_hubs(met: DataFrame) -> DataFrame:
    """Adds the hub of each bucket: the node that meets most others over all its buckets (an original among its copies)."""
    sizes = met.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size"))
    reach = met.join(sizes, ["band", "value"]).groupBy("node").agg(F.sum("size").alias("reach")).withColumnRenamed("node", "_node")
    ranked = met.join(reach, F.col("node") == F.col("_node"))
    hubs = ranked.groupBy("band", "value").agg(F.max(F.struct("reach", "node", "n")).alias("h")).select(
        "band", "value", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.reach").alias("hub_reach"))
    return met.join(hubs, ["band", "value"])


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    rows, _ = written(sketches(docs), "near-sketches")
    classes, _ = written(rows.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch")), "near-classes")
    first_ids = classes.select("node", "first_id")
    banded = classes.select("node", "n", F.posexplode("bands").alias("band", "value"))
    shared = (banded.groupBy("band", "value").agg(F.min("node").alias("low"), F.max("node").alias("high"))
              .filter("low < high").select("band", "value"))
    met, _ = written(banded.join(shared, ["band", "value"]), "near-met")
    met, _ = written(_with_hubs(met), "near-buckets")

    def fits(n, m):
        return 100 * F.least(n, m) >= percent * F.greatest(n, m)

    stars = met.filter(fits(F.col("n"), F.col("hub_n")) & (F.col("node") != F.col("hub"))).groupBy("node", "hub").agg(
        F.count(F.lit(1)).alias("times"), F.max("hub_reach").alias("reach"))
    first = stars.groupBy("node").agg(F.max(F.struct("reach", "times", "hub")).alias("best")).select("node", F.col("best.hub").alias("hub"))
    first, _ = written(first, "near-first")
    links = verified(docs, first, first_ids, percent)
    parts = _components(classes, links)

    def labelled(df: DataFrame, node: str, name: str) -> DataFrame:
        return df.join(parts.select(F.col("node").alias("_n"), F.col("component").alias(name)), F.col(node) == F.col("_n")).drop("_n")

    # buckets that still hold several components: candidates by sketch, clusters of components, then full sets
    inside = labelled(met.select("band", "value", "node", "n"), "node", "c")
    mixed = inside.groupBy("band", "value").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1")
    inside = inside.join(mixed.select("band", "value"), ["band", "value"])
    known = classes.select(F.col("node").alias("_n"), "sketch")
    inside, _ = written(inside.join(known, F.col("node") == F.col("_n")).drop("_n"), "near-mixed")
    clusters = connected_components(across(inside, ["band", "value"], percent), "a", "b").select(
        F.col("node").alias("of"), F.col("component").alias("cluster"))
    nodes = classes.select("node", "first_id", "n", "sketch")
    nodes = labelled(nodes, "node", "c").join(clusters, F.col("c") == F.col("of")).drop("of")
    nodes, _ = written(nodes, "near-clusters")
    if not nodes.isEmpty():
        sets = shingle_sets(docs, nodes.select("node", F.col("first_id").alias("id")))
        full = nodes.join(sets, (F.col("node") == F.col("s_node")) & F.col("first_id").eqNullSafe(F.col("s_id")))
        full, _ = written(full.select("cluster", "node", "c", "n", "sketch", "set").dropDuplicates(["node"]), "near-full")
        found, _ = written(across(full, ["cluster"], percent), "near-found")
        merged = connected_components(found, "a", "b").select(F.col("node").alias("of"), F.col("component").alias("whole"))
        parts = parts.join(merged, F.col("component") == F.col("of"), "left").select(
            "node", F.coalesce("whole", "component").alias("component"))

    named = first_ids.join(parts, "node")
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_node, _ = written(named.join(names, "component").select(F.col("node").alias("of"), "component_id", "component"), "near-names")
    out = rows.select("doc_id", "tie", "n_shingles", "node").join(of_node, F.col("node") == F.col("of"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
                      .alias("component_id"), "tie", F.col("component").alias("group")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The input with one row of each group of similar documents (of its smallest id), all columns kept.

    Rows without words are in no group and stay. Of several rows under the smallest id the smallest hash of the text
    stays, of repeated rows one.
    """
    found, _ = written(near_duplicates(docs, percent).select("doc_id", "tie", "group", "kept"), "near-rows")
    stays = found.filter("kept AND group IS NOT NULL").groupBy("group").agg(F.min(F.struct("doc_id", "tie")).alias("best")).select(
        F.col("best.doc_id").alias("s_id"), F.col("best.tie").alias("s_tie"))

    def same(a, b, c, d):
        return F.col(a).eqNullSafe(F.col(b)) & (F.col(c) == F.col(d))

    rows = found.filter("group IS NOT NULL").groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("copies"))
    marked = rows.join(stays, same("doc_id", "s_id", "tie", "s_tie"), "left").select(
        F.col("doc_id").alias("m_id"), F.col("tie").alias("m_tie"), F.col("s_tie").isNull().alias("gone"), "copies")
    marked, _ = written(marked.filter("gone OR copies > 1"), "near-marked")
    keyed = docs.withColumn("_tie", F.xxhash64("text"))
    key = F.col("doc_id").cast("long").eqNullSafe(F.col("m_id")) & (F.col("_tie") == F.col("m_tie"))
    single = keyed.join(marked, key, "left_anti")
    repeated = keyed.join(marked.filter("NOT gone"), key, "left_semi").dropDuplicates(["doc_id", "_tie"])
    return single.unionByName(repeated).drop("_tie")
