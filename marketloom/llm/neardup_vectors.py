"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A unit vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the coordinate of
largest size, with its sign. A table joins two such hashes. A vector lives in one bucket per table and visits those of
its next best hash values, so two close vectors meet unless both differ widely in every table. Vectors that meet are
compared in double precision. A pair that meets several times is counted where it meets first (the codes of both tell),
so no pair leaves its task: a task emits one row per vector, the number of links and a root for its local component.

Equal vectors are one class with a count. A bucket with many classes is dealt out as pairs of blocks; no bucket is one
task and none is cut short. Vectors are compared only with an equal, non-null label (and an equal length). Edges: a null
label, null or empty vector, null or non-finite component or zero norm links with nothing; repeated rows are rows of one
class; a null id never names a component that has another id; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import written
from .common import parallelism

#: Tables, hashes joined in a table, buckets of a table that a vector visits besides its own, classes in a block.
TABLES, JOINED, VISITS, BLOCK = 4, 2, 3, 1500
SEED = 20_240_601


def padded(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def hadamard(x):
    """Fast Walsh-Hadamard transform of the rows (their length is a power of two)."""
    import numpy as np

    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def codes(unit, tables: int = TABLES, joined: int = JOINED, visits: int = VISITS):
    """(vectors, tables, 1 + visits) bucket codes: the own bucket first, then those visited, nearest first."""
    import numpy as np

    size = padded(unit.shape[1])
    x0 = np.zeros((len(unit), size))
    x0[:, : unit.shape[1]] = unit
    rng = np.random.default_rng(SEED)
    out = np.empty((len(unit), tables, 1 + visits), np.int64)
    width = min(2 * size, visits + 1)
    for t in range(tables):
        ranked, losses = [], []
        for _ in range(joined):
            x = x0
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], size))
            both = np.hstack([x, -x])
            best = np.argsort(-both, 1)[:, :width]
            value = np.take_along_axis(both, best, 1)
            ranked.append(best)
            losses.append((value[:, :1] - value) ** 2)
        code = np.zeros((len(unit), 1), np.int64)
        loss = np.zeros((len(unit), 1))
        for best, lost in zip(ranked, losses):
            code = (code[:, :, None] * (2 * size) + best[:, None, :]).reshape(len(unit), -1)
            loss = (loss[:, :, None] + lost[:, None, :]).reshape(len(unit), -1)
        order = np.argsort(loss, 1, kind="stable")[:, : 1 + visits]
        out[:, t, :] = np.take_along_axis(code, order, 1)
    return out


def unit_rows(vectors):
    """Rows of length one in double precision."""
    import numpy as np

    x = np.asarray(vectors, float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable() -> F.Column:
    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return (F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
            & F.forall("embedding", finite) & F.exists("embedding", lambda x: F.abs(x) > 0))


BUCKETS = "table int, code long, role int, node long, label long, dim int, n long, vector binary, codes binary"
FOUND = "node long, links long, root long"


def bucket_rows(classes: DataFrame) -> DataFrame:
    """A row per class and bucket it lives in (role 0) or visits (role 1)."""
    import pyarrow as pa

    schema = pa.schema([("table", pa.int32()), ("code", pa.int64()), ("role", pa.int32()), ("node", pa.int64()),
                        ("label", pa.int64()), ("dim", pa.int32()), ("n", pa.int64()), ("vector", pa.binary()),
                        ("codes", pa.binary())])

    def deal(batches):
        import numpy as np

        from .common import records

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                vectors = batch.column("embedding").to_pylist()
                dims = np.array([len(v) for v in vectors])
                for dim in np.unique(dims):
                    mine = np.flatnonzero(dims == dim)
                    unit = unit_rows([vectors[i] for i in mine])
                    code = codes(unit)
                    _, tables, places = code.shape
                    flat = code.reshape(len(mine), -1)
                    rep = np.repeat(mine, tables * places)
                    raw = [u.tobytes() for u in unit]
                    packed = [c.tobytes() for c in code]
                    who = np.repeat(np.arange(len(mine)), tables * places)
                    yield records(schema, {
                        "table": np.tile(np.repeat(np.arange(tables), places), len(mine)), "code": flat.ravel(),
                        "role": np.tile((np.arange(places) > 0).astype(int), len(mine) * tables),
                        "node": batch.column("node").take(pa.array(rep)), "label": batch.column("label").take(pa.array(rep)),
                        "dim": np.full(len(rep), dim), "n": batch.column("n").take(pa.array(rep)),
                        "vector": [raw[i] for i in who], "codes": [packed[i] for i in who]})

    return classes.select("node", F.col("label").cast("long").alias("label"), "embedding", "n").mapInArrow(deal, BUCKETS)


def compare(left, right, table: int, code: int, threshold: float):
    """[(row of left, row of right)] of the pairs whose first meeting is this bucket and whose cosine is enough.

    A side: dict of node, role (arrays), unit (rows) and codes (rows, tables, places). ``right`` is None inside a block.
    """
    import numpy as np

    same = right is None
    right = left if same else right
    s = left["unit"] @ right["unit"].T
    ok = (s >= threshold) & (left["node"][:, None] != right["node"][None, :])
    ok &= (left["role"][:, None] == 0) | (right["role"][None, :] == 0)
    i, j = np.nonzero(np.triu(ok, 1) if same else ok)
    out = []
    for at in range(0, len(i), 100_000):
        a, b = i[at : at + 100_000], j[at : at + 100_000]
        x, y = left["codes"][a], right["codes"][b]
        low = (left["node"][a] < right["node"][b])[:, None]
        home_x, home_y = x[:, :, 0], y[:, :, 0]
        first, second = np.where(low, home_x, home_y), np.where(low, home_y, home_x)
        in_y = (home_x[:, :, None] == y).any(2)  # the own bucket of x is one of y's
        in_x = (home_y[:, :, None] == x).any(2)
        first_in, second_in = np.where(low, in_y, in_x), np.where(low, in_x, in_y)
        met = first_in | second_in
        where = met.argmax(1)
        rows = np.arange(len(a))
        bucket = np.where(first_in[rows, where], first[rows, where], second[rows, where])
        keep = (where == table) & (bucket == code)
        out.append(np.stack([a[keep], b[keep]], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), int)


def _links(sides, pairs):
    """Rows (node, links, root) of the vectors in ``pairs`` (of two sides, or of one with itself)."""
    import numpy as np

    nodes, sizes = (np.concatenate([s[c] for s in sides]) for c in ("node", "n"))
    a, b = pairs[:, 0], pairs[:, 1] + (len(sides[0]["node"]) if len(sides) > 1 else 0)
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, a, sizes[b])
    np.add.at(links, b, sizes[a])
    root = nodes.copy()
    while True:  # smallest node along the pairs; within a task and a block
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (before == root).all():
            break
    hit = np.flatnonzero(links)
    return nodes[hit], links[hit], root[hit]


def bucket_links(buckets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Links found in the buckets; those with more than ``block`` rows are compared block by block."""
    import pyarrow as pa

    keys = ["label", "dim", "table", "code"]
    sizes = buckets.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    many = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (buckets.join(sizes, keys).withColumn("blocks", many).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")))
    group = [*keys, "lo", "hi"]
    n = parallelism(buckets.sparkSession)
    ordered = dealt.select(*group, "own", "role", "node", "n", "vector", "codes").repartition(n, *group).sortWithinPartitions(
        *group)
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def search(batches):
        import numpy as np

        def side(rows, block_no):
            mine = [r for r in rows if r["own"] == block_no]
            first = np.frombuffer(mine[0]["codes"], np.int64)
            return {"node": np.array([r["node"] for r in mine]), "role": np.array([r["role"] for r in mine]),
                    "n": np.array([r["n"] for r in mine]),
                    "unit": np.stack([np.frombuffer(r["vector"]) for r in mine]),
                    "codes": np.stack([np.frombuffer(r["codes"], np.int64) for r in mine]).reshape(
                        len(mine), TABLES, len(first) // TABLES)}

        def close(key, rows):
            label, dim, table, code, lo, hi = key
            blocks = {r["own"] for r in rows}
            if len(rows) < 2 or lo != hi and len(blocks) < 2:
                return []
            left = side(rows, lo)
            right = None if lo == hi else side(rows, hi)
            pairs = compare(left, right, table, code, threshold)
            if not len(pairs):
                return []
            nodes, links, root = _links([left] if right is None else [left, right], pairs)
            return [pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(root)], schema=schema)]

        key, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                k = tuple(r[c] for c in group)
                if k != key:
                    if rows:
                        yield from close(key, rows)
                    key, rows = k, []
                rows.append(r)
        if rows:
            yield from close(key, rows)

    return ordered.mapInArrow(search, FOUND)


def link_vectors(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.filter(usable())
    classes, _ = written(good.groupBy("label", "embedding").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first")).withColumn("node", F.monotonically_increasing_id()),
        "vector-classes")
    buckets, _ = written(bucket_rows(classes), "vector-buckets")
    found, _ = written(bucket_links(buckets, threshold, block), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("node <> root"), "node", "root").withColumnRenamed("node", "member")
    placed = classes.select("node", "first").join(parts, F.col("node") == F.col("member"), "left").select(
        "node", "first", F.coalesce("component", "node").alias("component"))
    names = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    by_node = placed.join(names, "component").select("node", "component_id").join(links, "node", "left").select(
        F.col("node").alias("at"), "component_id", "links")
    table = classes.join(by_node, F.col("node") == F.col("at")).select(
        F.col("label").alias("c_label"), F.col("embedding").alias("c_embedding"), "component_id",
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    ok = rows.withColumn("usable", F.coalesce(usable(), F.lit(False)))
    linked = ok.filter("usable").join(table, (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("c_embedding")))
    alone = ok.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.select("vec_id", F.col("links").alias("n_links"), "component_id").union(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
