"""Vector links against all pairs."""

import numpy as np
import pytest

from marketloom.llm import neardup_vectors


def brute(rows):
    ok = [v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)
          and any(v) for _, v, label in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    low = {}
    for i in range(n):
        k = find(i)
        low[k] = min(low.get(k, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], low[find(i)]) for i in range(n))


@pytest.mark.parametrize("block", [neardup_vectors.BLOCK, 7])
def test_links(spark, block):
    r = np.random.default_rng(4)
    rows = []
    for k in range(12):
        base = r.normal(size=64)
        for j in range(12):
            v = base + 0.12 * r.normal(size=64) * (j > 1)
            rows.append((100 * k + j, (v * (1 + j)).astype("f4").tolist(), k % 3))
    rows += [(5000, None, 1), (5001, [0.0] * 64, 1), (5002, rows[0][1], None), (5003, [float("nan")] * 64, 0),
             (5004, [None] + rows[0][1][1:], 0), (5005, [], 0), (5006, [1.0, 2.0], 0), (5007, [2.0, 4.0], 0),
             (5008, [float("inf")] * 64, 0), (5009, rows[0][1], 0), (5010, [3e38] * 64, 2), (5011, [1.0] * 64, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = neardup_vectors.link_vectors(df, block=block).collect()
    assert sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in got) == brute(rows)
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got)
    assert neardup_vectors.link_vectors(df.limit(0)).count() == 0


def test_recall_near_the_threshold():
    r = np.random.default_rng(9)
    a = neardup_vectors.unit_rows(r.normal(size=(4000, 64)))
    side = r.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * neardup_vectors.unit_rows(side)
    x, y = neardup_vectors.codes(a), neardup_vectors.codes(b)
    met = ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any((1, 2))
    assert met.mean() >= 0.999
