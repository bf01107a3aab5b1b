"""Document fingerprints against sets of digests, their SQL, and sketches that must be enlarged."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from marketloom.llm import fingerprints

R = random.Random(11)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()


def prose(n):
    return "".join(R.choice(WORDS) + R.choice([" ", " ", " ", ". ", "\n", "! "]) for _ in range(n))


ROWS = [(i * 3, prose(R.randint(1, 120))) for i in range(80)]
ROWS += [(300, None), (301, ""), (302, "é日本😀" * 30), (None, "no id"), (None, None), (303, ROWS[5][1]), (304, ROWS[5][1]),
         (305, "same row"), (305, "same row"), (305, "other text, same id"), (306, prose(9000)), (307, "\n\n"), (308, "x")]
ROWS += [(-7, f"text {i} of one id") for i in range(60)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, block int, own string").repartition(3)


def digests(text):
    found = re.findall(rf"[^\n.!?]{{0,{fingerprints.PIECE - 1}}}[^\n]", text)
    return {int(hashlib.md5(p.encode()).hexdigest()[:15], 16) for p in found}


def brute(rows):
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()[:15]
    order = sorted(((d is not None, d or 0, md5(t or ""), d, t or "") for d, t in rows))
    out = []
    for i, (*_, doc_id, text) in enumerate(order):
        after, half = order[(i + 1) % len(order)][4], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, following = digests(text), digests(edited), digests(after)
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(like(own, changed), 12), round(like(own, following), 12)))
    return sorted(out, key=repr)


def trimmed(rows):
    return sorted(((r[0], r[1], r[2], round(r[5], 12), round(r[6], 12)) for r in rows), key=repr)


@pytest.mark.parametrize("block_rows", [1000, 7])
def test_fingerprints(spark, block_rows):
    got = [tuple(r) for r in fingerprints.fingerprint_documents(frame(spark, ROWS), block_rows).collect()]
    assert trimmed(got) == brute(ROWS)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", ROWS)
    want = con.execute(fingerprints.duckdb_sql()).fetchall()
    assert trimmed(want) == brute(ROWS)
    assert sorted(((*r[:3], r[3], r[4]) for r in got), key=repr) == sorted(((*r[:3], r[3], r[4]) for r in want), key=repr)


def test_small_tables(spark):
    assert fingerprints.fingerprint_documents(frame(spark, [])).collect() == []
    only = fingerprints.fingerprint_documents(frame(spark, [(4, "one line\nand more")])).collect()
    assert trimmed(map(tuple, only)) == brute([(4, "one line\nand more")])


def test_failed_peeling_is_retried_larger(spark, monkeypatch):
    """With too few cells in the first comparison every pair fails there; the larger sketches agree with the sets."""
    monkeypatch.setattr(fingerprints, "first_bits", lambda a, b: F.lit(1))
    rows = ROWS[:30]
    got = [tuple(r) for r in fingerprints.fingerprint_documents(frame(spark, rows), 8).collect()]
    assert trimmed(got) == brute(rows)


def test_peeling(spark):
    a, b = list(range(1, 60)), list(range(40, 110))
    spread = F.transform(F.col("k"), lambda x: F.conv(F.substring(F.md5(x.cast("string")), 1, 15), 16, 10).cast("long"))
    df = spark.createDataFrame([(a, b)], "k array<long>, l array<long>")
    df = df.select(spread.alias("a"), F.transform("l", lambda x: F.conv(F.substring(F.md5(x.cast("string")), 1, 15), 16, 10).cast("long")).alias("b"))
    for bits, want in ((2, None), (8, len(set(a) ^ set(b)))):
        cells = fingerprints.subtract(*(fingerprints.sketch(F.col(c), F.lit(bits)) for c in "ab"))
        assert df.select(fingerprints.peel(cells, F.lit(bits)).alias("d")).first()["d"] == want
