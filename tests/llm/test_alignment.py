"""Cross-tokenizer alignment against whole-text tokenisation and a naive walk over both sides."""

import hashlib
import random
from collections import Counter

import pytest

from marketloom.llm import alignment, catalog

R = random.Random(3)
BITS = ["the", "Hello", "naïve", "日本語", "don't", "x1y2", "re-use", "…", "a,b;c", "<|endoftext|>", "</s>", "<0x41>", "😀", "zzz" * 9, "\x1c", "\x00"]
JOINS = [" ", " ", " ", "\n", "  ", "\t", "", "\n\n", " \n", " ", " "]


def random_text():
    return "".join(R.choice(BITS) + R.choice(JOINS) for _ in range(R.randint(1, 40)))


ROWS = [(i, random_text()) for i in range(60)] + [
    (100, None), (101, ""), (102, " "), (103, "\n"), (104, "a▁b"), (105, "▁"), (None, "no id here"), (106, "word " * 30000),
    (107, "same text"), (107, "same text"), (108, "\nlead"), (109, " lead"), (110, "日本語" * 4000), (111, "\r\n x")]


def naive(rows):
    tool = alignment.Vocabularies(catalog.vocabulary(), catalog.vocabulary(catalog.PIECES))
    docs = []
    for doc_id, text in rows:
        a = tool.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tool.b.encode(text) if text else []
        left, right = [tool.a_bytes[i] for i in a], [tool.b_bytes[i] for i in b]
        if not text or not b"".join(left) == b"".join(right) == (" " + text).encode():
            docs.append((doc_id, [], [], [], []))
            continue
        ends = [sum(map(len, left[: i + 1])) for i in range(len(left))] if len(left) < 500 else None
        if ends is None:
            ends, total = [], 0
            for x in left:
                ends.append(total := total + len(x))
        others, total = {}, 0
        for j, x in enumerate(right):
            others[total := total + len(x)] = j
        groups, links, i, j = [], [], 0, 0
        for k, e in enumerate(ends):
            if e in others:
                groups.append((a[i : k + 1], b[j : others[e] + 1]))
                links.append((a[k], b[others[e]]))
                i, j = k + 1, others[e] + 1
        docs.append((doc_id, a, b, groups, links))
    counts = Counter(p for *_, links in docs for p in links)
    best: dict[int, int] = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest()
             if a else "") for doc_id, a, b, groups, links in docs]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(*r, 1, "t") for r in ROWS], "doc_id long, text string, n_a int, pairs string").repartition(3)


def test_alignment(spark, docs):
    got = alignment.align_tokenizers(docs, catalog.vocabulary(), catalog.vocabulary(catalog.PIECES))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(naive(ROWS), key=repr)


def test_bounded_memories(spark, monkeypatch):
    """Memories that overflow all the time give the same result."""
    monkeypatch.setattr(alignment, "PARTS", 3)
    monkeypatch.setattr(alignment, "WINDOWS", 2)
    tool = alignment.Aligner(catalog.vocabulary(), catalog.vocabulary(catalog.PIECES))
    want = {r[0]: r for r in naive(ROWS[:60])}
    for (doc_id, _), found in zip(ROWS[:60], tool.tokens([t for _, t in ROWS[:60]])):
        if found:
            n_a, n_b, digest, pairs = tool.align(*found)
            assert (n_a, n_b, len(pairs), digest) == tuple(want[doc_id][i] for i in (1, 2, 3, 7))


def test_alignment_of_nothing(spark, docs):
    assert alignment.align_tokenizers(docs.limit(0), catalog.vocabulary(), catalog.vocabulary(catalog.PIECES)).collect() == []


def test_pairs_are_bounded():
    v = alignment.Vocabularies(catalog.vocabulary(), catalog.vocabulary(catalog.PIECES))
    assert 50_000 < len(v.possible) < 1_000_000
    a, b = divmod(int(v.possible[1234]), len(v.b_bytes))
    assert v.a_bytes[a].endswith(v.b_bytes[b]) or v.b_bytes[b].endswith(v.a_bytes[a])


def test_new_parts_are_tokenised_many_at_a_time_and_documents_aligned_together():
    """Each new part was a text of its own for the byte-level side, and each new window a walk of its own."""
    tool, r = alignment.Aligner(catalog.vocabulary(), catalog.vocabulary(catalog.PIECES)), random.Random(5)
    plain, given = tool.v.a, []

    class Watched:
        def encode_batch_fast(self, texts, **how):
            given.extend(texts)
            return plain.encode_batch_fast(texts, **how)

        def __getattr__(self, name):
            return getattr(plain, name)

    tool.v.a = Watched()
    if hasattr(tool.v, "encoder"):
        tool.v.encoder.tokenizer = tool.v.a
    words = " ".join("".join(r.choices("abcdefghij", k=9)) for _ in range(3000))
    rows = [(0, words), *((i, t) for i, (_, t) in enumerate(ROWS, 1) if t)]
    tool.tokens([words])
    assert len(given) < 40
    found = [(row, x) for row, x in zip(rows, tool.tokens([t for _, t in rows])) if x]
    *of_rows, kinds, pairs, times = tool.align_many([x for _, x in found])
    want, at = {row[0]: row for row in naive(rows)}, 0
    for (doc_id, _), x, n_a, n_b, n_groups, digest, k in zip(*zip(*found), *of_rows, kinds, strict=True):
        assert (n_a, n_b, n_groups, digest) == tuple(want[doc_id][i] for i in (1, 2, 3, 7))
        alone = Counter(tool.align(*x)[3].tolist())
        assert dict(zip(pairs[at : at + k].tolist(), times[at : at + k].tolist())) == alone
        at += k
    assert at == len(pairs) == len(times)
