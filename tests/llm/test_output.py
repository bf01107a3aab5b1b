"""Token files, packing and sharding against brute force."""

import struct
from zlib import crc32

import pytest

from marketloom.llm import arrow_output, catalog, packing, sharding
from marketloom.llm.tokens import PieceEncoder, encoder

ROWS = [(5, "Hello world, don't\nstop.", "x"), (None, "no id", None), (1, None, "y"), (2, "", None),
        (7, "a  b \n\n c\td " * 700, "z"), (3, "the words " * 3000, "z"), (5, "Hello world, don't\nstop.", "x"),
        (8, "é" * 300, "n_tokens"), (9, "<|endoftext|> x", "s")]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, length string").repartition(3)


def want_ids(text, end):
    enc = encoder(catalog.vocabulary()).tokenizer
    return enc.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_token_files_round_trip(spark, docs):
    got = arrow_output.token_files(docs, catalog.vocabulary(), length=64, shards=3).collect()
    assert len(got) == len(ROWS)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (doc_id, text, _) in zip(sorted(got, key=lambda r: r["start"]), order):
        ids = want_ids(text, 2)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), crc(ids))
        start += len(ids)


def test_new_pieces_are_encoded_many_at_a_time_as_in_their_texts():
    """Each new piece was a text of its own for the tokenizer."""
    import random

    enc, plain = PieceEncoder(catalog.vocabulary()), encoder(catalog.vocabulary()).tokenizer
    given = []

    class Watched:
        def encode_batch_fast(self, texts, **how):
            given.extend(texts)
            return plain.encode_batch_fast(texts, **how)

        def __getattr__(self, name):
            return getattr(plain, name)

    enc.tokenizer = Watched()
    r = random.Random(4)
    text = " ".join("".join(r.choices("abcdefghij", k=9)) for _ in range(3000))
    assert enc.encode([text]) == [struct.pack(f"<{len(i)}I", *i) for i in [plain.encode(text, add_special_tokens=False).ids]]
    assert len(given) < 40
    odd = ["a", "B", "é", "e\u0301", "\u0301", "7", ".", "!?", "'s", "'", " ", " ", " ", "\n", "\n", "\t", "\r\n", "\xa0", "\x85", "\x1c", "\u180e", "\u200b",
           "\u2028", "\u3000", "語", "😀", "\0", "Ġ", "Ċ", "<|endoftext|>", "Ⅷ", "²", "_", "-"]
    texts = ["".join(r.choices(odd, k=r.randrange(60))) for _ in range(1500)]
    texts += [" ".join("".join(r.choices([x for x in odd if x.strip()], k=5)) for _ in range(9)) for _ in range(1500)]
    for t, got in zip(texts, enc.encode(texts)):
        ids = plain.encode(t, add_special_tokens=False).ids
        assert got == struct.pack(f"<{len(ids)}I", *ids), t


def test_token_files_of_nothing(spark, docs):
    assert arrow_output.token_files(docs.limit(0), catalog.vocabulary()).count() == 0


def naive_best_fit(lengths, capacity):
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            bins += 1
            rooms.append(capacity - n)
    return bins, sorted(rooms)


def test_plan_is_best_fit_decreasing():
    import random

    r = random.Random(3)
    for capacity in (7, 64, 100):
        for _ in range(40):
            lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 120))]
            counts = {n: lengths.count(n) for n in set(lengths)}
            fill = {}
            for n, lo, hi, first, per, base in packing.best_fit_plan(counts, capacity):
                for k in range(hi - lo):
                    w, at = first + k // per, base + k % per * n
                    assert fill.get(w, 0) == at
                    fill[w] = at + n
            bins, rooms = naive_best_fit(lengths, capacity)
            assert len(fill) == bins and sorted(fill) == list(range(bins))
            assert sorted(capacity - v for v in fill.values()) == rooms


def test_pack(spark, docs):
    got = packing.pack(docs, catalog.vocabulary(), capacity=2048).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["doc_id"], []).append(r)
        assert 0 < r["length"] <= 2048
    for doc_id, text, _ in ROWS:
        ids = want_ids(text, 1)
        mine = sorted(parts[doc_id], key=lambda r: r["start"])
        copies = sum(x[0] == doc_id for x in ROWS)
        assert sum(r["length"] for r in mine) == copies * len(ids)
        for r in mine:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
    fill = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 2048 and sorted(fill) == list(range(len(fill)))
    assert packing.pack(docs.limit(0), catalog.vocabulary()).count() == 0


def jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [*range(-50, 400), 2**63 - 1, -(2**63), None]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 40, 1000):
        for r in sharding.jump_shards(df, "k", n).collect():
            assert (r["shard"], r["grown_shard"]) == (jump(r["k"] or 0, n), jump(r["k"] or 0, n + 1))


def test_shards(spark, docs):
    got = sharding.shard_documents(docs, 3).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got)
    assert sizes == sorted((d or 0, len((t or "").encode()) + 16, crc32((t or "").encode())) for d, t, _ in ROWS)
    assert sharding.shard_documents(docs.limit(0), 3).count() == 0


def test_pieces_are_held_for_few_texts_at_a_time(monkeypatch):
    """Pieces of a whole slice of texts were held at once, and the memory was only bounded between slices."""
    from marketloom.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 100)
    monkeypatch.setattr(tokens, "CUT", 1000, raising=False)
    enc, plain, held = PieceEncoder(catalog.vocabulary()), encoder(catalog.vocabulary()).tokenizer, []
    learn = enc._learn

    def watched(new):
        learn(new)
        held.append(len(enc.known))

    enc._learn = watched
    texts = ["", *(" ".join(f"word{i}x{k}" for k in range(20)) for i in range(200)), "", "long " * 900, "end"]
    for t, got in zip(texts, enc.encode(texts), strict=True):
        ids = plain.encode(t, add_special_tokens=False).ids
        assert got == struct.pack(f"<{len(ids)}I", *ids), t
    assert max(held) < 300 and enc.encode([]) == []
