"""Alignment of two tokenizers' ids over whole documents, whose parts between spaces are tokenised once.

Each text is tokenised in full by both (space + text by the byte-level one, text by the piece model, which adds the space).
Texts are cut
at single spaces and line breaks; a part is tokenised by both sides once and remembered within a bounded memory.  The ids of
many documents then lie end to end in arrays: running byte lengths give the ends that both sides share, and these the groups
and the pair of ids that ends at each.  Within a group one pair ends together, so a link is the end of a group.

Work at scale: tokenising runs where the rows are and leaves one row per document with the distinct pairs and how often
each occurs, written once to the shared folder.  Counts of pairs are summed per task, then by Spark.  Of two ids that end
together one's bytes are the end of the other's, so only ``possible_pairs`` can occur: a few hundred thousand for the
vocabularies in use, whatever the corpus.  That bounds the counts that are collected and broadcast; the second pass reads
them by index.

Edges: a null or empty text, or one whose joined token bytes differ from space + text (U+2581 in the text is such a case),
has no tokens: zeros and an empty string; equal rows each count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import records, remember, slices
from .tokens import OTHER_BLANKS, PieceEncoder

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Parts of texts remembered per Python worker before that memory starts anew (longer ones are tokenised each time), and the
#: tokens of the first side that are aligned at once (a document of more is aligned alone).
PARTS, LONGEST_PART, WINDOWS = 500_000, 64, 200_000

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<int>, times array<int>"
LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

_single_space = re.compile(r"(?<=\S) (?=\S)")
_ascii_blanks = tuple(b for b in OTHER_BLANKS if b.isascii())


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the others for 256 onward."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers, the bytes of their ids and the pairs of ids that can end together."""

    def __init__(self, byte_level: str, pieces: str):
        import numpy as np
        import sentencepiece

        self.encoder = PieceEncoder(byte_level)
        self.a = self.encoder.tokenizer
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = byte_letters()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = []
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        for i, name in enumerate(names):
            self.b_bytes.append(bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode())
        # pieces never run over a space or a line break: parts of a text are tokenised alike alone and inside it
        self.separable = not any("▁" in n.lstrip("▁") or "\n" in n for n in names)
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int32) for side in (self.a_bytes, self.b_bytes))
        self.possible = self._possible()

    def _possible(self):
        """Sorted codes a * size + b of the pairs of which one's bytes are the end of the other's."""
        import numpy as np

        def by_bytes(side):
            found: dict[bytes, list[int]] = {}
            for i, x in enumerate(side):
                found.setdefault(x, []).append(i)
            return found

        of_a, of_b, size, codes = by_bytes(self.a_bytes), by_bytes(self.b_bytes), len(self.b_bytes), []
        for x, ids in of_a.items():
            for k in range(len(x)):
                codes += [a * size + b for b in of_b.get(x[k:], ()) for a in ids]
        for x, ids in of_b.items():
            for k in range(1, len(x)):
                codes += [a * size + b for a in of_a.get(x[k:], ()) for b in ids]
        return np.unique(np.array(codes, np.int64))

    def pair_owner(self):
        """The second side's id of every possible pair."""
        return self.possible % len(self.b_bytes)


class Aligner:
    """Ids of whole texts on both sides, with remembered parts, and what ends together there."""

    def __init__(self, byte_level: str, pieces: str):
        import pyarrow as pa

        self.v = Vocabularies(byte_level, pieces)
        self.of_a: dict[str, bytes] = {}
        self.of_b: dict[str, bytes] = {}
        self.odd: set[str] = set()  # parts of which some side's bytes differ
        self.entries = [pa.array(side, pa.large_binary()) for side in (self.v.a_bytes, self.v.b_bytes)]
        self.ids = max(len(self.v.a_bytes), len(self.v.b_bytes))
        # an id in decimal behind a comma, behind the mark of a group, of its second side, and behind nothing
        self.decimal = pa.array([b"%s%d" % (mark, i) for mark in (b",", b";", b"|", b"") for i in range(self.ids)], pa.large_binary())

    # tokens

    def _cut(self, text: str) -> list[str]:
        """Parts that follow a space (not kept), or start with their line break; a part of an irregular text that starts
        with a line break is given its space, which tells it from the others."""
        if not self.v.separable:
            return [" " + text]
        plain = len(text.split()) == text.count(" ") + text.count("\n") + 1
        if plain and not any(map(text.__contains__, _ascii_blanks if text.isascii() else OTHER_BLANKS)):
            return text.replace("\n", " \n").split(" ")
        first, *rest = _single_space.split(text)
        return [" " + first if first[:1] in ("\n", " ") else first, *rest]

    def _learn(self, parts: list[str]) -> None:
        """Ids of new parts on both sides; a part without its own blank in front has a space there."""
        from array import array

        import numpy as np

        full = [p if p[:1] in ("\n", " ") else " " + p for p in parts]
        blank = [p for p in parts if p[:1] == " "]
        behind = parts if not blank else [p for p in parts if p[:1] != " "]
        left = dict(zip(behind, self.v.encoder._encode_behind_blanks(behind)))
        left.update(zip(blank, self.v.encoder._encode(blank)))
        right = self.v.b.encode([p[1:] if p[:1] == " " else p for p in parts], num_threads=1)
        right = [array("I", ids[1:] if p[:1] == "\n" else ids).tobytes() for p, ids in zip(parts, right)]
        want = [f.encode() for f in full]
        sizes, whole = np.array(list(map(len, want))), b"".join(want)
        for known, side, entries, of_id in ((self.of_a, [left[p] for p in parts], self.entries[0], self.v.a_length),
                                            (self.of_b, right, self.entries[1], self.v.b_length)):
            known.update(zip(parts, side))
            ids = np.frombuffer(b"".join(side), np.uint32)
            ends = np.concatenate([[0], of_id[ids].cumsum()])[np.array(list(map(len, side))).cumsum() // 4]
            if np.array_equal(ends, sizes.cumsum()) and joined(entries, ids)[0] == whole:
                continue
            names = entries.to_pylist()
            self.odd.update(p for p, raw, w in zip(parts, side, want) if b"".join([names[i] for i in memoryview(raw).cast("I")]) != w)

    def tokens(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """Ids of space + text on both sides as 32-bit numbers; None where there are no tokens."""
        of_a, of_b, odd = self.of_a, self.of_b, self.odd
        if len(of_a) > PARTS:
            for memory in (of_a, of_b, odd):
                memory.clear()
        cut = [self._cut(t) if t else [] for t in texts]
        new = list({p for parts in cut for p in parts if p not in of_a})
        for i in range(0, len(new), 8192):
            self._learn(new[i : i + 8192])
        out: list[tuple[bytes, bytes] | None] = []
        for text, parts in zip(texts, cut):
            if not parts:
                out.append(None)
                continue
            a, b = b"".join(map(of_a.__getitem__, parts)), b"".join(map(of_b.__getitem__, parts))
            out.append((a, b) if not odd or odd.isdisjoint(parts) or self._joined(a, b, text) else None)
        for p in new:
            if len(p) > LONGEST_PART:
                del of_a[p], of_b[p]
                odd.discard(p)
        return out

    def _joined(self, a: bytes, b: bytes, text: str) -> bool:
        sides = [b"".join([side[i] for i in memoryview(raw).cast("I")]) for side, raw in
                 ((self.v.a_bytes, a), (self.v.b_bytes, b))]
        return sides[0] == sides[1] == f" {text}".encode()

    # alignment

    def walk(self, found: list[tuple[bytes, bytes]]):
        """(n_a, n_b, n_groups, checksums of the groups, codes of the pairs of all links in order) of documents with tokens.

        Documents lie end to end; the end of each is an end on both sides, so no group runs over it.
        """
        import hashlib

        import numpy as np

        v, left, right = self.v, *(np.frombuffer(b"".join(side), np.uint32) for side in zip(*found))
        n_a, n_b = (np.array([len(x) // 4 for x in side]) for side in zip(*found))
        ends, others = v.a_length[left].cumsum(), v.b_length[right].cumsum()
        last = []
        for own, other in ((ends, others), (others, ends)):
            there = np.zeros(ends[-1] + 1, bool)
            there[other] = True
            last.append(there[own].nonzero()[0])
        # groups: tokens from the one behind the last of the group before to the own last
        (start_a, size_a), (start_b, size_b) = ((np.append(0, x[:-1] + 1), np.diff(x, prepend=-1)) for x in last)
        kind_a, kind_b = np.zeros(len(left), np.int32), np.zeros(len(right), np.int32)
        kind_a[start_a], kind_b[start_b] = self.ids, 2 * self.ids
        kind_a[n_a.cumsum() - n_a] = 3 * self.ids
        which = np.empty(len(left) + len(right), np.int32)
        which[np.arange(len(left)) + np.repeat(start_b, size_a)] = kind_a + left.astype(np.int32)
        which[np.arange(len(right)) + np.repeat(last[0] + 1, size_b)] = kind_b + right.astype(np.int32)
        text, places = joined(self.decimal, which)
        cuts = places[np.append(0, (n_a + n_b).cumsum())].tolist()
        digests = [hashlib.sha256(text[i:j]).hexdigest() for i, j in zip(cuts, cuts[1:])]
        n_groups = np.diff(last[0].searchsorted(n_a.cumsum()), prepend=0)
        return n_a, n_b, n_groups, digests, left[last[0]].astype(np.int64) * len(v.b_bytes) + right[last[1]]

    def align(self, a: bytes, b: bytes) -> tuple[int, int, str, object]:
        """(n_a, n_b, checksum of the groups, index of the pair of every link) of one document."""
        import numpy as np

        n_a, n_b, _, digests, codes = self.walk([(a, b)])
        return int(n_a[0]), int(n_b[0]), digests[0], self.v.possible.searchsorted(codes).astype(np.int32)

    def align_many(self, found: list[tuple[bytes, bytes]]):
        """Of each document n_a, n_b, n_groups, checksum and how many distinct pairs; then all these pairs and their counts."""
        import numpy as np

        n_a, n_b, n_groups, digests, codes = self.walk(found)
        every = len(self.v.a_bytes) * len(self.v.b_bytes)
        codes += np.repeat(np.arange(len(found)) * every, n_groups)
        codes.sort()
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        owner, pair = np.divmod(codes[first], every)
        return (n_a, n_b, n_groups, digests, np.bincount(owner, minlength=len(found)),
                self.v.possible.searchsorted(pair).astype(np.int32), np.diff(first, append=len(codes)).astype(np.int32))


def joined(entries, which):
    """Bytes of the entries of an Arrow array (64-bit offsets) that ``which`` names, end to end, and where each starts and the last ends."""
    import numpy as np
    import pyarrow as pa

    found = entries.take(pa.array(which))
    _, places, raw = found.buffers()
    places = np.frombuffer(places, np.int64)[found.offset : found.offset + len(found) + 1]
    return memoryview(raw or b"").cast("B")[: places[-1]], places


_aligners: dict[tuple[str, str], Aligner] = {}
remember("alignment", _aligners.clear)


def aligner(byte_level: str, pieces: str) -> Aligner:
    key = (byte_level, pieces)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def aligned(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """One row per document with its distinct linked pairs (indexes of ``possible_pairs``) and how often each occurs."""
    import pyarrow as pa

    whole = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                        ("groups_sha256", pa.string()), ("pairs", whole), ("times", whole)])

    def rows_of(tool, part, texts):
        """A record batch for each run of rows whose tokens are aligned at once."""
        import numpy as np

        tokens = tool.tokens(texts)
        start = held = 0
        for i, found in enumerate(tokens):
            held += len(found[0]) // 4 if found else 0
            if held < WINDOWS and i + 1 < len(tokens):
                continue
            there = [k for k in range(start, i + 1) if tokens[k]]
            columns = {name: np.zeros(i + 1 - start, np.int64) for name in ("n_a", "n_b", "n_groups", "kinds")}
            digests, pairs, times = [""] * (i + 1 - start), np.zeros(0, np.int32), np.zeros(0, np.int32)
            if there:
                *of_rows, own, kinds, pairs, times = tool.align_many([tokens[k] for k in there])
                at = np.array(there) - start
                for name, values in zip(columns, (*of_rows, kinds)):
                    columns[name][at] = values
                for k, digest in zip(at.tolist(), own):
                    digests[k] = digest
            cuts = pa.array(np.append(0, columns.pop("kinds").cumsum()), pa.int32())
            lists = {n: pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for n, x in (("pairs", pairs), ("times", times))}
            yield pa.RecordBatch.from_arrays([part.column(0).slice(start, i + 1 - start), *map(pa.array, columns.values()),
                                              pa.array(digests, pa.string()), lists["pairs"], lists["times"]], schema=schema)
            start, held = i + 1, 0

    def run(batches):
        import gc

        tool = aligner(byte_level, pieces)
        gc.disable()  # the memories are large and hold no cycles: collecting would walk them again and again
        try:
            for part, texts in slices(batches, owner="alignment"):
                yield from rows_of(tool, part, texts)
        finally:
            gc.enable()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def pair_counts(found: DataFrame, possible: int) -> DataFrame:
    """pair, n: how many links of the corpus hold it; each task adds up its own."""
    import pyarrow as pa

    schema = pa.schema([("pair", pa.int32()), ("n", pa.int64())])

    def run(batches):
        import numpy as np

        total = np.zeros(possible, np.int64)
        for batch in batches:
            pairs, times = (batch.column(i).flatten().to_numpy() for i in (0, 1))
            total += np.bincount(pairs, times, possible).astype(np.int64)
        there = total.nonzero()[0]
        yield records(schema, {"pair": there.astype(np.int32), "n": total[there]})

    return found.select("pairs", "times").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokenizers(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per document."""
    import numpy as np
    import pyarrow as pa

    spark, v = docs.sparkSession, Vocabularies(byte_level, pieces)
    found, _ = written(aligned(docs, byte_level, pieces), "aligned")
    counts, owner = np.zeros(len(v.possible), np.int64), v.pair_owner()
    for row in pair_counts(found, len(counts)).collect():  # at most len(v.possible) rows, bounded by the vocabularies
        counts[row["pair"]] = row["n"]
    highest = np.zeros(len(v.b_bytes), np.int64)
    np.maximum.at(highest, owner, counts)
    shared = spark.sparkContext.broadcast((counts, (counts == highest[owner]).astype(np.int64)))
    schema = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in
                        ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")])

    def run(batches):
        counts, best = shared.value
        for batch in batches:
            pairs, times = (batch.column(n).flatten().to_numpy() for n in ("pairs", "times"))
            sizes = batch.column("pairs").value_lengths().to_numpy()
            ends = np.concatenate([[0], sizes.cumsum()])

            def per_row(values):
                sums = np.concatenate([[0], values.cumsum()])
                return sums[ends[1:]] - sums[ends[:-1]]

            keep = {n: batch.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
            times = times.astype(np.int64)
            yield records(schema, keep | {"n_links": batch.column("n_groups"), "n_best": per_row(best[pairs] * times),
                                          "count_sum": per_row(counts[pairs] * times)})

    return found.mapInArrow(run, LINKED)
