"""LM scoring by a gated recurrent network in numpy, trained data-parallel and applied to complete documents.

Tokens are the lower-cased (A-Z) words between ASCII blanks, then one end. Counts of all tokens of all training texts
give the base score and the vocabulary: the ``HEAD`` most frequent tokens have places of their own, every other token
(known or not) belongs to a class of spelling. The output is factored: softmax over classes given the state, then either
softmax over the words of a head class given the state, or the smoothed share of the word in its spelling class. All
probabilities add up to at most 1 over the known tokens and one unknown.

The network (a GRU) starts as the unigram model. Training segments are all stretches of every training text, each in one
round (chosen by hash); they are dealt to trainers, of which there are more for more segments. A trainer runs truncated
backpropagation, carrying the state from window to window of a segment; after each round the parameters are averaged,
weighted by tokens, in a tree. Scoring carries the state through a whole document: documents are laid end to end in
parallel streams, with the state reset where one begins.

Tokens outside a bounded dictionary are looked up by a join with the counts. Edges: a null or empty text is one end;
without training texts everything is unknown; repeated rows are each scored and each counted; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_path, written
from .common import slices

#: Tokens held by every worker; tokens with an output place; words of a head class; classes of spelling.
DICTIONARY, HEAD, PER_CLASS, SPELLINGS = 1 << 18, 1024, 32, 48
#: State size; steps of a window; tokens of a training segment; rounds.
STATE, STEPS, SEGMENT, ROUNDS = 32, 32, 128, 4
#: Parallel segments of an update; learning rate; segments per trainer.
BATCH, RATE, PER_TRAINER = 32, 0.008, 20_000
#: Parallel streams, tokens held at once and places whose probabilities are taken at once when scoring.
STREAMS, HELD, AT_ONCE = 256, 6_000_000, 2048
#: Distinct tokens a counting worker holds before it hands them on.
COUNTED = 500_000

END = b""
_ascii = bytes(range(128))


def tokens(text: bytes | None) -> list[bytes]:
    """Words without [\\x20\\x09-\\x0D], then the end; such bytes never cut a UTF-8 character."""
    words = text.lower().split() if text else []
    words.append(END)
    return words


def spelling(word: bytes) -> int:
    """What decides the class of a rare token: its last byte beyond ASCII, or else its last letter before marks."""
    beyond = word.translate(None, _ascii)
    if beyond:
        return 256 + beyond[-1]
    base = word.rstrip(b".,;:!?$#%&*|\"')")
    return (base or word or b"\0")[-1]


def column_tokens(texts):
    """Tokens of all texts of a binary Arrow array end to end, as ``tokens`` gives them, and how many each text has."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.cast(pa.binary()).fill_null(b"")
    as_string = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), texts.null_count, texts.offset)
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(as_string))
    # a blank after the last word leaves an empty one behind it, as an empty text is one: the end
    closed = pc.binary_join_element_wise(bare, pc.if_else(pc.equal(bare, ""), "", " "), "")
    lists = pc.ascii_split_whitespace(closed)
    return lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy()


def token_counts(docs: DataFrame) -> DataFrame:
    """word, n over all rows of ``docs``."""
    import pyarrow as pa

    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        held, rows = [], 0

        def merged():
            t = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return pa.table([t.column("word"), t.column("n_sum")], schema=schema)

        for part, _ in slices(batches):
            found = column_tokens(part.column(0))[0].value_counts()
            held.append(pa.table([found.field(0), found.field(1)], schema=schema))
            rows += len(found)
            if rows > 2 * COUNTED:
                held = [merged()]
                if held[0].num_rows > COUNTED:
                    yield from held.pop().to_batches()
                rows = sum(t.num_rows for t in held)
        if held:
            yield from merged().to_batches()

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(
        F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What the workers need: ids below HEAD are tokens, the others classes of spelling."""

    total: int  # N
    distinct: int  # V
    words: object  # the dictionary's tokens, an Arrow array; their rows of the two arrays below
    ids: object  # int16 per dictionary token
    log_count: object  # log10(c + 0.5) per dictionary token
    spellings: dict[int, int]  # key -> class of spelling; the last one is for all other keys
    head: int
    head_class: object  # class of each head token
    head_place: object  # its place in the class
    class_words: list  # head ids of each head class
    class_log_mass: object  # natural log of each class's share, head classes first
    head_log_share: object  # natural log of a head token's share of its class
    log_mass: object  # log10 of the smoothed total of each class of spelling

    @property
    def head_classes(self) -> int:
        return len(self.class_words)

    @property
    def inputs(self) -> int:
        return self.head + len(self.log_mass)

    def rare_id(self, word: bytes) -> int:
        return self.head + self.spellings.get(spelling(word), len(self.log_mass) - 1)

    def look_up(self, words):
        """Row in the dictionary (or -1) and id of each word of an Arrow array."""
        import numpy as np
        import pyarrow.compute as pc

        rows = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        ids = np.append(self.ids, np.int16(0))[rows]
        new = np.flatnonzero(rows < 0)
        if len(new):
            other = words.take(new).dictionary_encode()
            ids[new] = np.array([self.rare_id(w) for w in other.dictionary.to_pylist()], np.int16)[other.indices.to_numpy()]
        return rows, ids


def vocabulary(counts: DataFrame) -> Vocabulary:
    import numpy as np
    import pyarrow as pa

    total, distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    levels = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    level = (levels.withColumn("upto", F.sum("k").over(Window.orderBy(F.desc("n")))).filter(F.col("upto") <= DICTIONARY)
             .agg(F.min("n")).first()[0])
    # at most DICTIONARY rows
    rows = None if level is None else counts.filter(F.col("n") >= level).toArrow()
    found = sorted(zip(rows["word"].to_pylist(), rows["n"].to_pylist()), key=lambda x: (-x[1], x[0])) if rows else []
    head, tail = found[:HEAD], found[HEAD:]
    mass: dict[int, int] = {}
    for word, n in tail:
        k = spelling(word)
        mass[k] = mass.get(k, 0) + n
    best = sorted(mass, key=lambda k: (-mass[k], k))[: SPELLINGS - 1]
    spellings = {k: i for i, k in enumerate(best)}
    classes = len(best) + 1
    head_words = {w for w, _ in head}

    def sums(batches):
        for batch in batches:
            n, types = np.zeros(classes), np.zeros(classes)
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word not in head_words:
                    k = spellings.get(spelling(word), classes - 1)
                    n[k] += c
                    types[k] += 1
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(classes), pa.int32()), "n": n, "types": types})

    smoothed = np.full(classes, 0.5)
    for r in counts.select("word", "n").mapInArrow(sums, "k int, n double, types double").groupBy("k").agg(
            F.sum("n").alias("n"), F.sum("types").alias("types")).collect():
        smoothed[r["k"]] += r["n"] + 0.5 * r["types"]

    order = sorted(range(len(head)), key=lambda i: (spelling(head[i][0]), i))
    class_words = [order[i : i + PER_CLASS] for i in range(0, len(order), PER_CLASS)]
    head_mass = np.array([n + 0.5 for _, n in head])
    head_class, head_place = np.zeros(len(head), np.int32), np.zeros(len(head), np.int32)
    class_mass = np.empty(len(class_words))
    for c, words in enumerate(class_words):
        head_class[words], head_place[words] = c, np.arange(len(words))
        class_mass[c] = head_mass[words].sum()
    all_mass = np.concatenate([class_mass, smoothed])
    ids = np.array([*range(len(head)), *(len(head) + spellings.get(spelling(w), classes - 1) for w, _ in tail)], np.int16)
    return Vocabulary(total, distinct, pa.array([w for w, _ in found], pa.binary()), ids,
                      np.log10(np.array([n for _, n in found], float) + 0.5), spellings, len(head), head_class, head_place,
                      class_words, np.log(all_mass / all_mass.sum()),
                      np.log(head_mass / class_mass[head_class]) if len(head) else head_mass, np.log10(smoothed))


def by_gate(x):
    """Columns of the three gates as three matrices: elementwise steps then run over whole pieces of memory."""
    import numpy as np

    return np.ascontiguousarray(x.reshape(len(x), 3, STATE).transpose(1, 0, 2))


def summed(rows, keys):
    """Distinct keys and the sum of each one's rows (which are sorted by key and get changed): neighbours are added in halves."""
    import numpy as np

    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(first, append=len(keys))
    place, left = np.arange(len(keys)) - np.repeat(first, sizes), np.repeat(sizes, sizes)
    reach, at = 1, np.flatnonzero(left > 1)
    while len(at):
        at = at[(place[at] % (2 * reach) == 0) & (place[at] + reach < left[at])]
        rows[at] += rows[at + reach]
        reach *= 2
    return keys[first], rows[first]


class Network:
    """Parameters and the two passes.  Arrays: inputs (ids x 3H), recur (H x 3H), out (H x classes) and bias, head words."""

    def __init__(self, v: Vocabulary, seed: int = 1):
        import numpy as np

        rng = np.random.default_rng(seed)
        h, c = STATE, v.head_classes
        self.v = v
        bias = np.full((c, PER_CLASS), -1e4)
        for k, words in enumerate(v.class_words):
            bias[k, : len(words)] = v.head_log_share[words]
        self.p = {k: x.astype(np.float32) for k, x in {
            "inputs": rng.normal(0, 0.3, (v.inputs, 3 * h)), "recur": rng.normal(0, 0.6 / np.sqrt(h), (h, 3 * h)),
            "out": np.zeros((h, c + len(v.log_mass))), "out_bias": v.class_log_mass,
            "words": np.zeros((c, h, PER_CLASS)), "words_bias": bias}.items()}

    def flat(self):
        import numpy as np

        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat) -> Network:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype("f4")
            at += x.size
        return self

    def step(self, h, x, recur=None, out=None, keep=None):
        """Next state of the streams; ``x`` and ``recur`` may come by gate (see ``by_gate``), the results go to ``out``.

        ``keep`` (3 x streams x H) gets what the backward pass needs: both gates and the candidate's share of h @ recur. The
        candidate itself replaces its part of ``x`` where that came by gate.
        """
        import numpy as np

        x = by_gate(x) if x.ndim == 2 else x
        keep = np.matmul(h, by_gate(self.p["recur"]) if recur is None else recur, out=keep)
        zr, n = keep[:2], x[2]
        zr += x[:2]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)  # where it overflows, the gate is 0
        zr += 1
        np.reciprocal(zr, out=zr)
        n += zr[1] * keep[2]
        np.tanh(n, out=n)
        out = np.subtract(h, n, out=out)
        out *= zr[0]
        out += n
        return out

    def log_probs(self, states, ids, grads: dict | None = None):
        """Natural log-probability of each id given its state (classes of spelling: of the class).

        With ``grads``, adds the loss's gradients there and returns also those of the states.
        """
        import numpy as np

        v, p = self.v, self.p
        in_head = ids < v.head
        cls = np.where(in_head, v.head_class[np.minimum(ids, max(0, v.head - 1))] if v.head else 0,
                       v.head_classes + ids - v.head)
        rows = np.arange(len(ids))
        a = states @ p["out"]
        a += p["out_bias"]
        a -= a.max(1, keepdims=True)
        out = a[rows, cls]
        np.exp(a, out=a)
        s = a @ np.ones(a.shape[1], a.dtype)
        out -= np.log(s)
        back = None
        if grads is not None:
            a /= s[:, None]
            a[rows, cls] -= 1
            grads["out"] += states.T @ a
            grads["out_bias"] += np.ones(len(a), a.dtype) @ a
            back = a @ p["out"].T
        at = np.flatnonzero(in_head)
        if len(at):
            self._head_words(states, ids, at, cls[at], out, grads, back)
        return (out, back) if grads is not None else out

    def _head_words(self, states, ids, at, cls, out, grads, back):
        """Adds the words inside their head classes: rows lie in blocks of one class each, multiplied in one call."""
        import numpy as np

        p, width = self.p, 16 if len(at) < 1024 else 64
        turn = np.argsort(cls, kind="stable")
        order, cls = at[turn], cls[turn]
        sizes = np.bincount(cls, minlength=self.v.head_classes)
        blocks = -(-sizes // width)
        first, owner = np.cumsum(blocks) - blocks, np.repeat(np.arange(len(blocks)), blocks)
        slot = first[cls] * width + np.arange(len(order)) - (np.cumsum(sizes) - sizes)[cls]
        place = self.v.head_place[ids[order]]
        x = np.zeros((len(owner) * width, STATE), states.dtype)
        x[slot] = states[order]
        x, words = x.reshape(-1, width, STATE), p["words"][owner]
        a = np.matmul(x, words)
        a += p["words_bias"][owner][:, None, :]
        a -= a.max(2, keepdims=True)
        flat = a.reshape(-1, PER_CLASS)
        own = flat[slot, place]
        np.exp(a, out=a)
        s = flat @ np.ones(PER_CLASS, flat.dtype)
        out[order] += own - np.log(s[slot])
        if grads is None:
            return
        share = np.zeros_like(s)  # the unused rows of a block have no gradient
        share[slot] = 1 / s[slot]
        flat *= share[:, None]
        flat[slot, place] -= 1
        used, sums = summed(np.matmul(x.transpose(0, 2, 1), a), owner)
        grads["words"][used] += sums
        grads["words_bias"][used] += summed(a.sum(1), owner)[1]
        back[order] += np.matmul(a, words.transpose(0, 2, 1)).reshape(-1, STATE)[slot]

    def gradients(self, h, ids, weight, real=None, into: dict | None = None):
        """Truncated backpropagation over one window of ids (steps x streams); returns (gradients, last state, loss).

        Where ``real`` is given, the places outside it (after a stream's end) have no loss and give no gradient.
        ``into`` holds zeros of the parameters' shapes and gets the gradients.
        """
        import numpy as np

        p = self.p
        g = {k: np.zeros_like(x) for k, x in p.items()} if into is None else into
        steps, streams = ids.shape
        recur = by_gate(p["recur"])
        x = by_gate(p["inputs"]).take(ids, axis=1)
        states = np.empty((steps + 1, streams, STATE), x.dtype)
        states[0] = h
        kept = np.empty_like(x)
        for t in range(steps):
            self.step(states[t], x[:, t], recur, states[t + 1], kept[:, t])
        before = states[:-1]
        flat = before.reshape(-1, STATE)
        if real is None:
            loss, back = self.log_probs(flat, ids.ravel(), g)
        else:
            at = np.flatnonzero(real.ravel())
            back = np.zeros_like(flat)
            loss, back[at] = self.log_probs(flat[at], ids.ravel()[at], g)
        back = back.reshape(steps, streams, STATE)
        # a step's gradients are its state's gradient times these factors, which need no loop over the steps
        (z, r, of_h), n = kept, x[2]
        rest = 1 - z
        of_n = rest * (1 - n * n)
        dg = np.empty_like(x)
        np.multiply(before - n, z, out=dg[0])
        dg[0] *= rest
        np.multiply(of_n, r, out=dg[2])
        np.multiply(dg[2], of_h, out=dg[1])
        dg[1] *= 1 - r
        dh, turned, parts = np.zeros_like(before), np.ascontiguousarray(recur.transpose(0, 2, 1)), np.empty_like(x[:, 0])
        for t in range(steps - 1, 0, -1):
            now, to = dg[:, t], dh[t - 1]
            now *= dh[t]
            np.matmul(now, turned, out=parts)
            np.multiply(dh[t], z[t], out=to)
            to += back[t]
            for part in parts:
                to += part
        dg[:, 0] *= dh[0]
        g["recur"] += np.matmul(flat.T, dg.reshape(3, -1, STATE)).transpose(1, 0, 2).reshape(STATE, -1)
        np.multiply(dh, of_n, out=dg[2])
        order = np.argsort(ids, axis=None, kind="stable")
        which, sums = summed(dg.reshape(3, -1, STATE).transpose(1, 0, 2).reshape(-1, 3 * STATE)[order], ids.ravel()[order])
        g["inputs"][which] += sums
        if weight != 1:
            for y in g.values():
                y *= weight
        return g, states[-1], -float(loss.sum())


def fit_segments(net: Network, segments: list, rate: float = RATE) -> int:
    """Adam over the segments in batches, window by window with the state carried on; returns the tokens used."""
    import numpy as np

    value = net.flat()  # all parameters, their gradients and moments lie end to end
    grad, mean, square, spare = (np.zeros_like(value) for _ in range(4))
    into, at = {}, 0
    for k, x in net.p.items():
        net.p[k], into[k] = (y[at : at + x.size].reshape(x.shape) for y in (value, grad))
        at += x.size
    step = used = 0
    segments = sorted(segments, key=len, reverse=True)
    starts = np.arange(0, len(segments), BATCH)
    # batches have segments of like length, so they come in mixed order: the last updates are not all of short texts
    for i in np.random.default_rng(len(segments)).permutation(starts):
        group = segments[i : i + BATCH]
        lengths = np.array([len(x) for x in group])
        h = np.zeros((len(group), STATE), np.float32)
        ids = np.zeros((lengths[0], len(group)), np.int64)
        for k, x in enumerate(group):
            ids[: len(x), k] = x
        for t in range(0, lengths[0], STEPS):
            live = int((lengths > t).sum())  # the longest come first
            window = ids[t : t + STEPS, :live]
            real = np.arange(t, t + len(window))[:, None] < lengths[:live]
            grad.fill(0)
            _, h, _ = net.gradients(h[:live], window, 1, None if real.all() else real, into)
            step += 1
            used += int(real.sum())
            # every token counts alike, however few a window has
            weight = 1 / (BATCH * STEPS)
            norm = weight * np.sqrt(np.dot(grad, grad))
            grad *= np.float32(weight * min(1.0, 1.0 / (norm + 1e-9)))
            scale = np.float32(rate * min(1.0, step / 20) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step))
            np.subtract(grad, mean, out=spare)
            spare *= np.float32(0.1)
            mean += spare
            np.multiply(grad, grad, out=grad)
            grad -= square
            grad *= np.float32(0.001)
            square += grad
            np.sqrt(square, out=spare)
            spare += np.float32(1e-6)
            np.divide(mean, spare, out=spare)
            spare *= scale
            value -= spare
    return used


def training_segments(docs: DataFrame, shared) -> DataFrame:
    """turn, doc_id, start, ids: every stretch of SEGMENT tokens (the last one shorter) of every text.

    The turn is a hash of id and place.
    """
    import pyarrow as pa

    schema = pa.schema([("turn", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def cut(batches):
        from zlib import crc32

        from .common import records

        voc = shared.value
        for part, _ in slices(batches):
            turns, owners, starts, out = [], [], [], []
            words, sizes = column_tokens(part.column(1))
            ids = voc.look_up(words)[1]
            at = 0
            for doc_id, size in zip(part.column(0).to_pylist(), sizes.tolist()):
                for i in range(0, size, SEGMENT):
                    turns.append(crc32(f"{doc_id}:{i}".encode()) % ROUNDS)
                    owners.append(doc_id)
                    starts.append(i)
                    out.append(ids[at + i : at + min(size, i + SEGMENT)].tobytes())
                at += size
            yield records(schema, {"turn": turns, "doc_id": owners, "start": starts, "ids": out})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        cut, "turn int, doc_id long, start long, ids binary")


def dealt(segments: DataFrame, trainers: int) -> DataFrame:
    """ids of the segments, spread over the trainers by document and place: copies of one text don't meet in one.

    A session that deals to more partitions than were asked for has no more trainers for it: each takes several of them.
    """
    return segments.repartition(trainers, F.xxhash64("doc_id", "start", "ids")).coalesce(trainers).select("ids")


def averaged(rows: DataFrame, fan: int = 32):
    """Weighted mean of written (trainer, tokens, weights): sums of ``fan`` rows at a time, until few are left.

    The rows are counted: a session may deal the segments to more trainers than were asked for. Sums in between are deleted.
    """
    import numpy as np
    import pandas as pd

    spark, folders = rows.sparkSession, []

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(w, "f8") for w in frame["weights"])
        return pd.DataFrame({"trainer": [int(frame["trainer"].iloc[0]) // fan], "tokens": [int(frame["tokens"].sum())],
                             "weights": [total.tobytes()]})

    schema = "trainer int, tokens long, weights binary"
    while rows.count() > fan:
        rows, path = written(rows.groupBy(F.floor(F.col("trainer") / fan)).applyInPandas(add, schema), "lm-sums")
        folders.append(path)
    got = rows.collect()
    for path in folders:
        drop_path(spark, path)
    tokens_used = sum(r["tokens"] for r in got)
    return sum(np.frombuffer(r["weights"], "f8") for r in got) / tokens_used if tokens_used else None


def train(docs: DataFrame, v: Vocabulary, shared) -> Network:
    """Rounds of local training and averaging over the segments of ``docs``; ``shared`` is the broadcast vocabulary."""
    segments, folder = written(training_segments(docs, shared), "lm-segments")
    net = Network(v)
    trainers = max(1, round(segments.count() / PER_TRAINER))
    for turn in range(ROUNDS):
        start = net.flat()  # a few hundred kilobytes

        def fit(batches, start=start, rate=RATE / (1 + turn)):
            import numpy as np
            import pyarrow as pa
            from pyspark import TaskContext

            mine = [np.frombuffer(x, np.int16) for b in batches for x in b.column(0).to_pylist()]
            own = Network(shared.value).load(start)
            with np.errstate(over="ignore"):
                used = fit_segments(own, mine, rate)
            if used:
                yield pa.RecordBatch.from_pydict({
                    "trainer": pa.array([TaskContext.get().partitionId()], pa.int32()), "tokens": pa.array([used], pa.int64()),
                    "weights": pa.array([(own.flat().astype("f8") * used).tobytes()], pa.binary())})

        rows, path = written(dealt(segments.filter(F.col("turn") == turn), trainers).mapInArrow(
            fit, "trainer int, tokens long, weights binary"), "lm-round")
        mean = averaged(rows)
        drop_path(docs.sparkSession, path)  # a trainer's weights take a megabyte; their mean is here
        if mean is not None:
            net.load(mean)
    drop_path(docs.sparkSession, folder)
    return net


def run_streams(net: Network, documents: list):
    """Natural log-probability of each document (arrays of ids), all of it, with the state carried through."""
    import heapq

    import numpy as np

    v, total = net.v, np.zeros(len(documents))
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    n = min(STREAMS, len(documents))
    lanes: list[list[int]] = [[] for _ in range(n)]
    heap = [(0, k) for k in range(n)]
    for i in order:
        size, k = heapq.heappop(heap)
        lanes[k].append(i)
        heapq.heappush(heap, (size + len(documents[i]), k))
    lanes.sort(key=lambda x: -sum(len(documents[i]) for i in x))
    flat = [np.concatenate([documents[i] for i in x]) for x in lanes]
    owner = [np.repeat(np.array(x, np.int32), [len(documents[i]) for i in x]) for x in lanes]
    lengths = np.array([len(x) for x in flat])
    begins: dict[int, list[int]] = {}
    for k, lane in enumerate(lanes):
        at = 0
        for i in lane:
            begins.setdefault(at, []).append(k)
            at += len(documents[i])
    h = np.zeros((n, STATE), np.float32)
    inputs, recur = by_gate(net.p["inputs"]), by_gate(net.p["recur"])
    for s in range(0, int(lengths[0]) if n else 0, STEPS):
        live = int((lengths > s).sum())
        width = min(STEPS, int(lengths[0]) - s)
        ids, who = np.zeros((width, live), np.int64), np.full((width, live), -1, np.int32)
        for k in range(live):
            part = flat[k][s : s + width]
            ids[: len(part), k] = part
            who[: len(part), k] = owner[k][s : s + width]
        states = np.empty((width + 1, live, STATE), np.float32)
        states[0] = h[:live]
        for t in range(width):
            if s + t in begins:
                states[t, [k for k in begins[s + t] if k < live]] = 0
            net.step(states[t], inputs.take(ids[t], axis=1), recur, states[t + 1])
        h = states[width]
        seen, whose, what = states[:width].reshape(-1, STATE), who.ravel(), ids.ravel()
        for i in range(0, len(what), AT_ONCE):
            real = np.flatnonzero(whose[i : i + AT_ONCE] >= 0) + i
            logp = net.log_probs(seen[real], what[real])
            np.add.at(total, whose[real], logp)
    return total


SCORED = "doc_id long, n_tokens long, n_known long, log_counts double, rare_counts double, network double, unknown array<binary>"


def scores(docs: DataFrame, net: Network, shared) -> DataFrame:
    """Per row: what the dictionary and the network give, and the tokens that only the count table knows."""
    import pyarrow as pa

    flat = net.flat()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()),
                        ("rare_counts", pa.float64()), ("network", pa.float64()), ("unknown", pa.list_(pa.binary()))])

    def run(batches):
        from math import log

        import numpy as np

        voc = shared.value
        own = Network(voc).load(flat)
        logs, masses = np.append(voc.log_count, 0.0), np.concatenate([np.zeros(voc.head), voc.log_mass])
        waiting, parts, held = [], [], 0

        def flush():
            nonlocal waiting, parts, held
            with np.errstate(over="ignore"):
                network = run_streams(own, waiting) / log(10)
            at = 0
            for doc_ids, n, known, log_c, rare, mass, unknown in parts:
                yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(x) for x in (n, known, log_c, rare, network[at : at + len(n)] - mass)),
                                                  unknown], schema=schema)
                at += len(n)
            waiting, parts, held = [], [], 0

        for part, _ in slices(batches):
            words, sizes = column_tokens(part.column(1))
            rows, ids = voc.look_up(words)
            ends = np.cumsum(sizes, dtype=np.int64)
            first, log_c = ends - sizes, logs[rows]
            new = np.concatenate([[0], np.cumsum(rows < 0)])[np.append(first, ends[-1])]
            parts.append((part.column(0), sizes.astype(np.int64), sizes - np.diff(new), np.add.reduceat(log_c, first),
                          np.add.reduceat(np.where(ids >= voc.head, log_c, 0.0), first), np.add.reduceat(masses[ids], first),
                          pa.ListArray.from_arrays(pa.array(new, pa.int32()), words.filter(pa.array(rows < 0)))))
            waiting += np.split(ids, ends[:-1])
            held += len(ids)
            if held >= HELD:
                yield from flush()
        if waiting:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, SCORED)


def score_documents(docs: DataFrame, may_learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per input row (log10 probabilities)."""
    learning = docs.filter(may_learn).select("doc_id", "text")
    counts, _ = written(token_counts(learning), "lm-counts")
    v = vocabulary(counts)
    shared = docs.sparkSession.sparkContext.broadcast(v)  # DICTIONARY bounds it
    net = train(learning, v, shared)
    rows, _ = written(scores(docs, net, shared).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    shared.destroy()  # everything that read it has been written
    rare = (rows.select("row", F.explode("unknown").alias("token")).join(counts, F.col("token") == F.col("word"), "left")
            .groupBy("row").agg(F.count("n").alias("known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("logs"))
            .withColumnRenamed("row", "of"))
    zero = F.lit(0.0)
    logs = F.coalesce("logs", zero)
    import math

    share = math.log10(v.total + 0.5 * (v.distinct + 1))
    return rows.join(rare, F.col("row") == F.col("of"), "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("log_counts") + logs - F.col("n_tokens") * F.lit(share)).alias("base_score"),
        (F.col("network") + F.col("rare_counts") + logs).alias("score"))
