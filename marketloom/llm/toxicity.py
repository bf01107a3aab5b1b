"""Toxicity by a weighted finite-state grammar over clauses.

The first automaton reads the letters of a word and gives it a class: insult (with one of a few levels of weight), threat,
target, negation or report; insults are fixed seeds and learned word beginnings, whatever ending follows.  The second is
the composition of five weighted transducers (``transducers``): negation and reported speech discount insults and threats
in reach, a target raises them, an insult waits for its target, a threat counts only with one.  It reads the classes of a
clause (up to ``.``, ``!``, ``?``, ``;`` or a line break), words without a class as steps between them, and emits the
weights of matched clause patterns, not of isolated words.  Clauses are scored: a text has the sums of what its clauses
emitted, the number of clauses that emitted anything, and its strongest clause; its score is a logistic function of these.

Learned beginnings need support by toxic rows in different contexts (copies share theirs; fewer for fewer toxic rows),
log-odds and a lower confidence limit of them, counted where no negation or reporting verb stands in reach before, each
distinct text once; the logistic function is fitted on the same rows: at most ``per_label`` distinct (id, text) of each
label, by a hash.  Edges: a null or empty text emits nothing and gets the score of that; an id labelled twice is toxic if
any label says so; null labels and null ids teach nothing; without any labelled row only the seeds count; repeated rows
are each scored but teach once.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import bounded_sample, slices, text_key
from .transducers import INSULTS, LEVELS, NEGATION, PLAIN, READ, REACH, REPORT, TARGET, TARGETED, THREAT, THREATENED, clause_table

#: Rows of each label that may be used for fitting; least distinct contexts (of many toxic rows) and log-odds of a learned
#: beginning;
#: beginnings kept at most (the best supported ones).
PER_LABEL, CONTEXTS, LOG_ODDS, ENTRIES = 10_000, 12, 4.5, 4096
#: Least distinct contexts of few toxic rows, and toxic rows per context; least lower limit of the log-odds, so many standard
#: errors below them.
FEWEST, ROWS_PER_CONTEXT, LOWEST, ERRORS = 3, 16, 1.0, 2.33
#: Lengths of a word beginning, in characters.
SHORTEST, LONGEST = 3, 7
#: Weight of a seed word that no labelled row supports.
SEED_WEIGHT = 2.5

#: Fixed word lists of the grammar.
SEED_INSULTS = ("bastard", "creep", "cretin", "dumb", "fool", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic",
                "scum", "stupid", "trash", "vermin", "worthless")
THREATS = ("burn", "crush", "destroy", "hurt", "kill", "punish", "shoot", "stab", "strangle", "töten", "matar", "tuer")
TARGETS = ("du", "he", "her", "him", "ihr", "she", "them", "they", "toi", "tu", "ustedes", "vous", "you", "your", "youre")
NEGATIONS = ("aren't", "isn't", "jamais", "kein", "keine", "never", "nicht", "no", "not", "nunca", "nie", "wasn't")
REPORTS = ("called", "calls", "claimed", "quoted", "reported", "said", "says", "wrote")

FEATURES = ("plain", "targeted", "negated", "reported", "threat", "strongest", "clauses")

_token = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]")
_ends = frozenset(".!?;\n")


def level(weight: float) -> int:
    """The symbol of an insult of about this weight."""
    return min(zip((abs(weight - w) for w in LEVELS), INSULTS))[1]


@dataclass
class Grammar:
    """The word automaton: symbols of whole words, and beginnings of insults (the longest that matches wins)."""

    beginnings: dict[str, int] = field(default_factory=dict)
    words: dict[str, int] = field(default_factory=dict)
    memory: dict[str, int | None] = field(default_factory=dict)

    @classmethod
    def of(cls, beginnings: dict[str, float]) -> Grammar:
        words: dict[str, int] = {}
        for symbol, names in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            words |= {w: symbol for w in names}
        grammar = cls({key: level(w) for key, w in beginnings.items()}, words)
        seeds = {w: grammar.classify(w) or level(SEED_WEIGHT) for w in SEED_INSULTS}
        grammar.words |= seeds
        grammar.memory.clear()
        return grammar

    def classify(self, word: str) -> int | None:
        found = self.words.get(word)
        if found is None:
            for key in reversed(beginnings_of(word)):
                if key in self.beginnings:
                    found = self.beginnings[key]
                    break
        if len(self.memory) > 200_000:
            self.memory.clear()
        self.memory[word] = found
        return found


def beginnings_of(word: str) -> list[str]:
    """Beginnings of 3 to 7 characters, and the whole word (closed by $) where it is not longer."""
    out = [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)]
    if len(word) <= LONGEST:
        out.append(word + "$")
    return out


def emit(text: str | None, grammar: Grammar) -> list[float]:
    """What the composed transducer emits for a whole text, in the order of FEATURES."""
    table, memory, classify = clause_table(), grammar.memory, grammar.classify
    follow, emitted, gaps, vectors = table.follow, table.emitted, table.gaps, table.vectors
    total, clause, strongest, clauses = [0.0] * 5, None, 0.0, 0
    state = gap = 0
    for token in [*_token.findall((text or "").lower()), "."]:
        if token in _ends:
            if clause is not None:
                clauses += 1
                strongest = max(strongest, clause[PLAIN] + clause[TARGETED] + clause[THREATENED])
                total = [a + b for a, b in zip(total, clause)]
                clause = None
            state = gap = 0
            continue
        symbol = memory[token] if token in memory else classify(token)
        if symbol is None:
            gap += 1
            continue
        if gap:
            state = gaps[min(gap, REACH)][state]
            gap = 0
        i = state * READ + symbol
        state = follow[i]
        if emitted[i]:
            found = vectors[emitted[i]]
            clause = found if clause is None else [a + b for a, b in zip(clause, found)]
    return [*(math.log1p(max(0.0, x)) for x in total), strongest, math.log1p(clauses)]


@dataclass
class Model:
    beginnings: dict[str, float]
    weights: list[float]  # one per feature, then the constant


#: Used where nothing can be fitted.
DEFAULT = [0.5, 0.7, 0.0, 0.0, 1.0, 0.6, 0.2, -2.5]


def fit_logistic(x, y, penalty: float = 1.0, steps: int = 50) -> list[float]:
    """Ridge-penalised logistic regression with both labels weighted alike, by Newton steps; constant last."""
    import numpy as np

    x = np.hstack([np.asarray(x, float), np.ones((len(x), 1))])
    y = np.asarray(y, float)
    n1, n0 = y.sum(), (1 - y).sum()
    v = np.where(y > 0, 0.5 / n1, 0.5 / n0) * len(y)
    w = np.zeros(x.shape[1])
    ridge = penalty * np.append(np.ones(x.shape[1] - 1), 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (v * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (v * (y - p)) - ridge * w)
        w = w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return [float(a) for a in w]


def labelled_sample(docs: DataFrame, labels: DataFrame, may_learn: Column, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, toxic, text of at most ``per_label`` distinct (id, text) of each label."""
    per_doc = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & may_learn).groupBy("doc_id")
               .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    keys = docs.select("doc_id", text_key()).join(per_doc, "doc_id")
    return bounded_sample(docs, keys, "toxic", per_label, 2).select("doc_id", "toxic", "text")


def learn_beginnings(sample: DataFrame, contexts: int = CONTEXTS, log_odds: float = LOG_ODDS,
                     entries: int = ENTRIES) -> dict[str, float]:
    """Weighted word beginnings that mark the toxic rows of the sample; each distinct text counts once."""
    import pyarrow as pa

    turning = frozenset(NEGATIONS + REPORTS)
    schema = pa.schema([("key", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64()), ("mask", pa.int64())])

    def count(batches):
        from zlib import crc32

        from .common import records

        def flush():
            rows = {"key": list(n), "toxic": [v[0] for v in n.values()], "clean": [v[1] for v in n.values()],
                    "mask": [v[2] - (1 << 64) if v[2] >> 63 else v[2] for v in n.values()]}
            n.clear()
            return records(schema, rows)

        n: dict[str, list[int]] = {}
        for part, texts in slices(batches):
            for toxic, text in zip(part.column(0).to_pylist(), texts):
                seen: dict[str, int] = {}
                before, place, turned = "", 0, -REACH - 1
                for word in _token.findall((text or "").lower()):
                    place += 1
                    if word in _ends:
                        turned = -REACH - 1
                    elif word in turning:
                        turned = place
                    elif len(word) >= SHORTEST and place - turned > REACH:
                        bit = 1 << (crc32(before.encode()) & 63) if toxic else 0
                        for key in beginnings_of(word):
                            seen.setdefault(key, bit)  # one context of each text
                    before = word
                for key, mask in seen.items():
                    v = n.setdefault(key, [0, 0, 0])
                    v[1 - toxic] += 1
                    v[2] |= mask
            if len(n) > 500_000:
                yield flush()
        yield flush()

    rows = sample.groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select(
        "toxic", "text")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = rows.mapInArrow(count, "key string, toxic long, clean long, mask long").groupBy("key").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("mask").alias("mask"))
    cells = [F.col("toxic") + 0.5, sizes.get(1, 0) - F.col("toxic") + 0.5, F.col("clean") + 0.5, sizes.get(0, 0) - F.col("clean") + 0.5]
    odds = F.log(cells[0] / cells[1]) - F.log(cells[2] / cells[3])
    lowest = F.col("odds") - ERRORS * F.sqrt(sum((1 / c for c in cells), F.lit(0.0)))
    fewest = min(contexts, max(FEWEST, sizes.get(1, 0) // ROWS_PER_CONTEXT))
    best = (counts.withColumn("odds", odds).filter(
                (F.bit_count("mask") >= fewest) & (F.col("odds") >= log_odds) & (lowest >= LOWEST))
            .orderBy(F.desc("toxic"), "key").limit(entries).collect())
    return most_specific([(r["key"], r["toxic"], r["odds"]) for r in best])


def most_specific(found: list[tuple[str, int, float]], share: float = 0.9) -> dict[str, float]:
    """Without the beginnings of which one longer beginning explains nearly all toxic rows (``mor`` beside ``moron$``)."""
    support = {key: toxic for key, toxic, _ in found}
    explained = {key[:n] for key, toxic, _ in found for n in range(SHORTEST, len(key))
                 if toxic >= share * support.get(key[:n], float("inf"))}
    return {key: odds for key, _, odds in found if key not in explained}


def emissions(docs: DataFrame, beginnings: dict[str, float], carried: str = "doc_id") -> DataFrame:
    """A whole-number column and FEATURES of every row."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(beginnings)

    def run(batches):
        grammar = Grammar.of(shared.value)
        for part, texts in slices(batches):
            rows = [emit(t, grammar) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.float64()) for c in zip(*rows))],
                                             names=[carried, *FEATURES])

    spec = f"{carried} long, " + ", ".join(f"`{f}` double" for f in FEATURES)
    return docs.select(F.col(carried).cast("long").alias(carried), "text").mapInArrow(run, spec)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, per_label: int = PER_LABEL) -> Model:
    sample, _ = written(labelled_sample(docs, labels, may_learn, per_label), "toxicity-sample")
    beginnings = learn_beginnings(sample)
    rows = emissions(sample, beginnings, "toxic").collect()  # at most per_label rows of each of two labels
    y = [r["toxic"] for r in rows]
    if len(set(y)) < 2:
        return Model(beginnings, DEFAULT)
    return Model(beginnings, fit_logistic([[r[f] for f in FEATURES] for r in rows], y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 up) and FEATURES, one row per input row."""
    z = F.lit(model.weights[-1])
    for f, w in zip(FEATURES, model.weights):
        z = z + F.col(f) * F.lit(w)
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return emissions(docs, model.beginnings).withColumn("score", p).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")).select("doc_id", "score", "predicted", *FEATURES)
