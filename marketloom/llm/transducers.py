"""Weighted finite-state transducers of the clause grammar, and their composition into one table.

Every transducer reads the symbols of a clause word by word, passes one symbol on for each and may emit a weight.  States
count how many more words a negation, a reporting verb, a target, an insult or a threat reaches, so reach is part of the
automaton.  ``compose`` feeds the symbols that one transducer passes on to the next and adds up what both emit; states that
cannot be reached are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

#: Reach of a transducer, in words.
REACH = 6

#: Symbols: a word without a class, the end of a clause, classes of words; insults by level; passed on by transducers only:
#: a target that completes no threat, a threat with a target before it.
OTHER, END, TARGET, NEGATION, REPORT, THREAT = range(6)
LEVELS = (2.5, 4.5, 5.5, 7.0)
INSULTS = tuple(range(6, 6 + len(LEVELS)))
SHIELDED, AIMED = 6 + len(LEVELS), 7 + len(LEVELS)
SYMBOLS, READ = 8 + len(LEVELS), 6 + len(LEVELS)

#: What can be emitted.
PLAIN, TARGETED, NEGATED, REPORTED, THREATENED = range(5)
EMITTED = 5


@dataclass
class Transducer:
    """next state and symbol passed on by (state, symbol); emitted weights by (state, symbol, kind)."""

    follow: object
    passed: object
    weights: object


def machine(states: int, arcs: dict[tuple[int, int], tuple[int, int, dict[int, float]]], fade: list[int]) -> Transducer:
    """From arcs (state, symbol) -> (next, passed on, weights); other words pass through while the state fades."""
    import numpy as np

    follow = np.repeat(np.array(fade, np.int32)[:, None], SYMBOLS, 1)
    follow[:, END] = 0
    passed = np.tile(np.arange(SYMBOLS, dtype=np.int32), (states, 1))
    weights = np.zeros((states, SYMBOLS, EMITTED))
    for (state, symbol), (then, on, emitted) in arcs.items():
        follow[state, symbol], passed[state, symbol] = then, on
        for kind, weight in emitted.items():
            weights[state, symbol, kind] = weight
    return Transducer(follow, passed, weights)


def _fading() -> list[int]:
    return [max(0, r - 1) for r in range(REACH + 1)]


def discount(opener: int, kind: int) -> Transducer:
    """Negation or reported speech: an insult or threat in its reach is emitted as such and goes no further."""
    arcs: dict = {}
    for r in range(REACH + 1):
        arcs[r, opener] = REACH, OTHER, {}
        if r:
            arcs |= {(r, s): (r - 1, OTHER, {kind: w}) for s, w in zip(INSULTS, LEVELS)}
            arcs[r, THREAT] = r - 1, OTHER, {}
            arcs[r, TARGET] = r - 1, SHIELDED, {}
    return machine(REACH + 1, arcs, _fading())


def target() -> Transducer:
    """A target raises insults that follow in its reach and gives a threat its aim."""
    arcs: dict = {}
    for r in range(REACH + 1):
        arcs |= {(r, s): (REACH, s, {}) for s in (TARGET, SHIELDED)}
        if r:
            arcs |= {(r, s): (r - 1, OTHER, {TARGETED: w}) for s, w in zip(INSULTS, LEVELS)}
            arcs[r, THREAT] = r - 1, AIMED, {}
    return machine(REACH + 1, arcs, _fading())


def insult() -> Transducer:
    """A plain insult waits for a target in reach, which turns it into a targeted one."""
    count = len(LEVELS)
    fade = [0] + [1 + count * (r - 2) + k if r > 1 else 0 for r in range(1, REACH + 1) for k in range(count)]
    arcs: dict = {}
    for state in range(len(fade)):
        for k, (s, w) in enumerate(zip(INSULTS, LEVELS)):
            arcs[state, s] = 1 + count * (REACH - 1) + k, OTHER, {PLAIN: w}
        if state:
            w = LEVELS[(state - 1) % count]
            arcs |= {(state, s): (0, s, {PLAIN: -w, TARGETED: w}) for s in (TARGET, SHIELDED)}
    return machine(len(fade), arcs, fade)


def threat() -> Transducer:
    """A threat counts with a target before it or after it in reach."""
    arcs: dict = {}
    for r in range(REACH + 1):
        arcs[r, THREAT] = REACH, OTHER, {}
        arcs[r, AIMED] = REACH, OTHER, {THREATENED: 1.0}
        if r:
            arcs[r, TARGET] = r - 1, OTHER, {THREATENED: 1.0}
    return machine(REACH + 1, arcs, _fading())


def chain() -> list[Transducer]:
    """The five in the order in which they read."""
    return [discount(NEGATION, NEGATED), discount(REPORT, REPORTED), target(), insult(), threat()]


def compose(first: Transducer, then: Transducer) -> Transducer:
    """One transducer that does what ``then`` does with the symbols of ``first``."""
    import numpy as np

    n, m = len(first.follow), len(then.follow)
    on = first.passed[:, None, :]  # states of the first, states of the second, symbols
    b = np.arange(m)[None, :, None]
    follow = (first.follow[:, None, :] * m + then.follow[b, on]).reshape(n * m, SYMBOLS)
    passed = then.passed[b, on].reshape(n * m, SYMBOLS)
    weights = (first.weights[:, None, :, :] + then.weights[b, on]).reshape(n * m, SYMBOLS, EMITTED)
    seen, frontier = np.zeros(n * m, bool), np.array([0])
    while len(frontier):
        seen[frontier] = True
        frontier = np.unique(follow[frontier][:, :READ])
        frontier = frontier[~seen[frontier]]
    kept = np.flatnonzero(seen)
    number = np.zeros(n * m, np.int32)
    number[kept] = np.arange(len(kept))
    return Transducer(number[follow[kept]], passed[kept], weights[kept])


@dataclass
class ClauseTable:
    """The composed grammar as flat lists: next state and number of the emitted weights by state * READ + symbol, the state
    after up to ``REACH`` words without a class, and the distinct weights (number 0: none)."""

    follow: list[int]
    emitted: list[int]
    gaps: list[list[int]]
    vectors: list[tuple[float, ...]]


_tables: list[ClauseTable] = []


def clause_table() -> ClauseTable:
    if not _tables:
        import numpy as np

        whole = reduce(compose, chain())
        flat = whole.weights[:, :READ].reshape(-1, EMITTED)
        vectors, numbers = np.unique(np.vstack([np.zeros((1, EMITTED)), flat]), axis=0, return_inverse=True)
        none = int(numbers.ravel()[0])
        swap = np.arange(len(vectors))
        swap[[0, none]] = swap[[none, 0]]
        step, gaps, now = whole.follow[:, OTHER], [], np.arange(len(whole.follow))
        for _ in range(REACH + 1):
            gaps.append(now.tolist())
            now = step[now]
        _tables.append(ClauseTable(whole.follow[:, :READ].ravel().tolist(), swap[numbers.ravel()[1:]].tolist(), gaps,
                                   [tuple(v) for v in vectors[swap].tolist()]))
    return _tables[0]


def run_in_turn(symbols: list[int]) -> list[float]:
    """What the five emit for one clause when each is run by itself over the symbols of the one before."""
    total = [0.0] * EMITTED
    for t in chain():
        state, passed = 0, []
        for s in symbols:
            total = [a + b for a, b in zip(total, t.weights[state, s])]
            passed.append(int(t.passed[state, s]))
            state = int(t.follow[state, s])
        symbols = passed
    return total


def run_composed(symbols: list[int], table: ClauseTable) -> list[float]:
    """The same through the composed table."""
    total, state = [0.0] * EMITTED, 0
    for s in symbols:
        i = state * READ + s
        total = [a + b for a, b in zip(total, table.vectors[table.emitted[i]])]
        state = table.follow[i]
    return total
