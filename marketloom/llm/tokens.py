"""Exact byte-level BPE ids at corpus speed: texts are cut where the tokenizer always cuts, and pieces are remembered.

The tokenizer's own first step separates a text at a single space or line break that stands between two non-blank
characters, and marks after letters from the letters; it encodes the parts independently. So each part is encoded by
the tokenizers library once and looked up afterwards. Texts with other white space are cut at the safe places only.
The memory is bounded.
"""

from __future__ import annotations

import os
import re
from itertools import filterfalse

from .common import remember

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces remembered per Python worker before the memory starts anew; longer pieces are encoded each time.
REMEMBERED, LONGEST = 400_000, 64
#: Characters whose pieces are held at once, apart from those remembered (a longer text is held alone).
CUT = 500_000

#: White space other than the plain space and the line break (fixed values).
OTHER_BLANKS = ("\t", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", " ", " ",
                " ", " ", " ", " ", " ", " ", " ", " ", " ", " ",
                " ", " ", " ", "　")
_ascii_blanks, _all_blanks = OTHER_BLANKS[:8], OTHER_BLANKS
_safe_cut = re.compile(r"(?<=\S) (?=\S)")
_marks = ".,;:!?"


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.first: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self._opens: list = []

    def _encode(self, pieces: list[str]) -> list[bytes]:
        from array import array

        out = []
        for i in range(0, len(pieces), 8192):
            for e in self.tokenizer.encode_batch_fast(pieces[i : i + 8192], add_special_tokens=False):
                out.append(array("I", e.ids).tobytes())
        return out

    def _encode_behind_blanks(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces behind a space or their own line break.

        Pieces without other white space are encoded many in a text, as they stand in documents: each has one blank, with which
        a token starts, so the ids are cut there.
        """
        import numpy as np

        words, others = [], []
        for p in pieces:
            bare = p[1:] if p[:1] == "\n" else p
            (words if bare.split() == [bare] else others).append(p)
        found = dict(zip(others, self._encode([p if p[:1] == "\n" else " " + p for p in others])))
        if not self._opens:
            starts = np.zeros(self.tokenizer.get_vocab_size(), bool)
            starts[[i for token, i in self.tokenizer.get_vocab().items() if token[0] in "\u0120\u010a"]] = True  # space, line break
            self._opens.append(starts)
        for i in range(0, len(words), 8192):
            part = words[i : i + 8192]
            texts = ["".join([p if p[0] == "\n" else " " + p for p in part[k : k + 256]]) for k in range(0, len(part), 256)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            at = 4 * np.flatnonzero(self._opens[0][ids])
            if len(at) != len(part):  # a tokenizer that does not cut at blanks
                found.update(zip(part, self._encode([p if p[0] == "\n" else " " + p for p in part])))
                continue
            raw, at = ids.tobytes(), at.tolist()
            found.update(zip(part, [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]))
        return [found[p] for p in pieces]

    @staticmethod
    def _pieces(text: str) -> list[str]:
        """The first piece, then pieces that follow a cut space (not kept) or start with their line break."""
        blanks = _ascii_blanks if text.isascii() else _all_blanks
        plain = len(text.split()) == text.count(" ") + text.count("\n") + 1 and not any(b in text for b in blanks)
        return text.replace("\n", " \n").split(" ") if plain else _safe_cut.split(text)

    def _learn(self, new: set[str]) -> None:
        known, bases, marked = self.known, set(), []
        for p in new:
            base = p.rstrip(_marks)
            if base is not p and base[-1:].isalpha():
                marked.append((p, base))
                if base not in known and base not in new:
                    bases.add(base)
            else:
                bases.add(p)
        todo = list(bases)
        known.update(zip(todo, self._encode_behind_blanks(todo)))
        tails = {p[len(b):] for p, b in marked}
        tail_ids = dict(zip(tails, self._encode(list(tails))))
        for p, b in marked:
            known[p] = known[b] + tail_ids[p[len(b):]]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > CUT:
                out += self._encode_texts(texts[start:i])
                start, size = i, 0
            size += len(t)
        return out + self._encode_texts(texts[start:])

    def _encode_texts(self, texts: list[str]) -> list[bytes]:
        known, first = self.known, self.first
        if len(known) > REMEMBERED:
            known.clear()
        if len(first) > REMEMBERED // 10:
            first.clear()
        heads, cut, new = [], [], set()
        for t in texts:
            parts = self._pieces(t)
            heads.append(parts[0])
            del parts[0]
            cut.append(parts)
            new.update(filterfalse(known.__contains__, parts))
        self._learn(new)
        fresh = list({h for h in heads if h not in first})
        first.update(zip(fresh, self._encode(fresh)))
        out = [first[h] + b"".join(map(known.__getitem__, parts)) for h, parts in zip(heads, cut)]
        for group, pieces in ((known, new), (first, fresh)):
            for p in pieces:
                if len(p) > LONGEST:
                    group.pop(p, None)
        return out


_encoders: dict[str, PieceEncoder] = {}
remember("tokens", _encoders.clear)


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
