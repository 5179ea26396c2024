"""Runs of a text that byte-level BPE treats apart from each other, so that work on them can be kept.

A blank between two characters that are not white space always begins a pre-token, whatever stands
around it. Cut there, a text falls into chunks whose token ids depend on the chunk alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_ODD = re.compile(r"\s | \s")
_CUT = re.compile(r"(?<=\S) (?=\S)")

#: Chunks, or words, whose result a task keeps; beyond that it starts afresh. Results do not depend on it.
KEPT = 250_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 letters for
    themselves, the others by the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def cut(text: str) -> list[str]:
    """The chunks; all but the first have a blank before them that is left out here."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


class Kept:
    """Results by chunk. ``solve`` gives the results of a list of chunks."""

    def __init__(self, solve: Callable[[list[str]], list], most: int = KEPT):
        self.solve, self.most, self.first, self.rest = solve, most, {}, {}

    def of(self, texts: list[str]) -> list[tuple]:
        """Per text: the result of its first chunk and an iterator over those of the others."""
        if len(self.first) + len(self.rest) > self.most:
            self.first, self.rest = {}, {}
        parts = [cut(t) for t in texts]
        heads = list({p[0] for p in parts} - self.first.keys())
        new: set[str] = set()
        for p in parts:
            new.update(p[1:])
        tails = list(new - self.rest.keys())
        solved = self.solve(heads + [" " + t for t in tails])
        self.first.update(zip(heads, solved[: len(heads)], strict=True))
        self.rest.update(zip(tails, solved[len(heads) :], strict=True))
        get = self.rest.__getitem__
        return [(self.first[p[0]], map(get, p[1:])) for p in parts]
