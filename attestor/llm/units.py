"""Cutting texts where byte-level pretokenisers always cut, so that each distinct unit is encoded once.

A space between two characters that are not white space always starts a pretoken. Texts are cut
before such spaces; a text's ids are its units' ids in a row. Memory is bounded: texts are handled
in slices of SLICE characters, and the cache is emptied when it holds LIMIT units.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: Characters of text handled at once, and units remembered.
SLICE, LIMIT = 4_000_000, 300_000

_CUT = re.compile(r"(?<=\S)(?= \S)")
_OTHER = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 32]


def odd(text: str) -> bool:
    """Whether a space stands beside other white space, so that a plain split at spaces is not exact."""
    return "  " in text or any(c in text and (f"{c} " in text or f" {c}" in text) for c in _OTHER)


def slices(texts: list[str], size: int = SLICE) -> Iterator[list[tuple[int, str]]]:
    """Groups of (text number, part of the text), each of about ``size`` characters; long texts are cut at safe spaces."""
    group, held = [], 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > size:
            found = re.compile(r"\S \S").search(text, at + size)
            if found is None:
                break
            if group:
                yield group
            yield [(i, text[at : found.start() + 1])]
            group, held, at = [], 0, found.start() + 1
        part = text[at:] if at else text
        if held + len(part) > size and group:
            yield group
            group, held = [], 0
        group.append((i, part))
        held += len(part)
    if group:
        yield group


class UnitCache:
    """Values of units, where ``compute`` gives the values of distinct whole units (with their leading space)."""

    def __init__(self, compute: Callable[[list[str]], list], limit: int = LIMIT):
        self.compute, self.limit = compute, limit
        self.after: dict[str, object] = {}  # by the unit without its leading space
        self.whole: dict[str, object] = {}  # by the whole unit

    def clear(self) -> None:
        self.after.clear()
        self.whole.clear()

    def values(self, parts: list[str]) -> list[list]:
        """The units' values of each part."""
        if len(self.after) + len(self.whole) > self.limit:
            self.clear()
        cut = [(_CUT.split(p), True) if odd(p) else (p.split(" "), False) for p in parts]
        after: set[str] = set()
        whole: set[str] = set()
        for units, as_is in cut:
            if as_is:
                whole.update(units)
            else:
                whole.add(units[0])
                after.update(units)
                # the first unit also lands in ``after``: one needless entry a text at most
        after.difference_update(self.after)
        whole.difference_update(self.whole)
        new_after, new_whole = list(after), list(whole)
        found = self.compute([f" {u}" for u in new_after] + new_whole)
        self.after.update(zip(new_after, found))
        self.whole.update(zip(new_whole, found[len(new_after) :]))
        out = []
        for units, as_is in cut:
            if as_is:
                out.append([self.whole[u] for u in units])
            else:
                values = list(map(self.after.__getitem__, units))
                values[0] = self.whole[units[0]]
                out.append(values)
        return out
