"""Sets of hashed word shingles, and fast similarity sketches of them, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Words of a shingle; bytes hashed at once; sets whose intersections are counted at once.
WORDS, SLICE, TILE = 5, 1 << 20, 512

_SPACES = b" \t\n\x0b\x0c\r"
_r = np.random.default_rng(20240601)
_BYTE = _r.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_PLACE = _r.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_SHORT = _r.integers(1, 1 << 63, WORDS, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACES)] = True
_BASE = 0x9E3779B97F4A7C15
_GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a byte string: a polynomial in the base, from prefix sums."""
    b = np.frombuffer(data, np.uint8)
    up, down = _power(len(b))
    space = np.ones(len(b) + 2, bool)
    space[1:-1] = _IS_SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of WORDS words; of fewer words, one hash of them all."""
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        return mix((words * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + _SHORT[n])
    out = words[: n - WORDS + 1] * _PLACE[0]
    for k in range(1, WORDS):
        out += words[k : n - WORDS + 1 + k] * _PLACE[k]
    return mix(out)


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end at white space."""
    at = 0
    while len(text) - at > SLICE:
        gap = _GAP.search(text, at + SLICE)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's set of shingle hashes, sorted."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not group:
            return
        words, starts = _words(b"\n".join(group))
        cuts = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in group]))
        for a, b in zip(cuts, cuts[1:]):
            out.append(np.unique(_shingles(words[a:b])))
        group.clear()
        held = 0

    for text in texts:
        if len(text) > SLICE:
            flush()
            out.append(np.unique(_shingles(np.concatenate([_words(p)[0] for p in _parts(text)]))))
            continue
        if held + len(text) > SLICE:
            flush()
        group.append(text)
        held += len(text) + 1
    flush()
    return out


def sketches(found: list[np.ndarray], size: int = 128) -> np.ndarray:
    """Fast similarity sketches: rounds of throwing every element into a random bin; a bin keeps its least (round, hash).

    After ``size`` rounds with bins by hash come ``size`` rounds that fill one bin each, so every coordinate
    of a set that is not empty gets a value; most sets are done after a few rounds and leave.
    """
    empty = np.uint64((1 << 64) - 1)
    bits = size.bit_length() - 1
    out = np.full((len(found), size), empty, np.uint64)
    flat = out.reshape(-1)
    items = np.concatenate(found) if found else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(found)), [len(s) for s in found])
    low = np.uint64((1 << 55) - 1)
    for turn in range(2 * size):
        if not len(items):
            break
        x = mix(items + np.uint64(0x632BE59BD9B4E019 * (turn + 1) & (1 << 64) - 1))
        place = (x >> np.uint64(64 - bits)).astype(np.int64) if turn < size else turn - size
        np.minimum.at(flat, owner * size + place, (np.uint64(turn) << np.uint64(55)) | (x & low))
        if turn < 2 or turn % 4 == 3 or turn >= size:
            alive = np.unique(owner)
            open_ = np.zeros(len(found), bool)
            open_[alive] = (out[alive] == empty).any(axis=1)
            keep = open_[owner]
            if not keep.all():
                items, owner = items[keep], owner[keep]
    return out


def bands(sketch: np.ndarray, rows: int = 4) -> np.ndarray:
    """A hash of each run of ``rows`` coordinates, different for each band."""
    n, size = sketch.shape
    split = sketch.reshape(n, size // rows, rows)
    out = np.broadcast_to(np.arange(1, size // rows + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03), (n, size // rows)).copy()
    for k in range(rows):
        out = mix(out + split[:, :, k])
    return out


def similar(common: int, a: int, b: int, percent: int) -> bool:
    """Whether the intersection has at least ``percent`` hundredths of the union."""
    return 100 * common >= percent * (a + b - common)


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, by products of 0-1 matrices over the shared items."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for items, each in ((a, left), (b, right)):
        owner = np.repeat(np.arange(len(each)), [len(s) for s in each])
        slot = np.minimum(np.searchsorted(shared, items), max(0, len(shared) - 1))
        hit = shared[slot] == items if len(shared) else np.zeros(len(items), bool)
        slot, owner = slot[hit], owner[hit]
        order = np.argsort(slot, kind="stable")
        sides.append((slot[order], owner[order], len(each)))
    for start in range(0, len(shared), columns):
        blocks = []
        for slot, owner, n in sides:
            i, j = np.searchsorted(slot, [start, start + columns])
            block = np.zeros((n, columns), np.float32)
            block[owner[i:j], slot[i:j] - start] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out.astype(np.int64)
