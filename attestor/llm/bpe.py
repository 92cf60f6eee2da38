"""Byte-level BPE by corpus-level merge replay.

The distinct pretokens of a stretch of the corpus form one flat array of symbols. An inverted index
maps the rank that an adjacent pair would merge to, to the positions of such pairs. Ranks are applied
in order over all words at once; a merge looks only at its two neighbours and files their new pairs.

Defined cases: a null text counts as empty; an empty text has no ids (digests of the empty string);
extra columns are ignored; rows are independent, so repeated rows and null ids are plain rows.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.units import UnitCache, slices
from attestor.runtime import prepare, tidied

#: Unicode's White_Space, as the pattern's \s means it.
_SPACE = r"\t-\r \x85\xa0  -     　"


#: Units that a worker remembers with their ids, over its tasks.
REMEMBERED = 1_000_000
#: Places from which merges are done as arrays; a rank beyond all ranks.
MANY, NONE = 48, 1 << 62


class Merges:
    """A vocabulary of ranks: the rank of each adjacent pair, and the replay of merges."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.byte = np.full(256, -1, np.int64)
        for b in range(256):
            self.byte[b] = self.ranks[bytes([b])]
        self.shift = max(self.tokens).bit_length()
        self.pairs: dict[int, int] = {}
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = get(token[:i]), get(token[i:])
                if left is not None and right is not None:
                    self.pairs[left << self.shift | right] = rank
        by_left = sorted(self.pairs)
        self.keys = np.array(by_left, np.int64)
        self.to = np.array([self.pairs[k] for k in by_left], np.int64)
        mirrored = (self.keys & ((1 << self.shift) - 1)) << self.shift | self.keys >> self.shift
        by_right = np.argsort(mirrored)
        self.mirrored, self.mirrored_to = mirrored[by_right], self.to[by_right]
        self.splits: dict[int, list[int]] = {}
        for key, rank in self.pairs.items():
            self.splits.setdefault(rank, []).append(key)
        self.text = {r: str(r) for r in self.tokens}
        self.pattern = regex.compile(pattern.replace(r"\S", f"[^{_SPACE}]").replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]"))

    def pretokens(self, unit: str) -> list[str]:
        """The matches of the pattern in a unit."""
        rest = unit[1:]
        if unit[:1] == " " and rest.isalpha():
            return [unit]
        if unit[:1] == " " and rest[:-1].isalpha() and rest[-1] in ".,;:!?":
            return [unit[:-1], rest[-1]]
        return self.pattern.findall(unit)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of every word, by replaying all merges over all words."""
        out: list[list[int]] = [[self.ranks[w]] if w in self.ranks else [] for w in words]
        todo = [i for i, w in enumerate(words) if w and not out[i]]
        if not todo:
            return out
        flat = np.frombuffer(b"".join(words[i] for i in todo), np.uint8)
        ends = np.cumsum([len(words[i]) for i in todo])
        symbols = self.byte[flat]
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False  # no pair starts at a word's last symbol
        at = np.flatnonzero(inner)
        key = symbols[at] << self.shift | symbols[at + 1]
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[slot] == key
        at, rank = at[hit], self.to[slot[hit]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        firsts = np.flatnonzero(np.diff(rank, prepend=-1))
        index = {int(rank[a]): at[a:b].tolist() for a, b in zip(firsts, [*firsts[1:], len(rank)])}
        left = self._replay(symbols, inner, index)
        alive = left >= 0
        ids = left[alive].tolist()
        counts = np.concatenate([[0], np.cumsum(alive)])[ends].tolist()
        start = 0
        for i, end in zip(todo, counts):
            out[i] = ids[start:end]
            start = end
        return out

    def _replay(self, sym: np.ndarray, inner: np.ndarray, index: dict[int, list[int]]) -> np.ndarray:
        """Apply ranks in order. ``index``: the inverted index from rank to the left positions of its pairs.

        Long position lists are merged as arrays, short ones one by one on the same memory.
        """
        n = len(sym)
        places = np.arange(n)
        after = np.where(inner, places + 1, n)  # n: none
        before = np.full(n + 1, -1)
        before[1:] = np.where(inner, places, -1)
        heap = list(index)
        heapq.heapify(heap)
        views = memoryview(sym), memoryview(after), memoryview(before)
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            if len(found) < MANY or not self._merge_many(rank, found, sym, after, before, index, heap):
                self._merge_few(rank, found, *views, index, heap)
        return sym

    def _merge_few(self, rank: int, places: list[int], sym, after, before, index: dict, heap: list) -> None:
        n, shift, get = len(sym), self.shift, self.pairs.get
        places.sort()
        for k, p in enumerate(places):
            q = after[p]
            if sym[p] < 0 or q == n or get(sym[p] << shift | sym[q]) != rank:
                continue  # a neighbour has been merged meanwhile
            sym[p], sym[q] = rank, -1
            r, o = after[q], before[p]
            after[p] = r
            new = []
            if r != n:
                before[r] = p
                new.append((p, get(rank << shift | sym[r])))
            if o >= 0:
                new.append((o, get(sym[o] << shift | rank)))
            sooner = False
            for place, to in new:
                if to is not None:
                    if to in index:
                        index[to].append(place)
                    else:
                        index[to] = [place]
                        heapq.heappush(heap, to)
                    sooner = sooner or to < rank
            if sooner:  # a lower rank has come up: it goes first, the rest of this rank afterwards
                if k + 1 < len(places):
                    index[rank] = places[k + 1 :]
                    heapq.heappush(heap, rank)
                return

    def _merge_many(self, rank: int, found: list[int], sym, after, before, index: dict, heap: list) -> bool:
        """The same for all places at once; False, with nothing done, where their order could matter."""
        n, shift = len(sym), self.shift
        p = np.unique(np.array(found))
        p = p[(sym[p] >= 0) & (after[p] < n)]
        q = after[p]
        key = sym[p] << shift | sym[q]
        fits = np.zeros(len(p), bool)
        for split in self.splits[rank]:
            fits |= key == split
        p, q = p[fits], q[fits]
        if not len(p):
            return True
        if len(p) > 1 and (q[:-1] == p[1:]).any():
            return False
        r, o = after[q], before[p]
        right, left = r < n, o >= 0
        first = self._known(self.keys, self.to, rank, sym[r[right]])
        second = self._known(self.mirrored, self.mirrored_to, rank, sym[o[left]])
        if (len(first) and (first < rank).any()) or (len(second) and (second < rank).any()):
            return False
        both = self.pairs.get(rank << shift | rank)
        if both is not None and both < rank:
            return False
        sym[p], sym[q] = rank, -1
        after[p] = r
        before[r[right]] = p[right]
        # neighbours may have merged at the same time: look again
        first = self._known(self.keys, self.to, rank, sym[r[right]])
        second = self._known(self.mirrored, self.mirrored_to, rank, sym[before[p][left]])
        at = np.concatenate([p[right], before[p][left]])
        to = np.concatenate([first, second])
        at, to = at[to < NONE], to[to < NONE]
        if len(at):
            order = np.argsort(to, kind="stable")
            at, to = at[order].tolist(), to[order]
            cuts = np.flatnonzero(np.diff(to, prepend=-1))
            for k, a, b in zip(to[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
                if k in index:
                    index[k] += at[a:b]
                else:
                    index[k] = at[a:b]
                    heapq.heappush(heap, k)
        return True

    def _known(self, keys: np.ndarray, to: np.ndarray, rank: int, other: np.ndarray) -> np.ndarray:
        """The ranks of (rank, other) by ``keys`` sorted by their high half, or NONE."""
        a, b = np.searchsorted(keys, [rank << self.shift, rank + 1 << self.shift])
        if a == b or not len(other):
            return np.full(len(other), NONE)
        key = rank << self.shift | other
        slot = np.minimum(np.searchsorted(keys[a:b], key), b - a - 1) + a
        return np.where(keys[slot] == key, to[slot], NONE)

    def units(self, units: list[str]) -> list[tuple[str, bytes]]:
        """Each unit's ids as decimal text, joined by commas, and the bytes that they decode to."""
        cut = [self.pretokens(u) for u in units]
        words = list({w for c in cut for w in c})
        ids = self.encode([w.encode("utf-8", "surrogatepass") for w in words])
        text = {w: ",".join([self.text[x] for x in i]) for w, i in zip(words, ids)}
        back = {w: self.decode(i) for w, i in zip(words, ids)}
        return [(",".join([text[w] for w in c]), b"".join([back[w] for w in c])) for c in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


_loaded: dict[str, tuple[Merges, UnitCache]] = {}


def _cache(path: str) -> UnitCache:
    if path not in _loaded:
        gc.set_threshold(1_000_000)  # tables of many small tuples, no cycles
        merges = Merges(path)
        _loaded[path] = merges, UnitCache(merges.units, REMEMBERED)
    return _loaded[path][1]


def encoded(texts: list[str], cache: UnitCache) -> Iterator[tuple[str, bytes]]:
    """For each text its ids as decimal text joined by commas, and the decoded bytes."""
    done, ids, back = 0, [], []
    for group in slices(texts):
        for (i, _), units in zip(group, cache.values([part for _, part in group])):
            while done < i:
                yield ",".join(ids), b"".join(back)
                done, ids, back = done + 1, [], []
            ids.extend(u[0] for u in units if u[0])
            back.extend(u[1] for u in units)
    while done < len(texts):
        yield ",".join(ids), b"".join(back)
        done, ids, back = done + 1, [], []


def encode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ids array<int>, decoded binary."""
    return _run(docs, vocab, id_col, text_col, "ids array<int>, decoded binary", lambda ids, back: ([int(x) for x in ids.split(",")] if ids else [], back))


def digests(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_tokens, and digests of the ids and of the decoded bytes, made where they arise."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return _run(
        docs, vocab, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda ids, back: (ids.count(",") + 1 if ids else 0, sha(ids.encode()), sha(back)),
    )


def _run(docs: DataFrame, vocab: str, id_col: str, text_col: str, columns: str, result) -> DataFrame:
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    names = [c.split()[0] for c in columns.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    kinds = [types[c.split()[1]] for c in columns.split(", ")]

    def run(batches):
        cache = _cache(vocab)
        for batch in batches:
            done = [result(*x) for x in encoded(batch.column(1).to_pylist(), cache)]
            arrays = [pa.array([x[k] for x in done], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(tidied(run), f"`{id_col}` {kind}, {columns}")
