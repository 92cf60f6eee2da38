"""Bounded-space online packing of documents into fixed windows.

Each partition keeps OPEN windows. A document's full windows leave at once; what remains of it goes
to the open window with the least room that holds it; when none does, the fullest window is filled
with the head of the piece and leaves. The windows still open at a partition's end are merged, GROUP
partitions at a time, into full windows; the last partial one is cut into powers of two, which need
no padding.

Defined cases: a null or empty text has the end id alone; null and repeated ids, and repeated rows,
are documents like any other; an empty table gives no sequences; extra columns are ignored; a long
document is cut at window size, each id lying in exactly one piece.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.units import UnitCache, slices
from attestor.runtime import materialise, prepare, tidied

#: Length of a window; open windows of a partition; partitions whose leftovers meet in one task; the id after a document.
WINDOW, OPEN, GROUP, END_ID = 1024, 32, 64, 0

#: Characters handed to the tokenizer at once: its records of a text take far more memory than the text.
_JOINED = 200_000
#: Units remembered; their values are short here.
REMEMBERED = 300_000


def _ranks(file: dict) -> dict[bytes, int] | None:
    """The ranks by bytes that a tokenizers file amounts to, or None."""
    model, cut = file["model"], file.get("pre_tokenizer") or {}
    vocab, merges = model.get("vocab"), model.get("merges")
    plain = model.get("type") == "BPE" and not file.get("normalizer") and not model.get("byte_fallback") and not model.get("ignore_merges")
    if not plain or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    if len(vocab) != 256 + len(pairs) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    # byte-level files write the bytes that do not print as the characters from 256 on
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {bytes(byte[c] for c in token): i for token, i in vocab.items()}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, as the tokenizers library gives them for its file.

    Where the file is a plain byte-level BPE whose merges stand in the order of their ids, those ids are
    the ranks of the tiktoken library, which gives the same ids in a quarter of the time; texts are cut at
    the file's added tokens first, which are ids of their own. Any other file is left to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.set_threshold(1_000_000)  # many small objects, no cycles
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = file.get("added_tokens") or []
        simple = not any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added)
        self.ranks = _ranks(file) if simple else None
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        # the first that starts, of these the longest
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache = UnitCache(self.units, REMEMBERED)
        if self.ranks is not None:
            import tiktoken

            self.tokenizer = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
            self.starts = np.zeros(max(self.ranks.values()) + 1, bool)
            self.starts[[r for t, r in self.ranks.items() if t[:1] == b" "]] = True
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)

    def encoded(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids."""
        if self.ranks is None:
            for text in texts:
                yield np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()
            return
        cut = [self.marks.split(t) if self.marks else [t] for t in texts]  # every other part is an added token
        ids = _by_units([p for parts in cut for p in parts[::2]], self.cache)
        for parts in cut:
            yield b"".join([self.added[p] if k % 2 else next(ids) for k, p in enumerate(parts)])

    def units(self, units: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(units)
        run: list[int] = []
        held = 0
        for i, u in enumerate(units):
            rest = u[1:]
            if u[:1] != " " or not rest or " " in rest or rest != rest.strip():
                if u:
                    out[i] = self._ids(u).tobytes()
                continue
            run.append(i)
            held += len(u)
            if held > _JOINED:
                self._joined(units, run, out)
                run, held = [], 0
        if run:
            self._joined(units, run, out)
        return out

    def _ids(self, text: str) -> np.ndarray:
        return self.tokenizer.encode_to_numpy(text).astype("<u4")

    def _joined(self, units: list[str], run: list[int], out: list[bytes]) -> None:
        """Each unit starts with the only one of its ids that holds a space, so the ids of many can be told apart."""
        ids = self._ids("".join([units[i] for i in run]))
        cuts = np.flatnonzero(self.starts[ids]).tolist()
        if len(cuts) != len(run):  # not seen; one by one is always right
            for i in run:
                out[i] = self._ids(units[i]).tobytes()
            return
        flat = ids.tobytes()
        for i, a, b in zip(run, cuts, [*cuts[1:], len(ids)]):
            out[i] = flat[4 * a : 4 * b]


_loaded: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _by_units(texts: list[str], cache: UnitCache) -> Iterator[bytes]:
    done, ids = 0, []
    for group in slices(texts):
        for (i, _), units in zip(group, cache.values([part for _, part in group])):
            while done < i:
                yield b"".join(ids)
                done, ids = done + 1, []
            ids.extend(units)
    while done < len(texts):
        yield b"".join(ids)
        done, ids = done + 1, []


class Windows:
    """Open windows of ``size`` ids. A piece is (document, start, bytes of its ids, the document's ids)."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.open: list[list] = []  # [room, pieces]

    def add(self, piece: tuple) -> Iterator[list[tuple]]:
        """Place a piece; yields the windows that leave."""
        doc, start, ids, total = piece
        while len(ids) >= 4 * self.size:
            yield [(doc, start, ids[: 4 * self.size], total)]
            start, ids = start + self.size, ids[4 * self.size :]
        while ids:
            need = len(ids) // 4
            best = min((w for w in self.open if w[0] >= need), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.most:
                best = [self.size, []]
                self.open.append(best)
            if best is None:  # none has room: fill the fullest and let it go
                best = min(self.open, key=lambda w: w[0])
                need = best[0]
            best[1].append((doc, start, ids[: 4 * need], total))
            best[0] -= need
            start, ids = start + need, ids[4 * need :]
            if best[0] == 0:
                self.open = [w for w in self.open if w is not best]
                yield best[1]


_COLUMNS = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def _rows(window: list[tuple], sequence: int) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, total in window:
        yield doc, start, len(ids) // 4, ids, total, sequence, offset
        offset += len(ids) // 4


def _batch(rows: list[tuple], id_type: pa.DataType, more: dict) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 7
    arrays = [pa.array(c, t) for c, t in zip(columns, [id_type, *_ARROW])]
    names = ["_id", *(c.split()[0] for c in _COLUMNS.split(", "))]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array([v] * len(rows), pa.int64()) for v in more.values())], [*names, *more])


def pack(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most_open: int = OPEN) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        part = TaskContext.get().partitionId()
        encoder, windows, sequence, id_type = _encoder(vocab), Windows(window, most_open), part << 32, None
        for batch in batches:
            id_type, done = batch.schema.field(0).type, []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encoded(batch.column(1).to_pylist())):
                ids += end
                for full in windows.add((doc, 0, ids, len(ids) // 4)):
                    done.extend(_rows(full, sequence))
                    sequence += 1
            yield _batch(done, id_type, {"_group": -1})
        encoder.cache.clear()  # a worker goes on to other work
        if windows.open:
            left = [row for _, pieces in windows.open for row in _rows(pieces, -1)]
            yield _batch(left, id_type, {"_group": part // GROUP})

    placed = materialise(rows.mapInArrow(tidied(run), f"_id {kind}, {_COLUMNS}, _group long"), "packed")
    names = ["_id", *(c.split()[0] for c in _COLUMNS.split(", "))]

    def merge(key, table):
        """Leftovers of GROUP partitions, at most GROUP * OPEN windows: fill one window after the other."""
        windows, sequence, done = Windows(window, 1), (1 << 60) + (key[0].as_py() << 32), []
        for row in table.sort_by([("doc_tokens", "descending"), ("_id", "ascending"), ("start", "ascending")]).select(["_id", "start", "ids", "doc_tokens"]).to_pylist():
            for full in windows.add((row["_id"], row["start"], row["ids"], row["doc_tokens"])):
                done.extend(_rows(full, sequence))
                sequence += 1
        for _, pieces in windows.open:
            for part in powers(pieces):
                done.extend(_rows(part, sequence))
                sequence += 1
        return pa.Table.from_batches([_batch(done, table.schema.field("_id").type, {})])

    merged = placed.where("_group >= 0").groupBy("_group").applyInArrow(merge, f"_id {kind}, {_COLUMNS}")
    return placed.where("_group < 0").select(*names).unionByName(merged).withColumnRenamed("_id", id_col)


def powers(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """Cut a partial window into sequences whose lengths are powers of two, the longest first."""
    left = sum(len(p[2]) // 4 for p in pieces)
    queue = list(pieces)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            doc, start, ids, total = queue.pop(0)
            take = min(room, len(ids) // 4)
            out.append((doc, start, ids[: 4 * take], total))
            if len(ids) > 4 * take:
                queue.insert(0, (doc, start + take, ids[4 * take :], total))
            room -= take
        yield out
