"""Substring dedup by content-defined chunking with a gear rolling hash.

A text's bytes are cut where a gear hash of the last 16 bytes has zero bits, so cuts move with the
content when something is inserted before it. A stretch without such a place for LONGEST bytes is cut at the
last least hash in it, which also is a rule of the content: text of one word over and over is cut in step
wherever it stands. Runs of CHAIN chunks (about 70 bytes) are looked up by digest, 96 bits of two independent
hashes. Of the documents that hold a digest the one with the least id is the original (by hash, where ids are not
whole numbers; without an id, the last); its runs stay, in all others they are repeats. What repeats only within
one document stays. Stretches of repeats of at least LEAST bytes are cut out of their texts, in whole words, or in
whole characters where no white space is within EDGE bytes. Up to about a chunk on either side of a passage stays.

Each task resolves the repeats among HELD places at a time and sends on only the first place of a digest among
them, so a passage that many documents share reaches the task of its digest once for each such load, not once per
document. Digests are dealt to as many tasks as the table's size asks for.

Defined cases: a null text stays null, an empty one empty; texts of fewer than CHAIN chunks are left as
they are; a text that wholly repeats others becomes (nearly) empty but its row stays; rows that repeat
both id and text are treated as one and get the same text; null ids are allowed; an empty table stays
empty; the result does not depend on the order of rows; extra columns pass through, but for ones named
removed or n_removed, which are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.shingles import mix
from attestor.runtime import prepare, tidied

#: A cut where these bits are zero; bytes of a chunk at least and at most; chunks looked up together; bytes cut out at least.
MASK, SHORTEST, LONGEST, CHAIN, LEAST = 0xF000, 8, 48, 3, 100
#: Bytes in which an edge of a stretch looks for white space.
EDGE = 64
#: Bytes handled at once; places resolved at once in a task; bytes of text for each bucket of digests; tasks that resolve buckets, one after the other.
SLICE, HELD, BUCKET, TASKS = 1 << 20, 500_000, 16 << 20, 100_000

_r = np.random.default_rng(977)
_GEAR = _r.integers(0, 1 << 16, 256).astype(np.uint16)
#: Two of each, for two hashes.
_BYTE = _r.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_PLACE = _r.integers(1, 1 << 63, (2, LONGEST), dtype=np.uint64) | np.uint64(1)
_LINK = _r.integers(1, 1 << 63, (2, CHAIN), dtype=np.uint64) | np.uint64(1)
_PAD = bytes(16)


def _gear(b: np.ndarray) -> np.ndarray:
    """The gear hash of the 16 bytes up to each place."""
    h = _GEAR[b]
    for s in (1, 2, 4, 8):  # the hash of 2s bytes from that of s: h(i) + (h(i - s) << s)
        more = h.copy()
        more[s:] += h[:-s] << np.uint16(s)
        h = more
    return h


def _cuts(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends, and the number of the text that each is in; texts lie at [start, end) with padding before."""
    b = np.frombuffer(buffer, np.uint8)
    parts = []
    for a in range(0, len(b), SLICE):
        low = max(0, a - len(_PAD))
        found = np.flatnonzero((_gear(b[low : a + SLICE]) & np.uint16(MASK)) == 0) + 1 + low
        parts.append(found[found > a] if a else found)
    raw = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    owner = np.searchsorted(ends, raw, "left")
    inside = owner < len(ends)
    raw, owner = raw[inside], owner[inside]
    inside = (raw > starts[owner]) & (raw < ends[owner])
    raw, owner = raw[inside], owner[inside]
    before = np.maximum(np.concatenate([[0], raw[:-1]]), starts[owner]) if len(raw) else raw
    raw = raw[raw - before >= SHORTEST]  # by the cut before it, kept or not: a rule of the content alone
    points = np.unique(np.concatenate([raw, ends[ends > starts]]))
    owner = np.searchsorted(ends, points, "left")
    before = np.maximum(np.concatenate([[0], points[:-1]]), starts[owner]) if len(points) else points
    long = np.flatnonzero(points - before > LONGEST)
    if len(long):
        extra = [_forced(b, int(before[i]), int(points[i])) for i in long]
        points = np.sort(np.concatenate([points, *extra]))
        owner = np.searchsorted(ends, points, "left")
    return points, owner


def _forced(b: np.ndarray, start: int, end: int) -> list[int]:
    """Cuts of a long chunk, each at the last least hash of the next LONGEST bytes."""
    hashes = _gear(b[start + 1 - len(_PAD) : end])[len(_PAD) - 1 :]
    out, at = [], start
    while end - at > LONGEST:
        window = hashes[at + SHORTEST - 1 - start : at + LONGEST - start]
        at += LONGEST - int(window[::-1].argmin())
        out.append(at)
    return out


def _digests(buffer: bytes, begin: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two hashes of each chunk [begin, end)."""
    b = np.frombuffer(buffer, np.uint8)
    out = np.empty((2, len(ends)), np.uint64)
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, begin[i] + SLICE)))
        size = ends[i:j] - begin[i:j]
        first = np.cumsum(size) - size
        within = np.arange(size.sum()) - np.repeat(first, size)
        held = b[np.repeat(begin[i:j] - first, size) + np.arange(len(within))]
        for k in (0, 1):
            out[k, i:j] = np.add.reduceat(_BYTE[k][held] * _PLACE[k][within], first) + size.astype(np.uint64)
        i = j
    return mix(out)


def chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its chunks' ends, and the digests (two rows, of 64 and of 32 bits) of its runs of CHAIN chunks."""
    group: list[bytes] = []
    held = 0

    def done():
        sizes = np.array([len(t) for t in group], np.int64)
        buffer = b"".join([_PAD + t for t in group])
        ends = np.cumsum(sizes + len(_PAD))
        starts = ends - sizes
        points, owner = _cuts(buffer, starts, ends)
        begin = np.maximum(np.concatenate([[0], points[:-1]]), starts[owner]) if len(points) else points
        digest = _digests(buffer, begin, points)
        bounds = np.searchsorted(owner, np.arange(len(group) + 1))
        for i, (a, z) in enumerate(zip(bounds, bounds[1:])):
            n = z - a - CHAIN + 1
            runs = np.zeros((2, 0), np.uint64)
            if n > 0:
                runs = mix(sum(digest[:, a + k : a + k + n] * _LINK[:, k : k + 1] for k in range(CHAIN)))
                runs[1] >>= np.uint64(32)
            yield points[a:z] - starts[i], runs

    for text in texts:
        if group and held + len(text) > SLICE:
            yield from done()
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield from done()


def _firsts(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by digest that else leaves places as they are, and for each place of it the first one of its digest."""
    order = np.argsort(digest, kind="stable")
    d = digest[order]
    new = np.concatenate([[True], d[1:] != d[:-1]])
    return order, order[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]


def _by_document(key: np.ndarray, text: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(key and text hash of a document, its distinct places)."""
    order = np.lexsort((place, text, key))
    key, text, place = key[order], text[order], place[order]
    cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])) if len(key) else []
    for a, b in zip(cuts, [*cuts[1:], len(key)]):
        yield int(key[a]), int(text[a]), np.unique(place[a:b])


def _encode(t: str | None) -> bytes:
    return (t or "").encode("utf-8", "surrogatepass")


def _key(df: DataFrame, id_col: str) -> Column:
    """What orders documents: a whole number as it is, another id by its hash, a null one last."""
    whole = df.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)), F.lit((1 << 63) - 1))


_ENTRY = np.dtype([("digest", "<u8"), ("more", "<u4"), ("key", "<i8"), ("text", "<i8"), ("place", "<i4")])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_key, _hash (of the text), places (chunks at which a run starts that an earlier document has), for texts that have any.

    Of a run that a text holds more than once at least one place is given.
    """
    prepare(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = int(max(32, -(-size // BUCKET)))
    tasks = min(buckets, TASKS)
    rows = docs.select(_key(docs, id_col).alias("key"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["bucket", "key", "hash", "places", "blob"])

    def found(entries: np.ndarray, order: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
        """The places, in ``order``, whose digest stands in another document ``first``; by document."""
        a, b = entries[order], entries[first]
        again = order[(a["more"] == b["more"]) & ((a["key"] != b["key"]) | (a["text"] != b["text"]))]
        for key, text, places in _by_document(*(entries[c][again] for c in ("key", "text", "place"))):
            yield (key ^ text) % buckets, key, text, places, None

    def resolved(held: list[tuple]) -> Iterator[tuple]:
        """A load's own repeats by document, and its first places by bucket."""
        held.sort(key=lambda x: x[:2])
        counts = [x[2].shape[1] for x in held]
        entries = np.empty(sum(counts), _ENTRY)
        for c, k in (("key", 0), ("text", 1)):
            entries[c] = np.repeat(np.array([x[k] for x in held], np.int64), counts)
        entries["place"] = np.concatenate([np.arange(c, dtype=np.int32) for c in counts])
        entries["digest"], entries["more"] = np.concatenate([x[2] for x in held], axis=1)
        order, first = _firsts(entries["digest"])
        yield from found(entries, order, first)
        order = order[(order == first) | (entries["more"][order] != entries["more"][first])]  # by digest, so by bucket
        bucket = ((entries["digest"][order] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            yield int(bucket[a]), None, None, None, entries[order[a:b]].tobytes()

    def chunk(batches):
        held, places = [], 0
        for batch in batches:
            out = []
            keys, hashes = (batch.column(k).to_pylist() for k in (0, 1))
            for key, text, (_, runs) in zip(keys, hashes, chunks([_encode(t) for t in batch.column(2).to_pylist()])):
                if runs.shape[1]:
                    held.append((key, text, runs))
                    places += runs.shape[1]
                if places > HELD:
                    out.extend(resolved(held))
                    held, places = [], 0
            yield batch_of(out)
        if held:
            yield batch_of(list(resolved(held)))

    def meet(blobs: list[bytes]) -> Iterator[tuple]:
        entries = np.frombuffer(b"".join(blobs), _ENTRY)
        blobs.clear()
        order, first = _firsts(entries["digest"])
        shared = np.isin(first, first[order != first])
        entries = entries[order[shared]]
        entries = entries[np.lexsort((entries["place"], entries["text"], entries["key"]))]
        if len(entries):
            yield from found(entries, *_firsts(entries["digest"]))

    def look_up(batches):
        blobs, last = [], None
        for batch in batches:
            out = []
            sent = batch.filter(pc.is_valid(batch.column(4)))
            for b, x in zip(sent.column(0).to_pylist(), sent.column(4).to_pylist()):
                if b != last and blobs:
                    out.extend(meet(blobs))
                    blobs = []
                last = b
                blobs.append(x)
            yield batch.filter(pc.is_null(batch.column(4)))
            yield batch_of(out)
        if blobs:
            yield batch_of(list(meet(blobs)))

    schema = "bucket int, key long, hash long, places array<int>, blob binary"
    dealt = rows.mapInArrow(tidied(chunk), schema).repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidied(look_up), schema).groupBy(F.col("key").alias("_key"), F.col("hash").alias("_hash")).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))


def spans(text: bytes, ends: np.ndarray, places: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Byte ranges to cut out: stretches covered by repeated runs, of at least ``least`` bytes, shrunk to whole words or characters."""
    marked = np.zeros(len(ends) + 1, np.int64)
    np.add.at(marked, places, 1)
    np.add.at(marked, np.minimum(places + CHAIN, len(ends)), -1)
    inside = np.concatenate([[False], np.cumsum(marked[:-1]) > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin = np.concatenate([[0], ends])
    out = []
    for a, b in zip(begin[edge[::2]].tolist(), begin[edge[1::2]].tolist()):
        if b - a < least:
            continue
        a, b = _edge(text, a, range(a, min(b, a + EDGE) + 1)), _edge(text, b, range(b, max(a, b - EDGE) - 1, -1))
        if a < b:
            out.append((a, b))
    return out


def _edge(text: bytes, at: int, near: range) -> int:
    """The first place of ``near`` beside white space or the text's ends; else the first that parts no character."""
    for i in near:
        if i in (0, len(text)) or text[i - 1 : i].isspace() or text[i : i + 1].isspace() and near.step < 0:
            return i
    return next((i for i in near if text[i] & 0xC0 != 0x80), at)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with repeats cut out of ``text_col``, and n_removed (characters) and removed (their ranges in the text before)."""
    tag = f"_cut{uuid.uuid4().hex[:8]}"  # no column of docs
    found = repeats(docs, id_col, text_col).select(F.col("_key").alias(f"{tag}k"), F.col("_hash").alias(f"{tag}h"), F.col("places").alias(f"{tag}p"))
    joined = docs.withColumns({f"{tag}k": _key(docs, id_col), f"{tag}h": F.xxhash64(text_col)}).join(found, [f"{tag}k", f"{tag}h"], "left")

    @F.pandas_udf("text string, removed array<struct<start:int,end:int>>")
    def cut(texts, places):
        import pandas as pd

        out = []
        for text, at in zip(texts, places):
            if at is None or text is None:
                out.append((text, []))
                continue
            data = _encode(text)
            ((ends, runs),) = chunks([data])
            # a run that an earlier document has is a repeat wherever it stands in this one
            gone = spans(data, ends, np.flatnonzero(np.isin(runs[0], runs[0][np.asarray(at, np.int64)])), least)
            kept, last, ranges = [], 0, []
            length = lambda a, b: len(data[a:b].decode("utf-8", "surrogatepass"))
            done = 0
            for a, b in gone:
                kept.append(data[last:a])
                done += length(last, a)
                ranges.append({"start": done, "end": done + length(a, b)})
                done += length(a, b)
                last = b
            kept.append(data[last:])
            out.append((b"".join(kept).decode("utf-8", "surrogatepass"), ranges))
        return pd.DataFrame(out, columns=["text", "removed"])

    out = joined.withColumn(f"{tag}c", cut(F.col(text_col), F.col(f"{tag}p")))
    names = [c for c in docs.columns if c not in ("removed", "n_removed")]
    out = out.select(*[F.col(f"{tag}c.text").alias(c) if c == text_col else F.col(c) for c in names], F.col(f"{tag}c.removed").alias("removed"))
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]).cast("long"))
    return out.withColumn("n_removed", total)
