"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors become integers floor(256 x) and are laid out so that neighbours share a document range: each
range (a partition of about RANGE vectors) holds blocks of BLOCK vectors as a forward index, with each
term's (component's) maximum and minimum in the block and in the range. For a query the sum of its terms
times those maxima bounds every score in the block or range.

1. A query searches its own range, which gives a first kth result.
2. Queries meet the maxima and minima of all ranges (packs of PACK, a small part of the vectors' bytes);
   pairs of a query and a range whose bound falls below the query's kth end here.
3. Vectors go only to ranges that some query is left for, once for each CHUNK of such queries, and queries
   only to the ranges left for them. In a range, blocks are scored in the order of their bounds, AHEAD at
   a time for each query, until the bounds fall below the kth result so far.

What is shuffled and scored thus grows with the pairs that survive. Where vectors have no structure
(directions spread evenly) bounds exclude little, and an exact search scores nearly all pairs; a task
holds one range and CHUNK queries then too, and scores them by matrix products.

Defined cases: vectors null, without id, or with a null or non-finite component take no part; an empty
vector scores 0 with all; of vectors of different length the shorter is filled up with zeros; integers
beyond +-2^62 are held at that; sums are exact and held within a long; rows that repeat an id are
candidates (and queries) of their own, but not for queries of that id; ties go to the smaller id; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.runtime import materialise, prepare

#: Vectors of a block and of a range; queries that a task searches a range for; ranges whose bounds a task holds; queries bounded or searched
#: at once; blocks scored for a query before its kth result is looked at again.
BLOCK, RANGE, CHUNK, PACK, BATCH, AHEAD = 64, 4096, 32_768, 4096, 1024, 8
#: Vectors, picked by their id's hash, whose nearest one orders the table.
PIVOTS = 64
_LIMIT = 1 << 62


def matrix(rows: list[bytes]) -> np.ndarray:
    """Integer vectors as rows, filled up with zeros."""
    width = max((len(r) for r in rows), default=0) // 8
    if all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r) // 8] = np.frombuffer(r, "<i8")
    return out


def _same_width(*arrays: np.ndarray) -> list[np.ndarray]:
    width = max(a.shape[1] for a in arrays)
    return [np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in arrays]


def _magnitude(a: np.ndarray) -> int:
    return max(int(a.max(initial=0)), -int(a.min(initial=0)))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows: in doubles where those are exact, else in Python's integers."""
    if _magnitude(a) * _magnitude(b) * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)


_NONE, _LAST = -(1 << 63), (1 << 63) - 1


def bounds_of(queries: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The largest score that each query can have with vectors between ``low`` and ``top``."""
    return _sum(product(np.maximum(queries, 0), top), product(np.minimum(queries, 0), low))


class Blocks:
    """A document range: vectors in blocks, with term maxima and minima."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, size: int = BLOCK):
        self.ids, self.vectors = ids, vectors
        self.cuts = [(a, min(a + size, len(ids))) for a in range(0, len(ids), size)]
        self.top = np.stack([vectors[a:b].max(axis=0) for a, b in self.cuts])
        self.low = np.stack([vectors[a:b].min(axis=0) for a, b in self.cuts])
        self.least = np.array([ids[a:b].min() for a, b in self.cuts])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray, floor_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, score): of each query at most ``k`` results, the best, ordered by query, score and id.

        ``floor``, ``floor_id``: a kth result that each query is known to have; blocks and results below it are left out.
        """
        queries, vectors, top, low = _same_width(queries, self.vectors, self.top, self.low)
        floor, floor_id = floor.copy(), floor_id.copy()
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        bounds = bounds_of(queries, top, low)
        order = np.argsort(-bounds.astype(np.float64), axis=1, kind="stable")
        rest = np.flip(np.maximum.accumulate(np.flip(np.take_along_axis(bounds, order, axis=1), axis=1), axis=1), axis=1)
        active = np.arange(len(queries))
        for step in range(0, len(self.cuts), AHEAD):
            active = active[rest[active, step] >= floor[active]]  # no later block can reach the kth
            if not len(active):
                break
            block = order[active, step : step + AHEAD]
            todo, block = np.repeat(active, block.shape[1]), block.ravel()
            bound = bounds[todo, block]
            open_ = (bound > floor[todo]) | ((bound == floor[todo]) & (self.least[block] <= floor_id[todo]))
            todo, block = todo[open_], block[open_]
            by = np.argsort(block, kind="stable")
            todo, block = todo[by], block[by]
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            found = [best]
            for s, e in zip(starts, [*starts[1:], len(block)]):
                a, b = self.cuts[block[s]]
                q, own = todo[s:e], self.ids[a:b]
                got = product(queries[q], vectors[a:b])
                # few are left once a query has k results
                r, c = np.nonzero(got >= floor[q][:, None])
                fits = ((got[r, c] > floor[q[r]]) | (own[c] <= floor_id[q[r]])) & (own[c] != query_ids[q[r]])
                r, c = r[fits], c[fits]
                found.append((q[r], own[c], got[r, c]))
            best = _best(tuple(np.concatenate(x) for x in zip(*found)), k)
            if len(best[0]):
                last = np.flatnonzero(np.diff(best[0], append=-1))
                full = last[(last >= k - 1) & (best[0][np.maximum(last - k + 1, 0)] == best[0][last])]
                q, kth_id, kth = (x[full] for x in best)
                better = (kth > floor[q]) | ((kth == floor[q]) & (kth_id < floor_id[q]))
                floor[q[better]], floor_id[q[better]] = kth[better], kth_id[better]
        return best


def _best(found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """Of (query, id, score) the ``k`` best of each query, in order."""
    order = np.lexsort((found[1], ~found[2], found[0]))
    q = found[0][order]
    first = np.maximum.accumulate(np.where(np.diff(q, prepend=-1) != 0, np.arange(len(q)), 0))
    order = order[np.arange(len(q)) - first < k]
    return tuple(x[order] for x in found)


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums held within a long."""
    if max(_magnitude(a), _magnitude(b)) < 1 << 62:
        return a + b
    return np.clip(a.astype(object) + b.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _integers(vector) -> bytes:
    return np.clip(np.floor(256.0 * np.asarray(vector, np.float64)), -float(_LIMIT), float(_LIMIT)).astype("<i8").tobytes()


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row where ``is_query`` holds: query_id, rank, ``id_col``, score of its k best other rows."""
    spark = vectors.sparkSession
    prepare(spark)
    usable = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & usable)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    picked = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivots = matrix([_integers(r["v"]) for r in picked]).astype(np.float64)

    def place(frames):
        for f in frames:
            vs = [_integers(v) for v in f["v"]]
            m, p = _same_width(matrix(vs).astype(np.float64), pivots)
            size = np.linalg.norm(p, axis=1)
            near = np.argsort(-(m @ p.T) / np.where(size > 0, size, 1), axis=1, kind="stable")[:, :2]
            key = near[:, 0] * PIVOTS + near[:, -1]
            yield pd.DataFrame({"key": key, "id": f["id"], "v": vs, "q": f["q"]})

    placed = materialise(rows.mapInPandas(place, "key long, id long, v binary, q boolean"), "vectors")
    ranges = max(1, -(-placed.count() // RANGE))

    def index(frames):
        """A range: its blocks and its bounds, its queries with their kth result in it, and those results."""
        part = TaskContext.get().partitionId()
        held = [f for f in frames if len(f)]
        if not held:
            return
        f = pd.concat(held)
        f = f.sort_values(["key", "id"], kind="stable").reset_index(drop=True)
        blocks = Blocks(f["id"].to_numpy(np.int64), matrix(list(f["v"])))
        shown = lambda v: v.astype("<i8").tobytes()
        for a, b in blocks.cuts:
            yield _rows("block", part, 0, f["id"][a], shown(f["id"][a:b].to_numpy()), shown(blocks.vectors[a:b]), 0, 0)
        yield _rows("bounds", part, 0, 0, shown(blocks.top.max(axis=0)), shown(blocks.low.min(axis=0)), 0, 0)
        q = f[f["q"].to_numpy(bool)]
        for a in range(0, len(q), BATCH):
            some = q[a : a + BATCH]
            ids, n = some["id"].to_numpy(np.int64), len(some)
            row, found, score = blocks.search(ids, matrix(list(some["v"])), k, np.full(n, _NONE), np.full(n, _LAST))
            rows = (part << 32) + some.index.to_numpy(np.int64)
            low, high = np.full(n, _NONE), np.full(n, _LAST)
            kth = np.bincount(row, minlength=n).cumsum() - 1
            full = np.bincount(row, minlength=n) == k
            low[full], high[full] = score[kth[full]], found[kth[full]]
            yield _rows("query", part, rows, ids, b"", list(some["v"]), low, high)
            if len(row):
                yield _rows("result", part, rows[row], ids[row], b"", b"", score, found)

    stored = materialise(placed.repartitionByRange(ranges, "key", "id").mapInPandas(index, f"kind string, {', '.join(f'{c} {t}' for c, t in _INDEX.items())}"), "blocks")
    query = ["row", F.col("id").alias("query"), F.col("v").alias("vector"), F.col("n").alias("floor"), F.col("m").alias("floor_id")]
    last = stored.agg(F.max("range")).first()[0] or 0  # asked for or, in a session that raises such numbers, more
    queries = stored.where("kind = 'query'").select("range", *query, F.pmod(F.xxhash64("row"), F.lit(1 << 30)).alias("h"))
    chunks = max(1, -(-queries.count() // BATCH))
    queries = queries.withColumn("chunk", (F.col("h") % chunks).cast("int")).withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(last // PACK))))
    bounds = stored.where("kind = 'bounds'").select("range", F.col("ids").alias("top"), F.col("v").alias("low"), F.floor(F.col("range") / PACK).cast("int").alias("pack"))
    bounds = bounds.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def prune(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Pairs of a query and another range than its own whose bound reaches the query's kth result."""
        if _none(left, right):
            return pd.DataFrame({c: [] for c in _PAIRS})
        asked, top, low = _same_width(matrix(list(right["vector"])), matrix(list(left["top"])), matrix(list(left["low"])))
        places = left["range"].to_numpy()
        near = (bounds_of(asked, top, low) >= right["floor"].to_numpy(np.int64)[:, None]) & (places[None, :] != right["range"].to_numpy()[:, None])
        q, r = np.nonzero(near)
        out = right.iloc[q].assign(range=places[r])
        return out[list(_PAIRS)]

    pairs = bounds.groupBy("chunk", "pack").cogroup(queries.groupBy("chunk", "pack")).applyInPandas(prune, ", ".join(f"{c} {t}" for c, t in _PAIRS.items()))
    pairs = materialise(pairs, "pairs")
    dealt = pairs.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("n_chunks"))
    blocks = stored.where("kind = 'block'").select("range", "ids", F.col("v").alias("vectors")).join(dealt, "range")
    blocks = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).drop("n_chunks")
    left_for = pairs.join(dealt, "range").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("n_chunks")).cast("int")).drop("n_chunks")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if _none(left, right):
            return pd.DataFrame({"row": [], "query_id": [], "id": [], "score": []}).astype("int64")
        ids = [np.frombuffer(x, "<i8") for x in left["ids"]]
        vs = [np.frombuffer(x, "<i8").reshape(len(i), -1) for i, x in zip(ids, left["vectors"])]
        found, out = Blocks(np.concatenate(ids), np.concatenate(_same_width(*vs))), []
        for a in range(0, len(right), BATCH):
            some = right.iloc[a : a + BATCH]
            rows, asked = some["row"].to_numpy(np.int64), some["query"].to_numpy(np.int64)
            q, i, s = found.search(asked, matrix(list(some["vector"])), k, some["floor"].to_numpy(np.int64), some["floor_id"].to_numpy(np.int64))
            out.append(pd.DataFrame({"row": rows[q], "query_id": asked[q], "id": i, "score": s}))
        return pd.concat(out)

    results = blocks.groupBy("range", "chunk").cogroup(left_for.groupBy("range", "chunk")).applyInPandas(search, "row long, query_id long, id long, score long")
    own = stored.where("kind = 'result'").select("row", F.col("id").alias("query_id"), F.col("m").alias("id"), F.col("n").alias("score"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    best = own.unionByName(results).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")


#: Columns of an indexed row (n, m: a score and an id), and of a query that is left for a range.
_INDEX = {"range": "int", "row": "long", "id": "long", "ids": "binary", "v": "binary", "n": "long", "m": "long"}
_PAIRS = {"range": "int", "row": "long", "query": "long", "vector": "binary", "floor": "long", "floor_id": "long"}


def _rows(kind: str, *values) -> pd.DataFrame:
    size = max((len(v) for v in values if isinstance(v, (list, np.ndarray))), default=1)
    return pd.DataFrame({"kind": [kind] * size, **{c: v if isinstance(v, (list, np.ndarray)) else [v] * size for c, v in zip(_INDEX, values)}})


def _none(*frames: pd.DataFrame) -> bool:
    return any(not len(f.columns) or not len(f) for f in frames)
