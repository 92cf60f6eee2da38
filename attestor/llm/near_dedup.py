"""MinHash near-dedup with fast similarity sketching, banding and exact verification.

1. A map over whole texts gives each document's set of 5-word shingles (hashed), a digest of the set, and
   the band hashes of its sketch. Documents with equal sets are one node from here on.
2. In each bucket of a band every node is compared with one leader, on full sets; links give components.
3. Buckets that still hold nodes of different components are gone through exactly, in blocks: nodes
   outside the leader's component against all others, again on full sets. A block holds at most about
   BLOCK shingles and NODES or MAIN nodes, so a task's memory does not grow with its bucket; nodes whose sizes
   alone rule a link out are not compared. A block of links that are needed to connect components is all
   that leaves a task. No pair inside a component is ever made.
4. Components by repeated minimum labels with pointer jumping.

Joins by a key that many rows may share (a set, a bucket, a leader, a component) go through even_join():
a key that holds more than one in HEAVY of the rows is dealt over several tasks.

A pair at the threshold shares no bucket with probability (1 - 0.75**4)**32, about 5e-6.

Defined cases: a null or empty text, or one without words, has an empty set and no links; of fewer than
five words the whole sequence is the one shingle; rows with null id link like others, component_id being
the least id that is not null (null if there is none); rows that repeat an id are documents of their
own; an empty table gives an empty result; extra columns pass through drop_near_copies and are ignored
otherwise.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm import shingles
from attestor.runtime import materialise, prepare, settle, tidied

#: Hundredths of the union that must be shared; coordinates of a sketch; rows of a band.
PERCENT, SKETCH, ROWS = 75, 128, 4
#: Shingles of a block that is compared with another block at once; nodes of a block outside the leader's component, and inside it.
BLOCK, NODES, MAIN = 400_000, 1024, 128
#: A key with more than one in so many of the rows of a join is dealt over several tasks.
HEAVY = 1024


def _texts(batch, i: int) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(i).to_pylist()]


def _key(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid, id, hash (of the text), n (size of the set), key (digest of the set), bands."""
    prepare(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = shingles.sets(_texts(batch, 3))
            hashes = np.concatenate([shingles.bands(shingles.sketches(found[a : a + 256], SKETCH), ROWS) for a in range(0, len(found), 256)]).astype(np.int64)
            each = hashes.shape[1]
            sizes = np.array([len(s) for s in found], np.int64)
            full = sizes > 0
            offsets = np.concatenate([[0], np.cumsum(full * each)]).astype(np.int32)
            arrays = [pa.array(sizes), pa.array([_key(s) for s in found], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[full].ravel()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], ["uid", "id", "hash", "n", "key", "bands"])

    return materialise(rows.mapInArrow(tidied(run), f"uid long, id {kind}, hash long, n long, key binary, bands array<long>"), "sketched")


def even_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """``rows`` joined with ``table`` (one row of each ``key``), evenly whatever the keys' shares.

    A key with more than one in HEAVY of the rows is dealt by a hash of the row, and its row of ``table`` copied, in
    proportion to its share: at most HEAVY such keys, which the driver reads, and 2 * HEAVY copies. Rows without a key are dealt
    by the hash. ``counts``: ``key`` and c, its number of rows, and ``n``, the number of rows, where they are known.
    """
    counts = counts if counts is not None else rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    most = F.greatest(F.lit(1), F.lit(rows.count() if n is None else n) / HEAVY)
    heavy = {r[key]: r["_n"] for r in counts.where(F.col("c") > most).select(key, F.ceil(F.col("c") / most).cast("int").alias("_n")).collect()}
    copies = F.lit(1)
    if heavy:  # a hash set lets most rows pass; only those of heavy keys look their number up
        found = F.element_at(F.create_map(*[F.lit(x) for kv in heavy.items() for x in kv]), F.col(key))
        copies = F.when(F.col(key).isin(*heavy), found).otherwise(copies)
    salt = F.pmod(F.xxhash64(*rows.columns), F.when(F.col(key).isNull(), HEAVY).otherwise(copies)).cast("int")
    left = rows.withColumn("_salt", salt)
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid and set (sorted hashes) of the nodes (uid, id, hash, key), from their whole texts."""
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    joined = rows.join(nodes, (F.col("_hash") == F.col("hash")) & F.col("_id").eqNullSafe(F.col("id"))).select("uid", "key", "_text")

    def run(batches):
        for batch in batches:
            uids, found = [], []
            for uid, key, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingles.sets(_texts(batch, 2))):
                if _key(s) == key:
                    uids.append(uid)
                    found.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(found, pa.binary())], ["uid", "set"])

    # rows that repeat an id and a text give a node's set each; one stays, whatever their order
    made = joined.mapInArrow(tidied(run), "uid long, set binary")
    return materialise(made.groupBy("uid").agg(F.first("set").alias("set")), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""

    def side(c):
        return sets.select(F.col("uid").alias(c), F.col("set").alias(f"set_{c}"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shingles.similar(common, len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = even_join(pairs.join(side("b"), "b"), side("a"), "a", counts=pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))).select("a", "b", "set_a", "set_b")
    return both.mapInArrow(tidied(run), "a long, b long")


def _stored(df: DataFrame, label: str) -> DataFrame:
    """A narrow table between two steps."""
    return materialise(df.hint("rebalance"), label)


def components(edges: DataFrame) -> DataFrame:
    """(uid, label): every node of the edges (a, b) with the least node that it reaches."""
    both = settle(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = _stored(both.groupBy(F.col("a").alias("uid")).agg(F.min("b").alias("m")).select("uid", F.least("uid", "m").alias("label")), "labels")
    n_edges, n_nodes = both.count(), labels.count()
    degrees = _stored(both.groupBy(F.col("b").alias("uid")).agg(F.count(F.lit(1)).alias("c")), "degrees")
    while True:
        near = even_join(both.withColumnRenamed("b", "uid"), labels, "uid", counts=degrees, n=n_edges).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("uid") == F.col("a")).select("uid", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("uid").alias("label"), F.col("label").alias("far"))
        new = _stored(even_join(_stored(step, "step"), jump, "label", "left", n=n_nodes).select("uid", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        labels = new.select("uid", "label")
        if new.where("old <> label").isEmpty():
            return labels


def _blocks(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components inside buckets, found by comparing blocks of nodes on full sets."""
    rows = _stored(members.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid")), "labelled")
    main = rows.where("uid = leader").select("band", F.col("label").alias("main"))
    rows = settle(even_join(rows, main, "band").withColumn("rest", F.col("label") != F.col("main")), "blocks")
    # blocks by a hash of the node, as many as the nodes and their sets ask for: even, and without ordering a bucket in one task
    other = ~F.col("rest") & (F.col("uid") != F.col("leader"))
    most = lambda cond, n: F.greatest(F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)) / BLOCK, F.count_if(cond) / n)
    last = lambda cond, n: F.floor(most(cond, n)).cast("int")
    # two nodes: compared already; a bucket with the same nodes as another: gone through once
    mark = lambda s: F.sum(F.xxhash64(F.col("uid"), F.lit(s)).cast("decimal(20,0)"))
    buckets = rows.groupBy("band").agg(
        F.count(F.lit(1)).alias("c"), F.count_if("rest").alias("r"), mark(1).alias("s"), mark(2).alias("t"), last(F.col("rest"), NODES).alias("last_r"), last(other, MAIN).alias("last_m")
    ).where("c > 2 and r > 0")
    once = _stored(buckets.groupBy("c", "s", "t").agg(F.min_by(F.struct("band", "last_r", "last_m"), "band").alias("b")).select("b.*", "c"), "buckets")
    # tasks: (i, j) of a rest block and a main block; (i, -1 - k) of two rest blocks i < k; rest block i with itself in (i, 0)
    upto = lambda c: F.sequence(F.lit(0), F.col(c))
    rest_tasks = F.concat(
        F.transform(upto("last_m"), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"))),
        F.transform(F.filter(upto("last_r"), lambda k: k > F.col("block")), lambda k: F.struct(F.col("block").alias("i"), (-1 - k).alias("j"))),
        F.transform(F.filter(upto("last_r"), lambda k: k < F.col("block")), lambda k: F.struct(k.alias("i"), (-1 - F.col("block")).alias("j"))),
    )
    tasks = F.when(F.col("rest"), rest_tasks).otherwise(F.transform(upto("last_r"), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"))))
    block = F.pmod(F.xxhash64("uid", F.lit(3)), F.when(F.col("rest"), F.col("last_r")).otherwise(F.col("last_m")) + 1).cast("int")
    rows = even_join(rows.where("uid <> leader").select("band", "uid", "label", "rest", "n"), once.drop("c"), "band", counts=once.select("band", "c")).withColumn("block", block).select("band", "uid", "label", "rest", "block", F.explode(tasks).alias("task"))
    rows = rows.join(sets, "uid").select("band", "task.i", "task.j", "uid", "label", "rest", "block", "set")

    def compare(group: list[tuple]) -> Iterator[tuple[int, int]]:
        i, j = group[0][1], group[0][2]
        first = [x for x in group if x[5] and x[6] == i]
        other = [x for x in group if not x[5]] if j >= 0 else [x for x in group if x[5] and x[6] == -1 - j]
        if j == 0:
            other = other + first
        if not first or not other:
            return
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        first, other = (sorted(side, key=lambda x: len(x[7])) for side in (first, other))
        sizes = np.array([len(x[7]) // 8 for x in other])
        for at in range(0, len(first), shingles.TILE):
            some = first[at : at + shingles.TILE]
            # a set with more than the other's over PERCENT, or less than PERCENT of it, cannot be similar
            low, high = len(some[0][7]) // 8 * percent, len(some[-1][7]) // 8 * 100
            start, end = np.searchsorted(100 * sizes, low), np.searchsorted(percent * sizes, high, "right")
            for to in range(start, end, shingles.TILE):
                near = other[to : min(end, to + shingles.TILE)]
                left, right = ([np.frombuffer(x[7], np.uint64) for x in side] for side in (some, near))
                a, b = (np.array([len(s) for s in side]) for side in (left, right))
                la, lb = (np.array([x[4] for x in side]) for side in (some, near))
                common = shingles.intersections(left, right)
                hit = (100 * common >= percent * (a[:, None] + b[None, :] - common)) & (la[:, None] != lb[None, :])
                for x, y in zip(*np.nonzero(hit)):
                    p, q = find(int(la[x])), find(int(lb[y]))
                    if p != q:
                        root[p] = q
                        yield some[x][3], near[y][3]

    def run(batches):
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if group and group[0][:3] != row[:3]:
                    out.extend(compare(group))
                    group = []
                group.append(row)
            yield _edges(out)
        if group:
            yield _edges(list(compare(group)))

    dealt = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return dealt.mapInArrow(tidied(run), "a long, b long")


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """uid, id, hash, n_shingles, component_id, first (uid of the component's row with that id)."""
    table = sketched(docs, id_col, text_col)
    nodes = table.where("n > 0").groupBy("key").agg(
        F.min("uid").alias("uid"), F.min_by("id", "uid").alias("id"), F.min_by("hash", "uid").alias("hash"), F.first("n").alias("n"),
        F.min_by("bands", "uid").alias("bands"), F.min(F.struct(F.col("id").isNull(), "id", F.col("uid").alias("row"))).alias("least"),
    )
    nodes = settle(nodes, "nodes")
    spread = nodes.select(F.explode("bands").alias("band"), "uid", "n")
    leaders = spread.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("uid"), "uid")).alias("l"))
    leaders = _stored(leaders.where("c > 1").select("band", "c", F.col("l.uid").alias("leader")), "leaders")
    members = settle(even_join(spread, leaders.drop("c"), "band", counts=leaders.select("band", "c")), "members")
    involved = members.select("uid").distinct()
    sets = _sets(docs, nodes.select("uid", "id", "hash", "key").join(involved, "uid"), id_col, text_col)
    stars = _stored(members.where("uid <> leader").select(F.col("leader").alias("a"), F.col("uid").alias("b")).distinct(), "stars")
    links = settle(_verified(stars, sets, percent), "links")
    labels = components(links)
    more = settle(_blocks(members, labels, sets, percent), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    joined = _stored(nodes.select("key", "uid", "least").join(labels, "uid", "left"), "joined")
    linked = joined.where(F.col("label").isNotNull()).select("key", "label", "least")
    best = linked.groupBy("label").agg(F.min("least").alias("best"))
    alone = joined.where(F.col("label").isNull()).select("key", "least")
    by_key = settle(even_join(linked.drop("least"), best, "label").select("key", F.col("best").alias("least")).unionByName(alone), "components")
    out = even_join(table.select("uid", "id", "hash", "n", "key"), by_key, "key", "left")
    return out.select(
        "uid", "id", "hash", F.col("n").alias("n_shingles"), F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("component_id"),
        F.coalesce("least.row", "uid").alias("first"),
    )


def find_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles, component_id, kept (the id is the component's)."""
    found = _grouped(docs, id_col, text_col, percent)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, the one with the least id; columns as given."""
    tag = f"_near{uuid.uuid4().hex[:8]}"  # no column of docs
    kept = _grouped(docs, id_col, text_col, percent).where("uid = first").select(F.col("id").alias(f"{tag}i"), F.col("hash").alias(f"{tag}h"))
    rows = docs.withColumn(tag, F.xxhash64(text_col)).join(kept, (F.col(tag) == F.col(f"{tag}h")) & F.col(id_col).eqNullSafe(F.col(f"{tag}i")), "left_semi")
    # rows that repeat id and text: one stays
    one = F.row_number().over(Window.partitionBy(id_col, tag).orderBy(F.lit(1)))
    return rows.withColumn(f"{tag}n", one).where(F.col(f"{tag}n") == 1).select(*docs.columns)
