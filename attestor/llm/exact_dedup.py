"""Exact dedup by a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z only. A Misra-Gries pass finds frequent
digests; the verified ones (at most COUNTERS of them, so a broadcast of bounded size) are resolved
map-side, and the other digests, none of which holds more than 2/COUNTERS of the rows, go through an
ordinary pre-aggregated shuffle.

Defined cases: a null text counts as empty; empty texts equal one another; a row with a null id
loses to any row with an id; of rows that repeat both id and text exactly one stays; an empty table
gives an empty result; extra columns pass through ``drop_copies`` and are ignored by ``find_copies``.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.runtime import materialise, prepare, tidied

#: Misra-Gries counters, and so the most digests that are ever broadcast.
COUNTERS = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text):
    """SHA-256 (binary) of the text after lower-casing A-Z."""
    return F.unhex(F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER).cast("binary"), 256))


def misra_gries(counters: dict, more: dict, k: int) -> dict:
    """Merge two summaries and cut the result to ``k`` counters; undercounts by at most n/(k+1)."""
    for key, n in more.items():
        counters[key] = counters.get(key, 0) + n
    if len(counters) > k:
        cut = sorted(counters.values(), reverse=True)[k]
        counters = {key: n - cut for key, n in counters.items() if n > cut}
    return counters


def _summaries(k: int):
    def run(batches):
        counters: dict = {}
        for batch in batches:
            counts = pc.value_counts(batch.column(0))
            counters = misra_gries(counters, dict(zip(counts.field(0).to_pylist(), counts.field(1).to_pylist())), k)
        yield pa.RecordBatch.from_pydict({"_digest": pa.array(list(counters), pa.binary()), "_n": pa.array(list(counters.values()), pa.int64())})

    return run


def _frequent(table: DataFrame, n: int, k: int) -> DataFrame:
    """Verified frequent digests with their exact count and the row that stays; at most ``k`` rows.

    The estimates sum to at most n, so fewer than k of them exceed n/k; a digest with more than 2n/k
    rows is estimated above n/k.
    """
    found = (
        table.select("_digest").mapInArrow(tidied(_summaries(k)), "_digest binary, _n long")
        .groupBy("_digest").agg(F.sum("_n").alias("_n"))
        .where((F.col("_n") > n / k) & (F.col("_n") > 1)).select("_digest")
    )
    return _totals(table.join(F.broadcast(found), "_digest")).where("_size > 1")


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_digest").agg(F.count(F.lit(1)).alias("_size"), F.max(F.struct("_id", "_row")).alias("_keep"))


def _table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), digest(text_col).alias("_digest"), F.monotonically_increasing_id().alias("_row"))
    return materialise(rows, "digests")


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256."""
    table = _table(docs, id_col, text_col)
    heavy = materialise(_frequent(table, table.count(), counters), "frequent")
    marked = table.join(F.broadcast(heavy), "_digest", "left")
    light = table.join(F.broadcast(heavy.select("_digest")), "_digest", "left_anti")
    both = marked.where(F.col("_size").isNotNull()).unionByName(light.join(_totals(light), "_digest"))
    return both.select(
        F.col("_id").alias(id_col), F.col("_keep._id").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_keep._row")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``docs`` with, of rows of equal text, only the one with the largest id; columns as given.

    Losing rows of frequent digests go map-side; whole rows are shuffled once, with a partial limit of
    one row per digest before the shuffle.
    """
    tag = f"_d{uuid.uuid4().hex[:8]}"
    table = _table(docs, id_col, text_col)
    heavy = materialise(_frequent(table, table.count(), counters), "frequent")
    best = heavy.select(F.col("_digest").alias(f"{tag}h"), F.col("_keep._id").alias(f"{tag}k"))
    rows = docs.withColumn(tag, digest(text_col)).join(F.broadcast(best), F.col(tag) == F.col(f"{tag}h"), "left")
    rows = rows.where(F.col(f"{tag}h").isNull() | F.col(id_col).eqNullSafe(F.col(f"{tag}k")))
    first = F.row_number().over(Window.partitionBy(tag).orderBy(F.col(id_col).desc_nulls_last()))
    return rows.withColumn(f"{tag}n", first).where(F.col(f"{tag}n") == 1).select(*docs.columns)
