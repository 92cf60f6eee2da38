"""Claim extraction: the most checkable sentences of every document.

All of it happens inside a row, with higher-order functions over the document's sentences, so that no
shuffle is needed whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import text as tx


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sentence: ``id_col``, idx, sentence."""
    return docs.select(id_col, F.posexplode(tx.sentences(F.col(text_col))).alias("idx", "sentence"))


def _candidates(found: Column) -> tuple[Column, Column]:
    """Structs of the sentences that are long enough with their facts, and of the first long one that is no question."""
    rows = F.transform(found, lambda s, i: F.struct(i.alias("idx"), s.alias("text")))
    long_ = F.filter(rows, lambda r: F.length(r["text"]) >= tx.LEAST_CHARS)
    usable = F.filter(long_, lambda r: tx.is_long_enough(r["text"]))
    counted = F.transform(usable, lambda r: F.struct(r["idx"].alias("idx"), r["text"].alias("text"), tx.facts(r["text"]).alias("n")))
    spare = F.slice(F.filter(long_, lambda r: ~F.endswith(r["text"], F.lit("?"))), 1, 1)
    return counted, F.transform(spare, lambda r: F.struct(F.lit(-1).alias("neg"), r["idx"].alias("idx"), r["text"].alias("text")))


def _scored(counted: Column) -> Column:
    """(neg, idx, text) of the sentences that can be checked; neg is the priority with a minus, to sort by."""
    viable = F.filter(counted, lambda r: tx.is_checkable(r["text"], r["n"]))
    return F.transform(viable, lambda r: F.struct((-tx.priority(r["text"], r["n"])).alias("neg"), r["idx"].alias("idx"), r["text"].alias("text")))


def claims(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 5, compound: bool = False) -> DataFrame:
    """``id_col``, claim_id, text, source_sentence_index, priority_score, parent_sentence, sub_claims.

    The ``most`` best sentences by priority, then in the order of the text, numbered C001 on. With ``compound``
    a sentence of two predicates becomes two claims, within the same bound.
    """
    rows = docs.select(id_col, tx.sentences(F.col(text_col)).alias("_s"))
    counted, spare = _candidates(F.col("_s"))
    rows = rows.select(id_col, counted.alias("_n"), spare.alias("_spare"))
    rows = rows.select(id_col, _scored(F.col("_n")).alias("_v"), "_spare")
    rows = rows.select(id_col, F.when(F.size("_v") > 0, F.col("_v")).otherwise(F.col("_spare")).alias("_c"))
    best = F.slice(F.array_sort("_c"), 1, most)
    in_order = F.array_sort(F.transform(best, lambda r: F.struct(r["idx"].alias("idx"), r["text"].alias("text"), (-r["neg"]).alias("score"))))
    split = lambda t: F.when(F.length(t) > 30, tx.predicates(t)).otherwise(F.array(t))
    rows = rows.withColumn("_b", in_order)

    def made(r: Column) -> Column:
        parts = split(r["text"])
        base = lambda t, parent, subs: F.struct(
            t.alias("text"), r["idx"].alias("source_sentence_index"), r["score"].alias("priority_score"), parent.alias("parent_sentence"), subs.alias("sub_claims")
        )
        nothing = F.lit(None).cast("string")
        two = F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))
        if not compound:
            return F.array(base(r["text"], nothing, two))
        return F.when(F.size(parts) > 1, F.transform(parts, lambda t: base(t, r["text"], F.array(t)))).otherwise(F.array(base(r["text"], nothing, two)))

    flat = F.slice(F.flatten(F.transform("_b", made)), 1, most)
    out = rows.select(id_col, F.posexplode(flat).alias("_i", "_r"))
    return out.select(id_col, F.format_string("C%03d", F.col("_i") + 1).alias("claim_id"), "_r.*")
