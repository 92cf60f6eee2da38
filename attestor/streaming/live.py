"""Streams: claims as documents arrive, and verdicts per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestor.operators.claims import claims
from attestor.plans.verify import verify
from attestor.runtime import scratch


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    """Documents of a folder of Parquet files, as files come."""
    return spark.readStream.schema(schema).parquet(folder)


def claim_stream(docs: DataFrame, most: int = 5) -> DataFrame:
    """Claims of a stream; extraction is within a row, so it needs no state and no watermark."""
    return claims(docs, most=most)


def verdict_stream(docs: DataFrame, provider, path: str, checkpoint: str):
    """Start a query that appends the verdicts of every micro-batch to ``path``; a claim's evidence is complete in its batch.

    What a micro-batch stores between steps goes at its end.
    """

    def batch(rows: DataFrame, number: int) -> None:
        with scratch():
            verify(rows, provider)["verdicts"].write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
