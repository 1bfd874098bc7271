"""Incremental refresh of stored postings from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lorevine.operators import lexical


def postings_stream(documents: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the postings of new documents, one folder per batch, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        lexical.postings(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
