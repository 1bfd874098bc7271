"""The corpus pipeline: documents through five stages, each reading what the last one kept."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from lorevine.llm import common
from lorevine.llm.stages import STAGES

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written as Parquet in the shared
    folder and read again as the next one's documents; what nothing reads any more goes."""
    docs = common.table(spark, sf_dir, "documents")
    folder, before = f"{common.shared_folder(spark)}/pipeline-{uuid4().hex}", None
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            path = f"{folder}/{number}.parquet"
            docs = common.stored(docs, path)
            if before is not None:
                common.remove(spark, before)
            before = path
    return docs
