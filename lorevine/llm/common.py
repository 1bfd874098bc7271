"""What the operators of this package share: table access, lineage cuts, worker set-up."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One white-space run as the contracts of the word-based operators define it.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; the path is only ever given to Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch: texts are long, and a worker holds a batch several times over.
BATCH_BYTES = "8m"


def workers_can_import(spark: SparkSession) -> None:
    """Put the folder that holds this library on the path of the Python workers, and
    keep Arrow batches small (a setting of the session)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application that all executors share: in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is made if driver and executors are one process (a local
    master, as in tests); on a cluster it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lorevine-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read again, so that readers get just the columns they use."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def parts(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session is sized for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a few numbers each that are worth a task.
TASK_ROWS = 20_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more tasks than that many rows are worth: each task of each step costs files and messages."""
    return df.coalesce(max(1, min(parts(df.sparkSession), -(-rows // TASK_ROWS))))


def document_text(df: DataFrame) -> DataFrame:
    """doc_id and text of a documents table, null text read as empty."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until it is no column of ``df`` (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def n_words(text: Column) -> Column:
    """The number of maximal runs of characters other than x20 and x09 to x0D."""
    pieces = F.size(F.split(text, BLANKS))
    edges = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(
        text.rlike(r"[\x20\x09-\x0D]\z"), 1
    ).otherwise(0)
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    return F.when(text.isNull() | blank, F.lit(0)).otherwise(pieces - edges).cast("long")


def order_hash(*cols: Column | str, seed: str = "lorevine") -> Column:
    """A seeded order of rows that any engine with md5 can reproduce."""
    return F.md5(F.concat_ws("\x1f", F.lit(seed), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]))
