"""Building and opening the stored index: every table is overwritten as a whole, so a rebuild is idempotent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevine.functions.references import extract_references
from lorevine.functions.stemmer import normalize
from lorevine.operators import assembly, lexical, models
from lorevine.operators.search import Corpus, field_counts

TABLES = ("records", "edges", "chunks", "postings", "doc_len", "term_df", "vectors", "fields")


def build(records: DataFrame, target: str, stemmed: bool = True) -> dict[str, int]:
    """Write all tables from records (doc_id, text, ...); the counts of chunks, vectors and records."""
    spark = records.sparkSession
    records.write.mode("overwrite").parquet(f"{target}/records")
    stored = spark.read.parquet(f"{target}/records")
    stored.select("doc_id", F.posexplode(extract_references("text")).alias("edge_no", "e")).select("doc_id", "edge_no", "e.*").write.mode("overwrite").parquet(f"{target}/edges")
    assembly.chunks(stored).write.mode("overwrite").parquet(f"{target}/chunks")
    chunks = spark.read.parquet(f"{target}/chunks")
    models.embed(chunks, "text").select("chunk_id", "doc_id", "embedding").write.mode("overwrite").parquet(f"{target}/vectors")
    terms = stored.select("doc_id", (normalize("text") if stemmed else F.col("text")).alias("text"))
    # Postings are made once; the frames derived from them read what was written.
    lexical.postings(terms).write.mode("overwrite").parquet(f"{target}/postings")
    post = spark.read.parquet(f"{target}/postings")
    lexical.doc_lengths(post).write.mode("overwrite").parquet(f"{target}/doc_len")
    lexical.term_df(post).write.mode("overwrite").parquet(f"{target}/term_df")
    path = F.col("path") if "path" in stored.columns else F.lit("")
    both = {name: normalize(c) if stemmed else c for name, c in (("text", F.col("text")), ("path", path))}
    field_counts(stored.select("doc_id", *[c.alias(name) for name, c in both.items()])).write.mode("overwrite").parquet(f"{target}/fields")
    n = chunks.count()
    return {"chunks": n, "vectors": n, "records": stored.count()}


def table(spark: SparkSession, target: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"no such table: {name}")
    return spark.read.parquet(f"{target}/{name}")


def opened(spark: SparkSession, target: str, stemmed: bool = True) -> Corpus:
    """The stored index as a corpus to search; ``stemmed`` as it was built.

    Its records need record_id, article and type; an edge leaves the record whose text has it. ``path``, where
    records have one, is the second field.
    """
    records = table(spark, target, "records")
    edges = table(spark, target, "edges").join(records.select("doc_id", F.col("record_id").alias("source_id")), "doc_id")
    return Corpus(records, table(spark, target, "fields"), table(spark, target, "vectors"), edges, normalize if stemmed else None)
