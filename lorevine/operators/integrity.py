"""Integrity checks over records and edges, and the anomaly report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorevine.functions import text as T


def duplicate_ids(records: DataFrame) -> DataFrame:
    return records.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def title_number(path):
    """The number of the Titre in a path, arabic or roman; null where there is none or it is mixed."""
    found = F.regexp_extract(path, r"(?i)Titre ([IVXLC0-9]+)", 1)
    return F.when(found.rlike("^[0-9]+$"), found.cast("int")).when(found.rlike("(?i)^[IVXLC]+$"), T.roman(F.upper(found)))


def title_mismatches(records: DataFrame) -> DataFrame:
    """Articles of three digits whose first one isn't their title's number."""
    first = F.regexp_extract("article", r"^(\d)\d{2}-", 1)
    number = title_number(F.col("path"))
    return records.filter((first != "") & number.isNotNull() & (first.cast("int") != number)).select("record_id", "article", "path", number.alias("title_number"))


def dangling(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Internal edges whose article has no record."""
    known = records.filter(F.col("article").isNotNull()).select(F.concat(F.lit("pcg-"), F.col("article")).alias("target")).distinct()
    return edges.filter(F.col("family") == "internal").join(known, "target", "left_anti").select("source_id", "target")


def check(records: DataFrame, edges: DataFrame) -> DataFrame:
    """All anomalies as (record_id, category)."""
    empty = records.filter(F.coalesce(F.trim("text"), F.lit("")) == "").select("record_id", F.lit("empty text").alias("category"))
    return (
        duplicate_ids(records).select("record_id", F.lit("duplicate id").alias("category"))
        .unionByName(empty)
        .unionByName(title_mismatches(records).select("record_id", F.lit("title mismatch").alias("category")))
        .unionByName(dangling(records, edges).select(F.col("source_id").alias("record_id"), F.lit("dangling reference").alias("category")))
    )


def anomaly_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def report(records: DataFrame, found: DataFrame) -> str:
    """The anomaly report in Markdown: the most frequent categories first."""
    lines = ["# Anomalies", "", f"- records: {records.count()}"]
    for row in anomaly_counts(found).collect():
        lines += ["", f"## {row.category} ({row.n})", ""]
        lines += [f"- {r.record_id[:100]}" for r in found.filter(F.col("category") == row.category).orderBy("record_id").toLocalIterator()]
    return "\n".join(lines)
