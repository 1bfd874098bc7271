"""Verification of citations: verdicts, rates and how literally an extract was copied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorevine.functions import text as T

#: Verdicts from the worst to the best, and the shortest extract that proves anything.
SEVERITY = ("unknown_record", "extract_absent", "extract_too_short", "version_ambiguous", "version_omitted", "ok")
LEAST_CHARS = 30


def verdicts(cited: DataFrame, records: DataFrame) -> DataFrame:
    """cite_id, item_id, record_id, extract -> verdict.

    An id that is no record may be one without its version: exactly one version is an
    omission, several are ambiguous.
    """
    exact = records.select(F.col("record_id"), F.col("text").alias("exact_text"))
    versions = records.filter(F.col("record_id").contains("@")).groupBy(F.substring_index("record_id", "@", 1).alias("record_id"))
    versions = versions.agg(F.count(F.lit(1)).alias("n_versions"), F.min("text").alias("version_text"))
    both = cited.join(exact, "record_id", "left").join(versions, "record_id", "left")
    holds = lambda c: T.citation_key(F.col(c)).contains(T.citation_key(F.col("extract")))
    verdict = (
        F.when(F.length(F.trim("extract")) < LEAST_CHARS, "extract_too_short")
        .when(F.col("exact_text").isNotNull(), F.when(holds("exact_text"), "ok").otherwise("extract_absent"))
        .when(F.coalesce("n_versions", F.lit(0)) == 0, "unknown_record")
        .when(F.col("n_versions") > 1, "version_ambiguous")
        .otherwise(F.when(holds("version_text"), "version_omitted").otherwise("extract_absent"))
    )
    raw = F.coalesce(F.col("exact_text"), F.when(F.col("n_versions") == 1, F.col("version_text"))).contains(F.col("extract"))
    return both.select("cite_id", "item_id", "record_id", verdict.alias("verdict"), F.coalesce(raw & (F.length(F.trim("extract")) >= LEAST_CHARS), F.lit(False)).alias("raw_match"))


def rates(found: DataFrame) -> DataFrame:
    """Rates over all citations; null, not zero, where there are none."""
    share = lambda test: F.round(F.try_divide(F.sum(F.when(test, 1).otherwise(0)), F.count(F.lit(1))), 4)
    return found.agg(
        F.count(F.lit(1)).alias("n_citations"), share(F.col("verdict") == "unknown_record").alias("unknown_rate"),
        share(F.col("verdict").isin("extract_absent", "extract_too_short")).alias("unsupported_rate"), share(F.col("verdict") == "version_omitted").alias("omitted_rate"), share(F.col("raw_match")).alias("raw_rate"),
    )


def per_answer(found: DataFrame) -> DataFrame:
    """Citations per answer: least, most, median and mean."""
    n = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.percentile("n", F.lit(0.5)).alias("median"), F.round(F.avg("n"), 4).alias("mean"))


def worst(found: DataFrame) -> DataFrame:
    """item_id, verdict: the worst verdict of an answer."""
    order = F.array_position(F.array(*[F.lit(v) for v in SEVERITY]), F.col("verdict"))
    return found.groupBy("item_id").agg(F.min_by("verdict", order).alias("verdict"))


def ladder(pairs: DataFrame) -> DataFrame:
    """extract, text -> level: raw, spaces, typography, case_accents or absent."""
    spaced = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    typo = lambda c: F.translate(spaced(c), T.CITATION_APOSTROPHES + "«»“”–—", "''''\"\"\"\"--")
    folded = lambda c: T.fold(F.lower(typo(c)))
    level = F.lit("absent")
    for name, f in (("case_accents", folded), ("typography", typo), ("spaces", spaced), ("raw", lambda c: c)):
        level = F.when(f(F.col("text")).contains(f(F.col("extract"))), name).otherwise(level)
    return pairs.withColumn("level", level)


def leak_audit(rewrites: DataFrame) -> DataFrame:
    """item_id, question, rewrite, gold (array of articles) -> numbers the rewrite added, and whether they leak.

    ``copied``: none beyond the question's; ``leak``: a gold number came in; ``invented``: another did.
    """
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d{3,4}-\d+(?:-\d+)?"), F.lit(0)))
    added = F.array_except(numbers("rewrite"), numbers("question"))
    verdict = F.when(F.size(added) == 0, "copied").when(F.size(F.array_intersect(added, "gold")) > 0, "leak").otherwise("invented")
    return rewrites.select("item_id", F.array_join(F.array_sort(added), ",").alias("added"), verdict.alias("verdict"))
