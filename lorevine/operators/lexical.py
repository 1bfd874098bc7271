"""Inverted index and BM25 over it.

An index is a set of frames derived from one table of postings, which is what should be
stored or cached: postings (doc_id, term, tf), lengths, document frequencies, totals. A
batch of questions is a frame too; its terms prune the postings by an equi-join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorevine.functions import text as T

K1, B = 1.2, 0.75
#: What takes the place of an inverse document frequency that isn't positive.
LEAST_IDF = 1e-6


@dataclass(frozen=True)
class SearchConfig:
    """Levers of a search; the defaults are neutral."""

    pool: int = 50
    k: int = 10
    n_rerank: int = 25
    rrf_k: int = 60
    consensus_weight: float = 1.0
    question_weight: int = 1
    path_weight: float = 1.0
    comment_boost: float = 1.0
    df_max: float | None = None
    dedup: bool = False
    rewrite_mode: str = "extend"

    def __post_init__(self) -> None:
        if self.consensus_weight < 0 or self.rrf_k < 0:
            raise ValueError("consensus_weight and rrf_k must not be negative")
        if self.rewrite_mode not in ("replace", "extend"):
            raise ValueError(f"unknown rewrite_mode {self.rewrite_mode!r}")
        if self.question_weight < 1 or (self.rewrite_mode == "replace" and self.question_weight != 1):
            raise ValueError("question_weight must be 1 or more, and 1 where the rewrite replaces the question")


def postings(docs: DataFrame, fields: dict[str, float] | None = None) -> DataFrame:
    """doc_id, term, tf (weighted over fields), n (tokens of all fields, unweighted)."""
    fields = fields or {"text": 1.0}
    parts = [docs.select("doc_id", F.explode(T.tokens(F.coalesce(F.col(c), F.lit("")))).alias("term"), F.lit(w).alias("w")) for c, w in fields.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("doc_id", "term").agg(F.sum("w").alias("tf"), F.count(F.lit(1)).alias("n"))


def counted(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """doc_id, term and n_<field> for each field: postings whose fields have no weight yet."""
    each = F.array(*[F.struct(F.lit(c).alias("field"), T.tokens(F.coalesce(F.col(c), F.lit(""))).alias("terms")) for c in fields])
    terms = docs.select("doc_id", F.explode(each).alias("f")).select("doc_id", "f.field", F.explode("f.terms").alias("term"))
    return terms.groupBy("doc_id", "term").agg(*[F.count(F.when(F.col("field") == c, 1)).alias(f"n_{c}") for c in fields])


def weighted(counts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Postings of ``counted`` fields under weights: no shuffle, so a weight can change with every search."""
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    tf, n = add([F.col(f"n_{c}") * F.lit(w) for c, w in weights.items()]), add([F.col(f"n_{c}") for c in weights])
    return counts.select("doc_id", "term", tf.alias("tf"), n.alias("n"))


def doc_lengths(post: DataFrame) -> DataFrame:
    return post.groupBy("doc_id").agg(F.sum("n").alias("dl"))


def term_df(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def totals(docs: DataFrame, post: DataFrame) -> DataFrame:
    """One row: number of rows and their mean length."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(post.agg(F.sum("n").alias("n_tokens"))).select("n_docs", (F.col("n_tokens") / F.col("n_docs")).alias("avgdl"))


def query_terms(questions: DataFrame, dedup: bool = False) -> DataFrame:
    """item_id, term, qtf: a repeated term counts as often as it occurs unless ``dedup``."""
    out = questions.select("item_id", F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    return out.withColumn("qtf", F.lit(1).cast("long")) if dedup else out


def frequent_terms_dropped(terms: DataFrame, df: DataFrame, n_docs: DataFrame, df_max: float) -> DataFrame:
    """Terms in at most the share ``df_max`` of rows; a question that would lose all keeps all. Always dedups."""
    known = terms.join(df, "term", "left").crossJoin(n_docs.select("n_docs"))
    known = known.withColumn("ok", F.coalesce((F.col("df") > 0) & (F.col("df") <= df_max * F.col("n_docs")), F.lit(False)))
    known = known.withColumn("any_ok", F.max("ok").over(Window.partitionBy("item_id")))
    return known.filter(F.col("ok") | ~F.col("any_ok")).select("item_id", "term", F.lit(1).cast("long").alias("qtf"))


def idf(n_docs: Column, df: Column) -> Column:
    raw = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)


def bm25(terms: DataFrame, post: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id, score (6 decimals) of every row that has a term of the question."""
    stats = totals(docs, post)
    weighted = terms.join(term_df(post), "term").crossJoin(stats)
    scored = weighted.join(post.select("doc_id", "term", "tf"), "term").join(doc_lengths(post), "doc_id")
    part = F.col("qtf") * idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("item_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def top(hits: DataFrame, k: int | None, by: str = "item_id", *tie: str) -> DataFrame:
    """``hits`` with rank (from 1) by descending score; ties by the columns named."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), *(tie or ("doc_id",)))
    ranked = hits.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def boosted_to_records(chunk_hits: DataFrame, records: DataFrame, boost: float) -> DataFrame:
    """Chunk hits -> record hits: the best chunk of each record; other types than regulatory are scaled."""
    typed = chunk_hits.join(records.select("record_id", "type"), "record_id", "left")
    scaled = F.when(F.col("type") == "regulatory", F.col("score")).otherwise(F.col("score") * boost)
    return typed.groupBy("item_id", "record_id").agg(F.max(scaled).alias("score"))


def positions(docs: DataFrame) -> DataFrame:
    """doc_id, pos, piece: tokens cut at their hyphens, numbered through the text."""
    pieces = F.filter(F.flatten(F.transform(T.tokens(F.coalesce(F.col("text"), F.lit(""))), lambda t: F.split(t, "-"))), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(pieces).alias("pos", "piece"))


def phrase_postings(terms: DataFrame, placed: DataFrame) -> DataFrame:
    """term, doc_id, tf: occurrences of the pieces of a term next to each other.

    A piece found at a position proposes a start; a start that all pieces of the term
    propose is an occurrence, so no sequence of joins is needed.
    """
    cut = terms.select("term", F.filter(F.split("term", "-"), lambda p: p != "").alias("pieces")).distinct()
    each = cut.select("term", F.size("pieces").alias("m"), F.posexplode("pieces").alias("i", "piece"))
    starts = each.join(placed, "piece").groupBy("term", "m", "doc_id", (F.col("pos") - F.col("i")).alias("start")).agg(F.count(F.lit(1)).alias("met"))
    return starts.filter(F.col("met") == F.col("m")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def bm25_phrases(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """BM25 in which a hyphenated term is a phrase and lengths count pieces."""
    placed = positions(docs)
    lengths = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    post = phrase_postings(terms, placed)
    stats = totals(docs, lengths)
    scored = terms.join(term_df(post), "term").crossJoin(stats).join(post, "term").join(lengths.withColumnRenamed("n", "dl"), "doc_id")
    part = F.col("qtf") * idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("item_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
