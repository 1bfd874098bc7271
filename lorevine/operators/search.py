"""One search over a batch of questions: every mode, every lever of ``SearchConfig``.

A corpus is a set of frames, those of a stored index or others of the same columns; a question
is a row, so a plan of a few joins serves all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorevine.operators import evaluation, lexical, models, ranking
from lorevine.operators.lexical import SearchConfig

MODES = ("bm25", "dense", "hybrid", "hybrid+graph", "hybrid+rerank")
FIELDS = ("text", "path")


@dataclass(frozen=True)
class Corpus:
    """records (doc_id, record_id, article, type, text), fields (doc_id, term, n_text, n_path), vectors (doc_id,
    embedding; any number for a record), edges (edge_no, source_id, target, family), and what was done to texts
    before their terms were taken."""

    records: DataFrame
    fields: DataFrame
    vectors: DataFrame
    edges: DataFrame
    prepare: Callable[[Column], Column] | None = None


def field_counts(records: DataFrame) -> DataFrame:
    """doc_id, term, n_text, n_path: occurrences by field, to be weighted when a search is made."""
    return lexical.counted(records, FIELDS)


def _asked(questions: DataFrame, config: SearchConfig) -> DataFrame:
    """item_id, text, lexical_text, dense_text; a question without rewrite stays as it is."""
    if "rewrite" not in questions.columns:
        return questions.withColumns({"lexical_text": F.col("text"), "dense_text": F.col("text")})
    both = ranking.composed(F.col("text"), F.col("rewrite"), config.rewrite_mode, config.question_weight)
    none = F.col("rewrite").isNull()
    return questions.withColumns({name: F.when(none, F.col("text")).otherwise(c) for name, c in zip(("lexical_text", "dense_text"), both)})


def lexical_channel(asked: DataFrame, corpus: Corpus, config: SearchConfig) -> DataFrame:
    """item_id, doc_id, score, rank: the pool of BM25, scaled by type after it was cut."""
    post = lexical.weighted(corpus.fields, {"text": 1.0, "path": config.path_weight})
    text = F.coalesce("lexical_text", F.lit(""))
    terms = lexical.query_terms(asked.select("item_id", (corpus.prepare(text) if corpus.prepare else text).alias("text")), config.dedup)
    if config.df_max is not None:
        terms = lexical.frequent_terms_dropped(terms, lexical.term_df(post), lexical.totals(corpus.records, post), config.df_max)
    pool = lexical.top(lexical.bm25(terms, post, corpus.records), config.pool).drop("rank")
    if config.comment_boost == 1.0:
        return lexical.top(pool, None)
    typed = corpus.records.select(F.col("doc_id").alias("record_id"), "type")
    return lexical.top(lexical.boosted_to_records(pool.withColumnRenamed("doc_id", "record_id"), typed, config.comment_boost).withColumnRenamed("record_id", "doc_id"), None)


def dense_channel(asked: DataFrame, corpus: Corpus, config: SearchConfig) -> DataFrame:
    """item_id, doc_id, score, rank: the pool of nearest vectors, the best of each record.

    A column ``qv`` of the questions is their vector; without one the offline embedder makes it.
    """
    vectors = asked.select("item_id", "qv") if "qv" in asked.columns else models.embed(asked, "dense_text").select("item_id", F.col("embedding").alias("qv"))
    pool = ranking.knn(vectors.filter("qv is not null"), corpus.vectors.select(F.col("doc_id").alias("vec_id"), "embedding"), config.pool)
    return lexical.top(pool.groupBy("item_id", "doc_id").agg(F.max("score").alias("score")), None)


def before_rerank(questions: DataFrame, corpus: Corpus, config: SearchConfig | None = None, mode: str = "hybrid") -> tuple[DataFrame, DataFrame]:
    """(routed, ranked): hits of the articles a question names, and the ranking without them.

    Routes always come from the question itself, never from its rewrite.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    config = config or SearchConfig()
    asked = _asked(questions, config)
    routed = ranking.routed(questions, corpus.records)
    if mode == "bm25":
        hits = lexical_channel(asked, corpus, config)
    elif mode == "dense":
        hits = dense_channel(asked, corpus, config)
    else:
        channels = {"bm25": lexical_channel(asked, corpus, config), "dense": dense_channel(asked, corpus, config)}
        hits = ranking.fused(channels, config.rrf_k, config.consensus_weight, None)
    named = hits.select("item_id", "doc_id", "score", "rank").join(corpus.records.select("doc_id", "record_id"), "doc_id")
    left = named.join(routed.select("item_id", "record_id").distinct(), ["item_id", "record_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("rank", "record_id"))
    source = "fusion" if mode.startswith("hybrid") else mode
    return routed, left.withColumn("rank", place).withColumn("source", F.lit(source))


def search(questions: DataFrame, corpus: Corpus, config: SearchConfig | None = None, mode: str = "hybrid") -> DataFrame:
    """item_id, doc_id, record_id, score, source, rank: the first ``config.k`` hits of every question.

    Routed records stay before the others and aren't reranked; reranking reads ``n_rerank`` texts of a question;
    graph expansion puts neighbours among the hits by score. A question without hits, null text included, has no rows.
    """
    config = config or SearchConfig()
    routed, ranked = before_rerank(questions, corpus, config, mode)
    if mode == "hybrid+rerank":
        order = ranking.reranked(ranked, questions, corpus.records, config.n_rerank, config.k)
        ranked = order.select("item_id", "doc_id", "score", "rank").join(corpus.records.select("doc_id", "record_id"), "doc_id").withColumn("source", F.lit("fusion"))
    out = ranking.pinned(routed, ranked, config.k)
    if mode == "hybrid+graph":
        out = ranking.expanded(out, corpus.edges, corpus.records, config.k)
    return out.join(corpus.records.select("doc_id", "record_id"), "record_id").select("item_id", "doc_id", "record_id", "score", "source", "rank")


def measure(questions: DataFrame, corpus: Corpus, gold: DataFrame, mode: str = "hybrid") -> Callable[[SearchConfig], DataFrame]:
    """What ``campaign.run_grid`` calls: scores per question (``gold``: item_id, doc_id) of a configuration."""
    return lambda config: evaluation.per_question(search(questions, corpus, config, mode), gold, config.k)
