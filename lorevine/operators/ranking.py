"""Dense search, fusion, routing, graph expansion and reranking over frames of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorevine.functions import text as T

#: The score of a routed hit, the share a neighbour inherits, hits that are expanded.
ROUTE_SCORE, NEIGHBOUR_SHARE, EXPANDED = 100.0, 0.5, 5
PASSAGE_CHARS = 1000
ARTICLE_IN_QUESTION = r"(?i)art(?:icles?|\.)\s*(\d{3,4}-\d+(?:-\d+)?)"


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def knn(queries: DataFrame, vectors: DataFrame, k: int | None) -> DataFrame:
    """item_id, doc_id, score (minus the distance, 6 decimals), rank: exact search.

    ``queries`` (item_id, qv) is the stated query set; every vector is compared with it.
    """
    pairs = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v")).crossJoin(queries.select("item_id", F.col("qv").cast("array<double>").alias("qv")))
    scored = pairs.select("item_id", "doc_id", (F.round(-l2(F.col("v"), F.col("qv")), 6) + 0.0).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def contributions(channels: dict[str, DataFrame], rrf_k: int) -> DataFrame:
    """item_id, doc_id, channel, rank, c = 1/(k + rank) of every channel's hits."""
    every = None
    for name, hits in channels.items():
        part = hits.select("item_id", "doc_id", F.lit(name).alias("channel"), "rank")
        every = part if every is None else every.unionByName(part)
    return every.withColumn("c", 1.0 / (rrf_k + F.col("rank")))


def fused(channels: dict[str, DataFrame], rrf_k: int = 60, consensus: float = 1.0, k: int | None = 10) -> DataFrame:
    """Weighted reciprocal-rank fusion: the best contribution, and ``consensus`` times the others."""
    parts = contributions(channels, rrf_k)
    best = F.max("c")
    score = F.round(best + consensus * (F.sum("c") - best), 9).alias("score")
    ranks = [F.min(F.when(F.col("channel") == name, F.col("rank"))).alias(f"{name}_rank") for name in channels]
    out = parts.groupBy("item_id", "doc_id").agg(score, *ranks)
    order = [F.col("score").desc(), *[F.col(f"{name}_rank").asc_nulls_last() for name in channels], F.col("doc_id")]
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return out if k is None else out.filter(F.col("rank") <= k)


def routed(questions: DataFrame, records: DataFrame) -> DataFrame:
    """Regulatory records of the article numbers in a question, in order of mention; repeats stay."""
    cited = questions.select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(ARTICLE_IN_QUESTION), F.lit(1))).alias("mention", "article"))
    found = cited.join(records.filter(F.col("type") == "regulatory"), "article")
    return found.select("item_id", "mention", "article", "record_id", F.lit(ROUTE_SCORE).alias("score"), F.lit("route").alias("source"))


def pinned(routes: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Routed hits first, then the ranked ones without them, ``k`` in all."""
    rest = ranked.join(routes.select("item_id", "record_id").distinct(), ["item_id", "record_id"], "left_anti")
    one = routes.select("item_id", "record_id", "score", "source", F.lit(0).alias("section"), F.col("mention").cast("long").alias("place"))
    two = rest.select("item_id", "record_id", "score", "source", F.lit(1).alias("section"), F.col("rank").cast("long").alias("place"))
    order = Window.partitionBy("item_id").orderBy("section", "place", "record_id")
    return one.unionByName(two).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("section", "place")


def expanded(hits: DataFrame, edges: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """One hop from the first hits along internal edges; the first parent counts, seen records don't."""
    start = hits.filter(F.col("rank") <= EXPANDED).select("item_id", F.col("record_id").alias("source_id"), F.col("rank").alias("parent"), "score")
    reached = start.join(edges.filter(F.col("family") == "internal"), "source_id").withColumn("article", F.regexp_replace("target", "^pcg-", ""))
    reached = reached.join(records.filter(F.col("type") == "regulatory").select("article", "record_id"), "article")
    new = reached.join(hits.select("item_id", "record_id"), ["item_id", "record_id"], "left_anti")
    first = F.row_number().over(Window.partitionBy("item_id", "record_id").orderBy("parent", "edge_no"))
    new = new.withColumn("_n", first).filter("_n = 1").select("item_id", "record_id", F.round(F.col("score") * NEIGHBOUR_SHARE, 7).alias("score"), F.lit("graph").alias("source"), (F.col("parent") + 1000).alias("rank"))
    every = hits.select("item_id", "record_id", "score", "source", "rank").unionByName(new)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "rank", "record_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def overlap_score(question: Column, passage: Column) -> Column:
    """Share of the question's distinct tokens that the cut passage has: the offline reranker."""
    q = F.array_distinct(T.tokens(question))
    p = F.array_distinct(T.tokens(F.substring(passage, 1, PASSAGE_CHARS)))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, p)) / F.size(q)).otherwise(F.lit(0.0))


def reranked(hits: DataFrame, questions: DataFrame, docs: DataFrame, n_rerank: int, k: int) -> DataFrame:
    """The first ``n_rerank`` hits in the order of the reranker; cut before any text is read."""
    cut = hits.filter(F.col("rank") <= n_rerank) if k > 0 else hits.limit(0)
    texts = cut.join(docs.select("doc_id", F.col("text").alias("passage")), "doc_id").join(questions.select("item_id", F.col("text").alias("question")), "item_id")
    scored = texts.select("item_id", "doc_id", "score", F.col("rank").alias("first_rank"), F.round(overlap_score(F.col("question"), F.col("passage")), 6).alias("score_rerank"))
    order = Window.partitionBy("item_id").orderBy(F.col("score_rerank").desc(), "first_rank")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def composed(question: Column, rewrite: Column, mode: str = "extend", question_weight: int = 1) -> tuple[Column, Column]:
    """(lexical text, dense text) of a question and its rewrite; only the lexical one repeats the question."""
    if mode == "replace":
        return F.coalesce(rewrite, question), F.coalesce(rewrite, question)
    repeated = F.array_join(F.array_repeat(question, question_weight), " ")
    return F.concat_ws(" ", repeated, rewrite), F.concat_ws(" ", question, rewrite)
