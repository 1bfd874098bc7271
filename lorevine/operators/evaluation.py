"""Evaluation: gold matching, recall and rank measures, paired statistics, agreement."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def matches(record_id: Column, citation: Column) -> Column:
    """A record is what a citation names: equal, or followed by @, # or -c."""
    rest = F.substring(record_id, F.length(citation) + 1, F.length(record_id))
    return (record_id == citation) | (record_id.startswith(citation) & rest.rlike("^([@#]|-c)"))


def matched(records: DataFrame, cited: DataFrame) -> DataFrame:
    """``records`` with each citation that names them: by an equi-join on the three ids a citation may use.

    These are the id itself, the id without version and number, and that without the comment's mark too.
    """
    plain = F.regexp_extract("record_id", "^[^@#]*", 0)
    keys = F.array_distinct(F.array(F.col("record_id"), plain, F.regexp_replace(plain, "-c.*$", "")))
    both = records.withColumn("citation", F.explode(keys)).join(cited, "citation")
    return both.filter(matches(F.col("record_id"), F.col("citation")))


def containing(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id of passages (item_id, text) and the texts (doc_id, text) that contain them.

    Both meet on three adjacent words, hashed: a passage gives those after its first word (which may begin within
    a word of the text, as the last may end in one), a text all it has. Only pairs that meet are compared, where they meet: the passages
    are sent to every task, and no text leaves its own. Passages of fewer than five words are compared with every text.
    """
    words = lambda text: F.split(text, r"[^\p{L}\p{N}]+")
    three = lambda w, i: F.xxhash64(*[F.get(w, i + j) for j in range(3)])
    # The first and the last word of a passage may be cut off within a word of the text.
    asked = questions.select("item_id", F.col("text").alias("passage"), words(F.col("text")).alias("w"))
    long, short = asked.filter(F.size("w") >= 5), asked.filter((F.size("w") < 5) & (F.col("passage") != ""))
    keyed = long.select("item_id", "passage", three(F.col("w"), F.lit(1)).alias("key"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: three(F.col("w"), i)))
    own = docs.select("doc_id", "text", words(F.col("text")).alias("w")).select("doc_id", "text", F.explode_outer(F.when(F.size("w") >= 3, grams)).alias("key"))
    both = own.join(F.broadcast(keyed), "key").filter(F.col("text").contains(F.col("passage"))).select("item_id", "doc_id")
    rest = docs.select("doc_id", "text").join(F.broadcast(short), F.col("text").contains(F.col("passage"))).select("item_id", "doc_id")
    return both.unionByName(rest).distinct()


def per_question(hits: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """item_id, recall_5, recall_10, rr of every question that has gold."""
    found = gold.join(hits.filter(F.col("rank") <= max(k, 10)).select("item_id", "doc_id", "rank"), ["item_id", "doc_id"], "left")
    rr = F.min(F.when(F.col("rank") <= k, F.col("rank")))
    return found.groupBy("item_id").agg(
        F.round(F.avg(F.when(F.col("rank") <= 5, 1.0).otherwise(0.0)), 6).alias("recall_5"),
        F.round(F.avg(F.when(F.col("rank") <= 10, 1.0).otherwise(0.0)), 6).alias("recall_10"),
        F.round(F.coalesce(1.0 / rr, F.lit(0.0)), 6).alias("rr"),
    )


def macro(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 3).alias(c) for c in ("recall_5", "recall_10", "rr")])


def margins(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """item_id, margin_rank: the best rank of any gold in the whole fused list, null if absent."""
    return gold.join(hits.select("item_id", "doc_id", "rank"), ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.min("rank").alias("margin_rank"))


def margin_before_eviction(ranks: DataFrame) -> DataFrame:
    """Exposed and absent questions, median of found ranks, shares beyond 10 and 25 (absent counts as beyond)."""
    beyond = lambda n: F.round(F.avg(F.when(F.col("margin_rank") <= n, 0.0).otherwise(1.0)), 4)
    return ranks.agg(
        F.count(F.lit(1)).alias("n_exposed"), F.sum(F.when(F.col("margin_rank").isNull(), 1).otherwise(0)).alias("n_absent"),
        F.percentile("margin_rank", F.lit(0.5)).alias("median_rank"), beyond(10).alias("beyond_10"), beyond(25).alias("beyond_25"),
    )


def margin_among_present(ranks: DataFrame) -> DataFrame:
    there = ranks.filter(F.col("margin_rank").isNotNull())
    return there.agg(
        F.count(F.lit(1)).alias("n"), F.percentile("margin_rank", F.lit(0.5)).alias("median_rank"), F.round(F.avg("margin_rank"), 2).alias("mean_rank"),
        F.max("margin_rank").alias("max_rank"), F.sum(F.when(F.col("margin_rank") > 25, 1).otherwise(0)).alias("n_beyond_25"),
    )


def paired(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """item_id, a, b, delta; key sets must be equal, else the job fails."""
    both = a.select("item_id", F.col(value).alias("a")).join(b.select("item_id", F.col(value).alias("b")), "item_id", "full")
    both = both.withColumn("_ok", F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("the two configurations have different questions"))).otherwise(F.lit(True)))
    return both.filter("_ok").select("item_id", "a", "b", F.round(F.col("b") - F.col("a"), 6).alias("delta"))


def worst_category(pairs: DataFrame, category: DataFrame) -> DataFrame:
    """The category that loses most; nothing but losses count."""
    by = pairs.join(category, "item_id").groupBy("category").agg(F.round(F.avg("b") - F.avg("a"), 4).alias("delta"))
    return by.filter("delta < 0").orderBy("delta", "category").limit(1)


def flips(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.sum(F.when(F.col("delta") > 0, 1).otherwise(0)).alias("wins"), F.sum(F.when(F.col("delta") < 0, 1).otherwise(0)).alias("losses"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("delta") > 0, F.col("item_id")))), ",").alias("won"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("delta") < 0, F.col("item_id")))), ",").alias("lost"),
    )


def bootstrap(deltas: list[float], n_boot: int = 10_000, seed: int = 42) -> tuple[float, float, float, float]:
    """(mean, low, high, share of positive means) of resampled paired differences."""
    rng, n = random.Random(seed), len(deltas)
    means = sorted(sum(deltas[rng.randrange(n)] for _ in range(n)) / n for _ in range(n_boot))
    return round(sum(deltas) / n, 4), round(means[int(0.025 * n_boot)], 4), round(means[int(0.975 * n_boot)], 4), round(sum(m > 0 for m in means) / n_boot, 4)


def paired_bootstrap(pairs: DataFrame, by: str | None = None, n_boot: int = 10_000, seed: int = 42) -> DataFrame:
    """Bootstrap of the differences, by category if asked; a group is a question set, so it fits a task."""
    frame = pairs if by else pairs.withColumn("all", F.lit("all"))
    key = by or "all"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        deltas = rows.sort_values("item_id")["delta"].tolist()
        return pd.DataFrame([(rows[key].iloc[0], len(deltas), *bootstrap(deltas, n_boot, seed))], columns=[key, "n", "delta", "low", "high", "p"])

    return frame.select(key, "item_id", "delta").groupBy(key).applyInPandas(one, f"`{key}` string, n long, delta double, low double, high double, p double")


def kappa(ratings: DataFrame) -> DataFrame:
    """n, exact agreement, mean gap and quadratic-weighted kappa of columns a and b."""
    cells = ratings.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    n = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"), F.sum(F.abs(F.col("a") - F.col("b")) * F.col("c")).alias("gap"),
                  F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")) * F.col("c")).alias("seen"))
    rows, columns = cells.groupBy("a").agg(F.sum("c").alias("ca")), cells.groupBy("b").agg(F.sum("c").alias("cb"))
    expected = rows.crossJoin(columns).agg(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")) * F.col("ca") * F.col("cb")).alias("chance"))
    value = F.when(F.col("chance") == 0, F.when(F.col("seen") == 0, 1.0).otherwise(-1.0)).otherwise(1 - F.col("seen") * F.col("n") / F.col("chance"))
    return n.crossJoin(expected).select("n", F.round(F.col("same") / F.col("n"), 4).alias("exact"), F.round(F.col("gap") / F.col("n"), 4).alias("mean_gap"), F.round(value, 4).alias("kappa"))


def identical(scores: DataFrame) -> DataFrame:
    """Groups of configurations with the same vector of scores (config, item_id, value)."""
    prints = scores.groupBy("config").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("item_id", "value")))), 256).alias("print"))
    return prints.groupBy("print").agg(F.array_join(F.array_sort(F.collect_list("config")), ",").alias("configs"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("configs", "n")


def round_robin(rows: DataFrame, category: str, key: str, n: int) -> DataFrame:
    """``n`` rows, one of each category in turn."""
    turn = F.row_number().over(Window.partitionBy(category).orderBy(key))
    return rows.withColumn("turn", turn).orderBy("turn", category).limit(n)
