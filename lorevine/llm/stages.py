"""The stages of the corpus pipeline: each takes documents and lets its decisions take effect.

All keep the columns they get (the last one excepted), whatever further columns there
are and whatever these are called, and work on every row. An empty table gives an empty
table, and so do empty labels or an empty benchmark give the documents as they are. Null
texts are read as empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevine.llm import common, decontaminate, mix_sources, parity_join, shard_slots, toxicity


def _columns(docs: DataFrame, of: str = "") -> list[Column]:
    return [F.col(f"{of}`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5.

    Every row is judged by its own text: null ids are kept or not like others, repeated rows
    alike. Null and empty texts have the score of the intercept, so they stay unless nearly all labels
    are toxic. Without labels nothing is dropped.
    """
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    name = common.free_name(docs, "_toxicity")
    return toxicity.score(docs, model, name).filter(F.col(f"`{name}`") < 0.5).select(*_columns(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id, rows without id last.

    Rows are grouped by their texts, whatever ids they share or lack. Of rows that have
    id and text in common, the least of a hash of the other columns stays. Rows
    without id and without words are like nothing and all stay; of rows with an id but without words, one of each
    id and text stays.
    """
    rows = parity_join.grouped(docs, null_ids=True).filter("n > 0 or id is not null")
    # Ties of the same id: by the key, a hash of the text.
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("doc_id")))["doc_id"]
    key, row = common.free_name(docs, "_key"), common.free_name(docs, "_row")
    stays = rows.groupBy(F.coalesce("root", "node", "doc_id")).agg(first.alias(key)).select(F.col(f"`{key}`"))
    wordless = F.col("doc_id").isNull() & (common.n_words(F.col("text")) == 0)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    kept = docs.filter(~wordless).withColumn(key, parity_join.row_key()).join(stays, key, "left_semi")
    one = kept.groupBy(F.col(f"`{key}`")).agg(F.min_by(F.struct(*_columns(docs)), F.struct(F.md5(F.to_json(others)), F.col("text").isNull())).alias(row))
    return one.select(*[F.col(f"`{row}`")[c].alias(c) for c in docs.columns]).unionByName(docs.filter(wordless))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of benchmark words.

    Rows are judged one by one; null and empty texts have no window and stay, and so does all
    where the benchmark is empty.
    """
    return decontaminate.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rounded to whole documents.

    Rows with the same id, source and number of words are taken equally often; a null source is a
    source. Texts without words are never taken. Ties of the order are broken by size.
    """
    mixed = mix_sources.mix(mix_sources.sized_rows(docs))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), F.lit(0).cast("long"), lambda n, copy: n + mix_sources.taken_words(copy))
    times = F.floor(total / (F.col("size") * F.col("copies")) + 0.5).cast("int")
    taken = mixed.filter("size > 0").select("doc_id", "source", "size", times.alias("times")).filter("times > 0")
    size, again = common.free_name(docs, "_size"), common.free_name(docs, "_again")
    rows = docs.withColumn(size, common.n_words(F.col("text")))
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").cast("string").eqNullSafe(F.col("m.source")) & (F.col(f"d.`{size}`") == F.col("m.size"))
    both = rows.alias("d").join(taken.alias("m"), same)
    return both.select(*_columns(docs, "d."), F.explode(F.sequence(F.lit(1), F.col("m.times"))).alias(again)).drop(again)


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's size, checksum, shard and place in the shard.

    A null id is an id, a null text has no bytes, and repeated rows have places of their own.
    """
    return shard_slots.shard(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_to_weights),
    ("sharding", deal_into_shards),
]
