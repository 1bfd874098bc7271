"""Operator 6: mixing sources to target weights by Sainte-Lague apportionment.

Targets: sources in code-point order (null last) weigh 5, 2, 1 in turn and share
``share`` of all words; no target exceeds ``most`` times its source, and the excess goes
to the others by weight until none is above. The mix is made of equal blocks of
``block_words`` words. The highest quotients weight/(2k+1) decide how many blocks each
source gets, and again how many each shard of a source gets, so every shard has an
integer quota. Within a shard the documents lie end to end in a seeded order; whole
passes come first, then the first blocks of that order, so that all but one document of
a shard is taken whole.

Shards hold about ``shard_words`` words or ``shard_rows`` rows, so a hot source is many
shards. Only the highest quotients that can still be in doubt are made: twice as many
rows as there are sources (or shards). Words are counted in one pass over the texts;
everything after that handles ids and numbers. Repeated rows (one id, source and size)
are one row with a number of copies until the end, so a hot id costs no more than others.

Null or blank text has size 0 and is never taken. A source without words has target 0.
An empty table gives an empty result. Reruns agree: order and ties are fixed by hashes
of doc_id, then by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorevine.llm import common

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK_WORDS = 16
SHARD_WORDS, SHARD_ROWS = 1 << 20, 1 << 14


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> target. One row per source, so one window over all is small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    place = F.row_number().over(by_name) - 1
    out = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    out = out.withColumn("cap", F.col("source_size") * most).withColumn("all_words", F.sum("source_size").over(everything) * share)
    # Filling up: sources reach their caps in the order of cap by weight.
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full = order.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("before", F.coalesce(F.sum("cap").over(full), F.lit(0.0)))
    out = out.withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    out = out.withColumn("turn", F.row_number().over(order))
    out = out.withColumn("level", (F.col("all_words") - F.col("before")) / F.col("open"))
    # The level that holds is that of the first source which doesn't reach its cap.
    out = out.withColumn("final", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("turn", "level"))).over(everything)["level"])
    return out.select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight"))).alias("target"))


def sainte_lague(claims: DataFrame, group: list[str], weight: str, seats: str, order: list[Column]) -> DataFrame:
    """``claims`` with ``quota``: the ``seats`` of each group go to the highest weight/(2k-1).

    A claim gets every seat below what any divisor in reach would give it; only the
    quotients between that and the most it can get are made and ranked.
    """
    within = Window.partitionBy(*group)
    out = claims.withColumn("_sum", F.sum(weight).over(within)).withColumn("_n", F.count(F.lit(1)).over(within))
    part = F.when(F.col("_sum") > 0, F.col(weight) / F.col("_sum")).otherwise(F.lit(0.0))
    out = out.withColumn("_lo", F.greatest(F.lit(0), F.floor(part * (F.col(seats) - F.col("_n") / 2) - 0.5 - 1e-6)).cast("long"))
    out = out.withColumn("_hi", F.when(part > 0, F.least(F.col(seats), F.ceil(part * (F.col(seats) + F.col("_n") / 2) + 0.5 + 1e-6))).otherwise(0).cast("long"))
    out = out.withColumn("_left", F.col(seats) - F.sum("_lo").over(within)).withColumn("_id", F.row_number().over(within.orderBy(*order)))
    doubt = out.filter(F.col("_hi") > F.col("_lo")).select(*group, "_id", "_left", weight, F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))).alias("_k"))
    doubt = doubt.withColumn("_rank", F.row_number().over(within.orderBy((F.col(weight) / (2 * F.col("_k") - 1)).desc(), "_id")))
    won = doubt.filter(F.col("_rank") <= F.col("_left")).groupBy(*group, "_id").agg(F.count(F.lit(1)).alias("_won"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_id"]]
    joined = out.alias("a").join(won.alias("b"), same, "left")
    return joined.select("a.*", (F.col("a._lo") + F.coalesce(F.col("b._won"), F.lit(0))).alias("quota")).drop("_sum", "_n", "_lo", "_hi", "_left", "_id")


def mix(sized: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, source, size (words), copies -> with source_size, target and ``before``,
    ``until`` and ``passes``, from which ``taken_words`` has the words taken of each copy.

    ``sized`` should be cheap to read more than once (see ``common.cut``).
    """
    sized = sized.withColumn("words", F.col("size") * F.col("copies"))
    totals = sized.groupBy("source").agg(F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    targets = source_targets(totals.select("source", "source_size"))
    sources = totals.alias("t").join(targets.alias("g"), F.col("t.source").eqNullSafe(F.col("g.source"))).select("t.source", "t.source_size", "source_rows", "target")
    sources = sources.withColumn("claim", F.col("target")).withColumn("one", F.lit(1))
    seats = F.floor(F.sum("target").over(Window.partitionBy("one")) / block_words + 0.5).cast("long")
    sources = sainte_lague(sources.withColumn("blocks", seats), ["one"], "claim", "blocks", [F.col("source").asc_nulls_last()])
    sources = sources.withColumnRenamed("quota", "source_quota").withColumn(
        "shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("source_rows") / shard_rows)).cast("long")
    )
    sources = common.cut(sources.select("source", "source_size", "target", "source_quota", "shards"))

    rows = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.source_size", "s.target", "s.source_quota", "s.shards")
    rows = rows.withColumn("order_key", common.order_hash("doc_id"))
    rows = common.cut(rows.withColumn("shard", F.conv(F.left("order_key", F.lit(8)), 16, 10).cast("long") % F.col("shards")))
    shards = rows.groupBy("source", "shard").agg(F.sum("words").alias("shard_size"), F.max("source_quota").alias("source_quota"))
    shards = sainte_lague(shards.withColumn("claim", F.col("shard_size").cast("double")), ["source"], "claim", "source_quota", [F.col("shard")])

    placed = rows.alias("d").join(
        shards.select("source", "shard", "shard_size", "quota").alias("q"),
        F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard")),
    ).select("d.*", "q.shard_size", "q.quota")
    lies = Window.partitionBy("source", "shard").orderBy("order_key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("start", F.sum("words").over(lies) - F.col("words"))
    # A shard has n blocks, the last perhaps short; a quota is whole passes and the first blocks of one more.
    n = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_words))
    passes = F.least(F.floor(F.col("quota") / n), F.lit(int(MOST)))
    cut_at = F.when(passes >= int(MOST), F.lit(0)).otherwise((F.col("quota") - passes * n) * block_words)
    return placed.select("doc_id", "source", "size", "copies", "source_size", "target", passes.alias("passes"), (cut_at - F.col("start")).alias("until"))


def taken_words(copy: Column) -> Column:
    """Words taken of a copy (counted from 0) of a row of ``mix``."""
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("until") - copy * F.col("size")))
    return (F.col("passes") * F.col("size") + more).cast("long")


def sized_rows(documents: DataFrame) -> DataFrame:
    """doc_id, source, size and the number of copies of each such row."""
    rows = documents.select("doc_id", F.col("source").cast("string").alias("source"), common.n_words(F.col("text")).alias("size"))
    return common.cut(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: how many words of each are taken."""
    mixed = mix(sized_rows(common.table(spark, sf_dir, "documents")))
    each = mixed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.select("doc_id", "size", "source_size", "target", taken_words(F.col("copy")).alias("taken"))


#: The same rows in DuckDB SQL, every quotient made. It needs unique ids.
OP6_SQL = rf"""
WITH d AS (SELECT doc_id, CAST(source AS VARCHAR) AS source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS source_rows FROM d GROUP BY source),
w AS (SELECT *, {list(map(float, WEIGHTS))}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS weight, source_size * {MOST}::DOUBLE AS cap, sum(source_size) OVER () * {SHARE}::DOUBLE AS every FROM s),
v AS (SELECT *, row_number() OVER o AS turn, (every - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
f AS (SELECT min_by(level, turn) AS final FROM v WHERE level * weight < cap),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target,
  CAST(greatest(1, ceil(source_size / {SHARD_WORDS}), ceil(source_rows / {SHARD_ROWS})) AS BIGINT) AS shards FROM v, f),
b AS (SELECT CAST(floor(sum(target) / {BLOCK_WORDS} + 0.5) AS BIGINT) AS blocks FROM t),
q AS (SELECT source, count(*) AS quota FROM (SELECT source, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source NULLS LAST) AS place, blocks
  FROM (SELECT source, target, blocks, unnest(range(1, blocks + 1)) AS k FROM t, b WHERE target > 0)) WHERE place <= blocks GROUP BY source),
r AS (SELECT d.*, source_size, target, coalesce(quota, 0) AS source_quota, md5(concat_ws(chr(31), 'lorevine', doc_id)) AS order_key, ('0x' || left(md5(concat_ws(chr(31), 'lorevine', doc_id)), 8))::BIGINT % shards AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON d.source IS NOT DISTINCT FROM q.source),
h AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size, max(source_quota) AS source_quota FROM r GROUP BY source, shard),
g AS (SELECT source, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * k - 1) DESC, shard) AS place
  FROM (SELECT *, unnest(range(1, source_quota + 1)) AS k FROM h WHERE shard_size > 0)) WHERE place <= source_quota GROUP BY source, shard),
p AS (SELECT r.*, greatest(1, ceil(shard_size / {BLOCK_WORDS})) AS n, coalesce(g.quota, 0) AS quota, sum(size) OVER (PARTITION BY r.source, r.shard ORDER BY order_key, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM r JOIN h ON r.source IS NOT DISTINCT FROM h.source AND r.shard = h.shard LEFT JOIN g ON r.source IS NOT DISTINCT FROM g.source AND r.shard = g.shard),
z AS (SELECT *, least(floor(quota / n), {int(MOST)}) AS passes FROM p)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, CASE WHEN passes >= {int(MOST)} THEN 0 ELSE (quota - passes * n) * {BLOCK_WORDS} END - start)) AS BIGINT) AS taken FROM z
"""
