"""Operator 7 [native]: document fingerprints by spot signatures (SpotSigs).

A signature is a common word (the anchor) with the next ``CHAIN`` content words after it,
looked for within ``REACH`` words; the fingerprint is the set of hashed signatures. Sets
are partitioned by their length, in ranges so wide that sets which may be as alike as a
threshold asks are in one range or in neighbouring ones. Sets further apart, and those whose
lengths alone keep their Jaccard likeness under the threshold, are pruned: they are never intersected and
their likeness counts as 0. The query compares with the threshold ``PRUNED``, the pair search ``alike`` with ``THRESHOLD``.

Everything is a column expression. Texts move once, dealt out by ranges of ids whose
bounds come from quantiles, for the lookup of a document's neighbour in the order of ids.

A text without anchors has the set of its words as its fingerprint, one without words
the hash of the text, so that equal texts, and only those, agree there; null is read as
empty. Repeated rows are separate rows next to each other; ties in doc_id are broken by
the text; a null doc_id comes last. A single document is its own neighbour. An empty
table gives an empty result, and further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorevine.llm import common

CHAIN, REACH = 2, 10
#: Very common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he in is it its of on or that the this to was were which with "
    "au aux ce dans des du elle en est et il la le les ne ou par pas pour qui que sur un une "
    "als auch auf das dem den der die ein eine für im ist mit nicht sich sie und von zu "
    "al como con del el ella es las lo los más no para pero por se su una y"
).split()
#: Least likeness that the pair search looks for, and least one that the query tells from nothing.
THRESHOLD, PRUNED = 0.8, 0.2
#: Hexadecimal digits of a hashed signature.
DIGITS = 16


def hashed(value: Column) -> Column:
    return F.left(F.md5(value), F.lit(DIGITS))


def chains(words: Column) -> Column:
    """The hashed signature at each anchor of an array of words."""
    return F.transform(
        F.filter(F.transform(words, lambda w, i: F.when(w.isin(ANCHORS), i).otherwise(-1)), lambda i: i >= 0),
        lambda i: hashed(
            F.concat_ws(
                " ",
                F.element_at(words, i + 1),
                F.array_join(F.slice(F.filter(F.slice(words, i + 2, REACH), lambda w: ~w.isin(ANCHORS)), 1, CHAIN), " "),
            )
        ),
    )


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``, the set of signatures of the column ``text``; each step is made once."""
    df = df.withColumn("_w", F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    df = df.withColumn("_s", chains(F.col("_w")))
    whole = F.array(hashed(F.col(text)))
    df = df.withColumn("_s", F.when(F.size("_s") > 0, F.col("_s")).when(F.size("_w") > 0, F.transform("_w", hashed)).otherwise(whole))
    return df.withColumn(name, F.array_sort(F.array_distinct("_s"))).drop("_w", "_s")


def length_range(n: Column, threshold: float = THRESHOLD) -> Column:
    """The partition of a set by its length: ranges grow by the factor 1/threshold."""
    # The small number keeps a length that is a power of the factor in the range it begins.
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log(1 / threshold) + 1e-9).cast("int")


def comparable(a: Column, b: Column, threshold: float) -> Column:
    """Whether sets of these lengths are in one range or neighbouring ones, and may be as alike as the threshold."""
    near = F.abs(length_range(a, threshold) - length_range(b, threshold)) <= 1
    return near & (F.least(a, b) >= F.greatest(a, b) * threshold)


def likeness(a: Column, b: Column, threshold: float = PRUNED) -> Column:
    """Jaccard likeness of two sets; 0, without an intersection, where lengths prune the pair."""
    both = F.size(F.array_intersect(a, b))
    return F.when(comparable(F.size(a), F.size(b), threshold), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0)).cast("double")


def fingerprint(signature_set: Column) -> Column:
    """The set as text: 16 hex digits a signature."""
    return F.array_join(signature_set, "")


def alike(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b, likeness) of representatives of equal sets, and ``members`` in the second frame.

    Equal sets are one class. In each range of lengths and the one above, the sets meet
    on the rarest of their signatures (a prefix that two alike sets can't both avoid),
    pairs whose lengths rule the threshold out are pruned, and the rest is compared.
    """
    sets = common.cut(with_signatures(common.document_text(documents), "text", "sigs").select("doc_id", "sigs"))
    classes = sets.groupBy("sigs").agg(F.min("doc_id").alias("class_id"))
    members = sets.join(classes, "sigs").select("doc_id", "class_id")
    one = common.cut(classes.withColumn("n", F.size("sigs")))
    often = one.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = one.select("class_id", "n", F.explode("sigs").alias("sig")).join(often, "sig")
    place = F.row_number().over(Window.partitionBy("class_id").orderBy("df", "sig"))
    prefix = ranked.withColumn("at", place).filter((F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1) & (F.col("df") > 1))
    prefix = prefix.select("class_id", "n", "sig", length_range(F.col("n"), threshold).alias("part"))
    left = prefix.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "sig", "part")
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = left.join(right, ["sig", "part"]).filter(ordered & comparable(F.col("na"), F.col("nb"), threshold)).select("a", "b").distinct()
    whole = pairs.join(one.select(F.col("class_id").alias("a"), F.col("sigs").alias("sa")), "a").join(one.select(F.col("class_id").alias("b"), F.col("sigs").alias("sb")), "b")
    return whole.select("a", "b", likeness(F.col("sa"), F.col("sb"), threshold).alias("likeness")).filter(F.col("likeness") >= threshold), members


def _bounds(ids: DataFrame, n: int) -> list:
    """Ids that split the rows into about n equal ranges, highest first; n of them at most."""
    cuts = [i / n for i in range(1, n)]
    found = ids.agg(F.percentile_approx("doc_id", cuts, 10_000).alias("q")).first()["q"] if cuts else None
    return sorted({x for x in found or [] if x is not None})


def _range_of(doc_id: Column, bounds: list) -> Column:
    """How many bounds are above an id: a binary search by halving steps."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    held = F.array(*[F.lit(b) for b in bounds])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.element_at(held, F.least(at + step, F.lit(len(bounds)))) <= doc_id), at + step).otherwise(at))
    return F.when(doc_id.isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - below)


def op7_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are."""
    return edited_fingerprints(common.table(spark, sf_dir, "documents"))


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """The contract's rows for any table with doc_id and text."""
    spark = documents.sparkSession
    docs = common.document_text(documents)
    bounds = _bounds(docs.select("doc_id"), common.parts(spark))
    docs = docs.withColumn("_range", _range_of(F.col("doc_id"), bounds))
    # Signatures are made after the one move of the texts, so they don't move with them.
    dealt = with_signatures(docs.repartition(common.parts(spark), "_range"), "text", "sigs")
    within = Window.partitionBy("_range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").asc())
    lead = dealt.withColumn("_next", F.lead(F.struct("text", "sigs")).over(within))
    # The first row of each range goes to the range before: one row per range is all that is joined.
    heads = docs.groupBy("_range").agg(F.max("doc_id").alias("top"))
    heads = heads.withColumn("_to", F.coalesce(F.lag("_range").over(Window.orderBy("_range")), F.max("_range").over(Window.partitionBy())))
    top = docs.alias("d").join(F.broadcast(heads).alias("h"), (F.col("d._range") == F.col("h._range")) & F.col("d.doc_id").eqNullSafe(F.col("h.top")))
    top = top.groupBy(F.col("h._to").alias("_range")).agg(F.min("d.text").alias("_text"))
    donor = with_signatures(top, "_text", "_sigs").select("_range", F.struct(F.col("_text").alias("text"), F.col("_sigs").alias("sigs")).alias("_head"))
    rows = lead.join(donor, "_range", "left")
    rows = rows.select("doc_id", "text", "sigs", F.coalesce("_next", "_head").alias("_next"), F.length("text").cast("long").alias("n_chars"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("_next")["text"], F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "sigs", edited.alias("edited"), F.col("_next")["sigs"].alias("next_sigs"))
    rows = with_signatures(rows, "edited", "edited_sigs")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


_ANCHORS_SQL = "[" + ", ".join(f"'{w}'" for w in ANCHORS) + "]"
#: The same rows in DuckDB SQL.
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next FROM d WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next, length(text) // 2) AS edited FROM n),
t AS (SELECT text FROM e UNION SELECT next FROM e UNION SELECT edited FROM e),
w AS (SELECT text, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM t),
s AS (SELECT text, w, list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains({_ANCHORS_SQL}, w[i])),
  lambda i: md5(w[i] || ' ' || array_to_string(list_filter(w[i + 1 : i + {REACH}], lambda x: NOT list_contains({_ANCHORS_SQL}, x))[1 : {CHAIN}], ' '))) AS s FROM w),
f AS (SELECT text, list_sort(list_distinct(list_transform(CASE WHEN len(s) > 0 THEN s WHEN len(w) > 0 THEN list_transform(w, lambda x: md5(x)) ELSE [md5(text)] END, lambda x: left(x, {DIGITS})))) AS f FROM s),
j AS (SELECT doc_id, length(e.text) AS n_chars, edited, a.f AS a, b.f AS b, c.f AS c FROM e JOIN f a ON a.text = e.text JOIN f b ON b.text = e.edited JOIN f c ON c.text = e.next)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN least(len(a), len(b)) >= {PRUNED} * greatest(len(a), len(b)) THEN len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) ELSE 0.0 END AS near_edited,
  CASE WHEN least(len(a), len(c)) >= {PRUNED} * greatest(len(a), len(c)) THEN len(list_intersect(a, c)) / CAST(len(a) + len(c) - len(list_intersect(a, c)) AS DOUBLE) ELSE 0.0 END AS near_next
FROM j
"""
