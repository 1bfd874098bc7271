"""Operator 8: toxicity by a character n-gram linear classifier with naive Bayes scaling.

A text becomes the set of its character n-grams (bytes of the lower-cased text between
blanks, hashed). A feature is scaled by its naive Bayes log-count ratio between toxic and
clean training texts; features whose ratio is below ``LEAST_RATIO`` tell nothing and are
left out. The scaled features of a text are divided by their Euclidean length, so that one
rule holds for texts of every length, in training and in scoring, and a logistic
regression with an L2 penalty learns their weights. Both labels weigh the same in
training, however many rows of each there are: 0.5 means even odds at even shares.

Trained on a sample of labelled rows, at most ``SAMPLE_ROWS`` of each label, each with
its whole text; the driver gets the sets of hashed features (64 KiB a row at most), not
the texts. Every whole text is scored where it is read, without a shuffle.

Null or empty text, like any text without a known n-gram, gets the score of the
intercept. Without labelled rows of both labels the score is the share of label 1 (0
without labels). Rows whose label is null, or whose id has contradicting labels, are not
trained on; of several texts of one id the one with the least md5 is. Repeated rows are
scored alike; a null id is held out as crc32 of nothing would say: null is read as the
empty string. An empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevine.llm import common

#: Bound of the training sample: rows of each label.
SAMPLE_ROWS = 1000
GRAMS = (4, 5, 6)
BITS = 19
#: Least number of training texts with a feature, least log-count ratio, smoothing of counts, weight of the L2 penalty.
LEAST, LEAST_RATIO, SMOOTHING, PENALTY = 3, 1.0, 1.0, 2e-4

#: Punctuation between words is read as a blank, so that a word has one set of n-grams.
_BLANKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def features(text: str, seen: np.ndarray) -> np.ndarray:
    """Sorted hashes of the n-grams of a whole text. ``seen`` is a cleared scratch array of flags."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split()) + b" "
    part = np.frombuffer(raw, np.uint8).astype(np.uint32)
    code = np.zeros(len(part), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(part) < n:
            break
        code = code[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] + np.uint32(1)
        if n in GRAMS:
            mixed = (code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            seen[mixed >> np.uint32(32 - BITS)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def packed(found: np.ndarray) -> bytes:
    """A set of features as bytes: a list, or a table of bits where that is shorter."""
    if 4 * len(found) < 1 << BITS - 3:
        return found.astype(np.int32).tobytes()
    flags = np.zeros(1 << BITS, np.uint8)
    flags[found] = 1
    return np.packbits(flags).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    """The set that ``packed`` wrote."""
    if len(raw) < 1 << BITS - 3:
        return np.frombuffer(raw, np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))).astype(np.int32)


class Model:
    """Weights by hashed feature (the scaling is folded in), squared scales, and the intercept."""

    def __init__(self, weights: np.ndarray, squares: np.ndarray, intercept: float) -> None:
        self.weights, self.squares, self.intercept = weights, squares, intercept

    def margin(self, found: np.ndarray) -> float:
        """The log-odds of a whole text with these features."""
        length = float(self.squares[found].sum(dtype=np.float64)) ** 0.5
        return self.intercept + (float(self.weights[found].sum(dtype=np.float64)) / length if length else 0.0)


def train(rows: list[np.ndarray], labels: list[int], steps: int = 120) -> Model:
    """The model of training texts, given as sets of features."""
    nothing = np.zeros(1 << BITS, np.float32)
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return Model(nothing, nothing, float(np.log(share / (1 - share))))
    toxic, clean = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for found, label in zip(rows, y, strict=True):
        (toxic if label else clean)[found] += 1
    # Shares of texts rather than of occurrences: features are binary.
    ratio = np.log((toxic + SMOOTHING) / (y.sum() + 2 * SMOOTHING)) - np.log((clean + SMOOTHING) / ((1 - y).sum() + 2 * SMOOTHING))
    known = (toxic + clean >= LEAST) & (np.abs(ratio) >= LEAST_RATIO)
    ids, number = np.flatnonzero(known), np.cumsum(known).astype(np.int32) - 1
    scale = ratio[ids]
    kept = [number[found[known[found]]] for found in rows]
    at, row = np.concatenate(kept), np.repeat(np.arange(len(y), dtype=np.int32), [len(k) for k in kept])
    length = np.sqrt(np.bincount(row, weights=scale[at] ** 2, minlength=len(y)))
    values = scale[at] / length[row]
    evenly = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    # Accelerated gradient; rows have length 1, so a step of 4 is safe.
    v, vb = np.zeros(len(ids)), 0.0
    m, mb = v, vb
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=values * v[at], minlength=len(y)) + vb, -30, 30)))
        g = (p - y) * evenly
        m_new = v - 2 * (np.bincount(at, weights=values * g[row], minlength=len(ids)) + PENALTY * v)
        mb_new = vb - 2 * g.sum()
        v, vb = m_new + k / (k + 3) * (m_new - m), mb_new + k / (k + 3) * (mb_new - mb)
        m, mb = m_new, mb_new
    weights, squares = nothing, nothing.copy()
    weights[ids], squares[ids] = m * scale, scale**2
    return Model(weights, squares, float(mb))


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == fold


def training_sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, toxic and features of at most ``rows`` texts of each label in a seeded order, not of the held-out fold."""
    common.workers_can_import(documents.sparkSession)
    agreed = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"), F.min("toxic").cast("int").alias("least"))
        .filter(F.col("toxic") == F.col("least"))
        .select("doc_id", "toxic")
    )
    there = agreed.join(documents.select("doc_id"), "doc_id", "left_semi")
    picked = None
    for label in (0, 1):
        one = there.filter(F.col("toxic") == label).orderBy(common.order_hash("doc_id"), "doc_id").limit(rows)
        picked = one if picked is None else picked.unionByName(one)
    # At most 2 * rows ids: that bound is what makes the broadcast safe.
    found = common.document_text(documents).join(F.broadcast(picked), "doc_id")
    kind = dict(found.dtypes)["doc_id"]
    sets = found.select("doc_id", "toxic", F.md5("text").alias("digest"), "text").mapInArrow(_feature_sets, f"doc_id {kind}, toxic int, digest string, features binary")
    return sets.groupBy("doc_id", "toxic").agg(F.min_by("features", "digest").alias("features"))


def _feature_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << BITS, bool)
    for batch in batches:
        sets = [packed(features(t.as_py(), seen)) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "toxic", "digest")), pa.array(sets, pa.binary())], ["doc_id", "toxic", "digest", "features"])


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """The model of the bounded sample, whose sets of features are gathered on the driver."""
    rows = sorted(((r.doc_id, unpacked(bytes(r.features)), r.toxic) for r in training_sample(documents, labels).toLocalIterator()), key=lambda r: r[0])
    return train([f for _, f, _ in rows], [y for _, _, y in rows])


def score(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The columns of ``documents`` with the column ``name``, which takes the place of one so called."""
    common.workers_can_import(documents.sparkSession)
    kept = documents.sparkSession.sparkContext.broadcast((model.weights, model.squares, model.intercept))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*kept.value)
        seen = np.zeros(1 << BITS, bool)
        for batch in batches:
            margins = np.fromiter((known.margin(features(t.as_py() or "", seen)) for t in batch.column("text")), np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(margins, -30, 30))), pa.float64())], [*batch.schema.names, name])

    columns = [c for c in documents.columns if c != name]
    kinds = dict(documents.dtypes)
    return documents.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(scored, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"`{name}` double"]))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside fold 0."""
    documents = common.table(spark, sf_dir, "documents")
    scored = score(documents.select("doc_id", "text"), fit(documents, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
