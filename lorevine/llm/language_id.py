"""Operator 5: language identification by a linear-chain conditional random field.

Words are labelled with languages. The features of a word are its prefixes and suffixes,
its character n-grams and its presence in the lexicons of frequent words of each
language; transitions between labels are learned with them. Training sequences are
stretches of ``STRETCH`` words that together make up the whole labelled texts; every second one is
spliced with a stretch in another language, so that the chain learns how languages
switch. A text's words are decoded by
forward-backward, exactly and in whole, and the label with the most expected letters is
its language (of equal ones the first by code point); the score is that label's share.

The model is fitted on whole texts: at most ``SAMPLE_DOCS`` of each language, fewer where
that would be more than ``SAMPLE_ROWS`` in all, but one of each at least. Every lang value outside the held-out fold
is a label. Texts are scored
where they are read, without a shuffle; a task scores the distinct words of some hundred
texts at once and runs texts of like length through the chain together, within a bound of
cells. Beside these bounds, memory follows the longest single text.

Null text, or text without a letter, is ``und`` with score 0, as is every text where
there is nothing to learn from. Rows without lang are not learned from. Ids are only used
for the fold and the order of the sample; a null id hashes as the empty string. Several texts
of one id and lang are each a row of the sample, in the order of their hashes. Repeated
rows are learned from once and scored alike; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorevine.llm import common

#: Bounds of the training sample: whole texts of each language, and in all.
SAMPLE_DOCS, SAMPLE_ROWS = 80, 2000
#: Words of a training sequence.
STRETCH = 120
LEXICON = 400
BITS = 17
STEPS, RATE, PENALTY = 25, 0.3, 1e-4
#: Cells (words by labels) that go through the chain at once.
CELLS = 1 << 21

_P = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"[^\W\d_]+")


def word_features(words: list[str], lexicons: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature, number of its word) of all words: 2- and 3-grams of the word between
    marks (those with a mark are its short affixes), affixes of 3 characters, and lexicons."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    left = ends[word] - np.arange(len(codes))  # characters from here to the word's end
    found, of = [], []
    rolled = codes + np.uint64(1)
    for n in (2, 3, 4):
        rolled = rolled[:-1] * _P + codes[n - 1 :] + np.uint64(n)
        here = left[: len(rolled)] >= n
        if n == 4:  # only at either end
            here &= (np.concatenate(([True], word[1:] != word[:-1]))[: len(rolled)]) | (left[: len(rolled)] == n)
        found.append(rolled[here])
        of.append(word[: len(rolled)][here])
    listed = [(k, i) for i, w in enumerate(words) if w in lexicons for k in lexicons[w]]
    found.append(np.array([k + 1 for k, _ in listed], np.uint64))
    of.append(np.array([i for _, i in listed], np.int64))
    flat = np.concatenate(found)
    flat = (flat ^ (flat >> np.uint64(29))) * _P
    return (flat >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(of)


def words_of(text: str | None) -> list[str]:
    return [w for w in WORD.findall((text or "").lower()) if w.isalpha() or any(c.isalpha() for c in w)]


class Crf:
    """Labels, emission weights by hashed feature, transitions, start scores and lexicons."""

    def __init__(self, labels: list[str], emissions: np.ndarray, transitions: np.ndarray, lexicons: dict[str, list[int]]) -> None:
        self.labels, self.emissions, self.transitions, self.lexicons = labels, emissions, transitions, lexicons

    def emission(self, words: list[str]) -> np.ndarray:
        """Scores (word, label)."""
        ids, of = word_features(words, self.lexicons)
        return np.stack([np.bincount(of, weights=self.emissions[ids, k], minlength=len(words)) for k in range(len(self.labels))], 1).astype(np.float32)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Marginals (time, sequence, label) of sequences in descending length.

    ``scores`` are exponentiated emissions; messages are scaled to sum to 1. The expected
    number of each transition is added to ``pairs``, where it is given.
    """
    time, n, labels = scores.shape
    forward = np.empty_like(scores)
    scale = np.ones((time, n), scores.dtype)
    live = (lengths[None, :] > np.arange(time)[:, None]).sum(1)
    message = np.full((n, labels), 1.0 / labels, scores.dtype)
    for t in range(time):
        m = live[t]
        a = (message[:m] @ transitions if t else message[:m]) * scores[t, :m]
        scale[t, :m] = s = a.sum(1)
        message = forward[t, :m] = a / s[:, None]
    marginals = np.zeros_like(scores)
    back = np.ones((n, labels), scores.dtype)
    for t in range(time - 1, -1, -1):
        m = live[t]
        b = np.ones((m, labels), scores.dtype)
        if t + 1 < time and live[t + 1]:
            k = live[t + 1]
            ahead = back[:k] * scores[t + 1, :k] / scale[t + 1, :k, None]
            b[:k] = ahead @ transitions.T
            if pairs is not None:
                pairs += transitions * (forward[t, :k].T @ ahead)
        back = b
        marginals[t, :m] = forward[t, :m] * b
    return marginals


def train(rows: list[tuple[str, str]]) -> Crf | None:
    """A field from (text, lang) rows; None where there is nothing to learn from."""
    rows = [(words_of(t), lang) for t, lang in rows]
    rows = [(w, lang) for w, lang in rows if w]
    labels = sorted({lang for _, lang in rows})
    if not labels:
        return None
    number = {lang: k for k, lang in enumerate(labels)}
    counts = [Counter(w for words, lang in rows if lang == label for w in words) for label in labels]
    lexicons: dict[str, list[int]] = {}
    for k, c in enumerate(counts):
        for w, _ in c.most_common(LEXICON):
            lexicons.setdefault(w, []).append(k)
    stretches = [(words[i : i + STRETCH], lang) for words, lang in rows for i in range(0, len(words), STRETCH)]
    # The next stretch in another language, for each one: languages change seldom along the list.
    after: list[int | None] = [None] * len(stretches)
    for i in range(len(stretches) - 2, -1, -1):
        after[i] = i + 1 if stretches[i + 1][1] != stretches[i][1] else after[i + 1]
    sequences = []
    for i, (own, lang) in enumerate(stretches):
        # Every second one goes on in another language.
        if i % 2 and after[i] is not None:
            other, there = stretches[after[i]]
            tail = other[: max(1, len(own) // 2)]
            sequences.append((own + tail, [number[lang]] * len(own) + [number[there]] * len(tail)))
        else:
            sequences.append((own, [number[lang]] * len(own)))
    sequences = sorted((s for s in sequences if s[0]), key=lambda s: -len(s[0]))
    lengths = np.array([len(w) for w, _ in sequences])
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for words, _ in sequences for w in words))}
    flat, of_word = word_features(list(vocabulary), lexicons)
    time, n, k = int(lengths[0]), len(sequences), len(labels)
    at = np.zeros((time, n), np.int64)
    gold = np.zeros((time, n, k))
    mask = np.arange(time)[:, None] < lengths[None, :]
    for j, (words, ys) in enumerate(sequences):
        at[: len(words), j] = [vocabulary[w] for w in words]
        gold[np.arange(len(words)), j, ys] = 1
    weights, trans = np.zeros((1 << BITS, k)), np.zeros((k, k))
    used = np.unique(flat)
    of = np.searchsorted(used, flat)
    w, gw, gt = np.zeros((len(used), k)), np.full((len(used), k), 1e-8), np.full((k, k), 1e-8)
    pairs = np.einsum("tni,tnj->ij", gold[:-1], gold[1:])
    for _ in range(STEPS):
        by_word = np.stack([np.bincount(of_word, weights=w[of, c], minlength=len(vocabulary)) for c in range(k)], 1)
        scores = by_word[at]
        scores = np.exp(scores - scores.max(2, keepdims=True))
        step = np.exp(trans - trans.max())
        expected = np.zeros((k, k))
        marginals = forward_backward(scores, lengths, step, expected)
        error = (gold - marginals) * mask[:, :, None]
        per_word = np.stack([np.bincount(at[mask], weights=error[:, :, c][mask], minlength=len(vocabulary)) for c in range(k)], 1)
        grad = np.stack([np.bincount(of, weights=per_word[of_word, c], minlength=len(used)) for c in range(k)], 1) / n - PENALTY * w
        grad_t = (pairs - expected) / n - PENALTY * trans
        gw += grad**2
        gt += grad_t**2
        w += RATE * grad / np.sqrt(gw)
        trans += RATE * grad_t / np.sqrt(gt)
    weights[used] = w
    return Crf(labels, weights.astype(np.float32), np.exp(trans - trans.max()).astype(np.float32), lexicons)


def label_words(model: Crf, words: list[str]) -> list[str]:
    """The most probable label of each word of one text."""
    if not words:
        return []
    e = model.emission(words)
    marginals = forward_backward(np.exp(e - e.max(1, keepdims=True))[:, None, :], np.array([len(words)]), model.transitions)
    return [model.labels[k] for k in marginals[:, 0].argmax(1)]


def expected_shares(model: Crf, documents: list[list[str]]) -> list[np.ndarray]:
    """Share of the expected letters of each label, for each document that has words."""
    number = {w: i for i, w in enumerate(dict.fromkeys(w for words in documents for w in words))}
    out: list[np.ndarray] = [np.zeros(len(model.labels))] * len(documents)
    if not number:
        return out
    e = model.emission(list(number))
    e = np.exp(np.maximum(e - e.max(1, keepdims=True), -30))
    sizes = np.fromiter(map(len, number), np.float32, len(number))
    order = sorted((i for i in range(len(documents)) if documents[i]), key=lambda i: -len(documents[i]))
    start = 0
    while start < len(order):
        time = len(documents[order[start]])
        group = order[start : start + max(1, CELLS // (time * len(model.labels)))]
        # Padding costs time: a group ends where texts get much shorter than its first.
        group = group[: max(16, sum(2 * len(documents[i]) > time for i in group))]
        start += len(group)
        lengths = np.array([len(documents[i]) for i in group])
        scores = np.ones((time, len(group), len(model.labels)), np.float32)
        letters = np.zeros((time, len(group)), np.float32)
        for j, i in enumerate(group):
            at = np.fromiter(map(number.__getitem__, documents[i]), np.int64, lengths[j])
            scores[: lengths[j], j] = e[at]
            letters[: lengths[j], j] = sizes[at]
        marginals = forward_backward(scores, lengths, model.transitions)
        shares = np.einsum("tn,tnk->nk", letters, marginals, dtype=np.float64)
        for j, i in enumerate(group):
            out[i] = shares[j] / shares[j].sum()
    return out


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def training_rows(documents: DataFrame) -> list[tuple[str, str]]:
    """The bounded sample: (whole text, lang), in a fixed order."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & ~held_out() & F.col("doc_id").isNotNull()).withColumn("digest", F.xxhash64("text"))
    n_langs = max(1, rows.select("lang").distinct().count())
    most = max(1, min(SAMPLE_DOCS, SAMPLE_ROWS // n_langs))
    known = rows.select("doc_id", "lang", "digest", common.order_hash("doc_id", "lang").alias("key"))
    picked = known.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("key", "digest"))).filter(F.col("at") <= most)
    # At most SAMPLE_ROWS ids, or one for each label: that bound is what makes the broadcast safe.
    picked = picked.select("doc_id", "lang", "digest", "key").distinct()
    got = rows.join(F.broadcast(picked), ["doc_id", "lang", "digest"]).select("key", "digest", "lang", "text").dropDuplicates(["key", "digest"]).collect()
    return [(r.text, r.lang) for r in sorted(got, key=lambda r: (r.key, r.digest))]


def identify(texts: DataFrame, model: Crf | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    spark = texts.sparkSession
    common.workers_can_import(spark)
    kept = spark.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field_ = kept.value
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                documents = [words_of(t) if field_ else [] for t in batch.column("text").to_pylist()]
                shares = expected_shares(field_, documents) if field_ else [np.zeros(0)] * len(documents)
                best = [(field_.labels[int(s.argmax())], float(s.max())) if d else ("und", 0.0) for d, s in zip(documents, shares, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([b[0] for b in best], pa.string()), pa.array([min(1.0, b[1]) for b in best], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = common.document_text(texts)
    return rows.mapInArrow(predicted, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside the fold that is held out."""
    documents = common.table(spark, sf_dir, "documents")
    found = identify(documents.select("doc_id", "text"), train(training_rows(documents)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
