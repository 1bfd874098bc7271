"""BM25 in scans of the texts, for batches of questions over rows of any number.

The best rows of each question need only the terms that questions have, and only the best rows
of each task. So no table of postings is made: texts are dealt by id once for each of two scans, the
first of which counts and the second of which scores. What leaves a task is a row for each term, or
``k`` rows for each question. The questions' terms, with their frequencies, are sent to every task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorevine.functions import text as T
from lorevine.operators import lexical

K1, B, TOKEN_BREAK = lexical.K1, lexical.B, T.TOKEN_BREAK
#: Products of a posting and a question, or scores, that a task holds at a time.
BLOCK = 1_000_000
#: Texts that a task holds as tokens at a time.
ROWS = 2_000

# Workers get these functions themselves, so that they needn't find this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS))


def occurring(texts: pa.StringArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of tokens of each lower-cased text, and row, term and tf of the terms of ``vocabulary`` in it, by row.

    Tokens are those of ``text.tokens``, cut by Arrow.
    """
    pieces = pc.split_pattern_regex(texts, TOKEN_BREAK)
    every = pieces.flatten()
    row = np.repeat(np.arange(len(pieces)), np.diff(pieces.offsets.to_numpy()))
    lengths = np.bincount(row[~pc.is_in(every, value_set=pa.array(["", "-"])).to_numpy(zero_copy_only=False)], minlength=len(pieces))
    term = pc.fill_null(pc.index_in(every, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    both, tf = np.unique(row[term >= 0] * max(len(vocabulary), 1) + term[term >= 0], return_counts=True)
    return lengths, *np.divmod(both, max(len(vocabulary), 1)), tf


def counter(vocabulary: pa.Array):
    """Batches (text, rows) -> term and the rows that have it; for the term null, all rows and all tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, tokens = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in sliced(batches):
            lengths, _, term, _ = occurring(batch["text"], vocabulary)
            df += np.bincount(term, minlength=len(vocabulary))
            rows, tokens = rows + (pc.sum(batch["rows"]).as_py() or 0), tokens + int(lengths.sum())
        (seen,) = df.nonzero()
        terms = pa.concat_arrays([vocabulary.take(pa.array(seen)), pa.nulls(1, vocabulary.type)])
        yield pa.RecordBatch.from_arrays([terms, pa.array([*df[seen], rows]), pa.array([*[0] * len(seen), tokens])], ["term", "df", "n"])

    return count


def scorer(vocabulary: pa.Array, first: np.ndarray, item: np.ndarray, weight: np.ndarray, items: pa.Array, avgdl: float, k: int):
    """Batches (doc_id, text) by doc_id -> the best ``k`` rows (item_id, doc_id, score) of each question.

    ``item`` and ``weight`` from ``first[t]`` to ``first[t + 1]`` are the questions that have term t. Of equal scores the earlier row stays.
    """
    n = len(items)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, least = None, np.full(n, -1.0)  # (ids, item, score) by item and descending score; what a score must exceed
        for batch in sliced(batches):
            lengths, row, term, tf = occurring(batch["text"], vocabulary)
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / avgdl))
            times = first[term + 1] - first[term]
            # Rows are cut into blocks by how much there is to add up.
            block = np.cumsum(n + np.bincount(row, times, minlength=len(lengths)).astype(np.int64)) // BLOCK
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            for lo, hi in zip(starts, [*starts[1:], len(lengths)]):
                a, b = np.searchsorted(row, [lo, hi])
                of, till = times[a:b], np.cumsum(times[a:b])
                at = np.arange(of.sum()) + np.repeat(first[term[a:b]] - till + of, of)
                cell = np.repeat((row[a:b] - lo) * n, of) + item[at]
                total = np.bincount(cell, np.repeat(part[a:b], of) * weight[at], minlength=(hi - lo) * n)
                (hit,) = total.nonzero()
                score = np.floor(total[hit] * 1e6 + 0.5) / 1e6
                better = score > least[hit % n]
                hit, score = hit[better], score[better]
                if not len(hit):
                    continue
                ids, whose = batch["doc_id"].take(pa.array(lo + hit // n)), hit % n
                if kept:
                    ids, whose, score = pa.concat_arrays([kept[0], ids]), np.concatenate([kept[1], whose]), np.concatenate([kept[2], score])
                order = np.lexsort((-score, whose))
                begin = np.searchsorted(whose[order], np.arange(n))
                rank = np.arange(len(order)) - begin[whose[order]]
                order, last = order[rank < k], order[rank == k - 1]
                kept = ids.take(pa.array(order)), whose[order], score[order]
                least[whose[last]] = score[last]
        if kept:
            yield pa.RecordBatch.from_arrays([items.take(pa.array(kept[1])), kept[0], pa.array(kept[2])], ["item_id", "doc_id", "score"])

    return best


def top(terms: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``lexical.top`` of ``lexical.bm25`` over ``lexical.postings``: item_id, doc_id, score, rank of each question's best ``k`` rows.

    ``terms`` is item_id, term, qtf; ``docs`` is doc_id, text, whose rows of one id count as one text. The first
    scan runs when this is called.
    """
    asked = terms.select("item_id", "term", "qtf").toArrow().combine_chunks()
    vocabulary = pc.unique(asked["term"])
    texts = docs.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"), F.count(F.lit(1)).alias("rows"))
    text = F.lower("text").alias("text")
    counts = texts.select(text, "rows").mapInArrow(counter(vocabulary), "term string, df long, n long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).toArrow()
    term = pc.index_in(counts["term"], value_set=vocabulary).to_numpy()
    all_rows = np.isnan(term)
    n_docs, n_tokens = (int(counts[c].to_numpy()[all_rows].sum()) for c in ("df", "n"))
    df = np.zeros(len(vocabulary))
    df[term[~all_rows].astype(np.int64)] = counts["df"].to_numpy()[~all_rows]
    # By term, the questions that have it.
    coded = asked["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    of = pc.index_in(asked["term"], value_set=vocabulary).to_numpy().astype(np.int64)
    order = np.argsort(of, kind="stable")
    first = np.searchsorted(of[order], np.arange(len(vocabulary) + 1))
    raw = np.log((n_docs - df + 0.5) / (df + 0.5))
    weight = asked["qtf"].to_numpy() * np.where(raw <= 0, lexical.LEAST_IDF, raw)[of]
    score = scorer(vocabulary, first, coded.indices.to_numpy().astype(np.int64)[order], weight[order], coded.dictionary, n_tokens / max(n_docs, 1), k)
    kind = {f.name: f.dataType.simpleString() for f in [terms.schema["item_id"], docs.schema["doc_id"]]}
    placed = texts.filter("doc_id is not null").sortWithinPartitions("doc_id").select("doc_id", text)
    return lexical.top(placed.mapInArrow(score, f"item_id {kind['item_id']}, doc_id {kind['doc_id']}, score double"), k)
