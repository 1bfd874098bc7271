"""Operator 3: benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are windows of consecutive item words. For each length of window there is
a matcher: its shift table gives, for a block of two adjacent words, how far the search
may jump because no test string can end sooner; a block that ends a test string selects
its suffix-hash bucket, and direct comparison of the words confirms the occurrence. In
clean text almost every block is unknown, so the search reads one block in nine.

The texts are never shuffled: each task searches the rows it reads. The test strings
are handed to the tasks in blocks of items of at most ``BLOCK_BYTES``, one pass over the
documents per block, so nothing that is broadcast grows with the benchmark.

Null or empty text and text without words have no hits; an empty benchmark gives no hits
at all. An item without words (or null) has no windows. Repeated items with one id count
once; a null item id marks hits, and is left out of the list of items. Rows are handled
one by one, so repeated documents, null ids and further columns need no care.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevine.llm import common

WINDOW = 10
#: Bytes of item texts whose test strings are sent to the tasks at once.
BLOCK_BYTES = 8 << 20

#: Lower-cases A-Z and turns the ASCII characters that are no letter or digit into blanks.
_KEEP = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    """The words as UTF-8: runs of a-z (A-Z lower-cased), 0-9 and all code points from x80 on."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The test strings of an item: a shorter item is one window, one without words none."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class WuManber:
    """Occurrences of test strings of one length, in words."""

    def __init__(self, strings: dict[tuple[bytes, ...], set[str]], length: int) -> None:
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[object, int] = {}
        self.bucket: dict[object, list[tuple[tuple[bytes, ...], set[str]]]] = defaultdict(list)
        for string, items in strings.items():
            for end in range(self.block, length + 1):
                key = self.key(string, end)
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.bucket[self.key(string, length)].append((string, items))

    def key(self, words, end: int):
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Start and items of each occurrence."""
        shift, bucket, length, far, n = self.shift, self.bucket, self.length, self.far, len(words)
        end = length
        single = self.block == 1
        while end <= n:
            key = words[end - 1] if single else (words[end - 2], words[end - 1])
            step = shift.get(key, far)
            if step:
                end += step
                continue
            for string, items in bucket[key]:
                if tuple(words[end - length : end]) == string:
                    yield end - length, items
            end += 1


def matchers(items: list[tuple[str | None, str | None]], size: int = WINDOW) -> list[WuManber]:
    """One matcher for each length of test string in these items."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(dict)
    for item_id, text in items:
        for window in windows(words_of(text), size):
            by_length[len(window)].setdefault(window, set()).update([] if item_id is None else [item_id])
    return [WuManber(strings, length) for length, strings in sorted(by_length.items())]


def scan(text: str | None, found_by: list[WuManber]) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, disjoint hit spans in words, and sorted items with occurrences."""
    words = words_of(text)
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for matcher in found_by:
        for start, found in matcher.search(words):
            spans.append((start, start + matcher.length))
            items |= found
    return len(words), merged(spans), sorted(items)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint spans in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str | None]]]:
    """The distinct items in blocks of bounded size, one at a time on the driver."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    # Twice as many blocks as needed on average, since hashing deals them unevenly.
    n = 1 if total <= block_bytes else 2 * total // block_bytes + 1
    for k in range(n):
        block = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in block.toLocalIterator()]


def _pass(documents: DataFrame, items: list[tuple[str | None, str | None]], size: int) -> DataFrame:
    """Words, hit spans and items of each row, for one block of items."""
    kept = documents.sparkSession.sparkContext.broadcast(items)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_by = matchers(kept.value, size)
        for batch in batches:
            got = [scan(t.as_py(), found_by) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in batch.schema.names if c != "text"],
                    pa.array([n for n, _, _ in got], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _ in got], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([i for _, _, i in got], pa.list_(pa.string())),
                ],
                [*[c for c in batch.schema.names if c != "text"], "n_words", "hits", "items"],
            )

    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name != "text")
    return documents.mapInArrow(searched, f"{ids}, n_words long, hits array<struct<start: long, end: long>>, items array<string>")


def find_leaks(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hits (disjoint word spans) and items (sorted) of every row of documents.

    With more than one block of items, the rows are told apart by an id within the
    passes and their spans are merged after the last.
    """
    common.workers_can_import(documents.sparkSession)
    rows = common.document_text(documents)
    blocks = item_blocks(benchmark, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return _pass(rows, first, size)
    # Copies of a row have one result, so the passes run over distinct rows.
    digest = F.sha2("text", 256).alias("digest")
    out = _pass(rows.select("doc_id", digest, "text"), first, size)
    out = out.unionByName(_pass(rows.select("doc_id", digest, "text"), second, size))
    for block in blocks:
        out = out.unionByName(_pass(rows.select("doc_id", digest, "text"), block, size))
    return _combined(out, rows.select("doc_id", digest))


def without_leaks(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``documents`` in which no window occurs, as they are; one filter per block of items."""
    common.workers_can_import(documents.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    for block in item_blocks(benchmark, block_bytes):
        documents = documents.mapInArrow(_clean_rows(documents.sparkSession.sparkContext.broadcast(block), size), schema)
    return documents


def _clean_rows(kept, size: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_by = matchers(kept.value, size)
        for batch in batches:
            hit = (any(next(m.search(words), None) is not None for m in found_by) for words in (words_of(t.as_py()) for t in batch.column("text")))
            yield batch.filter(pa.array([not h for h in hit], pa.bool_()))

    return clean


def _combined(passes: DataFrame, rows: DataFrame) -> DataFrame:
    """Results of all passes by row: spans merged by a fold, items united."""
    key = [F.col("doc_id"), F.col("digest")]
    one = passes.groupBy(*key).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set("hits"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    folded = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    one = one.select("doc_id", "digest", "n_words", folded.alias("hits"), "items")
    return rows.alias("r").join(one.alias("o"), F.col("r.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("r.digest") == F.col("o.digest"))).select("r.doc_id", "n_words", "hits", "items")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of ten benchmark words."""
    found = find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: The same rows in DuckDB SQL: windows of the items joined to windows of the documents.
OP3_SQL = r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
s AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM s),
o AS (
    SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
m AS (SELECT o.doc_id, o.i, o.k, s.item_id FROM o JOIN s USING (k, win)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
