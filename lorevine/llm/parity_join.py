"""Operator 2: Jaccard join of word shingles by parity sketches.

Every shingle of a document is hashed and XORed into a sketch of blocks, one per residue
of the hash. Two sets with Jaccard likeness t or more differ in at most
d = (|A| + |B|)(1 - t)/(1 + t) shingles, and each of these changes one block: the number
of blocks in which sketches differ bounds the symmetric difference from below. So alike
sets agree in all blocks but d. A document therefore publishes its d + 1 fullest blocks
(in an order that both sides share), and two alike documents meet in one of them. If a
document has no more than d filled blocks, it also publishes a mark under which all such
documents meet. Sketches are made per size band; a pair that lies across the border of
two bands meets in a family of its own.

Documents that meet are compared by the Hamming distance of bit sketches, in which each
shingle toggles one bit, and only pairs within the bound are verified on whole texts.
Equal sets are one class from the start. In a bucket of up to ``SMALL`` documents all
pairs are candidates. In a larger one the document with the least id is compared with all others
(a task that meets a bucket in more documents sends its task just enough to tell that it
is large and deals the rest over all tasks); what then still belongs to different components is compared by bit sketches, in blocks of
rows within size windows, so no pair is left out and none is emitted that the distance
rules out.

Null or empty text, or text without words, has no shingles, is linked with nothing and is
its own component. Fewer words than a shingle has make one shingle. Inside, rows are known by
a hash of id and text (``row_key``), so texts that share a doc_id are compared each for itself and only
rows with the same id and text are one. A null doc_id has no component and is linked with
nothing, unless ``grouped`` is asked to link it. Ids are read as long: text that is no number
counts as null. An empty table gives an empty result;
further columns are ignored. Shingles, and rows, are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevine.llm import common, graph

WORDS = 5
#: The likeness as a whole percentage, so that the bounds are exact.
PERCENT = 80
#: Buckets up to this size give all pairs at once; rows of a block of a larger one.
SMALL, BLOCK_ROWS = 8, 4096
#: Bits of the sketches that are compared, and of the table that tells candidates from the rest.
BITS, TABLE_BITS = 2048, 1 << 24
#: Words whose hashes a task keeps, and set hashes by which it knows copies.
WORDS_KEPT, SETS_KEPT = 200_000, 100_000
#: Parts into which the rows of a bucket are dealt where they meet what holds for the whole bucket.
SALTS = 16
#: Hashes of shingles that a task of the verification keeps.
HASHES_KEPT = 1 << 21
#: Keys of large buckets that a task remembers; forgetting them only sends more rows to the key's task.
LARGE_KEPT = 100_000

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def row_key() -> Column:
    """What the join knows a row of documents by: a hash of its id and text, null text read as empty."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    # bytes.lower() and bytes.split() know just A-Z, and x20 and x09 to x0D.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    rolled = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        rolled = rolled * _P + h[i : len(h) - width + 1 + i]
    return np.unique(mixed(rolled))


def distance_bound(a: int, b: int) -> int:
    """The largest symmetric difference of sets of these sizes that are alike."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def families(n: int) -> list[tuple[int, int, int]]:
    """(family, number of blocks, greatest distance) of a set of ``n`` shingles."""
    band = n.bit_length() - 1
    low, high = 1 << band, (1 << band + 1) - 1
    most = floor(n * 100 / PERCENT)
    out = [(2 * band, _blocks(high, distance_bound(high, high)), distance_bound(n, min(high, most)))]
    if most > high:  # the border above
        out.append((2 * band + 1, _blocks(high + 1, distance_bound(high, floor(high * 100 / PERCENT))), distance_bound(n, most)))
    if low > 1 and (low - 1) * 100 >= PERCENT * n:  # the border below
        out.append((2 * band - 1, _blocks(low, distance_bound(low - 1, floor((low - 1) * 100 / PERCENT))), distance_bound(low - 1, n)))
    return out


def _blocks(size: int, distance: int) -> int:
    """About three shingles a block, and enough blocks to have more filled ones than ``distance``."""
    return 1 if distance == 0 else max(8, size * 5 // 16 + 1, distance + 2)


def published(h: np.ndarray) -> np.ndarray:
    """Keys of the blocks that a set publishes, over its families."""
    keys = []
    for family, blocks, distance in families(len(h)):
        at = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # ascending, since h is sorted
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        counts = np.diff(np.append(starts, len(h))).astype(np.uint64)
        salt = mixed(np.array([family + 1], np.uint64) * _P)[0]
        key = mixed(np.bitwise_xor.reduceat(h, starts) + at[starts] * _M1 + counts * _M2 + salt)
        keys.append(key[np.lexsort((key, -counts.astype(np.int64)))[: distance + 1]])
        if len(starts) <= distance:
            keys.append(mixed(np.array([salt], np.uint64) + _P))
    return np.concatenate(keys)


def bit_sketch(h: np.ndarray) -> bytes:
    """Each shingle toggles one of ``BITS`` bits."""
    return np.packbits((np.bincount((h & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 times the intersection is at least ``PERCENT`` times the union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(len(a)) and 100 * both >= PERCENT * (len(a) + len(b) - both)


SETS = "id long, doc_id long, n long, f1 long, f2 long, sketch binary, keys array<long>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, digests, bit sketch and published keys of each row's set; copies that a task knows publish nothing."""
    hashes, seen = _WordHashes(), set()
    for batch in batches:
        rows, keys = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            h = shingles(text.as_py(), hashes)
            first = int(np.bitwise_xor.reduce(mixed(h))) if len(h) else 0
            second = int(np.add.reduce(mixed(h ^ _M2))) if len(h) else 0
            known = (len(h), first, second)
            rows.append((*known, bit_sketch(h)))
            if doc_id is None or not len(h) or known in seen:  # a copy: the class is known by its first row
                keys.append(np.empty(0, np.uint64))
                continue
            if len(seen) >= SETS_KEPT:
                seen.clear()
            seen.add(known)
            keys.append(published(h))
        columns = [np.array([r[i] for r in rows], np.uint64).view(np.int64) for i in range(3)]
        ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *keys]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("doc_id"), *map(pa.array, columns), pa.array([r[3] for r in rows], pa.binary()), lists], [c.split()[0] for c in SETS.split(", ")])


class _Rows:
    """The rows (key, doc_id, spread) of a task, of which at most ``SMALL`` + 1 documents a flush aren't spread.

    So many tell the key's task that the bucket is large. All others of that key may go to
    any task.
    """

    def __init__(self) -> None:
        self.large = np.empty(0, np.uint64)  # keys, ascending

    def batch(self, keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        again = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])))
        keys, ids = keys[again], ids[again]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts = np.diff(np.append(starts, len(keys)))
        sent = np.minimum(counts, SMALL + 1)
        if len(self.large):
            at = np.minimum(np.searchsorted(self.large, keys[starts]), len(self.large) - 1)
            sent[self.large[at] == keys[starts]] = 0
        spread = np.arange(len(keys)) - np.repeat(starts, counts) >= np.repeat(sent, counts)
        new = keys[starts][sent > SMALL]
        if len(self.large) + len(new) > LARGE_KEPT:
            self.large = self.large[:0]
        self.large = np.sort(np.append(self.large, new))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids), pa.array(spread)], ["key", "doc_id", "spread"])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, keys) -> rows (key, doc_id, spread)."""
    rows = _Rows()
    for batch in batches:
        lists = batch.column("keys")
        lengths = np.diff(lists.offsets.to_numpy())
        ids, keys = np.repeat(batch.column("doc_id").fill_null(0).to_numpy(), lengths), lists.flatten().to_numpy().view(np.uint64)
        if len(keys):
            yield rows.batch(keys, ids)


def _two(x: np.ndarray, y: np.ndarray, a: str, b: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], [a, b])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of (key, doc_id, spread) -> pairs (null, a, b), and rows (key, doc_id, null) of large buckets."""
    read = []
    for b in batches:
        some = b.filter(b.column("spread"))
        if some.num_rows:  # known to be of large buckets
            yield pa.RecordBatch.from_arrays([some.column("key"), some.column("doc_id"), pa.nulls(some.num_rows, pa.int64())], ["key", "a", "b"])
        rest = b.filter(pc.invert(b.column("spread")))
        if rest.num_rows:
            read.append((rest.column("key").to_numpy(), rest.column("doc_id").to_numpy()))
    if not read:
        return
    keys, ids = np.concatenate([k for k, _ in read]), np.concatenate([i for _, i in read])
    del read
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    again = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])))
    keys, ids = keys[again], ids[again]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(starts, len(keys)))
    firsts, seconds = [], []
    for n in range(2, SMALL + 1):
        at = starts[counts == n]
        for i in range(n):
            for j in range(i + 1, n):
                firsts.append(ids[at + i])
                seconds.append(ids[at + j])
    large = np.repeat(counts, counts) > SMALL
    firsts.append(ids[:0])
    seconds.append(ids[:0])
    pairs = np.unique(np.stack([np.concatenate(firsts), np.concatenate(seconds)], 1), axis=0)
    for s in range(0, len(pairs), 1 << 16):
        p = pairs[s : s + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(p), pa.int64()), pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["key", "a", "b"])
    hot_keys, hot_ids = keys[large], ids[large]
    for s in range(0, len(hot_keys), 1 << 16):
        k = hot_keys[s : s + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(hot_ids[s : s + (1 << 16)]), pa.nulls(len(k), pa.int64())], ["key", "a", "b"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets, sorted by (key, i, j, n), with sketches -> pairs of different components within the bound.

    i and j number the blocks of rows that a task compares; a row of block i meets the
    rows of block j, and if i equals j those before it.
    """
    window: list[tuple] = []
    sketches = np.empty((0, BITS // 64), np.uint64)
    at = None
    for batch in batches:
        a, b = [], []
        raw = batch.column("sketch")
        for r, (key, i, j, block, doc, n, root) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("key", "i", "j", "block", "node", "n", "root")], strict=True)):
            if (key, i, j) != at:
                at, window = (key, i, j), []
                sketches = np.empty((64, BITS // 64), np.uint64)
            own = np.frombuffer(raw[r].as_py(), np.uint64)
            low = 0
            while low < len(window) and window[low][1] * 100 < PERCENT * n:
                low += 1
            if low:
                sketches = np.concatenate([sketches[low:], np.empty((low, BITS // 64), np.uint64)])
                window = window[low:]
            if window:
                far = np.bitwise_count(sketches[: len(window)] ^ own).sum(1)
                bound = np.fromiter((distance_bound(w[1], n) for w in window), np.int64, len(window))
                for k in np.flatnonzero(far <= bound):
                    other = window[k]
                    if other[2] != root and (i == j or other[3] != block):
                        a.append(min(doc, other[0]))
                        b.append(max(doc, other[0]))
            if len(window) == len(sketches):
                sketches = np.concatenate([sketches, np.empty_like(sketches)])
            sketches[len(window)] = own
            window.append((doc, n, root, block))
        yield _two(np.array(a, np.int64), np.array(b, np.int64), "a", "b")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, sets, held = _WordHashes(), {}, 0

    def of(row: int, text: pa.StringScalar) -> np.ndarray:
        nonlocal held
        if row not in sets:
            if held > HASHES_KEPT:
                sets.clear()
                held = 0
            sets[row] = shingles(text.as_py(), hashes)
            held += len(sets[row]) + 16
        return sets[row]

    for batch in batches:
        ids = (batch.column(c).to_pylist() for c in ("a", "b"))
        keep = [linked(of(a, one), of(b, two)) for a, b, one, two in zip(*ids, batch.column("text_a"), batch.column("text_b"), strict=True)]
        kept = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])


def _links(pairs: DataFrame, texts: DataFrame, sets: DataFrame, rows: int, checked: bool = False) -> DataFrame:
    """The pairs that are links, of ``rows`` rows in all. ``checked``: their sketches were compared already."""
    spark = pairs.sparkSession
    if not checked:
        own = sets.select(F.col("node"), "n", "sketch")
        near = common.few(pairs.join(own.toDF("a", "na", "sa"), "a"), rows).join(own.toDF("b", "nb", "sb"), "b")
        near = common.few(near.filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)), rows)
        pairs = near.mapInArrow(_within, "a long, b long")
    pairs = common.cut(pairs.select("a", "b"))
    table = candidate_table(pairs)
    kept = spark.sparkContext.broadcast(table)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = kept.value
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-1).to_numpy()
            at = mixed(ids.view(np.uint64)) % np.uint64(TABLE_BITS)
            known = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            yield batch.filter(pa.array(known.astype(bool)))

    # Rows that repeat with id and text have one key.
    some = texts.select("doc_id", "text").mapInArrow(candidates, "doc_id long, text string").dropDuplicates(["doc_id"])
    some = common.few(some, rows)
    # a may be one document for a whole bucket: it is met while rows are just two ids.
    both = common.few(pairs.join(some.toDF("a", "text_a"), "a"), rows).join(some.toDF("b", "text_b"), "b").select("a", "text_a", "b", "text_b")
    # Pairs are distinct already.
    return common.cut(common.few(both, rows).mapInArrow(_verified, "a long, b long"))


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with sketches -> those whose Hamming distance is within the bound of their sizes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("sa", "sb"))
        far = np.bitwise_count(one ^ two).sum(1)
        bound = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) * (100 - PERCENT) // (100 + PERCENT)
        kept = pa.array(far <= bound)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])


def candidate_table(pairs: DataFrame) -> np.ndarray:
    """A bit table of the ids in pairs. Its size is fixed; where it is full it only spares less work."""
    ids = pairs.select(F.col("a").alias("x")).unionByName(pairs.select(F.col("b").alias("x")))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(TABLE_BITS >> 6, np.uint64)
        for batch in batches:
            at = mixed(batch.column("x").to_numpy().view(np.uint64)) % np.uint64(TABLE_BITS)
            np.bitwise_or.at(table, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        words = np.flatnonzero(table)
        yield _two(words, table[words].view(np.int64), "word", "bits")

    rows = ids.mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = np.zeros(TABLE_BITS >> 6, np.uint64)
    for word, value in rows.toLocalIterator():  # at most TABLE_BITS / 64 rows
        table[word] = np.uint64(value & (1 << 64) - 1)
    return table


def grouped(documents: DataFrame, null_ids: bool = False) -> DataFrame:
    """Every row's id, row key (as doc_id), number of shingles n, node and root: rows with the same shingles
    have one node, and alike nodes one root. node is null for rows that are linked with nothing, root for nodes
    without a link. ``null_ids``: whether rows without id are linked as well."""
    spark = documents.sparkSession
    common.workers_can_import(spark)
    linkable = F.lit(True) if null_ids else F.col("doc_id").cast("long").isNotNull()
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.when(linkable, row_key()).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # One pass over the texts; the table with the keys goes as soon as the keys have met.
    folder = f"{common.shared_folder(spark)}/sets-{uuid4().hex}"
    made = common.stored(texts.mapInArrow(_sets, SETS), folder)
    sets = common.cut(made.drop("keys"))
    rows = sets.count()
    few = lambda df: common.few(df, rows)
    filled = sets.filter("n > 0 and doc_id is not null")
    # Rows in the order of their ids: early documents are apt to be those that others were made from.
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("doc_id").alias("node"))
    classes = filled.groupBy("f1", "f2", "n").agg(F.min(place).alias("place")).select("f1", "f2", "n", "place", F.col("place.node").alias("node"))
    node_of = common.cut(few(few(filled.select("doc_id", "f1", "f2", "n").join(classes, ["f1", "f2", "n"]).select("doc_id", "node", "n", "place")).distinct()))
    nodes = node_of.filter("doc_id = node").select("node").join(filled.select(F.col("doc_id").alias("node"), "n", "sketch"), "node").dropDuplicates(["node"])
    nodes = common.cut(few(nodes))

    n = common.parts(spark)
    keys = made.filter("size(keys) > 0").select("doc_id", "keys").mapInArrow(_dealt, "key long, doc_id long, spread boolean")
    spread = F.when(F.col("spread"), F.xxhash64("doc_id")).otherwise(F.lit(0).cast("long"))
    # No number of partitions: small ones merge, so that the checkpoint writes few files.
    met = common.cut(keys.repartition("key", spread).mapInArrow(_met, "key long, a long, b long"))
    common.remove(spark, folder)
    by_id = node_of.select("doc_id", "node")
    large = few(met.filter("key is not null").select("key", "a").join(node_of.select(F.col("doc_id").alias("a"), "node", "place"), "a").select("key", "node", "place"))
    large = common.cut(few(large.distinct()))
    star = _of_bucket(large, few(large.groupBy("key").agg(F.min("place")["node"].alias("first")))).select(F.col("first").alias("na"), F.col("node").alias("nb"))
    pairs = few(met.filter("key is null").select("a", "b").distinct())
    pairs = few(few(pairs.join(by_id.toDF("a", "na"), "a")).join(by_id.toDF("b", "nb"), "b").select("na", "nb")).unionByName(few(star))
    pairs = few(pairs.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).filter("a <> b").distinct())
    links = _links(pairs, texts, nodes, rows)
    roots = graph.components(links)

    hot = large.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    hot = common.cut(few(hot))
    mixed_keys = hot.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo <> hi")
    open_rows = common.cut(few(_of_bucket(hot, few(mixed_keys.select("key", "rows"))).select("key", "node", "root", "rows")))
    if not open_rows.isEmpty():
        more = _links(few(_open_pairs(open_rows, nodes, n)), texts, nodes, rows, checked=True)
        if not more.isEmpty():
            roots = graph.components(links.unionByName(more))
    of_rows = few(sets.filter("doc_id is not null").select("id", "doc_id", "n").join(few(by_id), "doc_id", "left")).join(roots, "node", "left").select("id", "doc_id", "n", "node", "root")
    of_rows = few(of_rows)
    alone = F.lit(None).cast("long")
    return of_rows.unionByName(sets.filter("doc_id is null").select("id", "doc_id", "n", alone.alias("node"), alone.alias("root")))


def _of_bucket(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` (key, node, ...) with what ``buckets`` (key, ...) says, each bucket's rows dealt over ``SALTS`` places."""
    salted = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id of the component) of every row."""
    rows = common.cut(grouped(documents))
    number = rows.count()
    few = lambda df: common.few(df, number)
    # Each node's least id first, so that few rows are left of a component that much is linked in.
    by_node = few(rows.filter("node is not null").groupBy("node", "root").agg(F.min("id").alias("least")))
    linked_nodes = common.cut(by_node.filter("root is not null"))
    least = few(linked_nodes.groupBy("root").agg(F.min("least").alias("least")))
    named = few(linked_nodes.select("node", "root").join(least, "root").select("node", "least")).unionByName(by_node.filter("root is null").select("node", "least"))
    out = few(rows.join(named, "node", "left"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def _open_pairs(rows: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Pairs of different components in buckets, by bit sketches, in blocks of rows.

    A bucket of more than ``BLOCK_ROWS`` rows is dealt into blocks, and each pair of
    blocks is a group of its own that any task can take.
    """
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root")
    dealt = dealt.join(nodes, "node").select("key", "i", "j", "block", "node", "root", "n", "sketch")
    near = dealt.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "node").mapInArrow(_near, "a long, b long")
    return near.distinct()


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles are at least 0.8 alike."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))


#: The same rows in DuckDB SQL: all shingles met, then all documents reachable. It needs unique ids.
OP2_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS shared FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * shared >= {PERCENT} * (n - shared)),
r AS (SELECT doc_id, doc_id AS reached FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""
