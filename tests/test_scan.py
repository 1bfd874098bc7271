"""BM25 by scans of the texts, and what queries over whole texts shuffle."""

import os

import pytest
from pyspark.sql import functions as F

from lorevine.operators import evaluation, lexical, scan
from lorevine.plans import catalog

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(repr, df.select("item_id", "doc_id", "score", "rank").collect()))


@pytest.mark.parametrize("kind", ["long", "string", "struct"])
def test_scans_equal_postings(spark, monkeypatch, kind):
    """Odd rows: an id twice, no id, no text, equal texts, capitals and hyphens; blocks of a few rows."""
    monkeypatch.setattr(scan, "ROWS", 3)
    monkeypatch.setattr(scan, "BLOCK", 40)
    texts = ["Le crédit-bail ÉTÉ, le - bail", None, "", "- - --", "été le fonds", "l'été : ΣΑΣ Fonds İ", "le", "÷ le×bail"] + ["bail fonds été"] * 9 + [f"le mot{i} bail été fonds mot{i % 4}" for i in range(40)]
    ids = [i // 2 if i < 8 else None if i == 20 else 100 - i for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    if kind == "string":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    if kind == "struct":
        docs = docs.withColumn("doc_id", F.struct(F.col("doc_id").alias("rec"), F.length("text").alias("i")))
    asked = spark.createDataFrame([("a", "le bail été le"), ("b", "crédit-bail mot3 fonds"), ("c", "rien"), ("d", None), ("e", "fonds mot1 - l")], "item_id string, text string")
    terms, post = lexical.query_terms(asked), lexical.postings(docs)
    for k in (1, 4, 1000):
        assert rows(scan.top(terms, docs, k)) == rows(lexical.top(lexical.bm25(terms, post, docs), k))
    assert scan.top(terms.filter("false"), docs, 3).count() == 0 and scan.top(terms, docs.filter("false"), 3).count() == 0


def test_containing_compares_where_texts_are(spark):
    docs = spark.createDataFrame([(1, "un deux trois quatre cinq six"), (2, "xun deux trois quatre cinqx"), (3, "deux trois quatre"), (4, None), (5, "un deux trois quatre cinq un deux trois quatre cinq")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "un deux trois quatre cinq"), (2, "trois quatre"), (3, ""), (4, None)], "item_id long, text string")
    found = evaluation.containing(asked, docs)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 2), (1, 5), (2, 1), (2, 2), (2, 3), (2, 5)]
    assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()


def shuffled(spark, run) -> int:
    """Bytes that a run's stages wrote for others."""
    context = spark.sparkContext
    store, none = context._jsc.sc().statusStore(), context._gateway.new_array(context._jvm.double, 0)

    def stages():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        every = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in map(every.apply, range(every.size()))}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["adoption_verdict", "chunk_max_per_record"])
def test_what_is_shuffled(spark, name):
    """No postings are shuffled, nor texts for each use: less than 6 times the input, of which two times are dealing one file out."""
    size = sum(os.path.getsize(f"{SF}/{t}.parquet") for t in ("documents", "benchmark", "embeddings"))
    spark.catalog.clearCache()
    n = shuffled(spark, lambda: catalog.QUERIES[name](spark, SF).collect())
    print(name, n / size)
    assert n < 6 * size
