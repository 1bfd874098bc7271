"""The engine's operators: goldens, SQL agreement on the smallest tables, independent oracles."""

import os
import random
import sqlite3

import literals
import pytest
from pyspark.sql import functions as F

from lorevine.functions import text as T
from lorevine.functions.references import extract_references
from lorevine.functions.stemmer import normalized
from lorevine.operators import assembly, citations, evaluation, integrity, lexical, models, ranking
from lorevine.plans import catalog, index
from lorevine.sources import files
from lorevine.sources import lines as line_source
from lorevine.streaming.refresh import postings_stream

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    import duckdb

    df = catalog.QUERIES[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    cursor = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    same = lambda v: repr(round(v, 6) if isinstance(v, float) else v)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(same(r[c]) for c in columns) for r in rows) == sorted(tuple(map(same, r)) for r in cursor.fetchall())


def test_stemmer_goldens():
    assert normalized("généré") == normalized("génération") == normalized("générer") == "gener"
    assert set(normalized("les amortissements des immobilisations").split()) & set(normalized("l'amortissement de l'immobilisation").split()) == {"amort", "de", "immobilis"}
    assert set(normalized("les amortissements dérogatoires").split()) & set(normalized("un amortissement dérogatoire").split()) == {"amort", "derogatoir"}
    assert "l313-7" in normalized("article L. 313-7 du code monétaire").split() and "214-1" in normalized("Art. 214-1 du PCG").split()
    assert normalized("le fonds de commerce") == normalized("le fonds commercial") and normalized("l’exercice") == normalized("l'exercice")
    both = set(normalized("Le titulaire d'un contrat de crédit-bail comptabilise en charges").split()) & set(normalized("comptabiliser les charges d'un contrat de crédit-bail").split())
    assert both == {"comptabilis", "le", "charg", "un", "contrat", "de", "credit-bail"}


@pytest.mark.parametrize(
    ("text", "targets"),
    [
        ("articles 212-1 et 212-2.", ["pcg-212-1", "pcg-212-2"]),
        ("articles 212-1 à 212-4.", ["pcg-212-1", "pcg-212-4"]),
        ("article L. 313-7 du Code monétaire et financier", ["legi-L313-7-comofi"]),
        ("articles L. 123-16 et L. 123-16-1 du code de commerce", ["legi-L123-16-code-de-commerce", "legi-L123-16-1-code-de-commerce"]),
        ("article L. 521-1 du Code monétaire et financier et article L. 521-2 du même code.", ["legi-L521-1-comofi", "legi-L521-2-comofi"]),
        ("article 1844-5 du code civil", ["legi-1844-5-code-civil"]),
        ("l’article L. 229-7 du code de l’environnement", ["legi-L229-7-code-de-l-environnement"]),
        ("règlement CRC n° 04-01; règlement n° 2004-06 du CRC", ["crc-04-01", "crc-2004-06"]),
        ("Avis CNC n° 2004-15; Avis CU n° 2006-C", ["avis-cnc-2004-15", "avis-cu-2006-C"]),
        (None, []),
    ],
)
def test_references(spark, text, targets):
    found = spark.createDataFrame([(text,)], "text string").select(extract_references("text").alias("edges")).first().edges
    assert [e.target for e in found] == targets


def test_joined_lines(spark):
    joined = lambda lines: spark.createDataFrame([(lines,)], "lines array<string>").select(assembly.joined("lines").alias("text")).first().text
    assert joined(["Voir les articles 214-15 à 214-", "18."]) == "Voir les articles 214-15 à 214-18."
    assert joined(["Première phrase.", "Deuxième phrase", "qui continue."]) == "Première phrase.\nDeuxième phrase qui continue."
    assert joined(["Traitement :", "-", "suite du texte"]) == "Traitement :\n- suite du texte"
    assert joined(["4 060 000", "-", "-", "-", "11 710 000"]) == "4 060 000\n-\n-\n- 11 710 000"
    assert joined([]) == ""


def test_chunks(spark):
    assert assembly.packed("Une phrase courte.") == ["Une phrase courte."] and assembly.packed("") == [""]
    made = assembly.packed("\n".join(f"mot{k}" for k in range(3)) + "\n" + " ".join(f"w{k}" for k in range(1000)))
    assert made[0] == "mot0\nmot1\nmot2" and len(made) >= 6 and made[1].split()[-40:] == made[2].split()[:40]


def test_assembly(spark):
    lines = spark.sql(literals.LINES_SQL).withColumn("size", F.col("size").cast("double")).withColumn("kind", assembly.kind())
    rows = {r.record_id: r for r in assembly.records(lines).collect() if r.doc_id == 1}
    one = rows["pcg-214-1@2026-01-01"]
    assert one.text == "Les biens sont amortis selon les articles 214-2 et 214-3." and one.targets == ["pcg-214-2", "pcg-214-3"]
    assert one.path == "Livre I Principes > Titre II Actif et évaluation" and (one.page_from, one.page_to) == (20, 20)
    note = rows["pcg-214-1-c1@2026-01-01"]
    assert note.text == "IR 3 – Commentaire\nLe texte du commentaire.\n- premier point" and note.source_citation == "IR 3 – Commentaire" and note.type == "comment"
    assert rows["pcg-na-1@2026-01-01"].path.endswith("Chapitre II Passif") and "pcg-214-2@2026-01-01#2" in rows
    categories = sorted(r.category for r in assembly.anomalies(lines).collect())
    assert categories == ["id collision", "section without level", "unclassified line"]


def test_fold_and_roman(spark):
    row = spark.range(1).select(T.fold(F.lit("éàçœ")).alias("f"), T.roman(F.lit("XCIV")).alias("r"), T.citation_key(F.lit(" L’É  té\n")).alias("k")).first()
    assert (row.f, row.r, row.k) == ("eacœ", 94, "l'é té")


def test_bm25_equals_fts5(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(texts)))
    want = {i: round(-s, 6) for i, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH '\"alpha\" OR \"zeta\"'")}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = lexical.query_terms(spark.createDataFrame([(1, "alpha zeta")], "item_id long, text string"))
    got = {r.doc_id: r.score for r in lexical.bm25(terms, lexical.postings(docs), docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)


def test_phrases_equal_fts5(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["214-1", "214", "1", "214-1-2", "credit-bail", "credit", "bail", "x"]) for _ in range(rng.randrange(1, 20))) for _ in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(texts)))
    want = {i: round(-s, 6) for i, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH '\"214-1\" OR \"credit-bail\" OR \"x\"'")}
    terms = lexical.query_terms(spark.createDataFrame([(1, "214-1 credit-bail x")], "item_id long, text string"))
    got = {r.doc_id: r.score for r in lexical.bm25_phrases(terms, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)


def test_config_is_checked():
    for bad in ({"consensus_weight": -1}, {"rrf_k": -1}, {"question_weight": 0}, {"rewrite_mode": "x"}, {"rewrite_mode": "replace", "question_weight": 2}):
        with pytest.raises(ValueError):
            lexical.SearchConfig(**bad)


def test_consensus_flips_a_winner(spark):
    one = spark.createDataFrame([(1, 10, 2), (1, 20, 5)], "item_id long, doc_id long, rank int")
    two = spark.createDataFrame([(1, 20, 6)], "item_id long, doc_id long, rank int")
    first = lambda w: ranking.fused({"bm25": one, "dense": two}, 60, w).filter("rank = 1").first().doc_id
    assert first(1.0) == 20 and first(0.025) == 10


def test_rerank_cuts_passages(spark):
    q, docs = spark.createDataFrame([(1, "needle")], "item_id long, text string"), spark.createDataFrame([(1, "x " * 600 + "needle"), (2, "needle")], "doc_id long, text string")
    hits = spark.createDataFrame([(1, 1, 9.0, 1), (1, 2, 8.0, 2)], "item_id long, doc_id long, score double, rank int")
    assert [r.doc_id for r in ranking.reranked(hits, q, docs, 25, 10).orderBy("rank").collect()] == [2, 1]
    assert ranking.reranked(hits, q, docs, 25, 0).count() == 0


def test_statistics(spark):
    assert evaluation.bootstrap([1.0] * 20) == (1.0, 1.0, 1.0, 1.0)
    rate = lambda rows: spark.createDataFrame(rows, "a int, b int")
    assert evaluation.kappa(rate([(0, 0), (3, 3), (1, 1)])).first().kappa == 1.0
    assert evaluation.kappa(rate([(0, 3), (3, 0)])).first().kappa == -1.0 and evaluation.kappa(rate([(2, 2)])).first().kappa == 1.0
    a, b = spark.createDataFrame([(1, 0.5)], "item_id long, rr double"), spark.createDataFrame([(2, 0.5)], "item_id long, rr double")
    with pytest.raises(Exception, match="different questions"):
        evaluation.paired(a, b, "rr").collect()


def test_rates_are_null_without_citations(spark):
    none = spark.createDataFrame([], "cite_id long, item_id long, record_id string, verdict string, raw_match boolean")
    row = citations.rates(none).first()
    assert row.n_citations == 0 and row.unknown_rate is None


def test_report(spark):
    records = spark.sql(literals.RECORDS_SQL)
    text = integrity.report(records, integrity.check(records, spark.sql(literals.EDGES_SQL)))
    assert "dangling reference" in text and text.startswith("# Anomalies")


def test_spans(spark):
    span = lambda text, x0, x1, size=10.0, font="Tahoma": (text, size, font, [x0, 0.0, x1, 10.0])
    cases = [
        ([span("l'", 0.0, 5.0), span(" ", 5.0, 9.0), span("actif", 9.0, 20.0)], "l'actif", "Tahoma"),
        ([span("deux", 0.0, 10.0), span("mots", 13.0, 20.0)], "deux mots", "Tahoma"),
        ([span("un", 0.0, 10.0), span("seul", 11.0, 20.0)], "unseul", "Tahoma"),
        ([span("o", 0.0, 2.0, font="Courier"), span("point", 10.0, 20.0)], "- point", "Tahoma"),
        ([span("x", 0.0, 2.0, size=1.0)], "", "Tahoma"),
        ([span(" ", 0.0, 9.0), span("a", 9.0, 10.0), span(" ", 10.0, 10.5), span("b", 10.5, 12.0), span("  ", 12.0, 15.0), span("cc", 15.0, 16.0, font="Tahoma-Bold")], "ab cc", "Tahoma-Bold"),
        ([], "", ""),
    ]
    df = spark.createDataFrame([(k, c, 1.0, 0.0) for k, (c, _, _) in enumerate(cases)], f"k int, spans array<{line_source.SPAN}>, dx double, dy double")
    out = {r.k: r.line for r in df.select("k", line_source.merge_spans("spans", "dx", "dy").alias("line")).collect()}
    assert [(out[k].text, out[k].font) for k in range(len(cases))] == [(text, font) for _, text, font in cases] and out[5].bold and not out[0].bold


def test_model_cache():
    model = models.CachedModel(lambda k: k.upper(), cap=1)
    assert model("a") == model("a") == "A" and model.made == 1
    with pytest.raises(models.ModelError):
        model("b")
    with pytest.raises(models.ModelError):
        models.CachedModel(lambda k: " ")("a")
    with pytest.raises(models.ModelError):
        models.CachedModel(str, read_only=True)("a")
    with pytest.raises(models.ModelError):
        models.parsed_answer('{"abstention": false, "reponse": " "}')
    with pytest.raises(models.ModelError):
        models.parsed_answer("{}", "max_tokens")
    with pytest.raises(models.ModelError):
        models.checked_note({"note": 3, "sur": 2, "par_critere": [1, 2]}, ["a", "b"])


def test_cache_join(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    cache = spark.createDataFrame([("a", "known")], "key string, value string")
    assert {r.key: r.value for r in models.through_cache(keys, cache, lambda k: k * 2).collect()} == {"a": "known", "b": "bb"}
    with pytest.raises(Exception, match="not in the cache"):
        models.through_cache(keys, cache, str, read_only=True).collect()


def test_index_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Voir l'article 214-1."), (2, "Les amortissements\ndes immobilisations")], "doc_id long, text string")
    once = index.build(docs, str(tmp_path / "ix"))
    assert once == index.build(docs, str(tmp_path / "ix")) == {"chunks": 2, "vectors": 2, "records": 2}
    assert index.table(spark, str(tmp_path / "ix"), "postings").filter(F.col("term").startswith("amort")).count() == 1
    assert index.table(spark, str(tmp_path / "ix"), "edges").first().target == "pcg-214-1"


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    postings_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {(r.term, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 2), ("b", 1)}


def test_files(spark, tmp_path, monkeypatch):
    (tmp_path / "q.jsonl").write_text('{"id": "q1", "question": "x", "citations": ["pcg-1-1"]}\n\n')
    (tmp_path / "c.json").write_text('{"[\\"x\\", [\\"r\\"]]": "answer"}')
    asked = files.questions(spark, str(tmp_path / "q.jsonl"))
    assert asked.count() == 1 and files.answers_by_question(files.cache_map(spark, str(tmp_path / "c.json")), asked).first().value == "answer"
    (tmp_path / "env").write_text("# note\nLV_A='1'\nLV_B=2\n")
    monkeypatch.setenv("LV_B", "kept")
    files.load_settings(tmp_path / "env")
    assert os.environ.pop("LV_A") == "1" and os.environ["LV_B"] == "kept"
    with pytest.raises(FileNotFoundError, match="build"):
        files.required(tmp_path / "none", "build")
    with pytest.raises(ValueError):
        files.download("", tmp_path / "q.jsonl", "0" * 64)
    assert not (tmp_path / "q.jsonl").exists()


def test_campaign(spark):
    from lorevine.operators import campaign

    configs = campaign.grid({"rrf_k": [60, 5], "dedup": [False, True]})
    assert list(configs) == ["reference", "rrf_k=5", "dedup=True"]
    cat = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "item_id long, category string")
    level = {"reference": 0.0, "rrf_k=5": 1.0, "dedup=True": -1.0}
    names = {id(c): n for n, c in configs.items()}
    measure = lambda c: spark.createDataFrame([(i, level[names[id(c)]]) for i in range(20)], "item_id long, recall_10 double")
    out = {r.config: r for r in campaign.run_grid(configs, measure, cat, n_boot=100).collect()}
    assert out["rrf_k=5"].adopted and not out["dedup=True"].adopted and out["dedup=True"].worst == -1.0
    base = measure(configs["reference"])
    campaign.assert_fresh(base, base)
    for other in (measure(configs["rrf_k=5"]), base.limit(5)):
        with pytest.raises(ValueError, match="published"):
            campaign.assert_fresh(base, other)
    figures = spark.createDataFrame([("a", -0.25), ("b", 0.5)], "name string, value double")
    assert campaign.unreported(figures, "delta −0,25") == ["b"]
