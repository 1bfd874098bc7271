"""The search over a stored index: modes, levers, routes, empty inputs."""

import pytest

from lorevine.operators import campaign, search
from lorevine.operators.lexical import SearchConfig
from lorevine.plans import index

RECORDS = [
    (1, "pcg-214-1", "214-1", "regulatory", "Amortissement", "L'amortissement est la répartition du montant amortissable. Voir l'article 214-2."),
    (2, "pcg-214-2", "214-2", "regulatory", "Dépréciation", "La valeur nette comptable est comparée à la valeur actuelle."),
    (3, "pcg-214-1-c1", "214-1", "comment", "Amortissement", "Commentaire : l'amortissement linéaire répartit le montant amortissable."),
    (4, "pcg-512-4", "512-4", "regulatory", "Trésorerie", "Les disponibilités et les banques."),
    (5, "pcg-513-1", "513-1", "regulatory", "Vide", None),
]
QUESTIONS = [(10, "Quel est le montant amortissable ?"), (11, "Que dit l'article 512-4 sur le montant amortissable ?"), (12, None), (13, "zzz")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("search") / "ix")
    index.build(spark.createDataFrame(RECORDS, "doc_id long, record_id string, article string, type string, path string, text string"), target)
    return index.opened(spark, target)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "item_id long, text string")


def found(hits):
    out = {}
    for r in hits.orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append((r.record_id, r.source))
    return out


def test_lexical_mode_ranks_and_routes(stored, questions):
    out = found(search.search(questions, stored, mode="bm25"))
    assert {r for r, _ in out[10][:2]} == {"pcg-214-1", "pcg-214-1-c1"}
    assert out[11][0] == ("pcg-512-4", "route")
    assert sum(r == "pcg-512-4" for r, _ in out[11]) == 1
    assert 12 not in out and 13 not in out


def test_k_holds_with_routes_in_every_mode(stored, questions):
    for mode in search.MODES:
        hits = search.search(questions, stored, SearchConfig(k=2), mode).collect()
        assert {r.rank for r in hits} <= {1, 2}
        assert [r.record_id for r in hits if r.item_id == 11 and r.source == "route"] == ["pcg-512-4"]


def test_graph_mode_adds_neighbours_of_hits(spark, stored):
    q = spark.createDataFrame([(1, "Que dit l'article 214-1 ?")], "item_id long, text string")
    seen = found(search.search(q, stored, SearchConfig(), "bm25"))[1]
    assert seen[0] == ("pcg-214-1", "route") and "pcg-214-2" not in dict(seen)
    grown = found(search.search(q, stored, SearchConfig(pool=1), "hybrid+graph"))[1]
    assert grown[:2] == [("pcg-214-1", "route"), ("pcg-214-2", "graph")]


def test_levers_are_in_force(spark, stored, questions):
    scores = lambda config, asked=questions: {(r.item_id, r.record_id): r.score for r in search.search(asked, stored, config, "bm25").filter("source = 'bm25'").collect()}
    plain = scores(SearchConfig())
    assert scores(SearchConfig(comment_boost=0.5))[10, "pcg-214-1-c1"] == plain[10, "pcg-214-1-c1"] / 2
    by_path = spark.createDataFrame([(1, "Trésorerie")], "item_id long, text string")
    assert scores(SearchConfig(path_weight=5.0), by_path)[1, "pcg-512-4"] > scores(SearchConfig(), by_path)[1, "pcg-512-4"]
    assert all(len([1 for i, _ in scores(SearchConfig(pool=1)) if i == item]) <= 1 for item in (10, 11))
    assert len(scores(SearchConfig(df_max=0.3))) < len(plain)


def test_rewrites_reach_the_channels_but_not_the_router(spark, stored):
    q = spark.createDataFrame([(1, "zzz", "banques article 214-2"), (2, "zzz", None)], "item_id long, text string, rewrite string")
    out = found(search.search(q, stored, SearchConfig(rewrite_mode="replace"), "bm25"))
    assert out == {1: [(r, "bm25") for r, _ in out[1]]} and "pcg-512-4" in dict(out[1])


def test_unknown_mode_and_empty_questions(stored, questions):
    with pytest.raises(ValueError):
        search.search(questions, stored, mode="sparse")
    assert search.search(questions.limit(0), stored, mode="hybrid+rerank").count() == 0


def test_grid_measures_the_search(spark, stored, questions):
    gold = spark.createDataFrame([(10, 1), (11, 4)], "item_id long, doc_id long")
    category = spark.createDataFrame([(10, "a"), (11, "b")], "item_id long, category string")
    configs = campaign.grid({"pool": [1], "comment_boost": [0.5]})
    out = {r.config: r for r in campaign.run_grid(configs, search.measure(questions, stored, gold, "bm25"), category, n_boot=20).collect()}
    assert set(out) == {"pool=1", "comment_boost=0.5"} and all(r.n == 2 for r in out.values())
