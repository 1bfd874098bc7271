"""The search in its five modes, over records, edges and questions of the input folder, with no lever neutral."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorevine.operators.lexical import SearchConfig
from lorevine.operators.search import MODES, Corpus, field_counts, search
from lorevine.plans.retrieval_queries import _OVERLAP, _ROUTED, KNN, RANKED, SCORES, STATS, TERMS_DEDUP, TOK, rrf_sql
from lorevine.plans.tables import UNIQUE_SQL, edges, load, route_questions, unique_records

CONFIG = SearchConfig(consensus_weight=0.5, path_weight=2.0, comment_boost=0.8, dedup=True)

_HITS = f"""{_ROUTED}, post AS (SELECT doc_id, term, sum(w) AS tf, count(*) AS n FROM (SELECT doc_id, unnest({TOK.format(c='text')}) AS term, 1.0 AS w FROM rec
 UNION ALL SELECT doc_id, unnest({TOK.format(c='path')}), {CONFIG.path_weight} FROM rec) GROUP BY doc_id, term), {STATS.replace('sum(tf)', 'sum(n)')}, {TERMS_DEDUP.replace('FROM benchmark', 'FROM rq')}, {SCORES}, {RANKED.replace('bmr AS', 'bm0 AS')},
bb AS (SELECT item_id, doc_id, CASE WHEN type = 'regulatory' THEN score ELSE score * {CONFIG.comment_boost} END AS score FROM bm0 JOIN rec USING (doc_id) WHERE rank <= {CONFIG.pool}), {RANKED.replace('FROM bm', 'FROM bb')}, {KNN}, {rrf_sql(CONFIG.rrf_k, CONFIG.consensus_weight)}"""
_BASE = {"bm25": "bmr", "dense": f"(SELECT * FROM knr WHERE rank <= {CONFIG.pool})"}
_RERANK = f"""rr AS (SELECT rk.*, round(len(list_intersect({_OVERLAP.format(c='q.text')}, {_OVERLAP.format(c='substring(rec.text, 1, 1000)')})) / len({_OVERLAP.format(c='q.text')}), 6) AS better
 FROM rk JOIN rec USING (record_id) JOIN rq q USING (item_id) WHERE rank <= {CONFIG.n_rerank}), lx AS (SELECT item_id, record_id, score, row_number() OVER (PARTITION BY item_id ORDER BY better DESC, rank) AS rank FROM rr)"""
_GRAPH = f"""nb AS (SELECT p.item_id, r.record_id, round(p.score * 0.5, 7) AS score, p.rank AS parent, e.edge_no FROM pi p JOIN ed e ON e.source_id = p.record_id AND e.family = 'internal'
 JOIN rec r ON r.article = replace(e.target, 'pcg-', '') AND r.type = 'regulatory' WHERE p.rank <= 5 AND (p.item_id, r.record_id) NOT IN (SELECT item_id, record_id FROM pi)),
al AS (SELECT item_id, record_id, score, source, rank FROM pi UNION ALL SELECT item_id, record_id, score, 'graph', parent + 1000 FROM (SELECT *, row_number() OVER (PARTITION BY item_id, record_id ORDER BY parent, edge_no) AS k FROM nb) WHERE k = 1),
ou AS (SELECT item_id, record_id, score, source, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, al.rank, record_id) AS rank FROM al)"""


def _sql(mode: str) -> str:
    source = "fusion" if mode.startswith("hybrid") else mode
    ranked = f"rk AS (SELECT b.item_id, record_id, score, row_number() OVER (PARTITION BY b.item_id ORDER BY b.rank, record_id) AS rank FROM {_BASE.get(mode, 'fur')} b JOIN rec USING (doc_id) WHERE (b.item_id, record_id) NOT IN (SELECT item_id, record_id FROM ro))"
    lx = _RERANK if mode == "hybrid+rerank" else "lx AS (SELECT * FROM rk)"
    pins = f"""un AS (SELECT item_id, record_id, score, source, 0 AS section, mention AS place FROM ro UNION ALL SELECT item_id, record_id, score, '{source}', 1, rank FROM lx),
pi AS (SELECT item_id, record_id, score, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY section, place, record_id) AS rank FROM un) WHERE rank <= {CONFIG.k})"""
    last = _GRAPH if mode == "hybrid+graph" else "ou AS (SELECT * FROM pi)"
    return f"WITH {_HITS}, {ranked}, {lx}, {pins}, {last} SELECT item_id, doc_id, record_id, CAST(score AS DOUBLE) AS score, source, CAST(rank AS INTEGER) AS rank FROM ou JOIN (SELECT doc_id, record_id FROM rec) USING (record_id) WHERE rank <= {CONFIG.k}"


def corpus(spark, sf) -> Corpus:
    known = unique_records(spark, sf)
    vectors = load(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return Corpus(known, field_counts(known), vectors, edges(spark, sf, UNIQUE_SQL))


def _query(mode: str):
    def run(spark, sf):
        vectors = load(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("qv"))
        return search(route_questions(spark, sf).join(vectors, "item_id", "left"), corpus(spark, sf), CONFIG, mode)

    return run


_NAMES = {mode: "search_" + mode.replace("hybrid+", "") for mode in MODES}
QUERIES = {name: _query(mode) for mode, name in _NAMES.items()}
ORACLE_SQL = {name: _sql(mode) for mode, name in _NAMES.items()}
