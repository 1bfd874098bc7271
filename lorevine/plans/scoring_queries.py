"""Queries that measure: recall, coverage, margins, paired statistics, agreement, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevine.operators import citations, evaluation
from lorevine.plans.retrieval_queries import BM, FUSED, KNN, POST, SCORES, STATS, TERMS_DEDUP, RANKED, TOK, bm25_hits, dense_hits, fused_hits
from lorevine.plans.tables import ANSWERS_SQL, CITED_SQL, RECORDS_SQL, REWRITES_SQL, derived, load, questions, records

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


GOLD = "gold AS (SELECT item_id, doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text))"
CATEGORY = "cat AS (SELECT item_id, min(lang) AS category FROM gold JOIN documents USING (doc_id) GROUP BY item_id)"


def per_q(ranked: str, name: str = "pq") -> str:
    return f"""{name} AS (SELECT item_id, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10,
 round(coalesce(1.0 / min(CASE WHEN rank <= 10 THEN rank END), 0.0), 6) AS rr FROM gold LEFT JOIN (SELECT * FROM {ranked} WHERE rank <= 10) h USING (item_id, doc_id) GROUP BY item_id)"""


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Question-document pairs in which the document contains the question's passage."""
    return evaluation.containing(questions(spark, sf), load(spark, sf, "documents"))


def category(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    """``known``: the gold pairs, where they are there already."""
    langs = load(spark, sf, "documents").select("doc_id", "lang")
    return (gold(spark, sf) if known is None else known).join(langs, "doc_id").groupBy("item_id").agg(F.min("lang").alias("category"))


@query("gold_containment", f"WITH {GOLD} SELECT * FROM gold")
def gold_containment(spark, sf):
    return gold(spark, sf)


@query("eval_per_question", f"WITH {BM}, {GOLD}, {per_q('bmr')} SELECT * FROM pq")
def eval_per_question(spark, sf):
    return evaluation.per_question(bm25_hits(spark, sf), gold(spark, sf))


@query("eval_recall_mrr", f"WITH {BM}, {GOLD}, {per_q('bmr')} SELECT count(*) AS n, round(avg(recall_5), 3) AS recall_5, round(avg(recall_10), 3) AS recall_10, round(avg(rr), 3) AS rr FROM pq")
def eval_recall_mrr(spark, sf):
    return evaluation.macro(evaluation.per_question(bm25_hits(spark, sf), gold(spark, sf)))


@query("eval_by_category", f"WITH {BM}, {GOLD}, {CATEGORY}, {per_q('bmr')} SELECT category, count(*) AS n, round(avg(recall_5), 3) AS recall_5, round(avg(recall_10), 3) AS recall_10, round(avg(rr), 3) AS rr FROM pq JOIN cat USING (item_id) GROUP BY category")
def eval_by_category(spark, sf):
    scores = evaluation.per_question(bm25_hits(spark, sf), gold(spark, sf))
    return evaluation.macro(scores.join(category(spark, sf), "item_id"), "category")


@query(
    "pool_coverage",
    f"""WITH {BM}, {KNN}, {GOLD}, po AS (SELECT item_id, doc_id FROM bmr WHERE rank <= 50 UNION SELECT item_id, doc_id FROM knr WHERE rank <= 50),
co AS (SELECT item_id, max(CASE WHEN (item_id, doc_id) IN (SELECT item_id, doc_id FROM po) THEN 1.0 ELSE 0.0 END) AS covered FROM gold GROUP BY item_id) SELECT count(*) AS n, round(avg(covered), 4) AS coverage FROM co""",
)
def pool_coverage(spark, sf):
    pool = bm25_hits(spark, sf, 50).select("item_id", "doc_id").union(dense_hits(spark, sf).select("item_id", "doc_id")).distinct()
    got = gold(spark, sf).join(pool.withColumn("in", F.lit(1.0)), ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.max(F.coalesce("in", F.lit(0.0))).alias("covered"))
    return got.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("covered"), 4).alias("coverage"))


_MARGIN = f"WITH {FUSED}, {GOLD}, ma AS (SELECT item_id, min(rank) AS margin_rank FROM gold LEFT JOIN fur USING (item_id, doc_id) GROUP BY item_id)"


@query("margin_before_eviction", f"{_MARGIN} SELECT count(*) AS n_exposed, count(*) FILTER (margin_rank IS NULL) AS n_absent, median(margin_rank) AS median_rank, round(avg(CASE WHEN margin_rank <= 10 THEN 0.0 ELSE 1.0 END), 4) AS beyond_10, round(avg(CASE WHEN margin_rank <= 25 THEN 0.0 ELSE 1.0 END), 4) AS beyond_25 FROM ma")
def margin_before_eviction(spark, sf):
    return evaluation.margin_before_eviction(evaluation.margins(fused_hits(spark, sf, k=None), gold(spark, sf)))


@query("margin_present", f"{_MARGIN} SELECT count(*) AS n, median(margin_rank) AS median_rank, round(avg(margin_rank), 2) AS mean_rank, CAST(max(margin_rank) AS INTEGER) AS max_rank, count(*) FILTER (margin_rank > 25) AS n_beyond_25 FROM ma WHERE margin_rank IS NOT NULL")
def margin_present(spark, sf):
    return evaluation.margin_among_present(evaluation.margins(fused_hits(spark, sf, k=None), gold(spark, sf)))


def two_configs(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    """Reciprocal ranks of the lexical channel and of the fused list, question by question.

    What both use is a few rows a question, made once and cached: the gold pairs (``known``) and the best of the lexical channel.
    """
    g = gold(spark, sf).cache() if known is None else known
    lexical_hits = bm25_hits(spark, sf, 50).cache()
    fused = fused_hits(spark, sf, bm25=lexical_hits)
    return evaluation.paired(evaluation.per_question(lexical_hits.filter("rank <= 10"), g), evaluation.per_question(fused, g), "rr")


_TWO = f"WITH {FUSED}, {GOLD}, {CATEGORY}, {per_q('bmr', 'pa')}, {per_q('fur', 'pb')}, pr AS (SELECT item_id, pa.rr AS a, pb.rr AS b, round(pb.rr - pa.rr, 6) AS delta FROM pa JOIN pb USING (item_id))"


@query("paired_delta", f"{_TWO} SELECT * FROM pr")
def paired_delta(spark, sf):
    return two_configs(spark, sf)


@query("flips", f"""{_TWO} SELECT count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id) FILTER (delta > 0), '') AS won,
 coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id) FILTER (delta < 0), '') AS lost FROM pr""")
def flips(spark, sf):
    return evaluation.flips(two_configs(spark, sf))


@query("worst_category", f"{_TWO} SELECT category, round(avg(b) - avg(a), 4) AS delta FROM pr JOIN cat USING (item_id) GROUP BY category HAVING round(avg(b) - avg(a), 4) < 0 ORDER BY delta, category LIMIT 1")
def worst_category(spark, sf):
    return evaluation.worst_category(two_configs(spark, sf), category(spark, sf))


@query("paired_bootstrap")
def paired_bootstrap(spark, sf):
    """Resampling with a fixed generator; checked against the same resampling in plain Python."""
    return evaluation.paired_bootstrap(two_configs(spark, sf))


@query("bootstrap_by_category")
def bootstrap_by_category(spark, sf):
    return evaluation.paired_bootstrap(two_configs(spark, sf).join(category(spark, sf), "item_id"), "category")


@query("adoption_verdict")
def adoption_verdict(spark, sf):
    """Adopted if the share of positive means is at least 0.95 and no category loses more than 0.05."""
    g = gold(spark, sf).cache()
    pairs = two_configs(spark, sf, g).cache()
    worst = evaluation.worst_category(pairs, category(spark, sf, g)).agg(F.coalesce(F.min("delta"), F.lit(0.0)).alias("worst"))
    return evaluation.paired_bootstrap(pairs).crossJoin(worst).select("n", "delta", "p", "worst", ((F.col("p") >= 0.95) & (F.col("worst") >= -0.05)).alias("adopted"))


@query(
    "identical_configs",
    f"""WITH {POST}, {STATS}, {TERMS_DEDUP}, {SCORES}, {RANKED}, {GOLD}, {per_q('bmr')},
v AS (SELECT 'a' AS config, item_id, rr AS value FROM pq UNION ALL SELECT 'b', item_id, rr FROM pq UNION ALL SELECT 'c', item_id, rr + 1 FROM pq),
pt AS (SELECT config, string_agg(item_id || ':' || value, ';' ORDER BY item_id) AS p FROM v GROUP BY config)
SELECT string_agg(config, ',' ORDER BY config) AS configs, count(*) AS n FROM pt GROUP BY p HAVING count(*) > 1""",
)
def identical_configs(spark, sf):
    v = evaluation.per_question(bm25_hits(spark, sf, dedup=True), gold(spark, sf)).select("item_id", F.col("rr").alias("value"))
    every = v.withColumn("config", F.lit("a")).unionByName(v.withColumn("config", F.lit("b"))).unionByName(v.withColumn("config", F.lit("c")).withColumn("value", F.col("value") + 1))
    return evaluation.identical(every)


@query(
    "agreement_kappa",
    """WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS c FROM labels GROUP BY ALL), n AS (SELECT sum(c) AS n, sum(CASE WHEN a = b THEN c ELSE 0 END) AS same, sum(abs(a - b) * c) AS gap, sum((a - b) * (a - b) * c) AS seen FROM c),
x AS (SELECT sum((ra.a - rb.b) * (ra.a - rb.b) * ra.ca * rb.cb) AS chance FROM (SELECT a, sum(c) AS ca FROM c GROUP BY a) ra, (SELECT b, sum(c) AS cb FROM c GROUP BY b) rb)
SELECT CAST(n AS BIGINT) AS n, round(same / n, 4) AS exact, round(gap / n, 4) AS mean_gap, round(CASE WHEN chance = 0 THEN CASE WHEN seen = 0 THEN 1.0 ELSE -1.0 END ELSE 1 - seen * n / chance END, 4) AS kappa FROM n, x""",
)
def agreement_kappa(spark, sf):
    return evaluation.kappa(load(spark, sf, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b")))


@query("round_robin_sample", "SELECT doc_id, lang, CAST(turn AS INTEGER) AS turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 30")
def round_robin_sample(spark, sf):
    """A sampling operator: one document of each language in turn, thirty in all."""
    return evaluation.round_robin(load(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 30).select("doc_id", "lang", "turn")


@query(
    "token_diff",
    f"""WITH {GOLD}, t AS (SELECT item_id, doc_id, list_distinct({TOK.format(c='b.text')}) AS q, list_distinct({TOK.format(c='d.text')}) AS p FROM gold JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id))
SELECT item_id, doc_id, array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(q, x)))[1:40], ' ') AS extra, len(list_filter(p, lambda x: NOT list_contains(q, x))) AS n_extra, len(list_filter(q, lambda x: NOT list_contains(p, x))) AS n_missing FROM t""",
)
def token_diff(spark, sf):
    from lorevine.functions import text as T

    both = gold(spark, sf).join(questions(spark, sf).select("item_id", T.tokens(F.col("text")).alias("q")), "item_id").join(load(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("p")), "doc_id")
    return both.select("item_id", "doc_id", F.array_join(F.slice(F.array_sort(F.array_except("p", "q")), 1, 40), " ").alias("extra"), F.size(F.array_except("p", "q")).cast("long").alias("n_extra"), F.size(F.array_except("q", "p")).cast("long").alias("n_missing"))


_ASKED = f"SELECT DISTINCT 'pcg-' || article AS citation FROM ({RECORDS_SQL}) r WHERE article IS NOT NULL AND doc_id % 5 = 2"


@query("gold_match", f"WITH rec AS ({RECORDS_SQL}) SELECT c.citation, rec.record_id, rec.doc_id FROM ({_ASKED}) c, rec WHERE starts_with(record_id, citation) AND (record_id = citation OR regexp_matches(record_id[length(citation) + 1 :], '^([@#]|-c)'))")
def gold_match(spark, sf):
    """The records that cited articles name, by an equi-join on what a citation may be."""
    return evaluation.matched(records(spark, sf), derived(spark, sf, _ASKED)).select("citation", "record_id", "doc_id")


KEY = "lower(trim(regexp_replace(translate({c}, '’‘ʼ＇', ''''''''''), '\\s+', ' ', 'g')))"
_VERDICTS = f"""WITH rec AS (SELECT record_id, min(text) AS text FROM ({RECORDS_SQL}) GROUP BY record_id), c AS ({CITED_SQL}),
ver AS (SELECT split_part(record_id, '@', 1) AS record_id, count(*) AS n_versions, min(text) AS version_text FROM rec WHERE contains(record_id, '@') GROUP BY 1),
j AS (SELECT c.*, rec.text AS exact_text, coalesce(n_versions, 0) AS nv, version_text, length(trim(extract)) AS n FROM c LEFT JOIN rec USING (record_id) LEFT JOIN ver USING (record_id)),
vd AS (SELECT cite_id, item_id, record_id, CASE WHEN n < 30 THEN 'extract_too_short' WHEN exact_text IS NOT NULL THEN CASE WHEN contains({KEY.format(c='exact_text')}, {KEY.format(c='extract')}) THEN 'ok' ELSE 'extract_absent' END
 WHEN nv = 0 THEN 'unknown_record' WHEN nv > 1 THEN 'version_ambiguous' WHEN contains({KEY.format(c='version_text')}, {KEY.format(c='extract')}) THEN 'version_omitted' ELSE 'extract_absent' END AS verdict,
 coalesce(n >= 30 AND contains(coalesce(exact_text, CASE WHEN nv = 1 THEN version_text END), extract), false) AS raw_match FROM j)"""


def _verdicts(spark, sf):
    one = records(spark, sf).groupBy("record_id").agg(F.min("text").alias("text"))
    return citations.verdicts(derived(spark, sf, CITED_SQL), one)


@query("citation_verdicts", f"{_VERDICTS} SELECT * FROM vd")
def citation_verdicts(spark, sf):
    return _verdicts(spark, sf)


@query("citation_rates", f"""{_VERDICTS} SELECT count(*) AS n_citations, round(avg(CASE WHEN verdict = 'unknown_record' THEN 1.0 ELSE 0.0 END), 4) AS unknown_rate, round(avg(CASE WHEN verdict IN ('extract_absent', 'extract_too_short') THEN 1.0 ELSE 0.0 END), 4) AS unsupported_rate,
 round(avg(CASE WHEN verdict = 'version_omitted' THEN 1.0 ELSE 0.0 END), 4) AS omitted_rate, round(avg(CASE WHEN raw_match THEN 1.0 ELSE 0.0 END), 4) AS raw_rate FROM vd""")
def citation_rates(spark, sf):
    return citations.rates(_verdicts(spark, sf))


@query("citations_per_answer", f"{_VERDICTS}, n AS (SELECT item_id, count(*) AS n FROM vd GROUP BY item_id) SELECT min(n) AS least, max(n) AS most, median(n) AS median, round(avg(n), 4) AS mean FROM n")
def citations_per_answer(spark, sf):
    return citations.per_answer(_verdicts(spark, sf))


@query("worst_verdict", f"{_VERDICTS} SELECT item_id, arg_min(verdict, list_position({list(citations.SEVERITY)!r}, verdict)) AS verdict FROM vd GROUP BY item_id")
def worst_verdict(spark, sf):
    return citations.worst(_verdicts(spark, sf))


_SP = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_TY = "translate(" + _SP + ", '’‘ʼ＇«»“”–—', '''''''''\"\"\"\"--')"
_FO = "translate(lower(" + _TY + "), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
_STEPS = " ".join(f"WHEN contains({f.format(c='text')}, {f.format(c='extract')}) THEN '{n}'" for n, f in (("raw", "{c}"), ("spaces", _SP), ("typography", _TY), ("case_accents", _FO)))
_AT = "substring(text, 1 + CAST(floor(length(text) * (doc_id % 11) / 12) AS INT), {n})"
_EXTRACTS = f"CASE doc_id % 4 WHEN 0 THEN {_AT.format(n=60)} WHEN 1 THEN replace({_AT.format(n=60)}, ' ', '  ') WHEN 2 THEN upper(translate({_AT.format(n=60)}, 'ß', '')) ELSE {_AT.format(n=30)} || ' # ' || substring(text, 1, 20) END"


@query("verbatim_ladder", f"SELECT doc_id, CASE {_STEPS} ELSE 'absent' END AS level FROM (SELECT doc_id, text, {_EXTRACTS} AS extract FROM documents)")
def verbatim_ladder(spark, sf):
    """Extracts cut from documents: as they are, respaced, upper-cased, or broken."""
    cut = load(spark, sf, "documents").withColumn("extract", F.expr(_EXTRACTS))
    return citations.ladder(cut).select("doc_id", "level")


@query("verbatim_histogram", f"WITH l AS (SELECT CASE {_STEPS} ELSE 'absent' END AS level FROM (SELECT doc_id, text, {_EXTRACTS} AS extract FROM documents)) SELECT level, count(*) AS n, round(count(*) / (SELECT count(*) FROM l), 4) AS share FROM l GROUP BY level")
def verbatim_histogram(spark, sf):
    counts = verbatim_ladder(spark, sf).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("level", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


_NUMS = "list_distinct(regexp_extract_all({c}, '\\d{{3,4}}-\\d+(?:-\\d+)?'))"


@query(
    "rewrite_leak_audit",
    f"""WITH w AS ({REWRITES_SQL}), a AS (SELECT item_id, gold, list_filter({_NUMS.format(c='rewrite')}, lambda x: NOT list_contains({_NUMS.format(c='question')}, x)) AS added FROM w)
SELECT item_id, array_to_string(list_sort(added), ',') AS added, CASE WHEN len(added) = 0 THEN 'copied' WHEN list_contains(added, gold) THEN 'leak' ELSE 'invented' END AS verdict FROM a""",
)
def rewrite_leak_audit(spark, sf):
    return citations.leak_audit(derived(spark, sf, REWRITES_SQL).withColumn("gold", F.array("gold")))


@query("abstention_rates", f"WITH a AS ({ANSWERS_SQL}) SELECT reason, count(*) AS n, round(avg(CASE WHEN abstention THEN 1.0 ELSE 0.0 END), 4) AS abstention_rate, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id) FILTER (NOT abstention), '') AS answered FROM a GROUP BY reason")
def abstention_rates(spark, sf):
    return derived(spark, sf, ANSWERS_SQL).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(F.col("abstention"), 1.0).otherwise(0.0)), 4).alias("abstention_rate"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("abstention"), F.col("item_id")))), ",").alias("answered"),
    )


@query("citation_key", f"SELECT doc_id, md5({KEY.format(c='text')}) AS key_md5 FROM documents")
def citation_key(spark, sf):
    from lorevine.functions import text as T

    return load(spark, sf, "documents").select("doc_id", F.md5(T.citation_key(F.col("text"))).alias("key_md5"))
