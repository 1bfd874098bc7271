"""Queries over lines, records and edges: classification, assembly, references, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorevine.functions import text as T
from lorevine.functions.references import extract_references, references_duckdb
from lorevine.operators import assembly, integrity
from lorevine.plans.tables import CITING_SQL, EDGES_SQL, LINES_SQL, RECORDS_SQL, ROMAN_SQL, SENTENCES_SQL, derived, edges, load, records

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


KIND = r"""CASE WHEN regexp_matches(trim(text), '^\d+$') AND trim(text) = page::VARCHAR AND (x < 60 OR y < 60) THEN 'noise' WHEN starts_with(font, 'Symbol') OR text IN ('•', '-', '–', '*') THEN 'bullet' WHEN size <= 9.1 THEN 'noise'
 WHEN size >= 10.4 THEN 'section' WHEN size BETWEEN 9.8 AND 10.3 AND bold AND regexp_matches(text, '^Art(?:\.\s*|icle\s+)\d') THEN 'article' WHEN size BETWEEN 9.8 AND 10.3 AND bold AND regexp_matches(text, '(?i)^(Livre|Titre|Chapitre|Section|Sous-section)\b') THEN 'section'
 WHEN size BETWEEN 9.8 AND 10.3 THEN 'regulatory' WHEN size BETWEEN 9.3 AND 9.7 THEN CASE WHEN bold THEN 'comment_title' ELSE 'comment' END ELSE 'unknown' END"""
_LINES = f"WITH sentences AS ({SENTENCES_SQL}), l AS ({LINES_SQL}), k AS (SELECT *, {KIND} AS kind FROM l)"


def lines(spark, sf):
    return derived(spark, sf, LINES_SQL).withColumn("size", F.col("size").cast("double")).withColumn("kind", assembly.kind())


@query("classify_lines", f"{_LINES} SELECT doc_id, seq, kind FROM k")
def classify_lines(spark, sf):
    return lines(spark, sf).select("doc_id", "seq", "kind")


@query("line_lag", f"{_LINES} SELECT doc_id, seq, coalesce(lag(kind) OVER w = 'section' AND lag(page) OVER w = page AND NOT regexp_matches(lag(text) OVER w, '\\.{{4,}}'), false) AS after_section FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY seq)")
def line_lag(spark, sf):
    return lines(spark, sf).select("doc_id", "seq", assembly.after_section().alias("after_section"))


_FILL = ", ".join(
    f"nullif(last_value(CASE WHEN depth = {k} THEN text WHEN depth < {k} THEN '' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING), '') AS l{k}" for k in range(1, 6)
)
_LEVEL = " ".join(f"WHEN starts_with(lower(text), '{x}') THEN '{x}'" for x in T.LEVELS)


@query("path_fill", f"{_LINES}, h AS (SELECT doc_id, seq, text, CASE {_LEVEL} END AS level FROM k WHERE kind = 'section'), d AS (SELECT *, list_position({list(T.LEVELS)!r}, level) AS depth FROM h), f AS (SELECT doc_id, seq, level, {_FILL} FROM d) SELECT doc_id, seq, level, concat_ws(' > ', l1, l2, l3, l4, l5) AS path FROM f")
def path_fill(spark, sf):
    return assembly.filled_path(lines(spark, sf).filter("kind = 'section'").select("doc_id", "seq", "text"))


@query("id_suffix", f"WITH r AS (SELECT record_id, row_number() OVER (ORDER BY doc_id) AS seq FROM ({RECORDS_SQL})) SELECT record_id, CASE WHEN n > 1 THEN record_id || '#' || n ELSE record_id END AS unique_id FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY seq) AS n FROM r)")
def id_suffix(spark, sf):
    return assembly.with_suffix(records(spark, sf).withColumn("seq", F.col("doc_id"))).select("record_id", "unique_id")


@query("assemble_records")
def assemble_records(spark, sf):
    """Records from the islands of ordered lines."""
    return assembly.records(lines(spark, sf))


@query("assembly_anomalies")
def assembly_anomalies(spark, sf):
    return assembly.anomalies(lines(spark, sf))


@query("extract_refs", f"SELECT doc_id, edge.target AS target, edge.family AS family FROM (SELECT doc_id, unnest({references_duckdb('c.text')}) AS edge FROM ({CITING_SQL}) c)")
def extract_refs(spark, sf):
    """References of every document."""
    return derived(spark, sf, CITING_SQL).select("doc_id", F.explode(extract_references("text")).alias("edge")).select("doc_id", "edge.target", "edge.family")


@query("duplicate_ids", f"SELECT record_id, count(*) AS n FROM ({RECORDS_SQL}) GROUP BY record_id HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return integrity.duplicate_ids(records(spark, sf))


_DANGLING = f"dg AS (SELECT source_id, target FROM ({EDGES_SQL}) WHERE family = 'internal' AND target NOT IN (SELECT 'pcg-' || article FROM ({RECORDS_SQL}) WHERE article IS NOT NULL))"


@query("dangling_edges", f"WITH {_DANGLING} SELECT * FROM dg")
def dangling_edges(spark, sf):
    return integrity.dangling(records(spark, sf), edges(spark, sf))


_NUMBER = "CASE upper(regexp_extract(path, '(?i)Titre ([IVXLC0-9]+)', 1)) WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'III' THEN 3 WHEN 'IV' THEN 4 WHEN 'V' THEN 5 WHEN 'X' THEN 10 ELSE TRY_CAST(regexp_extract(path, '(?i)Titre ([IVXLC0-9]+)', 1) AS INTEGER) END"
_MISMATCH = f"mm AS (SELECT record_id, article, path, {_NUMBER} AS title_number FROM ({RECORDS_SQL}) WHERE regexp_extract(article, '^(\\d)\\d{{2}}-', 1) <> '' AND TRY_CAST(regexp_extract(article, '^(\\d)\\d{{2}}-', 1) AS INTEGER) <> {_NUMBER})"


@query("title_mismatches", f"WITH {_MISMATCH} SELECT * FROM mm")
def title_mismatches(spark, sf):
    return integrity.title_mismatches(records(spark, sf))


_CHECK = f"""WITH {_DANGLING}, {_MISMATCH}, ck AS (SELECT record_id, 'duplicate id' AS category FROM ({RECORDS_SQL}) GROUP BY record_id HAVING count(*) > 1 UNION ALL
SELECT record_id, 'empty text' FROM ({RECORDS_SQL}) WHERE coalesce(trim(text), '') = '' UNION ALL SELECT record_id, 'title mismatch' FROM mm UNION ALL SELECT source_id, 'dangling reference' FROM dg)"""


@query("integrity_check", f"{_CHECK} SELECT * FROM ck")
def integrity_check(spark, sf):
    return integrity.check(records(spark, sf), edges(spark, sf))


@query("anomaly_counts", f"{_CHECK} SELECT category, count(*) AS n FROM ck GROUP BY category")
def anomaly_counts(spark, sf):
    return integrity.anomaly_counts(integrity.check(records(spark, sf), edges(spark, sf)))


@query("edge_counts", f"SELECT family, count(*) AS n FROM ({EDGES_SQL}) GROUP BY family")
def edge_counts(spark, sf):
    return edges(spark, sf).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"


@query("chunk_windows", f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT doc_id, i AS seq, md5(array_to_string(w[i * 180 + 1 : i * 180 + 220], ' ')) AS chunk_md5
FROM (SELECT doc_id, w, unnest(range(0, CAST(ceil(greatest(len(w) - 40, 1) / 180.0) AS BIGINT))) AS i FROM w)""")
def chunk_windows(spark, sf):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    w = load(spark, sf, "documents").select("doc_id", F.posexplode(T.windows(words, 220, 40)).alias("seq", "chunk"))
    return w.select("doc_id", F.col("seq").cast("long").alias("seq"), F.md5("chunk").alias("chunk_md5"))


@query("chunk_pack")
def chunk_pack(spark, sf):
    """Paragraphs packed greedily; tests hold its goldens."""
    return assembly.chunks(load(spark, sf, "documents")).select("doc_id", "seq", "chunk_id", F.md5("text").alias("chunk_md5"))


@query("roman_numbers", f"SELECT doc_id, roman, CAST(1 + doc_id % 99 AS INTEGER) AS value FROM ({ROMAN_SQL})")
def roman_numbers(spark, sf):
    return derived(spark, sf, ROMAN_SQL).select("doc_id", "roman", T.roman(F.col("roman")).alias("value"))


@query("normalize_stem")
def normalize_stem(spark, sf):
    """Stemmed and folded tokens of the French documents; tests hold the stemmer's goldens."""
    from lorevine.functions.stemmer import normalize

    return load(spark, sf, "documents").filter("lang = 'fr'").select("doc_id", F.md5(normalize("text")).alias("normalized_md5"))


@query("html_lines")
def html_lines(spark, sf):
    """Text blocks of the web pages; a lookahead keeps the pattern out of RE2."""
    from lorevine.sources.lines import html_lines as blocks

    return blocks(load(spark, sf, "pages"))


@query("embed_passages")
def embed_passages(spark, sf):
    """The offline embedder over the benchmark passages."""
    from lorevine.operators.models import embed

    return embed(load(spark, sf, "benchmark"), "text").select("item_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))
