"""Tables that queries read: the input folder's, and records, edges, lines, questions and
citations derived from them.

The derived ones are SQL that Spark and DuckDB both read (``FROM documents`` and the like), so a
query and its SQL see the same rows, and as many of them as the input has.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = "CAST(100 + {k} % 97 AS STRING) || '-' || CAST(1 + {k} % 3 AS STRING)"
_OWN, _ASKED, _OTHER = _NUMBER.format(k="doc_id"), _NUMBER.format(k="item_id"), _NUMBER.format(k="(item_id * 5 + 2)")

#: A document is a record: some share an id, some have two versions, some no article, some no text.
RECORDS_SQL = f"""SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'pcg-na-' || CAST(doc_id AS STRING) ELSE 'pcg-' || {_OWN} || CASE WHEN doc_id % 4 = 1 THEN '-c1' ELSE '' END END
|| CASE WHEN doc_id % 11 = 5 THEN '@2024-01-01' ELSE '@2026-01-01' END AS record_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE {_OWN} END AS article,
'Livre I > Titre ' || CASE doc_id % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'iii' WHEN 3 THEN 'X2' ELSE '1' END AS path,
CASE WHEN doc_id % 50 = 7 THEN '' ELSE text END AS text, CASE WHEN doc_id % 13 = 0 OR doc_id % 4 = 1 THEN 'comment' ELSE 'regulatory' END AS type FROM documents"""

#: The same with an id for each document, for what ranks records.
UNIQUE_SQL = f"SELECT doc_id, record_id || '#' || CAST(doc_id AS STRING) AS record_id, article, path, text, type FROM ({RECORDS_SQL}) r"

EDGES_SQL = f"""SELECT doc_id * 2 AS edge_no, record_id AS source_id, 'pcg-' || CAST(100 + (doc_id * 7 + 3) % 120 AS STRING) || '-' || CAST(1 + doc_id % 3 AS STRING) AS target, 'internal' AS family FROM ({RECORDS_SQL}) r
UNION ALL SELECT doc_id * 2 + 1, record_id, 'crc-04-' || CAST(10 + doc_id % 90 AS STRING), CASE WHEN doc_id % 2 = 0 THEN 'historical' ELSE 'external' END FROM ({RECORDS_SQL}) r WHERE doc_id % 5 = 0"""

ROUTE_SQL = f"""SELECT item_id, text || CASE item_id % 4 WHEN 0 THEN ' Que dit l''article ' || {_ASKED} || ' ?' WHEN 1 THEN ' Comparer Art. ' || {_ASKED} || ' et art. ' || {_OTHER}
WHEN 2 THEN '' ELSE ' Les articles ' || {_ASKED} || ' et ' || {_OTHER} || ', puis article ' || {_ASKED} END AS text FROM benchmark"""

_CUT = "substring(text, 1 + CAST(floor(length(text) * (doc_id % 7) / 8) AS INT), 60)"
#: A citation of every record, of three kinds of ids and five of extracts, taken from all over the text.
CITED_SQL = f"""SELECT doc_id AS cite_id, CAST(floor(doc_id / 4) AS BIGINT) AS item_id, CASE doc_id % 6 WHEN 0 THEN replace(replace(record_id, '@2024-01-01', ''), '@2026-01-01', '') WHEN 1 THEN 'pcg-999-' || CAST(doc_id AS STRING) || '@2026-01-01' ELSE record_id END AS record_id,
CASE doc_id % 5 WHEN 0 THEN {_CUT} WHEN 1 THEN replace({_CUT}, ' ', '  ') WHEN 2 THEN substring({_CUT}, 1, 12) WHEN 3 THEN replace({_CUT}, chr(39), '’') ELSE 'Un extrait qui ne figure nulle part dans ce texte' END AS extract FROM ({RECORDS_SQL}) r"""

REWRITES_SQL = f"""SELECT item_id, text || ' article ' || {_ASKED} AS question, text || CASE item_id % 4 WHEN 0 THEN ' ' || {_ASKED} WHEN 1 THEN ' ' || {_ASKED} || ' ' || {_OTHER} WHEN 2 THEN ' 999-1' ELSE '' END AS rewrite,
CASE WHEN item_id % 8 < 4 THEN {_OTHER} ELSE '999-1' END AS gold FROM benchmark"""

ANSWERS_SQL = """SELECT conv_id * 100 + turn AS item_id, length(text) % 3 = 0 AS abstention, CASE conv_id % 3 WHEN 0 THEN 'out_of_scope' WHEN 1 THEN 'fiscal' ELSE 'not_in_corpus' END AS reason FROM conversations WHERE role = 'assistant'"""

#: Texts that cite, in every way there is, by documents.
CITING_SQL = f"""SELECT doc_id, text || CASE doc_id % 8 WHEN 0 THEN ' Voir les articles ' || {_OWN} || ' et 212-2, puis l''article 1844-5 du code civil.' WHEN 1 THEN ' article L. 521-' || CAST(doc_id AS STRING) || ' du Code monétaire et financier et article L. 521-2 du même code.'
WHEN 2 THEN ' Avis CNC n° 2004-' || CAST(doc_id AS STRING) || ' et règlement CRC n° 04-01' WHEN 3 THEN ' règlement n° 2004-06 du CRC, l’article R. 12.3-4 du code de l’énergie' WHEN 4 THEN ' articles 212-1 à ' || {_OWN} || ' du même code' WHEN 5 THEN ' article ' || {_OWN} ELSE '' END AS text FROM documents"""

_TENS = "CASE CAST(floor((1 + doc_id % 99) / 10) AS INT) WHEN 0 THEN '' WHEN 1 THEN 'X' WHEN 2 THEN 'XX' WHEN 3 THEN 'XXX' WHEN 4 THEN 'XL' WHEN 5 THEN 'L' WHEN 6 THEN 'LX' WHEN 7 THEN 'LXX' WHEN 8 THEN 'LXXX' ELSE 'XC' END"
_ONES = "CASE (1 + doc_id % 99) % 10 WHEN 0 THEN '' WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' WHEN 6 THEN 'VI' WHEN 7 THEN 'VII' WHEN 8 THEN 'VIII' ELSE 'IX' END"
ROMAN_SQL = f"SELECT doc_id, {_TENS} || {_ONES} AS roman FROM documents"

_TURN = "(doc_id + seq * (1 + 2 * (doc_id % 3))) % 16"
#: Sentences of documents (``FROM sentences``) in the typography of all kinds of lines.
LINES_SQL = f"""SELECT doc_id, seq, CASE k WHEN 0 THEN 'Livre ' || t WHEN 1 THEN 'Titre II ' || substring(t, 1, 30) WHEN 2 THEN substring(t, 1, 20) WHEN 3 THEN 'Chapitre I ........ 45' WHEN 4 THEN 'Art. 21' || CAST(seq % 10 AS STRING) || '-' || CAST(1 + doc_id % 3 AS STRING) || ' ' || t
WHEN 5 THEN 'Art. 2 bis' WHEN 7 THEN t || ' selon l''article 212-1.' WHEN 9 THEN t || '-' WHEN 10 THEN 'Avis CNC n° 2004-15 ' || substring(t, 1, 20) WHEN 13 THEN '-' WHEN 14 THEN CAST(10 + CAST(floor(seq / 6) AS INT) AS STRING) ELSE t END AS text,
CASE WHEN k = 0 THEN 12.0 WHEN k < 4 THEN 11.0 WHEN k < 10 THEN 10.0 WHEN k < 14 THEN 9.5 WHEN k = 14 THEN 10.0 ELSE 9.2 END AS size, k IN (0, 1, 2, 3, 4, 5, 10) AS bold, CASE WHEN k = 13 THEN 'Symbol' ELSE 'Tahoma' END AS font, CASE WHEN k = 14 THEN 40.0 ELSE 70.0 END AS x, 100.0 + seq AS y,
10 + CAST(floor(seq / 6) AS INT) AS page FROM (SELECT doc_id, seq, trim(t) AS t, {_TURN} AS k FROM sentences) s"""
_SENTENCE = r"[.\n]+ ?"
SENTENCES_SQL = f"""SELECT doc_id, seq, t FROM (SELECT doc_id, unnest(range(0, len(p))) AS seq, unnest(p) AS t FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{_SENTENCE}') AS p FROM documents)) WHERE trim(t) <> ''"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; one that comes in fewer parts than there are cores is dealt out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows of SQL over the input folder's tables, which it names after FROM."""
    names = sorted(set(re.findall(r"FROM (\w+)\b", sql)))
    return spark.sql(re.sub(r"FROM (\w+)\b", r"FROM {\1}", sql), **{name: sentences(spark, sf_dir) if name == "sentences" else load(spark, sf_dir, name) for name in names})


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, t: the sentences of all documents."""
    each = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), _SENTENCE)).alias("seq", "t"))
    return each.withColumn("seq", F.col("seq").cast("long")).filter(F.trim("t") != "")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, RECORDS_SQL)


def unique_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, UNIQUE_SQL)


def edges(spark: SparkSession, sf_dir: str, records_sql: str = RECORDS_SQL) -> DataFrame:
    return derived(spark, sf_dir, EDGES_SQL.replace(RECORDS_SQL, records_sql))


def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, ROUTE_SQL)
