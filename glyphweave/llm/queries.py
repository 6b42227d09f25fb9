"""The queries of the operators here, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, linededup, lm, media, mixing, ngram_join, packing, sharding, tokencount, topk


#: Shards of the registered query: one for each reader of a training job.
SHARDS = 64


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_prefixes(_read(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs.select("doc_id", "lang", "text"), langid.fit(docs)).drop("text")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.source_rates(docs))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), shards=SHARDS)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.redelivered(_read(spark, sf_dir, "documents"), F.col("doc_id") % 10 == 0).select("doc_id", "text", "lines_in", "lines_kept")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return lm.score(docs, lm.fit(docs))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_read(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.captioned(_read(spark, sf_dir, "documents")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1,
    "op2_token_counts": op2,
    "op3_language_id": op3,
    "op4_mixing": op4,
    "op5_sharding": op5,
    "op6_line_dedup": op6,
    "op7_lm_scoring": op7,
    "op8_ngram_jaccard_join": op8,
    "op9_media_columns": op9,
    "op10_best_fit_packing": op10,
}
_WORDS = "CASE WHEN text IS NULL OR trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' ')) END"

SQL: dict[str, str] = {
    "op1_exact_top_k": f"""
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {topk.EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id)::INT AS rank FROM s)
SELECT query_id, rank, neighbour_id, score FROM r WHERE rank <= {topk.K}""",
    "op5_sharding": f"""
WITH b AS (SELECT *, sum(coalesce(strlen(text), 0)) OVER (ORDER BY doc_id NULLS FIRST) AS upto, sum(coalesce(strlen(text), 0)) OVER () AS total FROM documents)
SELECT doc_id, text, lang, source, n_chars, CASE WHEN doc_id IS NULL THEN 0 ELSE (SELECT count(*) FROM range(1, {SHARDS}) j(j) WHERE upto > total * j // {SHARDS}) END::INT AS shard FROM b""",
    "op9_media_columns": """
WITH l AS (SELECT doc_id, lang, text, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, lang, unnest(a) AS line, unnest(range(len(a))) AS no FROM l),
o AS (SELECT *, strlen(line) AS size, 24 + 8 + sum(strlen(line)) OVER (PARTITION BY doc_id ORDER BY no) - strlen(line) AS pos FROM u)
SELECT doc_id, 1::BIGINT AS track_id, 'vide' AS kind, CASE lang WHEN 'en' THEN 'avc1' WHEN 'fr' THEN 'hvc1' WHEN 'de' THEN 'av01' WHEN 'es' THEN 'vp09' ELSE 'mp4v' END AS codec,
       1000::BIGINT AS timescale, sum(500 + 10 * length(line))::BIGINT AS duration, count(*) AS samples,
       list(pos::BIGINT ORDER BY no) FILTER (WHERE no % 12 = 0) AS key_start, list((pos + size)::BIGINT ORDER BY no) FILTER (WHERE no % 12 = 0) AS key_end, NULL::VARCHAR AS error
FROM o GROUP BY doc_id, lang
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'empty' FROM documents WHERE text IS NULL""",
    "op4_mixing": f"""
WITH t AS (SELECT source, sum({_WORDS})::BIGINT AS tokens FROM documents GROUP BY source),
w AS (SELECT *, pow(tokens::DOUBLE, {mixing.ALPHA}) AS w FROM t),
r AS (SELECT source, CASE WHEN tokens = 0 THEN 1.0 ELSE round((w / tokens) / (SELECT min(w / tokens) FROM w WHERE tokens > 0), 6) END AS rate FROM w),
d AS (SELECT documents.*, floor(rate)::INT + (CASE WHEN ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS n
      FROM documents JOIN r ON documents.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(n))::INT AS copy FROM d""",
    "op6_line_dedup": """
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS no FROM s),
k AS (SELECT doc_id, no, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS b FROM l),
r AS (SELECT *, b = '' AS blank, row_number() OVER (PARTITION BY b ORDER BY doc_id % 10 = 0, doc_id, no) = 1 AS first FROM k),
g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) FILTER (WHERE blank OR first) AS text,
             count(*) FILTER (WHERE NOT blank) AS lines_in, count(*) FILTER (WHERE first AND NOT blank) AS lines_kept FROM r GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN lines_kept > 0 OR lines_in = 0 THEN g.text ELSE '' END AS text,
       coalesce(lines_in, 0)::INT AS lines_in, coalesce(lines_kept, 0)::INT AS lines_kept
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id""",
    "op8_ngram_jaccard_join": f"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[[:punct:][:space:][:cntrl:]]', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {ngram_join.N} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {ngram_join.N - 2}), lambda i: array_to_string(w[i:i+{ngram_join.N - 1}], ' ')) END)) AS s FROM t WHERE len(w) > 0),
c AS (SELECT min(doc_id) AS rep, list(doc_id) AS docs, s, len(s) AS n FROM g GROUP BY s),
e AS (SELECT rep, n, unnest(s) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep),
near AS (SELECT a, b FROM p WHERE i >= {ngram_join.THRESHOLD} * (na + nb - i) - 1e-9),
l AS (SELECT a AS x, b AS y FROM near UNION ALL SELECT b, a FROM near),
r AS (SELECT rep AS x, rep AS y FROM c UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
k AS (SELECT x AS rep, min(y) AS class_id FROM r GROUP BY x),
m AS (SELECT l.x AS rep, sum(len(c.docs)) AS others FROM l JOIN c ON c.rep = l.y GROUP BY l.x),
o AS (SELECT unnest(c.docs) AS doc_id, class_id, len(c.docs) - 1 + coalesce(others, 0) AS links FROM c JOIN k USING (rep) LEFT JOIN m USING (rep))
SELECT d.doc_id, coalesce(o.class_id, d.doc_id) AS class_id, coalesce(o.links, 0)::BIGINT AS links FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id""",
}
