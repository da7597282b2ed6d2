"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc_convert, bitplane, bwt_dedup, chunk_bpe, crc_resampling, decontam, line_crf, pivot_index, projection_forest, recurrent_lm, shingle_join, toxicity


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score(read(spark, sf_dir, "documents"))


def op2_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_vectors(read(spark, sf_dir, "embeddings"))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_convert.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.digests(read(spark, sf_dir, "documents"))


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_groups(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.plane_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.nearest(read(spark, sf_dir, "embeddings"))


def op12_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crc_resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


#: DuckDB SQL of the queries that SQL can express over whole tables; that of operator 11 is the exact search, which the forest equals
#: where its queue reaches all neighbours (recall is tested apart).  Tokenising, learned scores, edit
#: matching and byte strings of 100 are tested against plain versions in tests/llm instead.
ORACLE = {
    "op3_pivot_index": """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x != 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id != b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) >= 0.9 * a.n * b.n),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept FROM e JOIN r ON r.a = e.vec_id GROUP BY e.vec_id
""",
    "op4_arc_to_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT x, max(page_id) AS last FROM p GROUP BY x)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(x || '00', i * 5 // 4 + 1, 3) AS INT) >> CAST(7 - (i * 5) % 4 AS INT)) & 31) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != last THEN last END AS refers_to
FROM p JOIN m USING (x)
""",
    "op6_shingle_join": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
""",
    "op11_projection_forest": """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL),
good AS (SELECT DISTINCT vec_id, v FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x != 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM good q JOIN good c ON q.vec_id != c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op12_crc_resampling": """
WITH RECURSIVE c AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS x, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, xor(x >> 1, 3988292384 * (x & 1)), k + 1 FROM c WHERE k < 8),
tab AS (SELECT list(x ORDER BY i) AS tab FROM c WHERE k = 8),
t AS (SELECT doc_id, true AS corpus, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
l AS (SELECT doc_id, corpus, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM t),
w AS (SELECT doc_id, corpus, unnest(ws) AS w FROM l),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM w)),
b AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, CAST(length(h) AS BIGINT), 2), lambda i: CAST(CAST('0x' || substr(h, i, 2) AS INT) AS BIGINT))), lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) % 10000 AS b FROM v, tab),
n AS (SELECT b, count(*) FILTER (WHERE corpus) AS s, count(*) FILTER (WHERE NOT corpus) AS t FROM w JOIN b USING (w) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT sum(s)::DOUBLE FROM n) + 10000) / ((s + 1.0::DOUBLE) * ((SELECT sum(t)::DOUBLE FROM n) + 10000)))) AS g FROM n),
m AS (SELECT doc_id, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS weight FROM w JOIN b USING (w) JOIN g USING (b) WHERE corpus GROUP BY doc_id),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM documents LEFT JOIN m USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS o, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM x)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN n_features >= 20 AND o <= 10 * n // 100 THEN o END AS rank FROM r
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
