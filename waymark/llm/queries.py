"""The registered queries of this subpackage and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bpe, embedding_dedup, html_text, langid, ngram_join, toxicity, warc
from waymark.llm.common import LOWER, UPPER, crc_part, read, scratch
from waymark.llm.exact_dedup import annotate
from waymark.llm.mixing import EPOCHS, MOST_RATE, RATE_DIGITS, SEED, TEMPERATURE, mix
from waymark.llm.sharding import write_shards


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copy", "n_copies", F.round("rate", 6).alias("rate"), "mix_key", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source AS src, CAST(sum(octet_length(encode(t)) + 1) AS BIGINT) AS bytes FROM d GROUP BY source),
w AS (SELECT *, pow(CAST(bytes AS DOUBLE), {TEMPERATURE}e0) AS w FROM s),
e AS (SELECT src, CAST(printf('%.{RATE_DIGITS - 1}e', {EPOCHS}e0 * CAST((SELECT sum(bytes) FROM s) AS DOUBLE) * w / (SELECT sum(w) FROM w) / bytes) AS DOUBLE) AS rate FROM w),
r AS (SELECT src, rate, CAST(ceil(rate / {MOST_RATE}e0) AS BIGINT) AS parts, rate / ceil(rate / {MOST_RATE}e0) AS mean FROM e),
k AS (SELECT src, mean, CAST(k AS INTEGER) AS k FROM r, range(0, 1500) AS g(k) WHERE k <= 30 + mean + 12 * sqrt(mean)),
c AS (SELECT src, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY src ORDER BY k) AS cdf FROM k),
p AS (SELECT d.doc_id, d.source, d.key, md5(d.t) AS text_md5, r.rate, unnest(range(1, r.parts + 1)) AS part FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.src),
u AS (SELECT *, CAST(CAST('0x' || substr(md5(CASE WHEN part = 1 THEN '{SEED}:' ELSE '{SEED}#' || CAST(part AS VARCHAR) || ':' END || key), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496e0 AS u FROM p),
m AS (SELECT u.doc_id, u.source, u.text_md5, u.key, u.rate, u.part, count(*) FILTER (WHERE c.cdf <= u.u) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.src GROUP BY ALL),
n AS (SELECT doc_id, source, text_md5, key, rate, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY ALL)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, CAST(n AS INTEGER) AS n_copies, round(rate, 6) AS rate, substr(md5('{SEED}/' || key || '/' || CAST(copy AS VARCHAR)), 1, 16) AS mix_key, text_md5
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM n WHERE n > 0)
"""


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file()).drop("text")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.annotate(read(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"]).drop("representative")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = read(spark, sf_dir, "pages"), scratch(spark, "warc")
    shards = warc.write_index(warc.write_archives(pages, folder), folder)
    return warc.lookup(pages, folder, shards, with_payload=False).drop("url", "payload")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.training_labels(read(spark, sf_dir, "labels")))
    given = docs.select("doc_id", (crc_part(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return toxicity.score(given, model).drop("text")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.annotate(read(spark, sf_dir, "embeddings"), carry=["vec_id"])


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages")).drop("html")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", crc_part(F.col("doc_id"), 4) == 2)
    model = langid.fit(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = write_shards(read(spark, sf_dir, "documents"), scratch(spark, "shards"))
    return out.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(read(spark, sf_dir, "documents"), carry=["doc_id"])


OP9_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_bpe": op2_bpe,
    "op3_ngram_join": op3_ngram_join,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_html_text": op7_html_text,
    "op8_sharding": op8_sharding,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language": op10_language,
}
OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
SELECT page_id, n AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_aggregate(list_transform(range(0, 5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS INTEGER) * (1 << CAST(4 - j AS INTEGER))), 'sum') AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM (SELECT *, CAST(CAST(unhex(h) AS BIT) AS VARCHAR) AS bits FROM w)
"""

# All pairs, and the least id reachable by repeated minima over links.
OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9e0),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(c.low, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(c.low, v.vec_id)) AS kept
FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = v.vec_id
"""

# Shingles as strings, all pairs that share one, and the least id reachable.
OP3_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
t AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(x) AS h FROM (SELECT doc_id, s, unnest(s) AS x FROM s)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM t a JOIN t b ON a.h = b.h AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * shared >= 75 * (na + nb - shared) UNION ALL SELECT b, a FROM p WHERE 100 * shared >= 75 * (na + nb - shared)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.low, s.doc_id)) AS component_id FROM s LEFT JOIN c ON c.a = s.doc_id
"""

# The pages of these tables mark their article, which is what the operator has to find without looking for the mark.
OP7_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS a FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
d AS (SELECT page_id, url, regexp_replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g') AS t FROM t),
w AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM w
"""

SQL = {"op1_source_mixing": OP1_SQL, "op3_ngram_join": OP3_SQL, "op4_warc": OP4_SQL, "op6_embedding_dedup": OP6_SQL, "op7_html_text": OP7_SQL, "op9_exact_dedup": OP9_SQL}
