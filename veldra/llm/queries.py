"""The registered queries of the corpus operators, one ``opN_<name>`` each, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm import lines, mixing, multi_index, packing, pii, search, secrets, simhash, toxicity, warc
from veldra.llm.common import materialize, new_path, tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.more_like_this(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), "toxic")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(_table(spark, sf_dir, "embeddings"))


#: The key of the registered query, whose results must not change; callers bring their own.
QUERY_KEY = b"op6_surrogates"


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    return out.select("doc_id", "text", "n_entities")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    out = warc.read_archives(spark, path, payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = secrets.dictionary(vocabulary("word_bpe_49k.json"))
    with tables():
        forest = secrets.train(materialize(secrets.findings(spark, words), "findings"), words)
    out = secrets.scan(_table(spark, sf_dir, "documents"), forest, words)
    return out.select("doc_id", "pos", "value", F.round("p_secret", 6).alias("p_secret"), "is_secret")


QUERIES = {
    "op1_search": op1_search,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_multi_index": op5_multi_index,
    "op6_surrogates": op6_surrogates,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_secrets": op10_secrets,
}

OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
st AS (SELECT count(*) AS n, (SELECT count(*) FROM w) / count(*) AS mean FROM documents),
df AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term),
q AS (SELECT doc_id AS query_id, term, idf FROM tf JOIN df USING (term) WHERE doc_id % 100 = 0 AND df >= 2),
s AS (SELECT query_id, tf.doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT mean FROM st)))), 6) AS score
      FROM q JOIN tf USING (term) JOIN dl ON dl.doc_id = tf.doc_id WHERE tf.doc_id <> query_id GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s QUALIFY rank <= 10
"""

OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r FROM src),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST(r % 3 AS INT) + 1]::DOUBLE AS w, 3.0 * source_size::DOUBLE AS cap,
             [1.5, 1.0, 0.5][CAST(r % 3 AS INT) + 1]::DOUBLE AS a FROM ranked),
lev AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
fin AS (SELECT level AS l FROM lev WHERE cap >= w * level ORDER BY cap / w, r LIMIT 1),
tgt AS (SELECT source, source_size, a, least(cap, w * coalesce((SELECT l FROM fin), 0.0)) AS target FROM lev),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.a, CAST(round(t.target) AS BIGINT) AS goal,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source),
used AS (
  SELECT *, greatest(0, least(size, goal - place)) AS u0, greatest(0, least(size, goal - place - source_size)) AS u1,
         greatest(0, least(size, goal - place - 2 * source_size)) AS u2 FROM placed),
y AS (SELECT *, least(1.0, (place + u0 / 2.0) / target) AS y FROM used)
SELECT doc_id, size, source_size, target, CAST(u0 + u1 + u2 AS BIGINT) AS taken,
       CASE WHEN u0 > 0 THEN round(least(1.0, 2 * y / (a + sqrt(greatest(a * a + 4 * (1 - a) * y, 0)))), 9) END AS position
FROM y
"""

OP7_SQL = r"""
WITH exploded AS (
  SELECT doc_id, md5(coalesce(text, '')) AS tkey, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, rid, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM exploded),
k AS (SELECT doc_id, rid, pos, line,
  translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, bad.key IS NOT NULL AND k.doc_id IS DISTINCT FROM bad.keep AS gone FROM k LEFT JOIN bad ON k.key = bad.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, rid
"""

OP9_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS keep FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN keep IS NULL OR page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM k
"""

ORACLE_SQL = {"op1_search": OP1_SQL, "op9_warc": OP9_SQL, "op4_mixing": OP4_SQL, "op7_line_dedup": OP7_SQL}
