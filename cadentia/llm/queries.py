"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hnsw, language, line_dedup, packing, sharding, simhash, substrings, toxicity, warc
from .common import fresh_path, held_out, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Target file size of the sharding query.
SHARD_TARGET = 32 << 20


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out(F.col("doc_id"))))
    return language.identify(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "languages")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it is read back from the newest version of the compacted store: its length and digest."""
    docs = table(spark, sf_dir, "documents")
    store, version = sharding.compact_table(docs, fresh_path(spark, "store"), SHARD_TARGET)
    return store.read(version).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("payload", "url")


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, lexicon).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_language, op2_simhash, op3_sharding, op4_decontaminate, op5_packing, op6_warc, op7_hnsw, op8_toxicity, op9_line_dedup, op10_substrings]
    return {f.__name__: f for f in own}


OP9_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, unnest(range(len(lines) - 2)) AS pos, lines FROM l WHERE len(lines) >= 3),
h AS (SELECT doc_id, pos, array_to_string(lines[pos + 1 : pos + 3], chr(10)) AS win FROM w),
f AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM h),
gone AS (SELECT DISTINCT doc_id, pos + k AS line FROM f, (VALUES (0), (1), (2)) t(k) WHERE nth > 1),
each AS (SELECT doc_id, unnest(range(len(lines))) AS line, unnest(lines) AS txt FROM l),
kept AS (SELECT e.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
  coalesce(string_agg(e.txt, chr(10) ORDER BY e.line) FILTER (WHERE g.line IS NULL), '') AS text
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.line = g.line GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(k.text) AS text_sha256 FROM documents d LEFT JOIN kept k USING (doc_id)
"""

OP4_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, i AS pos, k, array_to_string(w[i + 1 : i + k], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k)),
hit AS (SELECT g.doc_id, g.pos, g.k, q.item_id FROM g JOIN q ON g.win = q.win AND g.k = q.k),
covered AS (SELECT doc_id, count(DISTINCT pos + j) AS n_hit FROM hit, range(10) t(j) WHERE j < k GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(node, root) AS (SELECT vec_id, vec_id FROM e UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


OP3_SQL = "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents"

#: A SHA-1 in hexadecimal, five digits at a time, as four letters of base 32.
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS h FROM p), f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (h)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": OP3_SQL, "op6_warc": OP6_SQL, "op4_decontaminate": OP4_SQL, "op7_hnsw": OP7_SQL, "op9_line_dedup": OP9_SQL}
