"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plcatlas.llm import bpe, exact_dedup, language, licenses, mixture, ngram_join, prefix_trie, quality, repair, secrets, simhash, substring_dedup, warc
from plcatlas.plans.registry import Registry

registry = Registry()
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
LEARN_FROM = "crc32(cast(id as string)) % 4 <> 2"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_check(documents(spark, sf_dir), bpe.read_ranks(VOCABULARY), PATTERN)


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(documents(spark, sf_dir)).select("doc_id", "size", "source", "source_size", "target", "taken")


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = warc.write_archives(pages, warc.shared_folder(spark, "warc"))
    return warc.read_archives(files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def remove_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs, LEARN_FROM)
    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out")
    return language.predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.summary(repair.repaired(repair.damaged(conversations(spark, sf_dir))))


def simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(documents(spark, sf_dir))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.with_digests(prefix_trie.prefix_trie(conversations(spark, sf_dir)))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM bad, range(13) t(k)),
flat AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT f.doc_id, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN f.word END, ' ' ORDER BY f.i) AS t
  FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.i = g.i GROUP BY f.doc_id)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

EXACT_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

# Rows are numbered after the damage; the walk keeps for each state the cheapest way there, least audit first. One edit consumes a row or inserts one.
REPAIR_SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
bytes AS (SELECT DISTINCT k, encode(k) AS b FROM src),
crc AS (
  SELECT k, b, 0 AS i, 4294967295::BIGINT AS c FROM bytes
  UNION ALL
  SELECT k, b, i + 1, list_reduce([xor(c, ascii(substr(k, i + 1, 1))::BIGINT), 0, 1, 2, 3, 4, 5, 6, 7],
    lambda a, x: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)) FROM crc WHERE i < strlen(k)),
hit AS (SELECT k, xor(c, 4294967295::BIGINT) % 20 AS h FROM crc WHERE i = strlen(k)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM src JOIN hit USING (k), (VALUES (1), (2)) t(copy) WHERE h <> 0 AND (copy = 1 OR h = 3)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^ \t-\r]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, NOT regexp_matches(text, '[.!?][ \t-\r]*\z') AS cut,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM numbered),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen) AS duplicate,
    count(*) FILTER (NOT blank AND NOT seen AND cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0 AS i, 0 AS used, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM (SELECT DISTINCT conv_id FROM damaged)
  UNION ALL
  SELECT conv_id, i, used, state, cost, audit, lines FROM (
    SELECT o.*, row_number() OVER (PARTITION BY conv_id, i, used, state ORDER BY cost, audit) AS nth FROM (
      SELECT w.conv_id, w.i + (e <> 'I')::INT AS i, CASE WHEN e = 'I' THEN w.used + 1 ELSE 0 END AS used,
        CASE WHEN e = 'D' THEN w.state WHEN e = 'K' AND initial = 's' THEN 1 WHEN w.state = 2 THEN 3 ELSE 2 END AS state,
        w.cost + CASE e WHEN 'D' THEN 4 WHEN 'I' THEN 3 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN e IN ('K', 'R') AND cut THEN 3 ELSE 0 END AS cost, w.audit || e AS audit,
        CASE e WHEN 'D' THEN w.lines WHEN 'K' THEN list_append(w.lines, role || ':' || text)
          ELSE list_append(w.lines, CASE WHEN w.state = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN text ELSE '' END) END AS lines
      FROM walk w CROSS JOIN (VALUES ('D'), ('I'), ('K'), ('R')) t(e) LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
      WHERE CASE e WHEN 'I' THEN w.used < 2 WHEN 'D' THEN j.i IS NOT NULL WHEN 'R' THEN j.i IS NOT NULL AND NOT blank AND NOT seen
        ELSE j.i IS NOT NULL AND NOT blank AND NOT seen AND (initial = 's' AND w.state = 0 OR initial = 'u' AND w.state <> 2 OR initial = 'a' AND w.state = 2) END
    ) o) WHERE nth = 1),
best AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost, audit) AS nth FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i WHERE state IN (0, 3))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.nth = 1
"""

TRIE_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR AS k, 0 AS i, 4294967295::BIGINT AS c FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT conv_id, k, i + 1, list_reduce([xor(c, ascii(substr(k, i + 1, 1))::BIGINT), 0, 1, 2, 3, 4, 5, 6, 7],
    lambda a, x: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)) FROM crc WHERE i < strlen(k)),
own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS turn,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM conversations WHERE conv_id IS NOT NULL),
taken AS (SELECT conv_id, xor(c, 4294967295::BIGINT) % 4 AS h FROM crc WHERE i = strlen(k)),
rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY origin, i) AS d, turn, words FROM (
    SELECT t.conv_id, 0 AS origin, o.i, o.turn, o.words FROM taken t JOIN own o ON o.conv_id = t.conv_id - t.conv_id % 20 AND o.i <= h
    UNION ALL SELECT t.conv_id, 1, o.i, o.turn, o.words FROM taken t JOIN own o ON o.conv_id = t.conv_id AND o.i > h)),
keyed AS (
  SELECT conv_id, d, words, sha256(string_agg(sha256(turn), ',') OVER (PARTITION BY conv_id ORDER BY d)) AS key FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM taken),
chain AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM keyed),
node AS (
  SELECT key, any_value(d) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM chain GROUP BY key),
kids AS (SELECT parent AS key, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY parent),
whole AS (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN kids USING (key)),
above AS (SELECT w.key, a.key AS top, w.n_children, (w.n_convs - 1) * w.words AS saved FROM whole w JOIN keyed o ON o.conv_id = w.conv_id AND o.d = w.depth JOIN keyed a ON a.conv_id = w.conv_id AND a.d <= w.depth),
sums AS (SELECT top AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY top)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM whole w JOIN sums USING (key) LEFT JOIN whole p ON p.key = w.parent
"""

registry.define("op1_byte_bpe", byte_bpe)
registry.define("op2_ngram_jaccard", ngram_jaccard)
registry.define("op3_source_mix", source_mix)
registry.define("op4_warc", warc_round_trip, WARC_SQL)
registry.define("op5_license_scan", license_scan)
registry.define("op6_secret_scan", secret_scan)
registry.define("op7_substring_dedup", remove_substrings, SUBSTRING_SQL)
registry.define("op8_quality_rules", quality_rules)
registry.define("op9_language_id", language_id)
registry.define("op10_exact_dedup", exact_duplicates, EXACT_SQL)
registry.define("op11_conversation_repair", conversation_repair, REPAIR_SQL)
registry.define("op12_simhash", simhash_classes)
registry.define("op13_prefix_trie", conversation_trie, TRIE_SQL)
