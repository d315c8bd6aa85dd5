"""The registered query of each operator, with its production parameters, and the SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import chat_format, chunked_bpe, cutting_stock, exact_dedup, packing, periodic_runs, prefix_trie, secrets, simhash, substring_dedup, topk, toxicity, url_filter

#: A bounded rule list (host, path, verdict), fixed by the query's contract.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer(), room=2048, separator=0)


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), size=35)


def op3_bpe_round_trip(spark, sf_dir):
    return chunked_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer())


def toxicity_chain(spark, docs, sf_dir):
    """The categories of ``labels``, in order: junk (quality 0), then toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    return toxicity.train(docs, labels, ["junk", "toxic"])


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity_chain(spark, docs, sf_dir), "toxic")


def op5_url_filter(spark, sf_dir):
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.rules_table(spark, URL_RULES))


def secrets_forest(spark):
    return secrets.train(spark, secrets.labelled_findings(spark))


def op6_secret_scan(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"), secrets_forest(spark))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op8_exact_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_simhash_near_dedup(spark, sf_dir):
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op10_chat_format(spark, sf_dir):
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op11_prefix_trie(spark, sf_dir):
    nodes = prefix_trie.trie(prefix_trie.shared_heads(prefix_trie.turn_marks(table(spark, sf_dir, "conversations"))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_pattern_packing(spark, sf_dir):
    return cutting_stock.pack_by_patterns(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), room=4096, separator=2)


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.collapse_runs(table(spark, sf_dir, "documents"), least=12, change=periodic_runs.looped)


_ALL = (
    op1_best_fit_packing,
    op2_substring_dedup,
    op3_bpe_round_trip,
    op4_toxicity,
    op5_url_filter,
    op6_secret_scan,
    op7_exact_dedup,
    op8_exact_top_k,
    op9_simhash_near_dedup,
    op10_chat_format,
    op11_prefix_trie,
    op12_pattern_packing,
    op13_periodic_runs,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    "op5_url_filter": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM cut),
p AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM parts),
rules(h, pre, says) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
                               ('example.net', '/de/8', 'allow'), ('org', '/es/', 'block'))
SELECT p.page_id, p.host, p.path,
       (SELECT arg_max(h || pre, length(h || pre)) FROM rules WHERE (p.host = h OR p.host LIKE '%.' || h) AND starts_with(p.path, pre)) AS rule,
       coalesce((SELECT arg_max(says, length(h || pre)) FROM rules WHERE (p.host = h OR p.host LIKE '%.' || h) AND starts_with(p.path, pre)), 'allow') AS verdict
FROM p""",
    "op8_exact_top_k": r"""
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op7_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g USING (body)""",
    # A turn's place among its conversation's is all of its order: no two turns of these tables share a number.
    "op11_prefix_trie": r"""
WITH RECURSIVE crc AS (
  SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS t, 1 AS i, 4294967295::BIGINT AS v FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT c, t, i + 1, list_reduce([xor(v, ascii(t[i])::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) FROM crc WHERE i <= length(t)),
h AS (SELECT c, xor(v, 4294967295) % 4 AS h FROM crc WHERE i = length(t) + 1),
o AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations),
r AS (SELECT h.c, i, m, words FROM h JOIN o ON o.c = h.c - h.c % 20 AND i <= h UNION ALL SELECT h.c, i + 4, m, words FROM h JOIN o ON o.c = h.c AND i > h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, m, words FROM r),
p AS (SELECT c, d, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) AS path, words FROM s UNION ALL SELECT c, 0, '', 0 FROM h),
e AS (SELECT c, max(d) AS last FROM p GROUP BY c),
n AS (
  SELECT path, d AS depth, min(p.c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS gain, coalesce(string_agg(CASE WHEN d = last THEN p.c::VARCHAR END, ',' ORDER BY p.c), '') AS ends
  FROM p JOIN e ON e.c = p.c GROUP BY path, d),
k AS (SELECT left(path, length(path) - 32) AS up, count(*) AS children FROM n WHERE depth > 0 GROUP BY up),
t AS (SELECT a.path, count(*) FILTER (k.up IS NULL) AS n_leaves, sum(b.gain) AS saved FROM n a JOIN n b ON starts_with(b.path, a.path) LEFT JOIN k ON k.up = b.path GROUP BY a.path)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.children, 0)::BIGINT AS n_children, t.n_leaves, t.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN t ON t.path = n.path LEFT JOIN k ON k.up = n.path LEFT JOIN n u ON n.depth > 0 AND u.path = left(n.path, length(n.path) - 32)""",
}
