"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curve_packing, hmm_lm, html_text, language, merkle, mixing, near_dedup, piece_scan, prefix_trie, quality, token_store, topk_search, url_filter
from .common import crc_mod, table

#: The tables bring no list of hosts. The url query lists those whose MD5 is under this text: about an eighth of all.
LISTED_UNDER = "2"
END_ID = 2
PACK_END_ID = 1


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "is_first")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    coded = piece_scan.encode_to_digest(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return coded.select("doc_id", "n_tokens", "ids_crc32", "n_chunks", "round_trip")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = language.fit(docs.filter(~held), "text", "lang", "doc_id")
    out = language.predict(docs.select("doc_id", "text", held.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op8_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return hmm_lm.score(docs, crc_mod(F.col("doc_id"), 7) == 2)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host"))
    listed = hosts.filter(F.md5("host") < LISTED_UNDER).distinct()
    return url_filter.filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_store.stored(docs, tokenizer_path("word_bpe_49k.json"), END_ID)


def op11_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return curve_packing.packed_digest(docs, tokenizer_path("word_bpe_49k.json"), PACK_END_ID)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.trie(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = merkle.manifest(table(spark, sf_dir, "documents"))
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_mixing, op3_quality, op4_html_text, op5_piece_scan, op6_language, op7_topk_search, op8_hmm_lm, op9_url_filter, op10_token_store, op11_curve_packing, op12_prefix_trie, op13_merkle_manifest)}


_OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP9 = """
WITH p AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS rv
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id)
SELECT p.page_id, host, path, rule,
       coalesce(rv, CASE WHEN md5(host) < '2' THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (page_id)
"""


#: Unsigned CRC-32 of text {0}, from the table of its 256 remainders, which a rule builds.
_CRC_TABLE = "crc(t) AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS UBIGINT))), lambda c, b: xor(crc.t[CAST((xor(c, b) & 255) + 1 AS BIGINT)], c >> 8)), CAST(4294967295 AS UBIGINT))"

_OP12 = f"""
WITH {_CRC_TABLE},
o AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
c AS (SELECT conv_id, l, CAST({_CRC.format("CAST(conv_id AS VARCHAR)")} % 6 AS BIGINT) AS h FROM o, crc),
b AS (SELECT c.conv_id, list_concat(coalesce(list_slice(p.l, 1, h), []), list_slice(c.l, h + 1, len(c.l))) AS l FROM c LEFT JOIN o p ON p.conv_id = c.conv_id - c.conv_id % 100),
x AS (SELECT conv_id, len(l) AS n, CAST(d AS BIGINT) AS depth, list_slice(l, 1, d) AS p FROM b, unnest(range(0, len(l) + 1)) AS u(d)),
n AS (
  SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(p[depth].t) END AS own,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM x GROUP BY depth, p),
k AS (SELECT q.depth, q.p, count(*) AS n_children FROM n q JOIN n z ON z.depth = q.depth + 1 AND list_slice(z.p, 1, q.depth) = q.p GROUP BY q.depth, q.p),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, p)),
a AS (
  SELECT q.depth, q.p, CAST(count(*) FILTER (WHERE z.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(z.own) AS BIGINT) AS saved_tokens
  FROM m q JOIN m z ON z.depth >= q.depth AND list_slice(z.p, 1, q.depth) = q.p GROUP BY q.depth, q.p)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN a ON a.depth = m.depth AND a.p = m.p LEFT JOIN m up ON up.depth = m.depth - 1 AND up.p = list_slice(m.p, 1, m.depth - 1)
"""


def _part(value: str) -> str:
    return f"coalesce(concat(strlen(CAST({value} AS VARCHAR)), ':', CAST({value} AS VARCHAR)), '-')"


_AHEAD = " || ".join(_part(c) for c in ("doc_id", "source", "lang", "n_chars"))
_OP13 = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (
  SELECT doc_id, coalesce('s' || source, '') AS s, sha256({_AHEAD} || {_part("text")}) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND CAST({_CRC.format("CAST(doc_id AS VARCHAR)")} % 2 AS INT) = 0 THEN sha256({_AHEAD} || {_part("replace(text, chr(10), '')")}) END AS alt
  FROM documents, crc),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM d),
t(s, k, i, n, h) AS (
  SELECT s, 0, i, n, leaf FROM r
  UNION ALL
  SELECT s, k + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY s, k, i // 3),
b AS (SELECT s, k AS top, h AS subroot, row_number() OVER (ORDER BY s) - 1 AS bi, count(*) OVER () AS bn FROM t WHERE n = 1),
u(k, i, n, h) AS (
  SELECT 0, bi, bn, subroot FROM b
  UNION ALL
  SELECT k + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY k, i // 3),
tw AS (SELECT s, k, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS g
       FROM t WHERE n > 1 WINDOW w AS (PARTITION BY s, k, i // 3 ORDER BY i)),
uw AS (SELECT k, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS g
       FROM u WHERE n > 1 WINDOW w AS (PARTITION BY k, i // 3 ORDER BY i)),
p AS (
  SELECT r.s, r.i, tw.k AS step, l, g FROM r JOIN tw ON tw.s = r.s AND tw.i = r.i // CAST(pow(3, tw.k) AS BIGINT)
  UNION ALL
  SELECT r.s, r.i, b.top + uw.k, l, g FROM r JOIN b USING (s) JOIN uw ON uw.i = b.bi // CAST(pow(3, uw.k) AS BIGINT)),
f(s, i, step, v) AS (
  SELECT s, i, 0, coalesce(alt, leaf) FROM r
  UNION ALL
  SELECT f.s, f.i, step + 1, sha256(l || v || g) FROM f JOIN p USING (s, i, step)),
e AS (SELECT s, i, arg_max(v, step) AS v FROM f GROUP BY s, i),
q AS (SELECT s, i, string_agg(l || g, '' ORDER BY step) AS proof FROM p GROUP BY s, i)
SELECT r.doc_id, r.leaf, b.subroot, u.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, v AS folded_root, v = u.h AS verified
FROM r JOIN b USING (s) JOIN e USING (s, i) LEFT JOIN q USING (s, i) JOIN u ON u.n = 1
"""


def _op3_sql() -> str:
    stop = ", ".join("'" + w + "'" for w in sorted(quality.STOP_WORDS))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tok AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (
  SELECT doc_id, i, row(word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS g, lead(i, 4) OVER o AS last
  FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win WHERE last IS NOT NULL) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM dup, range(5) AS r(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(ws, lambda x: list_contains([{stop}], lower(x)))) AS BIGINT) AS n_stop
  FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 1.5 AND 20 AND n_symbols / greatest(word_chars, 1) <= 0.1
       AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_stop / greatest(n_words, 1) >= 0.02 AND n_words / greatest(n_lines, 1) >= 1 AS kept
FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality": _op3_sql(), "op7_topk_search": _OP7, "op9_url_filter": _OP9, "op12_prefix_trie": _OP12, "op13_merkle_manifest": _OP13}
