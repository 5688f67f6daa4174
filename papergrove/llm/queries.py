"""The registered queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_wrapper, jaccard, media, merkle, mixing, ordinal, packing, patricia, repair, repetition, tokenbin, toxicity, warc
from .runtime import prepare

VOCABULARY = "word_bpe_49k.json"
SEQUENCE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(spark, table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.main_texts(spark, table(spark, sf_dir, "pages"))


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(spark, table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark, table(spark, sf_dir, "documents"))[0]


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.corpus_table(spark, table(spark, sf_dir, "documents"), VOCABULARY)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(spark, table(spark, sf_dir, "documents"), 3, 90, 100)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(spark, table(spark, sf_dir, "pages"))).drop("url")


def op8_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.train(spark, docs, ordinal.graded(table(spark, sf_dir, "labels")))
    return ordinal.classify(spark, docs, model)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), VOCABULARY, SEQUENCE)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(spark, docs, model).select("doc_id", "held_out", "score", "predicted", F.col("n_hits"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_repairs(spark, table(spark, sf_dir, "conversations"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patricia.exact_dedup(spark, table(spark, sf_dir, "documents"), keep="largest")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_media, op2_main_text, op3_repetition, op4_mixing, op5_token_files, op6_jaccard, op7_warc, op8_ordinal, op9_packing, op10_toxicity, op11_repair, op12_exact_dedup, op13_manifest)}

OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), both_have AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM both_have JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN size s ON s.doc_id = d.doc_id GROUP BY d.doc_id, s.n
"""

OP7_SQL = """
WITH page AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), coded AS (
  SELECT page_id, payload_bytes, h, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
         min(page_id) OVER (PARTITION BY h) AS first_id
  FROM page
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM coded
"""

OP11_SQL = """
WITH RECURSIVE given AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)),
                            lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS k FROM given
), damaged AS (
  SELECT g, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS i,
         row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged
), judged AS (
  SELECT g, i, turn, role, text, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) AS was, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'copy' WHEN right(bare, 1) IN ('.', '!', '?') THEN 'fine' ELSE 'cut' END AS fault FROM placed
), sums AS (
  SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'copy') AS duplicate, count(*) FILTER (fault = 'cut') AS truncated,
         count(*) FILTER (was IS NOT NULL AND was || c NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY g
), insertion(p, q, edits, lines) AS (
  VALUES (0, 0, '', []::VARCHAR[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (3, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])
), edit(p, q, c, op, cost) AS (
  VALUES (0, 1, 's', 'K', 0), (0, 2, 'u', 'K', 0), (1, 2, 'u', 'K', 0), (3, 2, 'u', 'K', 0), (2, 3, 'a', 'K', 0), (0, 2, '', 'R', 1), (1, 2, '', 'R', 1), (3, 2, '', 'R', 1), (2, 3, '', 'R', 1), (0, 0, '', 'D', 2), (1, 1, '', 'D', 2), (2, 2, '', 'D', 2), (3, 3, '', 'D', 2)
), step AS (
  SELECT g, 0::BIGINT AS i, 0 AS phase, {'cost': 0, 'edits': '', 'lines': []::VARCHAR[]} AS best FROM sums
  UNION ALL
  SELECT s.g, s.i + 1, e.q, min({'cost': (s.best.cost + 5 * length(a.edits) + e.cost + CASE WHEN j.fault = 'cut' AND e.op <> 'D' THEN 5 ELSE 0 END)::INT, 'edits': s.best.edits || a.edits || e.op,
    'lines': list_concat(s.best.lines, a.lines, CASE e.op WHEN 'D' THEN [] WHEN 'K' THEN [j.role || ':' || j.text] ELSE [CASE e.q WHEN 2 THEN 'user:' ELSE 'assistant:' END || j.text] END)})
  FROM step s JOIN insertion a ON a.p = s.phase JOIN judged j ON j.g = s.g AND j.i = s.i + 1 JOIN edit e ON e.p = a.q AND (e.op <> 'K' OR e.c = j.c) AND (e.op = 'D' OR j.fault IN ('fine', 'cut')) GROUP BY s.g, s.i, e.q
), done AS (
  SELECT s.g, min({'cost': (s.best.cost + 5 * length(a.edits))::INT, 'edits': s.best.edits || a.edits, 'lines': list_concat(s.best.lines, a.lines)}) AS best
  FROM step s JOIN sums USING (g) JOIN insertion a ON a.p = s.phase WHERE s.i = n AND a.q IN (0, 3) GROUP BY s.g
)
SELECT DISTINCT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.edits, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM given LEFT JOIN sums USING (g) LEFT JOIN done USING (g)
"""

OP12_SQL = """
WITH text AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM text WINDOW same AS (PARTITION BY t)
"""

OP13_SQL = """
WITH RECURSIVE field AS (
  SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
                     lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents
), leaf AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS h,
         sha256(head || coalesce(strlen((n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR) || ':' || (n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END), '-') || tail) AS claim
  FROM field
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf
), node AS (
  SELECT tree, 0 AS lvl, pos, h, n FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM node WHERE n > 1 GROUP BY tree, lvl, pos // 2
), top AS (
  SELECT 0 AS lvl, tree AS pos, h, (SELECT count(DISTINCT tree) FROM placed) AS n FROM node WHERE n = 1
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, pos // 2
), path AS (
  SELECT doc_id, h AS leaf, tree, 0 AS lvl, pos, n, claim, '' AS siblings FROM placed
  UNION ALL
  SELECT p.doc_id, p.leaf, p.tree, p.lvl + 1, p.pos // 2, (p.n + 1) // 2,
         sha256(CASE WHEN s.h IS NULL THEN p.claim WHEN p.pos % 2 = 1 THEN s.h || p.claim ELSE p.claim || s.h END), p.siblings || coalesce(s.h, '')
  FROM path p LEFT JOIN node s ON s.tree = p.tree AND s.lvl = p.lvl AND s.pos = xor(p.pos, 1) WHERE p.n > 1
), onward AS (
  SELECT doc_id, leaf, tree, 0 AS lvl, tree AS pos, (SELECT any_value(n) FROM top WHERE lvl = 0) AS n, claim, siblings FROM path WHERE n = 1
  UNION ALL
  SELECT p.doc_id, p.leaf, p.tree, p.lvl + 1, p.pos // 2, (p.n + 1) // 2,
         sha256(CASE WHEN s.h IS NULL THEN p.claim WHEN p.pos % 2 = 1 THEN s.h || p.claim ELSE p.claim || s.h END), p.siblings || coalesce(s.h, '')
  FROM onward p LEFT JOIN top s ON s.lvl = p.lvl AND s.pos = xor(p.pos, 1) WHERE p.n > 1
)
SELECT o.doc_id, o.leaf, b.h AS subroot, r.h AS root, sha256(o.siblings) AS proof_sha256, o.claim AS folded_root, o.claim = r.h AS verified
FROM onward o JOIN node b ON b.tree = o.tree AND b.n = 1 CROSS JOIN (SELECT h FROM top WHERE n = 1) r WHERE o.n = 1
"""

SQL: dict[str, str] = {"op11_repair": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_manifest": OP13_SQL, "op6_jaccard": OP6_SQL, "op7_warc": OP7_SQL}
