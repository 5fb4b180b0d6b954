"""The registered queries of this subpackage and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stackplume.llm import chunk_dedup, decontaminate, fm_quality, html_extract, jaccard_join, mixing, prefix_trie, quality_rules, secrets_scan, simhash, suffix_dedup, token_align, toxicity
from stackplume.llm.common import held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    lexicon = toxicity.train(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents.select("doc_id", "text"), lexicon)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_contamination(documents, table(spark, sf_dir, "benchmark")))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fm_quality.train(documents, table(spark, sf_dir, "labels"))
    scored = fm_quality.score(documents.select("doc_id", "text", "n_chars"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = secrets_scan.train(documents, table(spark, sf_dir, "labels"))
    return secrets_scan.digest(secrets_scan.scan(documents.select("doc_id", "text"), model))


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedupe(table(spark, sf_dir, "documents")).drop("kept")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.spliced_trie(table(spark, sf_dir, "conversations"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align_public(spark, table(spark, sf_dir, "documents"))[0]


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_extraction": op3_html_extraction,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_secret_scan": op8_secret_scan,
    "op9_chunk_dedup": op9_chunk_dedup,
    "op10_mix_sources": op10_mix_sources,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_token_align": op13_token_align,
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES: dict[str, str] = {
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase
  FROM sized),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i,
    unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase
  FROM d, lengths WHERE len(w) >= n),
found AS (SELECT doc_id, item_id, i, n FROM places JOIN windows USING (n, phrase)),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_prefix_trie": r"""
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, n, conv_id - conv_id % 5 AS head,
    xor(list_reduce(
      list_prepend(4294967295, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
      lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, k: xor(y // 2, (y % 2) * 3988292384))
    ), 4294967295) % 9 AS h
  FROM n),
cut AS (
  SELECT h.conv_id, h.head, h.h, least(h.h, coalesce(b.n, 0)) AS taken, least(h.h, coalesce(b.n, 0)) + greatest(h.n - h.h, 0) AS len
  FROM h LEFT JOIN n AS b ON b.conv_id = h.head),
r AS (
  SELECT cut.conv_id, place AS depth, role, text FROM cut JOIN t ON t.conv_id = cut.head AND place <= taken
  UNION ALL
  SELECT cut.conv_id, place - h + taken, role, text FROM cut JOIN t ON t.conv_id = cut.conv_id AND place > h),
p AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS depth, 'root' AS k, CAST(NULL AS VARCHAR) AS up, CAST(0 AS BIGINT) AS bytes FROM cut
  UNION ALL
  SELECT r.conv_id, r.depth, sha256(p.k || ':' || length(role) || ':' || role || text), p.k, CAST(strlen(text) AS BIGINT)
  FROM p JOIN r ON r.conv_id = p.conv_id AND r.depth = p.depth + 1),
nodes AS (
  SELECT k, any_value(up) AS up, any_value(p.depth) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * max(bytes) AS saved, count(*) FILTER (WHERE len = p.depth) AS ends,
    sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE len = p.depth), '')) AS ends_sha256
  FROM p JOIN cut USING (conv_id) GROUP BY k),
below AS (
  SELECT a.k, count(*) FILTER (WHERE v.ends = v.n_convs) AS n_leaves, CAST(sum(v.saved) AS BIGINT) AS saved_tokens
  FROM nodes AS v JOIN p AS a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.k),
kids AS (SELECT up, count(*) AS n_children FROM nodes GROUP BY up)
SELECT nodes.conv_id, nodes.depth, parent.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, saved_tokens, nodes.ends_sha256
FROM nodes JOIN below ON below.k = nodes.k LEFT JOIN kids ON kids.up = nodes.k LEFT JOIN nodes AS parent ON parent.k = nodes.up""",
}
