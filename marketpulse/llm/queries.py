"""One query per operator over the whole given tables, and the oracle SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, context_mixing, importance, merkle, mixing, near_duplicates, outliers, packing, personal_data, secrets, sharding, winnowing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.language_model_scores(_table(spark, sf_dir, "documents"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprint_digests(_table(spark, sf_dir, "documents"))


def op4_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judged(_table(spark, sf_dir, "documents"))


def op7_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"))


def op8_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(_table(spark, sf_dir, "documents"))


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(_table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op12_vocabulary_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(_table(spark, sf_dir, "documents"))


def op13_merkle_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_proofs(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_importance_sample,
        op2_context_mixing,
        op3_winnowing,
        op4_label_propagation,
        op5_soft_mixing,
        op6_robust_outliers,
        op7_trie_bpe,
        op8_semi_markov_pii,
        op9_secret_forest,
        op10_near_duplicates,
        op11_retrieval_packing,
        op12_vocabulary_alignment,
        op13_merkle_climb,
    )
}

# The contract's set is one row of words per shingle; components by repeated minimum over links.
ORACLE_SQL = {
    "op10_near_duplicates": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * inter >= 75 * (x.n + y.n - inter)),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM split
  UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen),
lowest AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT split.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, component_id, split.doc_id = component_id AS kept
FROM split LEFT JOIN sizes USING (doc_id) JOIN lowest ON lowest.node = split.doc_id
""",
    # Levels by repeated aggregation; the checksum that picks tampered rows is computed bit by bit.
    "op13_merkle_climb": r"""
WITH RECURSIVE plain AS (
  SELECT doc_id, source, text, lang, n_chars,
         coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
         list_reduce(range(0, 8 * length(doc_id::VARCHAR))::UBIGINT[], lambda c, i:
           (xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::BIGINT, 1))::UBIGINT ELSE 0 END) >> 1)
           .xor(CASE WHEN xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::BIGINT, 1))::UBIGINT ELSE 0 END) % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END),
           4294967295::UBIGINT) AS state
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(octet_length(encode(text)) || ':' || CASE WHEN xor(state, 4294967295::UBIGINT) % 5 = 0
           THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS shown
  FROM plain),
trees AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) AS n FROM leaves GROUP BY source),
placed AS (
  SELECT t.tree, t.n, row_number() OVER (PARTITION BY t.tree ORDER BY l.doc_id NULLS FIRST, leaf) - 1 AS idx, l.doc_id, leaf, shown
  FROM leaves l JOIN trees t ON l.source IS NOT DISTINCT FROM t.source),
inner_nodes (tree, level, idx, n, digest) AS (
  SELECT tree, 0::BIGINT, idx, n, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM inner_nodes WHERE n > 1 GROUP BY tree, level, idx // 16, n),
subroots AS (SELECT tree, digest FROM inner_nodes WHERE n = 1),
outer_nodes (level, idx, n, digest) AS (
  SELECT 0::BIGINT, tree, (SELECT count(*) FROM trees), digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM outer_nodes WHERE n > 1 GROUP BY level, idx // 16, n),
families AS (
  SELECT tree, level, idx // 16 AS up, list(digest ORDER BY idx) AS children FROM inner_nodes WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT -1, level, idx // 16, list(digest ORDER BY idx) FROM outer_nodes WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT p.tree, p.idx, f.level AS step, f.children, p.idx // (16 ** f.level)::BIGINT % 16 AS spot
  FROM placed p JOIN families f ON f.tree = p.tree AND f.up = p.idx // (16 ** (f.level + 1))::BIGINT
  UNION ALL
  SELECT p.tree, p.idx, 1000 + f.level, f.children, p.tree // (16 ** f.level)::BIGINT % 16
  FROM placed p JOIN families f ON f.tree = -1 AND f.up = p.tree // (16 ** (f.level + 1))::BIGINT),
paths AS (
  SELECT tree, idx, list(array_to_string(list_slice(children, 1, spot), '') || '|' || array_to_string(list_slice(children, spot + 2, 16), '') ORDER BY step) AS path
  FROM steps GROUP BY tree, idx),
folded AS (
  SELECT p.*, coalesce(path, []) AS path,
         list_reduce(list_prepend(shown, coalesce(path, [])), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root
  FROM placed p LEFT JOIN paths USING (tree, idx)),
root AS (SELECT digest AS root FROM outer_nodes WHERE n = 1)
SELECT doc_id, leaf, digest AS subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded JOIN subroots USING (tree) CROSS JOIN root
""",
}
