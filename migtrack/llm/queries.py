"""Registered queries of the numbered operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bin_packing, exact_dedup, lexical, merkle, near_dedup, pii, quality_rules, secret_scan, simhash, source_mix, substring_dedup, token_counts,
    vector_topk)
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.findings(table(spark, sf_dir, "documents"), reach=None))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken_words(table(spark, sf_dir, "documents"))


def op4_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack(table(spark, sf_dir, "documents"))


def op5_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_topk.search(vectors, vectors.filter("vec_id % 100 = 0"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicated(table(spark, sf_dir, "documents"), texts=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.findings(table(spark, sf_dir, "documents")))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents")).drop("position")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_secret_scan": op2_secret_scan,
    "op3_source_mix": op3_source_mix,
    "op4_bin_packing": op4_bin_packing,
    "op5_vector_topk": op5_vector_topk,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_pii": op7_pii,
    "op8_near_dedup": op8_near_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_simhash": op11_simhash,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_lexical_search": op13_lexical_search,
}

_OP9_SQL = r"""WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM d"""

_OP5_SQL = """WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id,
    CAST(list_sum([q.w[i] * c.w[i] FOR i IN range(1, least(len(q.w), len(c.w)) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""

# CRC-32 (reflected, 0xEDB88320) bit by bit, as DuckDB has no function for it; a node's way up is a list of its siblings,
# marked L, R or N (none) by side, and folding goes through that list
_OP12_SQL = r"""WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
      || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    xor(list_reduce([4294967295::UBIGINT] || [ascii(c)::UBIGINT FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
      lambda a, b: list_reduce([xor(a, b)] || [0::UBIGINT FOR i IN range(8)],
        lambda u, z: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384::UBIGINT) ELSE u >> 1 END)), 4294967295::UBIGINT) AS crc
  FROM documents),
l AS (
  SELECT doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || tail) AS leaf,
    sha256(head || CASE WHEN n_chars IS NULL THEN '-'
      ELSE strlen(CAST(n_chars + (crc % 7 = 0)::INT AS VARCHAR)) || ':' || (n_chars + (crc % 7 = 0)::INT) END || tail) AS given FROM d),
p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) AS grp,
    row_number() OVER () AS id FROM l),
t AS (
  SELECT 0 AS level, grp, pos, n, leaf AS h FROM p
  UNION ALL
  SELECT level + 1, grp, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1
  GROUP BY level, grp, pos // 2, n),
s AS (SELECT grp, h AS subroot, grp - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM s
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1
  GROUP BY level, pos // 2, n),
levels AS (SELECT DISTINCT level, grp, n FROM t WHERE n > 1),
low AS (
  SELECT p.id, list(CASE WHEN t.h IS NULL THEN 'N' WHEN (p.pos >> v.level) & 1 = 1 THEN 'L' || t.h ELSE 'R' || t.h END ORDER BY v.level) AS way
  FROM p JOIN levels v ON v.grp = p.grp LEFT JOIN t ON t.grp = p.grp AND t.level = v.level AND t.pos = xor(p.pos >> v.level, 1) GROUP BY p.id),
top AS (
  SELECT s.grp, list(CASE WHEN u.h IS NULL THEN 'N' WHEN (s.pos >> v.level) & 1 = 1 THEN 'L' || u.h ELSE 'R' || u.h END ORDER BY v.level) AS way
  FROM s JOIN (SELECT DISTINCT level FROM u WHERE n > 1) v ON true LEFT JOIN u ON u.level = v.level AND u.pos = xor(s.pos >> v.level, 1)
  GROUP BY s.grp),
w AS (
  SELECT p.doc_id, p.leaf, p.given, s.subroot, (SELECT h FROM u WHERE n = 1) AS root,
    list_concat(coalesce(low.way, []), coalesce(top.way, [])) AS way
  FROM p JOIN s ON s.grp = p.grp LEFT JOIN low ON low.id = p.id LEFT JOIN top ON top.grp = p.grp),
f AS (
  SELECT *, list_reduce([given] || way, lambda a, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || a) WHEN 'R' THEN sha256(a || x[2:])
    ELSE sha256(a) END) AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([x[2:] FOR x IN way], '')) AS proof_sha256, folded_root,
  folded_root = root AS verified FROM f"""

_OP13_SQL = r"""WITH q AS (
  SELECT item_id, row_number() OVER () AS item,
    list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark),
d AS (
  SELECT doc_id, row_number() OVER () AS doc,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
c AS (SELECT count(*) AS n, sum(len(terms))::HUGEINT AS l FROM d WHERE len(terms) > 0),
t AS (SELECT doc_id, doc, len(terms) AS size, unnest(terms) AS term FROM d),
f AS (SELECT doc_id, doc, size, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, c GROUP BY term, c.n),
s AS (
  SELECT a.item_id, a.item, f.doc_id, f.doc,
    CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * CAST(100 - 50 + (50 * f.size * c.n) // c.l AS BIGINT)))) AS BIGINT) AS score
  FROM (SELECT item_id, item, unnest(terms) AS term FROM q) a JOIN f USING (term) JOIN w USING (term), c GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, doc) AS rank FROM s WHERE score > 0)
WHERE rank <= 50"""

ORACLE_SQL: dict[str, str] = {
    "op5_vector_topk": _OP5_SQL,
    "op9_exact_dedup": _OP9_SQL,
    "op12_merkle_manifest": _OP12_SQL,
    "op13_lexical_search": _OP13_SQL,
}
