"""The corpus operators applied to their whole tables with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aircapture.llm import (
    addressable, bond, chat, lines, manifest, mixing, pieces, pivots, probminhash, quality, substrings, templates, toxicity,
)
from aircapture.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge(docs, quality.learn(quality.labelled_sample(docs, labels)))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.links(table(spark, sf_dir, "embeddings"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.groups(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "kept")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = ~toxicity.in_training(F.col("doc_id")) & F.col("doc_id").isNotNull()
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted"
    )


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.rotate(table(spark, sf_dir, "conversations"))
    shown = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m.start.cast("string"), m.end.cast("string"))), ",")
    return turns.withColumn("mask", shown)


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addressable.round_trip(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.without_common_lines(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return cleaned.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = manifest.tamper_check(table(spark, sf_dir, "documents"))
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_sentencepiece,
        op3_embedding_near_dedup,
        op4_minhash_near_dedup,
        op5_html_extraction,
        op6_toxicity,
        op7_source_mix,
        op8_chat_formatting,
        op9_token_binary,
        op10_substring_dedup,
        op11_hard_negatives,
        op12_line_dedup,
        op13_merkle_manifest,
    )
}

ORACLES = {
    "op3_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE e IS NOT NULL
), pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.95
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x
)
SELECT v.vec_id, (SELECT count(*) FROM pairs p WHERE p.x = v.vec_id) AS n_links,
       m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = v.vec_id
""",
    "op8_chat_formatting": """
WITH r AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS said,
         CAST(floor(turn / 64.0) AS BIGINT) AS stretch
  FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, stretch ORDER BY turn NULLS FIRST, role, said) AS nth FROM r
), s AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'), t AS (
  SELECT n.conv_id, perspective, stretch, (nth - 1) // 256 AS piece, nth, role = perspective AS mine,
         CASE WHEN role = perspective THEN '<|im_start|>assistant' || chr(10)
              WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || role || chr(10) END AS head,
         said || '<|im_end|>' AS body
  FROM n JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, stretch, piece ORDER BY nth)
            - length(head) - length(body) - 1 AS pos
  FROM t
), p AS (
  SELECT conv_id, perspective, stretch, piece, CAST(count(*) AS INTEGER) AS n_turns,
         string_agg(head || body || chr(10), '' ORDER BY nth) AS text,
         coalesce(string_agg(CASE WHEN mine THEN CAST(pos + length(head) AS BIGINT) || ':' || CAST(pos + length(head) + length(body) AS BIGINT) END,
                             ',' ORDER BY nth), '') AS mask
  FROM o GROUP BY ALL
)
SELECT conv_id, perspective, stretch, piece,
       CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, perspective ORDER BY stretch NULLS FIRST, piece
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       n_turns, text, mask
FROM p
""",
    "op10_substring_dedup": """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), g AS (
  SELECT doc_id, s, list_slice(words, s, s + 19) AS win
  FROM w, unnest(range(1, len(words) - 18)) AS t(s) WHERE len(words) >= 20
), d AS (
  SELECT doc_id, s FROM g QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, s) > 1
), c AS (SELECT doc_id, i FROM d, unnest(range(s, s + 20)) AS t(i) GROUP BY ALL), k AS (
  SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words
              ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5
""",
    "op12_line_dedup": """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT k.doc_id, CAST(count(*) AS BIGINT) AS n_lines, count(c.key) FILTER (k.doc_id <> c.last_doc) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL OR k.doc_id = c.last_doc), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id
""",
    "op13_merkle_manifest": """
WITH RECURSIVE h AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx,
         sha256(a || t) AS leaf, CASE WHEN crc % 2 = 0 THEN sha256(a || u) ELSE sha256(a || t) END AS claim
  FROM (
    SELECT doc_id, source, CAST(xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
               lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS BIGINT) AS crc,
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
             || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS a,
           coalesce(strlen(text) || ':' || text, '-') AS t,
           coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') AS u
    FROM documents
  )
), n AS (
  SELECT source, 0 AS lvl, idx, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM h
  UNION ALL
  SELECT source, any_value(lvl) + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3
  FROM n WHERE n > 1 GROUP BY source, idx // 3
), t AS (
  SELECT source, 0 AS lvl, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, digest, count(*) OVER () AS n FROM n WHERE n = 1
  UNION ALL
  SELECT NULL, any_value(lvl) + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3
  FROM t WHERE n > 1 GROUP BY idx // 3
), b AS (
  SELECT x.source, x.lvl, x.idx, coalesce(string_agg(y.digest, '' ORDER BY y.idx) FILTER (y.idx < x.idx), '') AS l,
         coalesce(string_agg(y.digest, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '') AS r
  FROM n x JOIN n y ON x.source IS NOT DISTINCT FROM y.source AND x.lvl = y.lvl AND x.idx // 3 = y.idx // 3 WHERE x.n > 1 GROUP BY ALL
), c AS (
  SELECT x.lvl, x.idx, coalesce(string_agg(y.digest, '' ORDER BY y.idx) FILTER (y.idx < x.idx), '') AS l,
         coalesce(string_agg(y.digest, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '') AS r
  FROM t x JOIN t y ON x.lvl = y.lvl AND x.idx // 3 = y.idx // 3 WHERE x.n > 1 GROUP BY ALL
), p AS (
  SELECT h.doc_id, b.lvl, l, r FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source AND b.idx = h.idx // CAST(3 ** b.lvl AS BIGINT)
  UNION ALL
  SELECT h.doc_id, 1000 + c.lvl, l, r FROM h JOIN t ON t.lvl = 0 AND h.source IS NOT DISTINCT FROM t.source
  JOIN c ON c.idx = t.idx // CAST(3 ** c.lvl AS BIGINT)
), q AS (
  SELECT doc_id, list({'l': l, 'r': r} ORDER BY lvl) AS steps, sha256(coalesce(string_agg(l || r, '' ORDER BY lvl), '')) AS proof FROM p GROUP BY doc_id
), f AS (
  SELECT h.doc_id, h.claim AS digest, coalesce(q.steps, []) AS steps, 1 AS i FROM h LEFT JOIN q ON h.doc_id IS NOT DISTINCT FROM q.doc_id
  UNION ALL
  SELECT doc_id, sha256(steps[i].l || digest || steps[i].r), steps, i + 1 FROM f WHERE i <= len(steps)
)
SELECT h.doc_id, h.leaf, s.digest AS subroot, z.digest AS root, coalesce(q.proof, sha256('')) AS proof_sha256,
       f.digest AS folded_root, f.digest = z.digest AS verified
FROM h JOIN (SELECT source, digest FROM n WHERE n = 1) s ON h.source IS NOT DISTINCT FROM s.source
JOIN (SELECT digest FROM t WHERE n = 1) z ON true LEFT JOIN q ON h.doc_id IS NOT DISTINCT FROM q.doc_id
JOIN f ON h.doc_id IS NOT DISTINCT FROM f.doc_id AND f.i = len(f.steps) + 1
""",
}
