"""The registered queries of this folder's operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.llm import hardnegatives, langid, lmscore, manifest, minhash, mixing, packing, rules, simhash, thresholds, tokenfile, topk, warc
from marketpulse.llm.common import fold, table


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a batch of its length bucket. Null and empty texts have length 0, a null doc_id is packed as any other; an empty table gives no row."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned outside the held-out third. Texts without a letter, null or empty are `und`; repeated rows count each; an empty table gives no row."""
    docs = table(spark, sf_dir, "documents")
    langs, model = langid.learn(docs, fold("doc_id", 3) != 1)
    told = langid.identify(docs.withColumn("held_out", fold("doc_id", 3) == 1), langs, model, ["doc_id", "held_out"])
    return told.select("doc_id", "held_out", "lang_pred", "score", "n_langs")


def op3_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids, read back from the token files. Null texts are empty; rows without doc_id come first, ties by text; an empty table gives no row."""
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated rate of every document and whether it is drawn. Null sources and languages are values of their own; a text without words has rate 0; an empty table gives no row."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return mixed.select("doc_id", "n_tokens", F.round("rate", 6).alias("rate"), "kept")


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every text, learned outside the held-out fifth. Null and empty texts are scored as empty ones; repeated rows each; an empty table gives no row."""
    docs = table(spark, sf_dir, "documents")
    ensemble = rules.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scored = rules.score(docs, ensemble, ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best inner products of every twentieth vector. Null vectors, and those with null or non-finite components, take no part; ties go to the smaller vec_id."""
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of every text under the models of good documents and of all. Null and empty texts have 0 tokens and null losses; a null doc_id is never a good one; an empty table gives no row."""
    wanted = table(spark, sf_dir, "labels").where(lmscore.good_documents())
    return lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), wanted.select("doc_id"))


def op8_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every text. Null texts have no words and fail the base rules; a stratum without enough labels has no cutoff and keeps what passes them; an empty table gives no row."""
    return thresholds.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader finds in the archives written from all pages. Null html is empty; equal payloads of 100 bytes or more are written once, ties to the smaller page_id; an empty table gives no row."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates over four-word shingles. Null and blank texts link with nothing; rows of one doc_id share a group; an empty table gives no row."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op11_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of fingerprints over three-word shingles. Null and blank texts have fingerprint zero, linked like any other; rows of one doc_id share a group; an empty table gives no row."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, most=3)


def op12_multi_index_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; labels of every seventh are moved on first. Null labels and vectors, and non-finite components, take no part; ties go to the smaller vec_id."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the documents, held against a copy in which half of the texts have lost their line ends."""
    docs = table(spark, sf_dir, "documents")
    rows = manifest.manifest(docs, manifest.without_newlines(F.col("doc_id"), F.col("text")))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_length_buckets, op2_language_mixture, op3_repair_tokens, op4_raked_mixture, op5_rule_ensemble, op6_segment_topk,
    op7_cross_entropy_difference, op8_risk_controlled_rules, op9_warc_segments, op10_circulant_minhash,
    op11_gray_simhash, op12_multi_index_negatives, op13_merkle_manifest)}


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, base: str) -> str:
    """All nodes of trees of threes over base (k, place, digest)."""
    return f"""{name} AS (
  SELECT k, 0 AS level, place, digest, count(*) OVER (PARTITION BY k) AS n FROM {base}
  UNION ALL
  SELECT k, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY k, level, place // 3, n)"""


def _steps(name: str, nodes: str, base: str, first: int) -> str:
    """Per node of base and level: the siblings to the left and to the right."""
    return f"""{name} AS (
  SELECT b.k, b.place, {first} + s.level AS step, coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < b.here), '') AS before,
    coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > b.here), '') AS after
  FROM (SELECT base.k, base.place, v.level, base.place // (3 ** v.level)::BIGINT AS here FROM {base} base
    JOIN (SELECT DISTINCT k, level FROM {nodes} WHERE n > 1) v USING (k)) b
  JOIN {nodes} s ON s.k = b.k AND s.level = b.level AND s.place // 3 = b.here // 3 GROUP BY b.k, b.place, s.level)"""


#: crc32 of the id in decimal, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1) + z))), 4294967295::UBIGINT)"""

#: Word counts and raking are SQL; the topics are tested in the order of the operator. Raking goes on far beyond convergence.
_MIX_SWEEPS = 40
ORACLE_SQL: dict[str, str] = {
    "op4_raked_mixture": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    CASE WHEN text IS NULL THEN '(none)' WHEN contains(text, 'License') OR contains(text, 'license') OR contains(text, 'LICENSE') THEN 'licence'
      WHEN contains(text, '@') THEN 'contact' WHEN contains(text, '|') THEN 'table' ELSE 'prose' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS draw
  FROM documents),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
s AS (SELECT source, pow(sum(tokens), 0.7) AS want FROM c GROUP BY source),
l AS (SELECT lang, pow(sum(tokens), 0.8) AS want FROM c GROUP BY lang),
t AS (SELECT topic, pow(sum(tokens), 0.9) AS want FROM c GROUP BY topic),
g AS (SELECT c.*, s.want / (SELECT sum(want) FROM s) AS to_s, l.want / (SELECT sum(want) FROM l) AS to_l, t.want / (SELECT sum(want) FROM t) AS to_t
  FROM c JOIN s USING (source) JOIN l USING (lang) JOIN t USING (topic)),
r AS (
  SELECT 0 AS step, *, tokens AS weight FROM g
  UNION ALL
  SELECT step + 1, source, lang, topic, tokens, to_s, to_l, to_t, CASE step % 3
      WHEN 0 THEN weight * to_s / sum(weight) OVER (PARTITION BY source)
      WHEN 1 THEN weight * to_l / sum(weight) OVER (PARTITION BY lang)
      ELSE weight * to_t / sum(weight) OVER (PARTITION BY topic) END
  FROM r WHERE step < 3 * {_MIX_SWEEPS}),
f AS (SELECT source, lang, topic, weight / tokens / max(weight / tokens) OVER () AS rate FROM r WHERE step = 3 * {_MIX_SWEEPS})
SELECT doc_id, n_tokens, round(coalesce(rate, 0), 6) AS rate, draw < coalesce(rate, 0) AS kept
FROM d LEFT JOIN f USING (source, lang, topic)""",
    "op12_multi_index_negatives": """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE h AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, {_leaf("text")} AS digest,
    {_leaf(f"CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS told FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, digest) - 1 AS place FROM h),
{_levels("nodes", "leaves")},
subroots AS (SELECT k AS key, '' AS k, digest, row_number() OVER (ORDER BY k) - 1 AS place FROM nodes WHERE n = 1),
{_levels("top", "subroots")},
{_steps("low", "nodes", "leaves", 0)},
{_steps("high", "top", "subroots", 1000)},
steps AS (SELECT * FROM low UNION ALL SELECT l.k, l.place, g.step, g.before, g.after FROM leaves l JOIN subroots s ON s.key = l.k JOIN high g ON g.place = s.place),
paths AS (SELECT k, place, string_agg(before || after, '' ORDER BY step) AS proof, list(before || '#' || after ORDER BY step) AS path FROM steps GROUP BY k, place),
folded AS (
  SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
    list_reduce(list_prepend(l.told, coalesce(p.path, [])), lambda done, s: sha256(split_part(s, '#', 1) || done || split_part(s, '#', 2))) AS folded_root
  FROM leaves l JOIN subroots s ON s.key = l.k LEFT JOIN paths p ON p.k = l.k AND p.place = l.place)
SELECT *, folded_root = root AS verified FROM folded""",
}
