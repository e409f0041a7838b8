"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import codec, conversations, decontaminate, line_dedup, lm, manifest, pieces, quality_gam, quality_rules, sharding, simhash, token_counts, warc
from panelwright.llm.runtime import new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_aho_corasick_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op2_rank_synchronous_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_minhash_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op4_attention_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_transducer_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = codec.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return codec.digests(done)


def op6_salvage_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc.read_archives(spark, folder, payloads=False).where("gap is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_pairwise_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_gam.score_quality(docs, quality_gam.train(docs, _table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", (quality_gam.fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def op8_sampled_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))


def op9_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_hashed_ngram_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ruled = quality_rules.apply_rules(docs, quality_rules.train(docs, _table(spark, sf_dir, "labels")), keep=["doc_id"])
    return ruled.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "probability")


def op11_survivor_coalescence_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.summaries(conversations.damage(_table(spark, sf_dir, "conversations")), F.col("present"))


def op12_aligned_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], back=True)
    return pieces.digests(done)


def op13_octopus_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    more = manifest.leaf("doc_id", "source", "lang", F.col("n_chars") + 1, "text")
    proved = manifest.manifest(docs, "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, more))
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_aho_corasick_decontamination, op2_rank_synchronous_token_counts, op3_minhash_line_dedup, op4_attention_lm_scores, op5_transducer_lexicon_bpe, op6_salvage_warc,
        op7_pairwise_gam_quality, op8_sampled_splitter_shards, op9_pigeonring_simhash, op10_hashed_ngram_quality_rules, op11_survivor_coalescence_repair, op12_aligned_sentencepiece,
        op13_octopus_merkle_manifest,
    )
    return {f.__name__: f for f in found}


#: Windows of the items and all runs of as many words of the documents meet by their text.
OP1_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), runs AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
), found AS (
  SELECT doc_id, i, runs.n, item_id FROM runs JOIN wins USING (win)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


#: Whole levels as lists; CRC-32 bit by bit, as DuckDB hasn't it.
OP13_SQL = r"""
WITH RECURSIVE f AS (
  SELECT *, list_reduce(string_split(CAST(doc_id AS VARCHAR), ''), lambda acc, c:
      list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(CAST(acc AS BIGINT), CAST(ascii(c) AS BIGINT))), CAST(4294967295 AS BIGINT)) AS crc
  FROM (SELECT doc_id, lang, n_chars, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents)
), d AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS changed
  FROM f
), p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d
), lv AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY place) AS nodes FROM p GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(1, (len(nodes) + 1) // 2 + 1), lambda i: sha256(nodes[2 * i - 1] || coalesce(nodes[2 * i], ''))) FROM lv WHERE len(nodes) > 1
), s AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM lv WHERE len(nodes) = 1
), tv AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM s
  UNION ALL
  SELECT level + 1, list_transform(range(1, (len(nodes) + 1) // 2 + 1), lambda i: sha256(nodes[2 * i - 1] || coalesce(nodes[2 * i], ''))) FROM tv WHERE len(nodes) > 1
), nodes AS (
  SELECT lang, level, unnest(nodes) AS digest, unnest(range(len(nodes))) AS place FROM lv
), tops AS (
  SELECT level, unnest(nodes) AS digest, unnest(range(len(nodes))) AS place FROM tv
), hops AS (
  SELECT p.lang, p.place, list(CASE WHEN nodes.digest IS NULL THEN 'N' WHEN (p.place >> lv.level) & 1 = 1 THEN 'L' || nodes.digest ELSE 'R' || nodes.digest END ORDER BY lv.level) AS hops
  FROM p JOIN lv ON p.lang IS NOT DISTINCT FROM lv.lang AND len(lv.nodes) > 1
  LEFT JOIN nodes ON p.lang IS NOT DISTINCT FROM nodes.lang AND nodes.level = lv.level AND nodes.place = xor(p.place >> lv.level, 1) GROUP BY p.lang, p.place
), over AS (
  SELECT s.place, list(CASE WHEN tops.digest IS NULL THEN 'N' WHEN (s.place >> tv.level) & 1 = 1 THEN 'L' || tops.digest ELSE 'R' || tops.digest END ORDER BY tv.level) AS hops
  FROM s JOIN tv ON len(tv.nodes) > 1 LEFT JOIN tops ON tops.level = tv.level AND tops.place = xor(s.place >> tv.level, 1) GROUP BY s.place
), w AS (
  SELECT p.*, s.subroot, list_concat(coalesce(hops.hops, []), coalesce(over.hops, [])) AS hops, (SELECT nodes[1] FROM tv WHERE len(nodes) = 1) AS root
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN hops ON p.lang IS NOT DISTINCT FROM hops.lang AND p.place = hops.place LEFT JOIN over ON s.place = over.place
), r AS (
  SELECT *, list_reduce(hops, lambda acc, h: sha256(CASE h[1] WHEN 'N' THEN acc WHEN 'L' THEN h[2:] || acc ELSE acc || h[2:] END), coalesce(changed, leaf)) AS folded_root FROM w
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(hops, lambda h: CASE h[1] WHEN 'N' THEN '' ELSE h[2:] END), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_aho_corasick_decontamination": OP1_SQL.strip(), "op13_octopus_merkle_manifest": OP13_SQL.strip()}
