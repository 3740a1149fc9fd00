"""The named queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrid.llm import (
    alignment,
    conversations,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    pii,
    quality_gam,
    quality_rules,
    suffix_dedup,
    topk,
    windows,
)
from noticegrid.llm.base import read

WORD_SQL = r"[^\x20\x09-\x0D]+"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op4_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(read(spark, sf_dir, "documents"))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def tokenizer_files() -> tuple[str, str]:
    """The tokenizer, and the ranks of the same vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), *tokenizer_files())


def op7_pii_lstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(pii.sample_texts(docs)))


def op8_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def fold(k: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % k


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gam.learn(docs, read(spark, sf_dir, "labels"), fold(5) != 0)
    return quality_gam.scored(docs, model).select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= quality_gam.KEEP_AT).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    parser = language_id.Parser(language_id.training_texts(docs, fold(4) != 2))
    return language_id.identify(docs, parser, "doc_id").select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op11_diagonal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pieces = map(public_tokenizers.path, ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
    return alignment.align(read(spark, sf_dir, "documents"), ranks, pieces)


def op12_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack(read(spark, sf_dir, "documents"), *tokenizer_files())


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(read(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_suffix_dedup, op3_quality_rules, op4_minhash_bayes, op5_line_templates, op6_best_fit_packing, op7_pii_lstm_crf, op8_maxscore_topk, op9_quality_gam, op10_language_id, op11_diagonal_alignment,
    op12_differencing_packing, op13_conversation_repair)}

ORACLE = {
    # The words taken are the overlap of a document's stretch of its source's axis with the words that are due.
    "op1_mix_sources": rf"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS deal,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD_SQL}')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (src - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM sources),
filled AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS due,
    coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM weighted),
judged AS (SELECT *, CAST(cap AS DOUBLE) / weight <= (due - CAST(spent AS DOUBLE)) / CAST(open_weight AS DOUBLE) AS is_full FROM filled),
level AS (
  SELECT (max(due) - CAST(coalesce(sum(cap) FILTER (is_full), 0) AS DOUBLE)) / nullif(CAST(coalesce(sum(weight) FILTER (NOT is_full), 0) AS DOUBLE), 0) AS lam FROM judged),
due AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE weight * lam END AS target FROM judged, level),
laid AS (
  SELECT s.*, d.source_size, d.target, CAST(round(d.target) AS BIGINT) AS words,
    CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY deal, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN due d ON s.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target,
  greatest(0, least(start + size, words) - start) + greatest(0, least(start + size, words - source_size) - start) AS taken
FROM laid""",
    "op3_quality_rules": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD_SQL}') AS words FROM documents),
grams AS (
  SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM docs WHERE len(words) >= 3)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM grams),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
lines AS (
  SELECT r, host, line, row_number() OVER () AS k, len(regexp_extract_all(line, '{WORD_SQL}')) AS n,
    lower(array_to_string(regexp_extract_all(line, '{WORD_SQL}'), ' ')) AS norm
  FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '{WORD_SQL}')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
counted AS (SELECT host, norm, count(DISTINCT r) AS n_docs FROM lines GROUP BY host, norm),
shared AS (SELECT host, norm FROM counted WHERE n_docs > 5),
lost AS (
  SELECT l.r, CAST(sum(l.n) AS BIGINT) AS shared_words FROM lines l JOIN shared s
  ON l.host IS NOT DISTINCT FROM s.host AND l.norm = s.norm GROUP BY l.r),
counts AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(shared_words, 0) AS shared_words
  FROM docs d LEFT JOIN covered USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - shared_words) >= 50 * n_words AS kept
FROM counts""",
    "op8_maxscore_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10""",
    "op5_line_templates": rf"""
WITH texts AS (SELECT md5(text) AS key, any_value(text) AS text FROM documents WHERE length(text) > 0 GROUP BY 1),
lines AS (
  SELECT key, place, list_transform(regexp_extract_all(line, '{WORD_SQL}'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
  FROM (SELECT key, unnest(range(len(l))) AS place, unnest(l) AS line FROM (SELECT key, string_split(text, chr(10)) AS l FROM texts))
  WHERE regexp_matches(line, '{WORD_SQL}')),
leafed AS (SELECT *, len(tokens) || chr(10) || array_to_string(tokens[1:3], chr(10)) AS leaf FROM lines),
held AS (SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT key) > 10),
chosen AS (SELECT * FROM leafed WHERE leaf IN (SELECT leaf FROM held)),
words AS (SELECT key, place, leaf, len(tokens) AS n, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM chosen),
constant AS (
  SELECT leaf, pos, token FROM words WHERE token <> '<*>' GROUP BY ALL HAVING count(DISTINCT key) > 10),
blanked AS (
  SELECT w.key, w.place, w.leaf, any_value(n) AS n, count(c.token) AS n_constant,
    string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY w.pos) AS template
  FROM words w LEFT JOIN constant c ON w.leaf = c.leaf AND w.pos = c.pos AND w.token = c.token GROUP BY 1, 2, 3),
good AS (SELECT * FROM blanked WHERE n_constant > 0 AND 100 * n_constant >= 50 * n),
recurring AS (SELECT leaf, template FROM good GROUP BY ALL HAVING count(DISTINCT key) > 10),
dropped AS (SELECT key, list(place) AS places FROM good JOIN recurring USING (leaf, template) GROUP BY key)
SELECT d.doc_id, CASE WHEN length(text) > 0 THEN CAST(len(string_split(text, chr(10))) AS BIGINT) ELSE 0 END AS n_lines,
  CAST(coalesce(len(places), 0) AS BIGINT) AS n_dropped,
  sha256(CASE WHEN places IS NULL THEN coalesce(text, '') ELSE
    coalesce(array_to_string([x[2] FOR x IN list_zip(range(len(string_split(text, chr(10)))), string_split(text, chr(10))) IF NOT list_contains(places, x[1])], chr(10)), '') END) AS kept_sha256
FROM documents d LEFT JOIN dropped ON md5(d.text) = dropped.key""",
}
