"""The queries opN_<name> of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import conversations, exact_dedup, html_extract, jaccard_join, language_id, lm_scoring, mixing, packing, quality_model, quality_rules, sentencepiece_np, toxicity, whitening
from .text import LOWER, UPPER, fold_of


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")), F.array_join("quality.failed_rules", ",").alias("failed_rules"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 7) == 2
    rows = lm_scoring.score(docs, ~held_out)
    return rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark)
    rows = exact_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), index)
    index.drop()
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "toxic"))
    rows = toxicity.score(docs, model)
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_pack_tokens(spark: SparkSession, sf_dir: str, ranks_path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks_path)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    model = language_id.train(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_shingles", "component_id", "class_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    return sentencepiece_np.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"), html_extract.train())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_of(F.col("doc_id"), 5) == 0
    rows = quality_model.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "quality"))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries():
    return {"op1_toxicity": op1_toxicity, "op2_jaccard_join": op2_jaccard_join, "op3_mix_sources": op3_mix_sources, "op4_lm_scoring": op4_lm_scoring, "op5_quality_rules": op5_quality_rules, "op6_exact_dedup": op6_exact_dedup, "op7_pack_tokens": op7_pack_tokens, "op8_language_id": op8_language_id, "op9_sentencepiece": op9_sentencepiece, "op10_html_extract": op10_html_extract, "op11_conversation_repair": op11_conversation_repair, "op12_quality_model": op12_quality_model, "op13_whitening": op13_whitening}


def oracle_sql():
    """Operators 5 and 6 in SQL; the others are held against brute force, round trips or held-out labels in the tests."""
    rules = {"n_words": "n_words", "mean_word_chars": "word_chars / n_words", "symbol_ratio": "n_symbols / word_chars", "capital_ratio": "n_capitals / word_chars", "stop_ratio": "n_stop / n_words", "dup_line_ratio": "n_dup_lines / n_lines", "bullet_ratio": "n_bullet / n_lines", "ellipsis_ratio": "n_ellipsis / n_lines"}
    stop = ", ".join(f"'{w}'" for s in sorted(set(quality_rules.STOP_WORDS)) for w in dict.fromkeys((s, s.capitalize())))
    broken = []
    for name, measure, least, most in quality_rules.RULES:
        value = f"coalesce(CASE WHEN {rules[measure].split('/')[-1].strip()} = 0 THEN 0 ELSE {rules[measure]} END, 0)"
        tests = ([f"{value} < {least}"] if least is not None else []) + ([f"{value} > {most}"] if most is not None else [])
        broken.append(f"CASE WHEN {' OR '.join(tests)} THEN '{name}' END")
    blank, word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
    op5 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM t, unnest(range(1, len(ws) - 1)) AS u(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
m AS (SELECT t.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{blank}', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
 length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, len(list_filter(ws, lambda x: x IN ({stop}))) AS n_stop, len(ls) AS n_lines, len(list_filter(ls, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•◦]'))) AS n_bullet, len(list_filter(ls, lambda x: regexp_matches(x, '(?:\\.\\.\\.|…)[\\x20\\x09\\r]*$'))) AS n_ellipsis FROM t LEFT JOIN cov USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {', '.join(broken)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v"""
    op6 = f"""WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256 FROM t WINDOW w AS (PARTITION BY x)"""
    return {"op5_quality_rules": op5, "op6_exact_dedup": op6}
