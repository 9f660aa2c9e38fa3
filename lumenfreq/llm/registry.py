"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html_text, language, lines, lm_score, mixing, ngram_join, packing, quality, tokens
from .shared import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write_shards(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1)
    return tokens.read_shards(spark, manifest)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.encode_pieces(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), 0, 2048), 2048)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    x = lm_score.score(docs, language.remainder(docs["doc_id"], 7) != 2)
    return x.withColumn("held_out", F.coalesce(language.remainder(F.col("doc_id"), 7) == 2, F.lit(False)))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language.remainder(F.col("doc_id"), 4) == 2
    names, model = language.train(docs.filter(~held_out))
    return language.identify(docs, names, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_frames": op1,
    "op2_line_dedup": op2,
    "op3_best_two_fit": op3,
    "op4_quality_rules": op4,
    "op5_gated_lm": op5,
    "op6_jaccard_join": op6,
    "op7_mix_sources": op7,
    "op8_language_mixture": op8,
    "op9_html_main_text": op9,
    "op10_posting_lists": op10,
}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

_LEADS = " || ' ' || ".join(["s", *(f"lead(s, {k}) OVER o" for k in range(1, quality.WINDOW))])

ORACLES: dict[str, str] = {
    "op2_line_dedup": f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
k AS (SELECT doc_id, i, line, translate(trim(line, {_WS}), '{_UP}', '{_LOW}') AS key FROM e),
c AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE c.top <> k.doc_id) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE c.top IS NULL OR c.top = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id""",
    "op4_quality_rules": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM documents),
p AS (SELECT doc_id, unnest(w) AS s, generate_subscripts(w, 1) AS i FROM t),
g AS (SELECT * FROM (SELECT doc_id, i, {_LEADS} AS g FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL),
d AS (SELECT g.doc_id, g.i FROM g JOIN (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1) r ON g.doc_id = r.doc_id AND g.g = r.g),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM d, (SELECT unnest(range(8)) AS j) GROUP BY doc_id),
f AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda s: length(s))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(w, lambda s: ends_with(s, '!!'))) AS n_shouts,
    len(list_filter(w, lambda s: list_contains([{_STOP}], lower(s)))) AS n_stop FROM t LEFT JOIN r ON t.doc_id = r.doc_id),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND word_chars / n_words BETWEEN 2 AND 20 AND n_symbols / n_words <= 0.1 AND n_shouts / n_words <= 0.2 AND n_stop / n_words >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.4, false) AS kept
FROM b""",
}
