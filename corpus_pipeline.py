"""A training-data pipeline of five stages.  Each takes (spark, docs, sf_dir) and is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfreq.llm import lines, mixing, ngram_join, packing, quality, tokens
from lumenfreq.llm.shared import discard, materialise, table

SEQUENCE = 2048


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one; n_chars follows the text."""
    from pyspark.sql import functions as F

    x = lines.dedup_lines(docs, figures=False)
    return x.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else x


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity of 0.8 or more) stays: the one of the least id."""
    return ngram_join.keep_one_of_each(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(tokens.encode_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, SEQUENCE), SEQUENCE)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: Tokenising, hash thresholds and packing can't be said in SQL; tests hold run(), stage by stage, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        if "lf_path" in vars(before):  # a stage's table that the next one has read
            discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
