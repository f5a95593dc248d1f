"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrid.llm.common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notegrid.llm.fingerprint import near_copies

    return near_copies(table(spark, sf_dir, "documents"))


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notegrid.llm.chat import rotate

    return rotate(table(spark, sf_dir, "conversations"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notegrid.llm.pii import find, fit

    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notegrid.llm.neighbours import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notegrid.llm.neardup import link

    return link(table(spark, sf_dir, "documents"), size=4, percent=80)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notegrid.llm.packing import added_tokens, pack

    # one vocabulary in two files: ranks, and the library's own with its added tokens
    special = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notegrid.llm.quality import held_out_quality

    return held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notegrid.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notegrid.llm.language import held_out_languages

    return held_out_languages(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notegrid.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notegrid.llm.collocations import mine

    return mine(table(spark, sf_dir, "documents"))


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notegrid.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notegrid.llm.negatives import mine

    rows = table(spark, sf_dir, "embeddings")
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", wrong), F.col("vid") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_fingerprints, op2_chat_rotation, op3_pii, op4_neighbours, op5_near_duplicates, op6_packing, op7_quality, op8_html_text, op9_language, op10_byte_bpe, op11_collocations, op12_mix, op13_hard_negatives, pipeline)}


def oracle_sql() -> dict[str, str]:
    from notegrid.llm import chat, collocations, mixing, negatives

    return {"op2_chat_rotation": chat.ORACLE, "op11_collocations": collocations.ORACLE, "op12_mix": mixing.ORACLE, "op13_hard_negatives": negatives.ORACLE}
