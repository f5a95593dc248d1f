"""Corpus pipeline: language ID, quality, near-dedup, PII, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of
documents; the last returns packed pieces.

Defined results, of every stage: rows are judged by their text alone, whatever is null or repeated in other
columns; very long texts are taken whole; an empty table gives an empty one; other columns, of any name, stay as
they are. Null and empty texts go in the first stage, as they have no letter; where a later stage gets them, the
quality stage scores them like an empty text, near-dedup keeps one for each doc_id, PII leaves them as they are
and packing gives them their end id.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrid.llm import language, neardup, packing, pii, quality
from notegrid.llm.common import materialize, release, slices, table

#: A document goes if no language of the corpus reaches this posterior.
LEAST_LANGUAGE_SCORE = 0.5
#: A document goes if label 1 is less likely than this.
LEAST_QUALITY = 0.7


def keep_texts(docs: DataFrame, judge: Callable[[list[str]], list[bool]], done: Callable[[], None] = lambda: None) -> DataFrame:
    """The rows whose text judge keeps; columns stay as they are, whatever their names. done: called at the end of a partition."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(judge([x or "" for x in part.column("text").to_pylist()]), pa.bool_()))
        done()
        release()

    return docs.mapInArrow(run, docs.schema)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language of the corpus; texts without a letter, or of doubtful language, go."""
    model = spark.sparkContext.broadcast(language.fit(docs))

    def judge(texts: list[str]) -> list[bool]:
        return [x != "und" and s >= LEAST_LANGUAGE_SCORE for x, s in zip(*model.value.predict(texts), strict=True)]

    return keep_texts(docs, judge, lambda: model.value.forget())  # later stages need the room


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that look like label 1 of labels.quality."""
    sample = materialize(quality.sampled(table(spark, sf_dir, "labels")), "labels")  # of bounded size, so the texts stay where they are
    known = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")
    trees = spark.sparkContext.broadcast(quality.fit_sample(quality.measure(known), sample))
    return keep_texts(docs, lambda texts: (trees.value.score(quality.statistics(texts)) >= LEAST_QUALITY).tolist())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest doc_id of each group of near-duplicates (five words, 0.8).

    Rows that repeat a doc_id are told apart by the set of their text; of equal ones one row stays. Rows without a
    doc_id all stay.
    """
    found = materialize(neardup.link(docs, digests=True), "linked")
    twice = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if not twice.limit(1).count():
        return neardup.without(docs, materialize(found.filter("NOT kept").select("doc_id"), "gone"))
    name = "set_digest"
    while name in docs.columns:
        name += "_"
    rows = neardup.with_digest(docs, name)
    kept = materialize(found.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")).distinct(), "kept")
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(F.col("kept_id")) & rows[name].eqNullSafe(F.col("kept_digest")), "left_semi")
    return rows.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", name]).unionByName(rows.filter("doc_id IS NULL")).drop(name)


def pii_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets."""
    return pii.redact(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    special = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special)


STAGES = [("language_id", language_id), ("quality", quality_filter), ("near_dedup", near_dedup), ("pii", pii_removal), ("packing", pack)]

#: Trained models can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
