"""Canonical tables of the memory corpus, derived from the supplied Parquet tables; and their SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: No operator reads a clock; this is the moment all queries are asked at.
AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.expr(f"TIMESTAMP_NTZ'{AS_OF}'")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Append-only events of the memories, one per row of events (those of the table, or a stream of them)."""
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))  # one row
    kinds = {"signup": "TraceCreated", "click": "TraceUpdated", "view": "TraceTouched", "purchase": "TraceArchived", "error": "TraceDeletedToArchive"}
    kind = F.lit("Other")
    for k, v in kinds.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    trace = F.concat(F.lit("m"), (F.col("event_id") % F.col("n")).cast("string"))
    return (
        (table(spark, sf_dir, "events") if events is None else events)
        .join(F.broadcast(n))
        .select((F.col("event_id") + 1).alias("seq"), trace.alias("trace_id"), kind.alias("event_type"), F.lit("dynamic").alias("trace_kind"), F.col("props").alias("payload"), F.col("ts").cast("timestamp_ntz").alias("recorded_at"), F.concat(F.lit("sha256:"), F.sha2(trace, 256)).alias("body_hash"), "user_id", "value")
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, with the metadata of a memory."""
    touched = ledger(spark, sf_dir).filter("event_type = 'TraceTouched'").groupBy("trace_id").agg(F.count(F.lit(1)).alias("touches"), F.max("recorded_at").alias("last_touch"))
    d = F.col("doc_id")
    kind = F.when(d % 20 == 0, "permanent").when((d % 20).isin(1, 2), "feel").when(d % 20 == 3, "plan").when(d % 20 == 4, "letter").when(d % 20 == 5, "i").otherwise("dynamic")
    base = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("m"), d.cast("string")).alias("id"),
        "doc_id",
        F.substring("text", 1, 40).alias("name"),
        F.col("text").alias("content"),
        F.array("source").alias("domain"),
        F.array("lang").alias("tags"),
        (1 + d % 10).cast("int").alias("importance"),
        ((d * 37 % 101) / F.lit(100.0)).alias("valence"),
        ((d * 53 % 101) / F.lit(100.0)).alias("arousal"),
        kind.alias("type"),
        (d % 7 == 0).alias("resolved"),
        (d % 14 == 0).alias("digested"),
        (d % 50 == 0).alias("pinned"),
        (d % 61 == 0).alias("anchor"),
        (d % 29 == 0).alias("dont_surface"),
        F.when(d % 43 == 0, F.concat(F.lit("m"), (d + 1).cast("string"))).alias("superseded_by"),
        F.when((d % 20).isin(1, 2), F.concat(F.lit("m"), (d - 1).cast("string"))).alias("triggered_by"),
        F.expr("timestampadd(MINUTE, cast(doc_id % 43200 as int), TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("created"),
    )
    joined = base.join(touched, base["id"] == touched["trace_id"], "left")
    return joined.select(*base.columns, F.greatest("created", "last_touch").alias("last_active"), F.coalesce("touches", F.lit(0)).cast("double").alias("activation_count"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), F.col("vec_id").cast("string")).alias("id"), "vec_id", "embedding")


#: The same views for DuckDB; put before a SELECT.
VIEWS = """WITH nd AS (SELECT count(*) AS n FROM documents),
ledger AS (
  SELECT event_id + 1 AS seq, 'm' || CAST(event_id % (SELECT n FROM nd) AS VARCHAR) AS trace_id,
         CASE event_type WHEN 'signup' THEN 'TraceCreated' WHEN 'click' THEN 'TraceUpdated' WHEN 'view' THEN 'TraceTouched' WHEN 'purchase' THEN 'TraceArchived' WHEN 'error' THEN 'TraceDeletedToArchive' ELSE 'Other' END AS event_type,
         'dynamic' AS trace_kind, props AS payload, ts AS recorded_at, 'sha256:' || sha256('m' || CAST(event_id % (SELECT n FROM nd) AS VARCHAR)) AS body_hash, user_id, value
  FROM events),
touched AS (SELECT trace_id, count(*) AS touches, max(recorded_at) AS last_touch FROM ledger WHERE event_type = 'TraceTouched' GROUP BY 1),
memories AS (
  SELECT 'm' || CAST(doc_id AS VARCHAR) AS id, doc_id, substring(text, 1, 40) AS name, text AS content, [source] AS domain, [lang] AS tags,
         CAST(1 + doc_id % 10 AS INT) AS importance, (doc_id * 37 % 101) / 100.0::DOUBLE AS valence, (doc_id * 53 % 101) / 100.0::DOUBLE AS arousal,
         CASE WHEN doc_id % 20 = 0 THEN 'permanent' WHEN doc_id % 20 IN (1, 2) THEN 'feel' WHEN doc_id % 20 = 3 THEN 'plan' WHEN doc_id % 20 = 4 THEN 'letter' WHEN doc_id % 20 = 5 THEN 'i' ELSE 'dynamic' END AS type,
         doc_id % 7 = 0 AS resolved, doc_id % 14 = 0 AS digested, doc_id % 50 = 0 AS pinned, doc_id % 61 = 0 AS anchor, doc_id % 29 = 0 AS dont_surface,
         CASE WHEN doc_id % 43 = 0 THEN 'm' || CAST(doc_id + 1 AS VARCHAR) END AS superseded_by,
         CASE WHEN doc_id % 20 IN (1, 2) THEN 'm' || CAST(doc_id - 1 AS VARCHAR) END AS triggered_by,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id % 43200 AS BIGINT)) AS created,
         greatest(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id % 43200 AS BIGINT)), last_touch) AS last_active,
         CAST(coalesce(touches, 0) AS DOUBLE) AS activation_count
  FROM documents LEFT JOIN touched ON touched.trace_id = 'm' || CAST(doc_id AS VARCHAR)),
vectors AS (SELECT 'm' || CAST(vec_id AS VARCHAR) AS id, vec_id, embedding FROM embeddings)
"""
