"""Queries of streams with keyed state, and of the catalog that they keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from notegrid.operators import aggregates as A
from notegrid.plans.registry import query
from notegrid.schema import VIEWS, ledger
from notegrid.storage import VersionedTable, new_path
from notegrid.streaming import stateful as ST

#: A ledger in which all that the catalog looks at occurs: unknown events and traces, kinds, payloads, bodies that stay.
TOLD_SQL = VIEWS + """, told AS (SELECT seq, CASE WHEN seq % 211 = 0 THEN '' ELSE trace_id END AS trace_id, CASE WHEN seq % 131 = 0 THEN 'TraceRenamed' ELSE event_type END AS event_type,
  CASE WHEN seq % 17 = 0 THEN 'archived' WHEN seq % 3 <> 0 THEN 'feel' END AS kind, CASE WHEN seq % 7 = 0 THEN 'plan' END AS payload_kind, CASE WHEN event_type <> 'TraceTouched' THEN 'sha256:' || sha256(trace_id || '|' || seq) END AS body_hash,
  CASE WHEN seq % 5 < 2 THEN seq % 5 = 1 END AS resolved, event_type = 'TraceDeletedToArchive' AND seq % 4 = 0 AS tombstone FROM ledger),
known AS (SELECT * FROM told WHERE event_type LIKE 'Trace%' AND event_type <> 'TraceRenamed' AND trace_id <> ''),
live AS (SELECT * FROM known JOIN (SELECT trace_id, coalesce(max(seq) FILTER (WHERE event_type = 'TraceCreated'), min(seq)) AS created_seq FROM known GROUP BY 1) USING (trace_id) WHERE seq >= created_seq),
catalog AS (SELECT trace_id, coalesce(arg_max(kind, seq) FILTER (WHERE kind IS NOT NULL), first(payload_kind ORDER BY seq), 'dynamic') AS trace_kind,
  arg_max(CASE WHEN tombstone THEN 'tombstone' WHEN event_type = 'TraceDeletedToArchive' THEN 'deleted_to_archive' WHEN event_type = 'TraceArchived' OR kind = 'archived' THEN 'archived' ELSE 'active' END, seq) AS state,
  coalesce(arg_max(body_hash, seq) FILTER (WHERE body_hash IS NOT NULL), '') AS body_hash, min(created_seq) AS created_seq, max(seq) AS latest_seq, arg_max(event_type, seq) AS latest_event_type,
  count(*) FILTER (WHERE event_type = 'TraceTouched') + CASE WHEN arg_min(event_type, seq) = 'TraceTouched' THEN 1 ELSE 0 END AS touch_count,
  coalesce(arg_max(resolved, seq) FILTER (WHERE resolved IS NOT NULL), FALSE) AS resolved, bool_or(event_type = 'TraceDeletedToArchive') AS deleted, bool_or(tombstone) AS tombstone FROM live GROUP BY trace_id)"""


def told(spark, sf):
    s, e = F.col("seq"), F.col("event_type")
    say = lambda name, when, value: F.when(when, F.concat(F.lit(f', "{name}": '), value)).otherwise("")
    payload = F.concat(F.lit('{"n": '), s.cast("string"), say("type", s % 7 == 0, F.lit('"plan"')), say("resolved", s % 5 < 2, (s % 5 == 1).cast("string")), say("erasure_mode", (e == "TraceDeletedToArchive") & (s % 4 == 0), F.lit('"Tombstone_only"')), F.lit("}"))
    body = F.when(e != "TraceTouched", F.concat(F.lit("sha256:"), F.sha2(F.concat("trace_id", F.lit("|"), s.cast("string")), 256)))
    return ledger(spark, sf).select("seq", F.when(s % 211 == 0, "").otherwise(F.col("trace_id")).alias("trace_id"), F.when(s % 131 == 0, "TraceRenamed").otherwise(e).alias("event_type"), F.when(s % 17 == 0, "archived").when(s % 3 != 0, "feel").otherwise("").alias("trace_kind"), body.alias("body_hash"), payload.alias("payload"))


@query("agg_06_trace_catalog", TOLD_SQL + " SELECT * FROM catalog")
def agg_06(spark, sf):
    return A.trace_projection(told(spark, sf))


@query("src_22_trace_catalog_table", TOLD_SQL + " SELECT trace_id, trace_kind, state, touch_count, concat_ws(' ', trace_id, trace_kind, state, latest_event_type) AS search_text, NULL AS name, NULL AS value FROM catalog UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, unnest(['applied_seq', 'trace_count', 'tombstone_count']), unnest([(SELECT max(seq) FROM told), (SELECT count(*) FROM catalog), (SELECT count(*) FROM catalog WHERE tombstone)])")
def src_22(spark, sf):
    """The catalog as a written table with its search text, and the rows of its metadata table."""
    events = told(spark, sf)
    store, meta = VersionedTable(spark, new_path(spark, "catalog")), VersionedTable(spark, new_path(spark, "catalog-meta"))
    store.write(A.trace_projection(events).withColumn("search_text", F.concat_ws(" ", "trace_id", "trace_kind", "state", "latest_event_type")))
    counts = store.read().agg(F.count(F.lit(1)).alias("trace_count"), F.count_if("tombstone").alias("tombstone_count")).crossJoin(events.agg(F.max("seq").alias("applied_seq")))  # one row each
    meta.write(counts.unpivot([], ["applied_seq", "trace_count", "tombstone_count"], "name", "value"))
    return store.read().select("trace_id", "trace_kind", "state", "touch_count", "search_text").unionByName(meta.read(), allowMissingColumns=True)


def arriving(spark, events, parts: str, repeated: str, path: str, batches: int = 4):
    """events as files of a log, dealt by an expression (so they come late and in any order), some of them twice; and a stream of all but the last part."""
    dealt = events.withColumn("part", F.expr(parts)).unionByName(events.filter(repeated).withColumn("part", F.expr(f"({parts} + 1) % 5")))
    dealt.write.partitionBy("part").parquet(f"{path}/log")
    files = len(spark.read.parquet(f"{path}/log/part=[0-4]").inputFiles())
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(f"{path}/log/part=[0-4]")


PARTS = "cast(seq * 31 % 6 as int)"


def catalog_stream(spark, sf):
    path = new_path(spark, "stream-catalog")
    events = told(spark, sf)
    return ST.stream_catalog(arriving(spark, events, PARTS, "seq % 10 = 3 AND seq * 31 % 6 < 5", path), path), events


ARRIVED_SQL = TOLD_SQL.replace(" FROM ledger),", " FROM ledger WHERE seq * 31 % 6 < 5),")


@query("str_01_stream_catalog", ARRIVED_SQL + " SELECT * FROM catalog")
def str_01(spark, sf):
    return ST.catalog_rows(catalog_stream(spark, sf)[0])


@query("str_01_stream_report", ARRIVED_SQL + ", r AS (SELECT (SELECT count(*) FROM catalog) AS trace_count, (SELECT count(*) FROM catalog WHERE tombstone) AS tombstone_count, (SELECT max(seq) FROM told) AS applied_seq, (SELECT count(*) FROM told WHERE trace_id = '' OR event_type NOT LIKE 'Trace%' OR event_type = 'TraceRenamed') AS unknown_event_count, (SELECT max(seq) FROM ledger) AS source_latest_seq) SELECT *, greatest(0, source_latest_seq - applied_seq) AS lag FROM r")
def str_01_report(spark, sf):
    log, events = catalog_stream(spark, sf)
    return ST.catalog_report(log, events.agg(F.max("seq").alias("latest")))


@query("str_06_order_violations", "WITH e AS (SELECT user_id AS source, event_id AS arrival, CASE WHEN event_id % 50 = 0 THEN 0 WHEN event_id % 70 = 1 THEN event_id - 30 ELSE event_id + 1 END AS seq, event_id // 4096 AS batch FROM events) SELECT source, arrival, seq FROM (SELECT *, max(seq) OVER (PARTITION BY source ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e) WHERE seq <= coalesce(before, -1)")
def str_06(spark, sf):
    from notegrid.plans.jobs import _stream

    k = F.col("event_id")
    sent = _stream(spark, sf).select(F.col("user_id").alias("source"), k.alias("arrival"), F.when(k % 50 == 0, F.lit(0).cast("long")).when(k % 70 == 1, k - 30).otherwise(k + 1).alias("seq"))
    return ST.order_violations(sent, new_path(spark, "stream-order")).read()


#: Five commands for each id, from the events: the first enqueues; the others enqueue again, finish or fail, for one of two texts.
QUEUE_SQL = """WITH RECURSIVE c AS (SELECT 'q' || CAST(event_id // 5 AS VARCHAR) AS id, event_id AS n, event_id % 5 AS k, CASE WHEN event_id % 5 = 0 OR event_type IN ('signup', 'click') THEN 'enqueue' WHEN event_type = 'view' THEN 'done' WHEN event_id % 13 = 0 THEN 'discard' ELSE 'failed' END AS op,
  'h' || CAST(user_id % 2 AS VARCHAR) AS h, event_id * 10.0::DOUBLE AS t, event_type AS error, event_type = 'signup' AS reset FROM events),
s AS (SELECT id, -1::BIGINT AS k, FALSE AS pending, NULL::VARCHAR AS content_hash, NULL::DOUBLE AS queued_at, 0::BIGINT AS attempts, 0.0::DOUBLE AS next_attempt_at, '' AS last_error FROM c WHERE k = 0
  UNION ALL SELECT id, c.k,
    CASE WHEN op = 'enqueue' THEN TRUE WHEN op = 'discard' OR (op = 'done' AND pending AND content_hash = h) THEN FALSE ELSE pending END, CASE WHEN op = 'enqueue' THEN h ELSE content_hash END,
    CASE WHEN op = 'enqueue' AND NOT (pending AND content_hash = h) THEN t ELSE queued_at END,
    CASE WHEN op = 'enqueue' AND (reset OR NOT pending OR content_hash <> h) THEN 0 WHEN op = 'failed' AND pending AND content_hash = h THEN attempts + 1 ELSE attempts END,
    CASE WHEN op = 'enqueue' AND (reset OR NOT pending) THEN 0.0 WHEN op = 'failed' AND pending AND content_hash = h THEN t + least(300.0, 5.0 * pow(2, attempts)) ELSE next_attempt_at END,
    CASE WHEN op = 'enqueue' AND (reset OR NOT pending) THEN '' WHEN op = 'failed' AND pending AND content_hash = h THEN error ELSE last_error END
  FROM s JOIN c USING (id) WHERE c.k = s.k + 1)
SELECT id, arg_max(content_hash, k) AS content_hash, arg_max(attempts, k) AS attempts, arg_max(queued_at, k) AS queued_at, arg_max(next_attempt_at, k) AS next_attempt_at, arg_max(last_error, k) AS last_error FROM s GROUP BY id HAVING arg_max(pending, k)"""


@query("str_04_reembed_queue", QUEUE_SQL)
def str_04(spark, sf):
    from notegrid.schema import table

    k, kind, path = F.col("event_id"), F.col("event_type"), new_path(spark, "queue")
    op = F.when((k % 5 == 0) | kind.isin("signup", "click"), "enqueue").when(kind == "view", "done").when(k % 13 == 0, "discard").otherwise("failed")
    commands = table(spark, sf, "events").select(F.concat(F.lit("q"), F.floor(k / 5).cast("string")).alias("id"), k.alias("n"), op.alias("op"), F.concat(F.lit("h"), (F.col("user_id") % 2).cast("string")).alias("content_hash"), (k * 10.0).alias("at"), kind.alias("error"), (kind == "signup").alias("reset"))
    for part in ("n % 5 < 3", "n % 5 >= 3"):  # the stream goes on with what has come since
        commands.filter(part).write.mode("append").parquet(f"{path}/log")
        items, _ = ST.stream_queue(spark.readStream.schema(commands.schema).parquet(f"{path}/log"), path)
    return items.read().filter("pending").select("id", "content_hash", "attempts", "queued_at", "next_attempt_at", "last_error")


@query("lif_19_saved_notes", "WITH k AS (SELECT DISTINCT conv_id AS key FROM conversations) SELECT CAST(key AS VARCHAR) AS key, CASE WHEN key % 7 = 1 THEN 9 WHEN key % 2 = 1 THEN CASE WHEN key % 3 = 0 THEN 0 ELSE 1 END END AS expected, CASE WHEN key % 5 = 0 OR key % 7 = 1 OR key % 4 = 0 THEN CASE WHEN key % 3 = 0 AND NOT (key % 5 <> 0 AND key % 7 <> 1) THEN 0 ELSE 1 END ELSE CASE WHEN key % 3 = 0 THEN 1 ELSE 2 END END AS revision, CASE WHEN key % 5 = 0 THEN 'bad_title' WHEN key % 7 = 1 THEN 'conflict' WHEN key % 3 = 0 THEN 'created' WHEN key % 4 = 0 THEN 'unchanged' ELSE 'updated' END AS fate FROM k")
def lif_19_saved(spark, sf):
    """Notes of two thirds of the dialogues are there; then each is edited: some without the day in the title, some from a wrong revision, some unchanged."""
    from notegrid.operators.lifecycle import save_notes
    from notegrid.schema import table

    k = F.col("conv_id")
    keys = table(spark, sf, "conversations").select("conv_id").distinct()
    text = lambda title, body: F.concat(title, F.lit("\n"), body)
    day, first = F.lit("2024-01-02").cast("date"), F.concat(F.lit("note "), k.cast("string"))
    store = VersionedTable(spark, new_path(spark, "notes"))
    old = keys.filter(k % 3 != 0).select(k.cast("string").alias("key"), day.alias("day"), F.lit(1).cast("long").alias("revision"), text(F.lit("# 2024-01-02"), first).alias("content"))
    store.write(old.withColumn("h", F.sha2("content", 256)))
    title, body = F.when(k % 5 == 0, "no day").otherwise("# 2024-01-02"), F.when(k % 4 == 0, first).otherwise(F.concat(first, F.lit(" again")))
    expected = F.when(k % 7 == 1, 9).when(k % 2 == 1, F.when(k % 3 == 0, 0).otherwise(1))
    return save_notes(store, keys.select(k.cast("string").alias("key"), day.alias("day"), text(title, body).alias("content"), expected.alias("expected_revision")))
