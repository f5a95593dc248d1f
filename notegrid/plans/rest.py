"""Queries of diversity, fallbacks, trimming, typed ingest and the remaining jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from notegrid.functions import scores
from notegrid.functions.scores import DECAY_SQL
from notegrid.operators import inference as I
from notegrid.operators import lifecycle as L
from notegrid.operators import ordered as O
from notegrid.operators import predicates as P
from notegrid.operators import retrieval as R
from notegrid.operators import similarity as SI
from notegrid.plans.jobs import passages
from notegrid.plans.joined import mid
from notegrid.plans.registry import query
from notegrid.plans.rows import AT_SQL
from notegrid.schema import VIEWS, as_of, memories, table, vectors
from notegrid.sources import files as S


@query("win_14_feel_diversity")
def win_14(spark, sf):
    d = F.col("doc_id")
    words = F.array_distinct(F.filter(F.split(F.lower("name"), r"\s+"), lambda x: x != ""))
    feels = memories(spark, sf).filter("type = 'feel'").select(F.floor(d / 200).alias("session"), d.alias("rank"), "id", words.alias("words"), "valence")
    return O.diverse_pick(feels.join(vectors(spark, sf).select("id", "embedding"), "id", "left"), "session")


@query("win_15_feel_selection", VIEWS + ", f AS (SELECT doc_id // 100 AS session, id, doc_id, triggered_by IN (SELECT id FROM memories WHERE doc_id % 3 = 0) AS direct FROM memories WHERE type = 'feel') SELECT session, id, rank FROM (SELECT session, id, row_number() OVER (PARTITION BY session ORDER BY direct DESC, doc_id DESC, id) AS rank FROM f) WHERE rank <= 5")
def win_15(spark, sf):
    m, d = memories(spark, sf), F.col("doc_id")
    feels = m.filter("type = 'feel'").withColumn("session", F.floor(d / 100))
    direct = feels.join(m.filter(d % 3 == 0).select(F.col("id").alias("triggered_by")), "triggered_by", "left_semi")
    return O.with_fallback(direct, feels, "session", [-d], 5)


@query("win_16_trim_tail", "SELECT conv_id AS day, part, turn AS pos FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY part, turn) AS spent FROM (SELECT *, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS part FROM conversations)) WHERE spent <= 2500")
def win_16(spark, sf):
    part = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("day"), part.alias("part"), F.col("turn").alias("pos"), F.length("text").alias("tokens"))
    return O.trim_tail(rows, 2500).drop("tokens")


@query("jon_11_plan_event_candidates", VIEWS + """, p AS (SELECT id, doc_id FROM memories WHERE type = 'plan' AND NOT dont_surface AND NOT resolved), e AS (SELECT m.id AS event, embedding FROM memories m JOIN vectors v ON v.id = m.id WHERE type = 'letter'),
s AS (SELECT e.event, p.id, round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM e JOIN vectors v ON TRUE JOIN p ON p.id = v.id WHERE list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]) > 0.2),
a AS (SELECT event, id, -score AS o FROM s UNION ALL SELECT event, id, doc_id::DOUBLE FROM e, (SELECT * FROM p ORDER BY doc_id LIMIT 10) WHERE event NOT IN (SELECT event FROM s)) SELECT event, id, rank FROM (SELECT event, id, row_number() OVER (PARTITION BY event ORDER BY o, id) AS rank FROM a) WHERE rank <= 20""")
def jon_11(spark, sf):
    m, v = memories(spark, sf), vectors(spark, sf)
    plans = P.active_plans(m).select("id", "doc_id")
    events = v.join(m.filter("type = 'letter'").select("id"), "id", "left_semi").select(F.col("vec_id").alias("query_id"), "vec_id", "embedding")
    near = SI.vector_scores(events, v.join(plans.select("id"), "id", "left_semi"), 0.2, k=20).filter("semantic > 0.2")
    close = near.select(mid(F.col("query_id")).alias("event"), "id", (-F.round("semantic", 6)).alias("o"))
    without = events.select(mid(F.col("query_id")).alias("event")).join(close.select("event"), "event", "left_anti")
    first = plans.orderBy("doc_id").limit(10).select("id", F.col("doc_id").cast("double").alias("o"))  # ten rows
    return O.with_fallback(close, without.join(F.broadcast(first)), "event", [F.col("o")], 20)


@query("lif_16_typed_ingest", VIEWS + f"SELECT 'l' || CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 0 THEN 'letter' ELSE 'i' END AS type, CASE WHEN doc_id % 2 = 0 THEN 'ai' END AS author, CASE WHEN doc_id % 2 = 1 THEN 'aspect:' || lower(tags[1]) END AS tag, doc_id % 2 = 1 AS dont_surface, {AT_SQL} AS created FROM memories")
def lif_16(spark, sf):
    d = F.col("doc_id")
    rows = memories(spark, sf).select(d.alias("seq"), F.when(d % 2 == 0, "letter").otherwise("i").alias("type"), F.when(d % 2 == 0, F.lit(" Assistant ")).alias("author"), F.when(d % 2 == 1, F.upper(F.element_at("tags", 1))).alias("aspect"))
    return L.typed_ingest(rows, as_of())


@query("scr_10_debug_breakdown")
def scr_10(spark, sf):
    m = memories(spark, sf)
    pairs = P.literal_matches(m, passages(spark, sf)).join(m, "id").join(passages(spark, sf), "query_id")
    topic = R.topic_scores(pairs)
    rows = pairs.drop("query").join(topic, ["query_id", "id"])
    total = F.col("topic") * R.W_TOPIC + 0.5 * R.W_EMOTION + scores.time_score(as_of()) * R.W_TIME + scores.importance_score() * R.W_IMPORTANCE
    norm = F.round(total / (R.W_TOPIC + R.W_EMOTION + R.W_TIME + R.W_IMPORTANCE) * 100, 2)
    return rows.select("query_id", "id", F.round("topic", 4).alias("topic"), norm.alias("normalised"), (norm >= R.TEXT_THRESHOLD).alias("passed")).orderBy(F.desc("normalised"), "query_id", "id").limit(50)


@query("str_03_vault_changes", VIEWS + "SELECT id, CASE WHEN doc_id % 9 = 1 THEN 'added' ELSE 'content' END AS change FROM memories WHERE doc_id % 9 IN (1, 3)")
def str_03(spark, sf):
    from notegrid.storage import new_path
    from notegrid.streaming.jobs import run_available

    k, m = F.col("doc_id") % 9, memories(spark, sf)
    now = m.select("id", F.when(k == 3, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"), "importance")
    path = new_path(spark, "vault")
    now.write.parquet(path)
    known = m.filter(k != 1)
    files = spark.readStream.schema(now.schema).parquet(path)
    # a file source never reports what has gone, so only additions and edits come this way
    each = lambda batch, to: S.snapshot_diff(known, batch, ["importance"]).filter("change <> 'removed'").select("id", F.col("change").alias("content"), F.lit(0).alias("importance")).write.mode("append").parquet(to)
    return run_available(files, "update", "changes", each).select("id", F.col("content").alias("change"))


def _cycle_sql(name, before, k):
    """One daily cycle k of DuckDB over the rows of the one before."""
    days = f"greatest(0.0::DOUBLE, date_diff('microsecond', last_active, {AT_SQL} + INTERVAL {k} DAY) / 86400000000.0::DOUBLE)"
    auto = f"(type NOT IN ('permanent', 'feel', 'i', 'plan', 'letter', 'archived') AND NOT pinned AND NOT anchor AND NOT resolved AND importance <= 4 AND {days} > 30)"
    score = DECAY_SQL.format(days=days, resolved="r")
    rows = f"SELECT * EXCLUDE (r) REPLACE (r AS resolved, CASE WHEN type NOT IN ('permanent', 'feel', 'i', 'plan', 'letter', 'archived') AND NOT pinned AND NOT anchor AND {score} < 0.3 THEN 'archived' ELSE type END AS type) FROM (SELECT *, resolved OR {auto} AS r FROM {before})"
    return f", {name} AS ({rows})"


@query("str_08_scheduled_decay", VIEWS + _cycle_sql("c0", "memories", 0) + _cycle_sql("c1", "c0", 1) + _cycle_sql("c2", "c1", 2) + " SELECT id, type, resolved FROM c2")
def str_08(spark, sf):
    from notegrid.storage import VersionedTable, new_path

    store = VersionedTable(spark, new_path(spark, "decay"))
    store.write(memories(spark, sf))
    for k in range(3):  # what an outer scheduler runs once a day
        L.apply_decay(store, as_of() + F.expr(f"INTERVAL {k} DAYS"))
    return store.read().select("id", "type", "resolved")


@query("udf_04_extract_memories", "SELECT conv_id, count(*) AS items, sum(greatest(1, least(10, length(text) % 15)))::BIGINT AS importance FROM conversations WHERE length(text) > 100 AND trim(substring(text, 1, 10), ' ') <> '' GROUP BY 1")
def udf_04(spark, sf):
    import json

    rows = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("content"))
    items = I.extract(rows, lambda t: json.dumps([{"content": t[:10], "importance": len(t) % 15}]) if len(t) > 100 else "nothing")
    return items.groupBy(F.split("id", "-")[0].cast("long").alias("conv_id")).agg(F.count(F.lit(1)).alias("items"), F.sum("importance").alias("importance"))
