"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from notegrid.operators import joins as J
from notegrid.operators.similarity import cosine
from notegrid.plans.registry import query
from notegrid.schema import VIEWS, ledger, memories, table, vectors

MID = "'m' || CAST({} AS VARCHAR)"


def mid(c):
    return F.concat(F.lit("m"), c.cast("string"))


@query("jon_01_attach_semantic", VIEWS + "SELECT m.id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS semantic, CASE WHEN v.id IS NULL THEN 9.5::DOUBLE ELSE 12.0::DOUBLE END AS weight_sum FROM memories m LEFT JOIN vectors v ON v.id = m.id CROSS JOIN (SELECT embedding FROM vectors WHERE vec_id = 0) q")
def jon_01(spark, sf):
    v = vectors(spark, sf)
    q = v.filter("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    return J.attach_scores(memories(spark, sf), v.join(F.broadcast(q)).select("id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("semantic")))


@query("jon_02_triggered_feels", VIEWS + "SELECT triggered_by AS source_id, id AS feel_id, created, row_number() OVER (PARTITION BY triggered_by ORDER BY created DESC, id) AS rank FROM memories f WHERE type = 'feel' AND triggered_by IN (SELECT id FROM memories)")
def jon_02(spark, sf):
    return J.triggered_feels(memories(spark, sf))


@query("jon_03_repair_digested", VIEWS + "SELECT s.source_id, CASE WHEN m.id IS NULL THEN 'missing' WHEN m.digested THEN 'already' ELSE 'repaired' END AS status FROM (SELECT DISTINCT triggered_by AS source_id FROM memories WHERE type = 'feel') s LEFT JOIN memories m ON m.id = s.source_id")
def jon_03(spark, sf):
    return J.repair_digested(memories(spark, sf))


@query("jon_04_orphan_vectors", VIEWS + "SELECT id FROM vectors WHERE id NOT IN (SELECT id FROM memories)")
def jon_04(spark, sf):
    return J.orphan_vectors(vectors(spark, sf), memories(spark, sf))


@query("jon_05_missing_or_stale_vectors", VIEWS + ", stored AS (SELECT v.id, CASE WHEN v.vec_id % 3 = 0 THEN sha256(m.content) WHEN v.vec_id % 3 = 1 THEN 'old' ELSE '' END AS h FROM vectors v JOIN memories m ON m.id = v.id) SELECT m.id, CASE WHEN s.id IS NULL THEN 'missing' ELSE 'stale' END AS reason FROM memories m LEFT JOIN stored s ON s.id = m.id WHERE trim(m.content) <> '' AND m.doc_id % 11 <> 0 AND (s.id IS NULL OR (s.h <> '' AND s.h <> sha256(m.content)))")
def jon_05(spark, sf):
    m = memories(spark, sf)
    k = F.col("vec_id") % 3
    stored = vectors(spark, sf).join(m.select("id", F.sha2("content", 256).alias("h")), "id").select("id", F.when(k == 0, F.col("h")).when(k == 1, "old").otherwise("").alias("content_hash"))
    return J.vectors_to_do(m, stored, m.filter("doc_id % 11 = 0"))


@query("jon_06_plan_cascade", VIEWS + "SELECT id FROM memories WHERE NOT resolved AND type NOT IN ('plan', 'letter') AND id IN (SELECT 'm' || CAST(doc_id + 5 AS VARCHAR) FROM memories WHERE type = 'plan' UNION SELECT CASE WHEN doc_id % 40 = 3 THEN 'manual' ELSE 'm' || CAST(doc_id + 6 AS VARCHAR) END FROM memories WHERE type = 'plan')")
def jon_06(spark, sf):
    m, d = memories(spark, sf), F.col("doc_id")
    plans = m.filter("type = 'plan'").select(mid(d + 5).alias("related_bucket"), F.when(d % 40 == 3, "manual").otherwise(mid(d + 6)).alias("resolved_by"))
    return J.plan_cascade(m, plans).select("id")


def _incoming(spark, sf):
    d = F.col("doc_id")
    return memories(spark, sf).filter(d % 10 < 3).select(F.when(d % 10 == 2, F.concat(F.lit("new"), F.col("id"))).otherwise(F.col("id")).alias("id"), F.concat(F.lit("new "), "name").alias("name"), "created")


INCOMING = ", incoming AS (SELECT CASE WHEN doc_id % 10 = 2 THEN 'new' || id ELSE id END AS id, doc_id, 'new ' || name AS name, created FROM memories WHERE doc_id % 10 < 3)"


@query("jon_07_import_conflicts", VIEWS + INCOMING + " SELECT i.id, i.name AS new_name, i.created AS new_created, m.name AS old_name, m.created AS old_created FROM incoming i JOIN memories m ON m.id = i.id")
def jon_07(spark, sf):
    return J.import_conflicts(_incoming(spark, sf), memories(spark, sf))


@query("jon_08_import_decisions", VIEWS + INCOMING + " SELECT i.id, a.action, CASE WHEN a.action = 'keep_both' THEN 'k' || substring(sha256(i.id), 1, 12) ELSE i.id END AS new_id FROM (SELECT i.id, CASE WHEN m.id IS NULL THEN 'insert' WHEN m.doc_id % 4 = 0 THEN 'overwrite' WHEN m.doc_id % 4 = 1 THEN 'keep_both' ELSE 'skip' END AS action FROM incoming i LEFT JOIN memories m ON m.id = i.id) a JOIN incoming i ON i.id = a.id")
def jon_08(spark, sf):
    m, k = memories(spark, sf), F.col("doc_id") % 4
    decisions = m.filter(k < 3).select("id", F.when(k == 0, "overwrite").when(k == 1, "keep_both").otherwise("skip").alias("decision"))
    return J.apply_decisions(_incoming(spark, sf), m, decisions)


@query("jon_09_duplicate_pairs", VIEWS + ", marked AS (SELECT id, 'm' || CAST(doc_id + 1 AS VARCHAR) AS c, 0.95 + (doc_id % 5) / 100.0 AS s FROM memories WHERE doc_id % 31 = 0 UNION ALL SELECT id, 'm' || CAST(doc_id - 1 AS VARCHAR), 0.95 FROM memories WHERE doc_id % 31 = 1) SELECT p.a, p.b, p.score, x.name AS a_name, y.name AS b_name FROM (SELECT least(id, c) AS a, greatest(id, c) AS b, max(s)::DOUBLE AS score FROM marked GROUP BY 1, 2) p JOIN memories x ON x.id = p.a JOIN memories y ON y.id = p.b")
def jon_09(spark, sf):
    m, d = memories(spark, sf), F.col("doc_id")
    marked = m.filter(d % 31 == 0).select("id", mid(d + 1).alias("dup_candidate"), (0.95 + (d % 5) / 100.0).alias("dup_score")).unionByName(m.filter(d % 31 == 1).select("id", mid(d - 1).alias("dup_candidate"), F.lit(0.95).alias("dup_score")))
    return J.duplicate_pairs(marked, m).withColumn("score", F.round("score", 6))


@query("jon_12_surface_context", VIEWS + ", dec AS (SELECT user_id AS session, seq AS pos, trace_id AS id, seq % 3 <> 0 AS allowed FROM ledger), r AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY pos) AS rank, m.id, m.name, count(*) OVER (PARTITION BY session) > 8 AS truncated FROM dec JOIN memories m ON m.id = dec.id WHERE allowed) SELECT * FROM r WHERE rank <= 8")
def jon_12(spark, sf):
    dec = ledger(spark, sf).select(F.col("user_id").alias("session"), F.col("seq").alias("pos"), F.col("trace_id").alias("id"), (F.col("seq") % 3 != 0).alias("allowed"))
    return J.surface_context(dec, memories(spark, sf))


@query("jon_13_state_key_candidates", VIEWS + ", k AS (SELECT id, lower(domain[1]) || '-' || CAST(doc_id % 5 AS VARCHAR) AS key, created, superseded_by IS NULL AND type = 'dynamic' AS current FROM memories) SELECT a.id, count(*) AS candidates, first(b.id ORDER BY b.created DESC, b.id) AS newest FROM k a JOIN k b ON a.key = b.key AND a.id <> b.id AND b.current GROUP BY a.id")
def jon_13(spark, sf):
    from notegrid.functions.text import state_key

    m = memories(spark, sf)
    key = state_key(F.concat(F.element_at("domain", 1), F.lit("-"), (F.col("doc_id") % 5).cast("string")))
    return J.state_key_candidates(m.select("id", key.alias("key"), "created", (F.col("superseded_by").isNull() & (F.col("type") == "dynamic")).alias("current")))


#: Links of every kind: chains of 150 rows (too long at first) in every other block of 150, else groups of ten with
#: a chain, a row that leads to itself, a circle with a way into it, and a row that leads nowhere.
CHAINS_SQL = """, chains AS (SELECT id, CASE WHEN doc_id // 150 % 2 = 0 THEN CASE WHEN doc_id % 150 < 149 THEN 'm' || CAST(doc_id + 1 AS VARCHAR) END
  ELSE CASE doc_id % 10 WHEN 3 THEN NULL WHEN 4 THEN id WHEN 7 THEN 'm' || CAST(doc_id - 2 AS VARCHAR) WHEN 8 THEN 'gone' WHEN 9 THEN 'm' || CAST(doc_id - 4 AS VARCHAR) ELSE 'm' || CAST(doc_id + 1 AS VARCHAR) END END AS nxt,
  CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 10 = 2 AND doc_id // 10 % 4 = 1 THEN 'other' ELSE 'own' END AS key FROM memories)"""


def _chains(spark, sf):
    d = F.col("doc_id")
    tens = F.when(d % 10 == 3, F.lit(None)).when(d % 10 == 4, mid(d)).when(d % 10 == 7, mid(d - 2)).when(d % 10 == 8, "gone").when(d % 10 == 9, mid(d - 4)).otherwise(mid(d + 1))
    nxt = F.when(F.floor(d / 150) % 2 == 0, F.when(d % 150 < 149, mid(d + 1))).otherwise(tens)
    key = F.when(d % 6 == 0, F.lit(None)).when((d % 10 == 2) & (F.floor(d / 10) % 4 == 1), "other").otherwise("own")
    return memories(spark, sf).select("id", "doc_id", "type", nxt.alias("superseded_by"), key.alias("state_key"))


@query("jon_14_supersession_chain", VIEWS.replace("WITH ", "WITH RECURSIVE ", 1) + CHAINS_SQL + """, walk AS (
SELECT c.id AS start, c.nxt AS cur, 1 AS hops, [c.id] AS seen, coalesce(c.key <> n.key, false) AS mixed, n.id IS NOT NULL AS there, n.nxt, n.key FROM chains c LEFT JOIN chains n ON n.id = c.nxt WHERE c.nxt IS NOT NULL
UNION ALL SELECT w.start, w.nxt, w.hops + 1, list_append(w.seen, w.cur), w.mixed OR coalesce(w.key <> n.key, false), n.id IS NOT NULL, n.nxt, n.key FROM walk w LEFT JOIN chains n ON n.id = w.nxt WHERE w.nxt IS NOT NULL AND w.hops < 100 AND NOT list_contains(w.seen, w.cur)),
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY start ORDER BY hops DESC) = 1),
coded AS (SELECT *, CASE WHEN cur = start AND hops = 1 THEN 'self_link' WHEN list_contains(seen, cur) THEN 'cycle' WHEN nxt IS NOT NULL THEN 'too_long' WHEN NOT there THEN 'missing_target' WHEN mixed THEN 'key_mismatch' END AS code FROM last)
SELECT start AS id, CASE WHEN code IS NULL THEN cur END AS current_id, CAST(CASE WHEN code IN ('self_link', 'cycle') THEN 100 ELSE hops END AS BIGINT) AS hops, code FROM coded""")
def jon_14(spark, sf):
    return J.supersession_chain(_chains(spark, sf))


@query("jon_14_set_supersession", VIEWS.replace("WITH ", "WITH RECURSIVE ", 1) + """, asked AS (SELECT doc_id, doc_id * 7919 % 100003 AS seq, 'm' || CAST(doc_id AS VARCHAR) AS old_id, 'm' || CAST(doc_id + 1 AS VARCHAR) AS new_id, CASE WHEN doc_id % 4 = 0 THEN 'own' WHEN doc_id % 31 = 5 THEN 'other' END AS asked_key FROM documents),
keyed AS (SELECT id, doc_id, type, superseded_by AS nxt, CASE WHEN doc_id % 3 <> 0 THEN 'own' END AS key FROM memories),
j AS (SELECT a.*, o.nxt IS NULL AS is_open, o.key AS ok, n.key AS nk, CASE WHEN n.id IS NULL THEN 'missing_new' WHEN o.type NOT IN ('dynamic', 'permanent') OR n.type NOT IN ('dynamic', 'permanent') THEN 'not_ordinary' WHEN o.nxt = a.new_id THEN CASE WHEN asked_key IS NULL OR asked_key IS NOT DISTINCT FROM o.key THEN 'unchanged' ELSE 'key_mismatch' END WHEN n.nxt IS NOT NULL THEN 'historical_target' WHEN coalesce(asked_key, o.key, n.key) IS NULL THEN 'no_key' WHEN asked_key = 'other' THEN CASE WHEN o.key IS NULL AND n.key IS NULL THEN NULL ELSE 'key_mismatch' END END AS reason FROM asked a JOIN keyed o ON o.doc_id = a.doc_id LEFT JOIN keyed n ON n.doc_id = a.doc_id + 1),
dep AS (SELECT a.seq, b.seq AS before FROM j a LEFT JOIN j b ON b.old_id = a.new_id AND b.seq < a.seq AND b.reason IS NULL WHERE a.reason IS NULL),
w AS (SELECT seq, true AS holds FROM dep WHERE before IS NULL UNION ALL SELECT d.seq, NOT w.holds FROM w JOIN dep d ON d.before = w.seq),
g AS (SELECT b.old_id, b.seq FROM j b JOIN w ON w.seq = b.seq WHERE w.holds),
s AS (SELECT j.*, CASE WHEN g.seq < j.seq AND (reason IS NULL OR reason IN ('no_key', 'key_mismatch')) AND is_open THEN 'historical_target' ELSE coalesce(reason, 'superseded') END AS status FROM j LEFT JOIN g ON g.old_id = j.new_id)
SELECT seq, old_id, new_id, status, CASE WHEN status = 'unchanged' THEN ok WHEN status = 'superseded' THEN coalesce(asked_key, ok, nk) END AS state_key FROM s""")
def jon_14_set(spark, sf):
    """One request a row, to be replaced by the next row, in a mixed order."""
    d, m = F.col("doc_id"), memories(spark, sf)
    asked = m.select((d * 7919 % 100003).alias("seq"), mid(d).alias("old_id"), mid(d + 1).alias("new_id"), F.when(d % 4 == 0, "own").when(d % 31 == 5, "other").alias("state_key"))
    return J.set_supersessions(m.select("id", "type", "superseded_by", F.when(d % 3 != 0, "own").alias("state_key")), asked)


@query("jon_15_event_lineage", "SELECT 'e' || CAST(e.event_id AS VARCHAR) AS id, 'e' || CAST(p AS VARCHAR) AS ancestor, CAST(d AS BIGINT) AS depth FROM (SELECT event_id, unnest(range(1, 40)) AS d FROM events) e, LATERAL (SELECT e.event_id // CAST(pow(2, e.d) AS BIGINT) AS p) WHERE e.event_id // CAST(pow(2, d - 1) AS BIGINT) > 0")
def jon_15(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    edges = e.filter("event_id > 0").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("child"), F.concat(F.lit("e"), F.floor(F.col("event_id") / 2).cast("string")).alias("parent"))
    start = e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"))
    return J.lineage(edges, start)


def _graph(spark, sf):
    """Events with one or two parents each (and an unknown one), in either order."""
    e = F.col("event_id")
    name = lambda c: F.concat(F.lit("e"), c.cast("string"))
    half, third = name(F.floor(e / 2)), name(F.floor(e / 3))
    parents = F.when(e == 0, F.array(F.lit("x"))).when(e % 8 == 0, F.array(third, F.lit("x"), half)).when(e % 4 == 0, F.array(half, third)).otherwise(F.array(half))
    return table(spark, sf, "events").select(name(e).alias("id"), e.alias("seq"), F.col("user_id").alias("actor"), parents.alias("parents"), F.array(F.col("event_type"), F.concat(F.lit("user"), (F.col("user_id") % 4).cast("string"))).alias("sources"))


GRAPH_SQL = """WITH RECURSIVE g AS (SELECT event_id AS id, CASE WHEN event_id = 0 THEN [] WHEN event_id % 8 = 0 THEN [event_id // 3, -1, event_id // 2] WHEN event_id % 4 = 0 THEN [event_id // 2, event_id // 3] ELSE [event_id // 2] END AS parents, user_id AS actor, [event_type, 'user' || CAST(user_id % 4 AS VARCHAR)] AS sources FROM events),
l AS (SELECT id AS child, parent, min(pos) AS pos FROM (SELECT id, unnest(parents) AS parent, unnest(range(len(parents))) AS pos FROM g) WHERE parent >= 0 AND parent <> id GROUP BY 1, 2)"""


@query("jon_15_source_chain", GRAPH_SQL + """, p AS (SELECT id, id AS at, CAST([] AS BIGINT[]) AS path FROM g UNION ALL SELECT p.id, l.parent, list_append(p.path, l.pos) FROM p JOIN l ON l.child = p.at),
s AS (SELECT p.id, source, min(list_concat(path, [2147483647, k])) AS first FROM p JOIN (SELECT id, unnest(sources) AS source, unnest(range(len(sources))) AS k FROM g) o ON o.id = p.at GROUP BY 1, 2)
SELECT 'e' || CAST(id AS VARCHAR) AS id, row_number() OVER (PARTITION BY id ORDER BY first) AS place, source FROM s""")
def jon_15_chain(spark, sf):
    return J.source_chains(_graph(spark, sf))


@query("jon_15_children", GRAPH_SQL + " SELECT 'e' || CAST(parent AS VARCHAR) AS parent, 'e' || CAST(child AS VARCHAR) AS child, child AS seq FROM l")
def jon_15_children(spark, sf):
    return J.event_children(_graph(spark, sf))


@query("jon_15_actor_events", GRAPH_SQL + " SELECT actor, row_number() OVER (PARTITION BY actor ORDER BY id) AS place, 'e' || CAST(id AS VARCHAR) AS id FROM g")
def jon_15_actors(spark, sf):
    return J.actor_events(_graph(spark, sf))


@query("jon_16_merge_decision", VIEWS + "SELECT seq AS id, CASE WHEN seq % 4 = 0 THEN 'prefer_existing' WHEN user_id % 3 > seq % 3 THEN 'prefer_new' WHEN user_id % 3 < seq % 3 THEN 'keep_both' ELSE 'mark_conflict' END AS decision FROM ledger")
def jon_16(spark, sf):
    pairs = ledger(spark, sf).select(F.col("seq").alias("id"), F.col("body_hash").alias("ex_hash"), F.when(F.col("seq") % 4 == 0, F.col("body_hash")).otherwise("other").alias("in_hash"), F.lit(1).alias("ex_term"), (F.col("seq") % 3).alias("ex_index"), F.lit(1).alias("in_term"), (F.col("user_id") % 3).alias("in_index"))
    return J.merge_decision(pairs)


@query("jon_17_preservation", VIEWS + """SELECT id AS trace_id, unnest(list_filter(CASE WHEN doc_id % 17 = 0 THEN ['missing_target'] ELSE [CASE WHEN doc_id % 13 = 0 AND type <> 'dynamic' THEN 'kind_changed' END, CASE WHEN doc_id % 19 = 0 THEN 'state_changed' END, CASE WHEN doc_id % 23 = 0 AND anchor THEN 'anchor_changed' END] END, lambda x: x IS NOT NULL)) AS code FROM memories""")
def jon_17(spark, sf):
    d = F.col("doc_id")
    source = memories(spark, sf).select(F.col("id").alias("trace_id"), "doc_id", F.col("type").alias("kind"), F.lit("active").alias("state"), F.lit(False).alias("tombstone"), "anchor")
    target = source.filter(d % 17 != 0).select("trace_id", F.when(d % 13 == 0, "dynamic").otherwise(F.col("kind")).alias("kind"), F.when(d % 19 == 0, "archived").otherwise(F.col("state")).alias("state"), "tombstone", F.when(d % 23 == 0, False).otherwise(F.col("anchor")).alias("anchor"))
    return J.preservation(source, target)


@query("jon_18_rebuild_diff", VIEWS + "SELECT id, 'lost' AS change FROM memories WHERE id NOT IN (SELECT trace_id FROM ledger) UNION ALL SELECT DISTINCT trace_id, 'created' FROM ledger WHERE trace_id NOT IN (SELECT id FROM memories)")
def jon_18(spark, sf):
    return J.rebuild_diff(memories(spark, sf), ledger(spark, sf).select(F.col("trace_id").alias("id")).distinct())


@query("jon_19_vector_manifest", VIEWS + ", f AS (SELECT coalesce(m.id, v.id) AS id, CASE WHEN v.id IS NULL THEN 'missing' WHEN m.id IS NULL THEN 'orphan' WHEN v.vec_id % 17 = 0 THEN 'malformed' END AS kind FROM memories m FULL JOIN vectors v ON v.id = m.id), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) AS k, count(*) OVER (PARTITION BY kind) AS n FROM f WHERE kind IS NOT NULL) SELECT kind, any_value(n) AS n, string_agg(id, ',' ORDER BY id) AS first_ids FROM r WHERE k <= 20 GROUP BY kind")
def jon_19(spark, sf):
    return J.vector_manifest(memories(spark, sf), vectors(spark, sf).select("id", (F.col("vec_id") % 17 != 0).alias("valid")))


@query("jon_20_time_ripple", VIEWS + ", t AS (SELECT id, created FROM memories WHERE id IN (SELECT trace_id FROM ledger WHERE event_type = 'TraceTouched')), n AS (SELECT t.id AS source, m.id, row_number() OVER (PARTITION BY t.id ORDER BY m.id) AS k FROM t JOIN memories m ON m.id <> t.id AND abs(date_diff('second', m.created, t.created)) <= 172800 WHERE NOT m.pinned AND m.type NOT IN ('permanent', 'feel', 'plan', 'letter', 'i')) SELECT id, round(count(*) * 0.3, 1)::DOUBLE AS credit FROM n WHERE k <= 5 GROUP BY id")
def jon_20(spark, sf):
    m = memories(spark, sf)
    touched = ledger(spark, sf).filter("event_type = 'TraceTouched'").select(F.col("trace_id").alias("id"))
    return J.time_ripple(m.join(touched, "id", "left_semi"), m)


@query("jon_21_journal_audit", VIEWS + ", p AS (SELECT seq AS command, 'k' || CAST(seq % 3 AS VARCHAR) AS key FROM ledger WHERE seq % 10 < 5), j AS (SELECT seq AS command, 'k' || CAST(seq % 3 AS VARCHAR) AS key FROM ledger WHERE seq % 10 < 3 OR seq % 10 = 9 UNION ALL SELECT seq, 'k' || CAST(seq % 3 AS VARCHAR) FROM ledger WHERE seq % 10 = 1), a AS (SELECT command, key, count(*) AS n FROM p GROUP BY 1, 2), b AS (SELECT command, key, count(*) AS n FROM j GROUP BY 1, 2) SELECT * FROM (SELECT coalesce(a.command, b.command) AS command, coalesce(a.key, b.key) AS key, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'unexpected' WHEN b.n > a.n THEN 'duplicate' END AS code FROM a FULL JOIN b ON a.command = b.command AND a.key = b.key) WHERE code IS NOT NULL")
def jon_21(spark, sf):
    keyed = ledger(spark, sf).select(F.col("seq").alias("command"), F.concat(F.lit("k"), (F.col("seq") % 3).cast("string")).alias("key"))
    k = F.col("command") % 10
    return J.journal_audit(keyed.filter(k < 5), keyed.filter((k < 3) | (k == 9)).unionByName(keyed.filter(k == 1)))


@query("jon_22_daily_citations", VIEWS + ", c AS (SELECT DISTINCT 'm' || regexp_extract(x, '[0-9]+') AS id FROM (SELECT unnest(['bucket:' || CAST(doc_id * 3 AS VARCHAR), 'note:' || CAST(doc_id AS VARCHAR)]) AS x FROM documents WHERE doc_id % 9 = 0) WHERE x LIKE 'bucket:%') SELECT m.id, c.id IS NOT NULL AS cited FROM memories m LEFT JOIN c ON c.id = m.id")
def jon_22(spark, sf):
    d = F.col("doc_id")
    sources = table(spark, sf, "documents").filter(d % 9 == 0).select(F.explode(F.array(F.concat(F.lit("bucket:"), (d * 3).cast("string")), F.concat(F.lit("note:"), d.cast("string")))).alias("x"))
    cited = sources.filter(F.col("x").startswith("bucket:")).select(F.concat(F.lit("m"), F.regexp_extract("x", "[0-9]+", 0)).alias("id")).distinct().withColumn("cited", F.lit(True))
    return memories(spark, sf).select("id").join(cited, "id", "left").select("id", F.coalesce("cited", F.lit(False)).alias("cited"))


@query("jon_23_first_of_kind", VIEWS + ", n AS (SELECT id, doc_id AS pos, domain[1] || CAST(doc_id % 7 AS VARCHAR) AS tag FROM memories WHERE doc_id % 2 = 0), o AS (SELECT DISTINCT domain[1] || CAST(doc_id % 5 AS VARCHAR) AS tag FROM memories WHERE doc_id % 2 = 1) SELECT id FROM n WHERE tag NOT IN (SELECT tag FROM o) AND pos = (SELECT min(pos) FROM n x WHERE x.tag = n.tag)")
def jon_23(spark, sf):
    d, m = F.col("doc_id"), memories(spark, sf)
    tag = lambda k: F.array(F.concat(F.element_at("domain", 1), (d % k).cast("string")))
    return J.first_of_kind(m.filter(d % 2 == 0).select("id", d.alias("pos"), tag(7).alias("tags")), m.filter(d % 2 == 1).select(tag(5).alias("tags")))


@query("jon_25_observe", VIEWS + "SELECT l.seq AS command, k.kind, l.trace_id AS id, CASE k.kind WHEN 'memory' THEN CASE WHEN l.trace_id IN (SELECT id FROM memories) THEN 'observed' ELSE 'missing' END WHEN 'vector' THEN CASE WHEN l.trace_id IN (SELECT id FROM vectors) THEN 'observed' ELSE 'missing' END ELSE 'unknown' END AS status FROM ledger l, (SELECT unnest(['memory', 'vector', 'mirror']) AS kind) k")
def jon_25(spark, sf):
    entries = ledger(spark, sf).select(F.col("seq").alias("command"), F.explode(F.array(*map(F.lit, ("memory", "vector", "mirror")))).alias("kind"), F.col("trace_id").alias("id"))
    return J.observe(entries, memories(spark, sf), vectors(spark, sf))
