"""Queries of aggregations, ordered operators, set operators and lifecycle jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from notegrid.functions import policy, scores
from notegrid.functions.policy import REASONS_SQL
from notegrid.functions.scores import DAYS_SQL, DECAY_SQL, SCORE_SQL
from notegrid.functions.text import token_estimate
from notegrid.operators import aggregates as A
from notegrid.operators import lifecycle as L
from notegrid.operators import ordered as O
from notegrid.plans.joined import mid
from notegrid.plans.registry import query
from notegrid.plans.rows import AT_SQL
from notegrid.schema import VIEWS, as_of, ledger, memories, table, vectors

TOKENS_SQL = "CAST(trunc(len(regexp_extract_all({0}, '[a-zA-Z]+')) * 1.3::DOUBLE + length({0}) * 0.05::DOUBLE) AS BIGINT)"
LIVE_SQL = ", known AS (SELECT * FROM ledger WHERE event_type <> 'Other'), made AS (SELECT trace_id, coalesce(max(seq) FILTER (WHERE event_type = 'TraceCreated'), min(seq)) AS created_seq FROM known GROUP BY 1), live AS (SELECT k.*, created_seq FROM known k JOIN made USING (trace_id) WHERE seq >= created_seq)"


@query("agg_01_vault_stats", VIEWS + "SELECT 'type' AS kind, type AS name, count(*) AS n, sum(strlen(content))::BIGINT AS bytes FROM memories GROUP BY 2 UNION ALL SELECT 'domain', domain[1], count(*), sum(strlen(content))::BIGINT FROM memories GROUP BY 2")
def agg_01(spark, sf):
    return A.vault_stats(memories(spark, sf))


@query("agg_02_pinned_count", VIEWS + "SELECT count(DISTINCT id) AS n FROM memories WHERE pinned AND type NOT IN ('archived', 'tombstone')")
def agg_02(spark, sf):
    return memories(spark, sf).filter(F.col("pinned") & ~policy.terminal()).agg(F.countDistinct("id").alias("n"))


@query("agg_03_anchors", VIEWS + "SELECT id, created FROM memories WHERE anchor")
def agg_03(spark, sf):
    return memories(spark, sf).filter("anchor").orderBy("created", "id").select("id", "created")


@query("agg_04_concept_nodes", VIEWS + ", t AS (SELECT id, anchor, unnest(list_concat(tags, domain)) AS label FROM memories) SELECT lower(label) AS key, any_value(label) AS label, 'tag' AS kind, count(DISTINCT id) AS freq, bool_or(anchor) AS anchor FROM t GROUP BY 1")
def agg_04(spark, sf):
    return A.concept_nodes(A.concept_tokens(memories(spark, sf)))


@query("agg_05_cooccurrence", VIEWS + ", t AS (SELECT DISTINCT id, unnest(list_concat(tags, domain)) AS key FROM memories) SELECT x.key AS a, y.key AS b, count(*) AS weight FROM t x JOIN t y ON x.id = y.id AND x.key < y.key GROUP BY 1, 2")
def agg_05(spark, sf):
    return A.cooccurrence(A.concept_tokens(memories(spark, sf)))


@query("agg_06_trace_metadata", VIEWS + LIVE_SQL + " SELECT trace_id, 'k' AS key, arg_max(json_extract_string(payload, '$.k'), seq) AS value FROM live GROUP BY 1")
def agg_06b(spark, sf):
    return A.trace_metadata(ledger(spark, sf))


@query("agg_09_vault_health", VIEWS + "SELECT \"check\", n, CASE WHEN n = 0 THEN 'ok' WHEN \"check\" = 'duplicate_ids' THEN 'error' ELSE 'warning' END AS status FROM (SELECT 'duplicate_ids' AS \"check\", count(*) AS n FROM (SELECT id FROM memories GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'orphan_vectors', count(*) FROM vectors WHERE id NOT IN (SELECT id FROM memories) UNION ALL SELECT 'missing_vectors', count(*) FROM memories WHERE id NOT IN (SELECT id FROM vectors))")
def agg_09(spark, sf):
    return A.health(memories(spark, sf), vectors(spark, sf))


@query("agg_11_plan_board", VIEWS + f"SELECT status, count(*) AS n, sum(CAST(status = 'active' AND created + INTERVAL 20 DAY <= {AT_SQL} AS INT))::BIGINT AS stale FROM (SELECT *, CASE WHEN resolved THEN 'resolved' WHEN doc_id % 3 = 0 THEN 'abandoned' ELSE 'active' END AS status FROM memories WHERE type = 'plan') GROUP BY 1")
def agg_11(spark, sf):
    plans = memories(spark, sf).filter("type = 'plan'").withColumn("status", F.when(F.col("resolved"), "Resolved").when(F.col("doc_id") % 3 == 0, "abandoned").otherwise("odd"))
    return A.plan_board(plans, as_of())


CYCLE_SQL = VIEWS + f", c AS (SELECT *, NOT resolved AND importance <= 4 AND {DAYS_SQL} > 30 AS auto FROM memories WHERE type NOT IN ('permanent', 'feel', 'i', 'plan', 'letter') AND NOT pinned AND NOT anchor), s AS (SELECT id, auto AS auto_resolved, {DECAY_SQL.format(days=DAYS_SQL, resolved='(resolved OR auto)')} AS score FROM c) "


@query("agg_12_decay_report", CYCLE_SQL + "SELECT count(*) AS checked, count(*) FILTER (WHERE score < 0.3) AS archived, count(*) FILTER (WHERE auto_resolved) AS auto_resolved, min(score) AS lowest FROM s")
def agg_12(spark, sf):
    return A.decay_report(memories(spark, sf), as_of())


@query("lif_01_decay_cycle", CYCLE_SQL + "SELECT id, auto_resolved, score, score < 0.3 AS archive FROM s")
def lif_01(spark, sf):
    return L.decay_cycle(memories(spark, sf), as_of())


@query("agg_16_surfacing_summary", "SELECT user_id AS run, event_type AS kind, count(*) FILTER (WHERE event_id % 3 = 0) AS returned, count(*) FILTER (WHERE event_id % 3 = 1) AS pointer, count(*) FILTER (WHERE event_id % 3 = 2) AS omitted, coalesce(sum(event_id % 50) FILTER (WHERE event_id % 3 = 0), 0)::BIGINT AS tokens FROM events GROUP BY 1, 2")
def agg_16(spark, sf):
    k = F.col("event_id") % 3
    return A.surfacing_summary(table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("kind"), F.when(k == 0, "returned").when(k == 1, "pointer").otherwise("omitted").alias("outcome"), (F.col("event_id") % 50).alias("tokens")))


@query("agg_17_ledger_invariants", VIEWS + ", t AS (SELECT trace_id, bool_or(event_type = 'TraceDeletedToArchive') AS gone, bool_or(event_type = 'TraceArchived') AS kept, bool_or(seq % 37 = 0) AND bool_or(seq % 37 <> 0) AS changed FROM ledger GROUP BY 1) SELECT trace_id, 'erased_without_archive' AS code FROM t WHERE gone AND NOT kept UNION ALL SELECT trace_id, 'hash_changed' FROM t WHERE changed")
def agg_17(spark, sf):
    return A.ledger_invariants(ledger(spark, sf).withColumn("body_hash", F.when(F.col("seq") % 37 == 0, "other").otherwise(F.col("body_hash"))))


ERASURES_SQL = VIEWS + """, e AS (SELECT seq, trace_id, CASE event_type WHEN 'TraceArchived' THEN 'TraceHardDeleted' WHEN 'TraceTouched' THEN 'AdminErasure' WHEN 'TraceUpdated' THEN 'TraceReconstructed' ELSE event_type END AS kind, CASE WHEN seq % 3 = 0 THEN 'other' ELSE 'own' END AS hash FROM ledger),
f AS (SELECT trace_id, bool_or(kind = 'TraceDeletedToArchive') AS kept, bool_or(kind = 'TraceCreated' AND seq % 2 = 0) AS test, min(seq) FILTER (kind = 'TraceCreated') AS first, min_by(hash, seq) FILTER (kind = 'TraceCreated') AS first_hash FROM e GROUP BY 1)
SELECT seq, trace_id, 'no_silent_erasure' AS code FROM e JOIN f USING (trace_id) WHERE kind = 'TraceHardDeleted' AND NOT kept AND NOT test UNION ALL SELECT seq, trace_id, 'admin_erasure_logged_as_internal_forgetting' FROM e WHERE kind = 'AdminErasure' AND seq % 4 <> 1
UNION ALL SELECT seq, trace_id, 'reconstruction_overwrote_original_trace' FROM e JOIN f USING (trace_id) WHERE kind = 'TraceReconstructed' AND (seq % 10 = 0 OR (seq % 2 = 0 AND first < seq AND first_hash <> hash))"""


@query("agg_17_erasure_invariants", ERASURES_SQL)
def agg_17_erasures(spark, sf):
    s, k = F.col("seq"), F.col("event_type")
    kind = F.when(k == "TraceArchived", "TraceHardDeleted").when(k == "TraceTouched", "AdminErasure").when(k == "TraceUpdated", "TraceReconstructed").otherwise(k)
    made = F.when(s % 2 == 0, '{"provenance": {"kind": "test", "erasable": true}}').otherwise('{"provenance": {"kind": "test", "erasable": "no"}}')
    admin = F.when(s % 4 == 0, '{"storage_action": "external", "internal_forgetting": "yes"}').when(s % 4 == 1, '{"external_storage_action": true}').when(s % 4 == 2, '{"action": "Forget"}')
    again = F.when(s % 10 == 0, '{"replaces_original": 1}').when(s % 2 == 0, '{"updates_original": true}').otherwise("{}")
    payload = F.when(k == "TraceCreated", made).when(k == "TraceTouched", admin).when(k == "TraceUpdated", again)
    return A.erasure_violations(ledger(spark, sf).select("seq", "trace_id", kind.alias("event_type"), F.when(s % 3 == 0, "other").otherwise("own").alias("body_hash"), payload.alias("payload")))


@query("agg_18_decision_audit", VIEWS + f"SELECT id, CASE WHEN contains(reasons, 'dont_surface') THEN 'dont_surface_leak' ELSE 'policy_bypass' END AS code FROM (SELECT id, {REASONS_SQL['spontaneous']} AS reasons FROM memories WHERE doc_id % 3 = 0) WHERE reasons <> ''")
def agg_18(spark, sf):
    return A.decision_audit(memories(spark, sf).withColumn("allowed", F.col("doc_id") % 3 == 0), policy.denial_reasons("spontaneous"))


MARKERS = {"imperative": "(?i)released under|you must", "secret": "token = ", "symbols": "[#$%&*]{3}"}


@query("agg_19_context_audit", " UNION ALL ".join(f"SELECT doc_id AS id, '{c}' AS code FROM documents WHERE regexp_matches(text, '{p}')" for c, p in MARKERS.items()))
def agg_19(spark, sf):
    return A.marked_texts(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), MARKERS)


@query("agg_20_compression_audit", "SELECT event_id AS id, unnest(list_filter([CASE WHEN event_id % 4 = 0 THEN 'loss_not_declared' END, CASE WHEN event_id % 5 = 0 THEN 'no_lineage' END], lambda x: x IS NOT NULL)) AS code FROM events WHERE event_type = 'click'")
def agg_20(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'click'")
    return e.select(F.col("event_id").alias("id"), A.codes((F.col("event_id") % 4 == 0, "loss_not_declared"), (F.col("event_id") % 5 == 0, "no_lineage")))


@query("agg_21_tool_log_audit", "SELECT event_id AS id, unnest(list_filter([CASE WHEN value > 50 AND event_type = 'view' THEN 'unrestricted_recall' END, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) > 90 THEN 'forbidden_flag' END], lambda x: x IS NOT NULL)) AS code FROM events")
def agg_21(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), A.codes(((F.col("value") > 50) & (F.col("event_type") == "view"), "unrestricted_recall"), (k > 90, "forbidden_flag")))


@query("agg_22_replay_validation", VIEWS + ", r AS (SELECT seq AS pos, CASE WHEN seq % 41 = 0 THEN seq - 2 ELSE seq END AS seq, CASE WHEN seq % 53 = 0 THEN '' ELSE trace_id END AS trace_id, CASE WHEN seq % 59 = 0 THEN 'sha256:xx' ELSE body_hash END AS body_hash FROM ledger), p AS (SELECT *, lag(seq) OVER (ORDER BY pos) AS prev FROM r) SELECT seq, unnest(list_filter([CASE WHEN prev >= seq THEN 'seq_not_increasing' END, CASE WHEN trace_id = '' THEN 'missing_trace_id' END, CASE WHEN NOT regexp_full_match(body_hash, 'sha256:[0-9a-f]{64}') THEN 'bad_body_hash' END], lambda x: x IS NOT NULL)) AS code FROM p")
def agg_22(spark, sf):
    s = F.col("seq")
    rows = ledger(spark, sf).select(s.alias("pos"), F.when(s % 41 == 0, s - 2).otherwise(s).alias("seq"), F.when(s % 53 == 0, "").otherwise(F.col("trace_id")).alias("trace_id"), F.when(s % 59 == 0, "sha256:xx").otherwise(F.col("body_hash")).alias("body_hash"))
    return A.replay_validation(rows)


@query("agg_23_segment_audit", "SELECT user_id AS trace_id, bool_or(event_type = 'signup') AS has_user_record, bool_or(event_type = 'error') AND NOT bool_or(event_type = 'purchase') AS removed_without_tombstone FROM events GROUP BY 1")
def agg_23(spark, sf):
    has = lambda k: F.bool_or(F.col("event_type") == k)
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("trace_id")).agg(has("signup").alias("has_user_record"), (has("error") & ~has("purchase")).alias("removed_without_tombstone"))


@query("agg_24_decision_listing", "SELECT event_id AS id, event_type AS module, CAST(json_extract_string(props, '$.k') AS INT) AS operation FROM events WHERE event_type = 'view' ORDER BY event_id DESC LIMIT 25")
def agg_24(spark, sf):
    r = table(spark, sf, "events").filter("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("event_type").alias("module"), F.from_json("props", "k int")["k"].alias("operation"))
    return r.orderBy(F.desc("id")).limit(25)


@query("agg_27_duplicate_files", VIEWS + "SELECT id, count(*) AS n, bool_or(path LIKE '%conflict%') AS conflict FROM (SELECT id, id || '.md' AS path FROM memories UNION ALL SELECT id, id || ' (conflict 1).md' FROM memories WHERE doc_id % 13 = 0) GROUP BY id HAVING count(*) > 1")
def agg_27(spark, sf):
    m = memories(spark, sf)
    files = m.select("id", F.concat("id", F.lit(".md")).alias("path")).unionByName(m.filter("doc_id % 13 = 0").select("id", F.concat("id", F.lit(" (conflict 1).md")).alias("path")))
    return files.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.rlike("path", F.lit(r"(?i)\(conflict|conflicted copy"))).alias("conflict")).filter("n > 1")


@query("agg_28_permanent_diagnosis", VIEWS + "SELECT count(*) AS permanent, count(*) FILTER (WHERE pinned) AS pinned, count(*) FILTER (WHERE id NOT IN (SELECT id FROM vectors)) AS without_vector FROM memories WHERE type = 'permanent'")
def agg_28(spark, sf):
    p = memories(spark, sf).filter("type = 'permanent'").join(vectors(spark, sf).select("id", F.lit(1).alias("v")), "id", "left")
    return p.agg(F.count(F.lit(1)).alias("permanent"), F.count_if("pinned").alias("pinned"), F.count_if(F.col("v").isNull()).alias("without_vector"))


@query("agg_29_vector_sizes", "SELECT CAST(len(embedding) AS INT) AS size, count(*) AS n, len(embedding) = 64 AS matches FROM embeddings GROUP BY 1, 3")
def agg_29(spark, sf):
    return A.vector_sizes(table(spark, sf, "embeddings"), 64)


@query("agg_30_pinned_desync", VIEWS + "SELECT count(DISTINCT id) AS total, count(*) FILTER (WHERE pinned) AS pinned, count(*) FILTER (WHERE type = 'permanent' AND NOT pinned) AS permanent_unpinned FROM memories")
def agg_30(spark, sf):
    return memories(spark, sf).agg(F.countDistinct("id").alias("total"), F.count_if("pinned").alias("pinned"), F.count_if((F.col("type") == "permanent") & ~F.col("pinned")).alias("permanent_unpinned"))


@query("agg_31_receipt_audit", """WITH r AS (SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS id, list(event_type ORDER BY event_id) AS s FROM events GROUP BY 1),
p AS (SELECT id, list_filter([coalesce(list_position(s, 'view'), 0), coalesce(list_position(s, 'click'), 0), coalesce(list_position(s, 'purchase'), 0)], lambda x: x > 0) AS p FROM r)
SELECT id, 'missing_stage' AS code FROM p WHERE len(p) < 3 UNION ALL SELECT id, 'misordered' FROM p WHERE p <> list_sort(p)""")
def agg_31(spark, sf):
    # a receipt is what a user did on a day, in order
    own = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date(F.col("ts").cast("timestamp_ntz")).cast("string"))
    acts = table(spark, sf, "events").groupBy(own.alias("id")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"))
    return A.receipt_audit(acts.select("id", F.transform("x", lambda e: e["event_type"]).alias("stages")), ["view", "click", "purchase"])


BOUNDARY_SQL = """WITH r AS (SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS id, list(event_type ORDER BY event_id) AS s, min(event_id) AS k FROM events GROUP BY 1),
q AS (SELECT id, s, k % 3 = 0 AS kind, list_contains(s, 'purchase') AS wrote, list_contains(s, 'signup') AS named, k % 5 <> 0 AS allowed, k % 7 <> 0 AS valid, k % 11 = 0 AS direct FROM r), p AS (SELECT *, kind OR wrote OR named AS m FROM q),
w AS (SELECT *, CASE WHEN m THEN ['view', 'click', 'purchase'] ELSE ['view', 'click'] END AS want FROM p), o AS (SELECT *, list_filter(list_transform(want, lambda x: coalesce(list_position(s, x), 0)), lambda x: x > 0) AS places FROM w)
SELECT id, 'missing_boundary_stage' AS code, stage FROM (SELECT id, s, unnest(want) AS stage FROM w) WHERE NOT list_contains(s, stage) UNION ALL SELECT id, 'boundary_stage_order_invalid', NULL FROM o WHERE places <> list_sort(places) UNION ALL SELECT id, 'adapter_direct_memory_write', NULL FROM w WHERE direct
UNION ALL SELECT id, 'ledger_append_after_policy_denial', NULL FROM w WHERE wrote AND NOT allowed UNION ALL SELECT id, 'mutation_without_events', NULL FROM w WHERE m AND NOT named UNION ALL SELECT id, 'mutation_without_ledger_append', NULL FROM w WHERE m AND NOT wrote
UNION ALL SELECT id, 'ledger_append_without_event_policy_validation', NULL FROM w WHERE wrote AND NOT (valid AND coalesce(list_position(s, 'click'), 0) > 0 AND list_position(s, 'click') < list_position(s, 'purchase'))"""


@query("agg_31_boundary_audit", BOUNDARY_SQL)
def agg_31_boundary(spark, sf):
    # a command is what a user did on a day, in order; a purchase stands for the append to the ledger
    own = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date(F.col("ts").cast("timestamp_ntz")).cast("string"))
    acts = table(spark, sf, "events").groupBy(own.alias("id")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"), F.min("event_id").alias("k"))
    stages, k = F.transform("x", lambda e: e["event_type"]), F.col("k")
    receipts = acts.select("id", F.when(k % 3 == 0, "write").otherwise("read").alias("kind"), stages.alias("stages"), F.filter(stages, lambda e: e == "signup").alias("events"), F.array_contains(stages, "purchase").alias("ledger_appended"), (k % 5 != 0).alias("preflight_allowed"), (k % 7 != 0).alias("validation_allowed"), (k % 11 == 0).alias("direct_write"))
    return A.boundary_audit(receipts, ["write"], ["view", "click", "purchase"], ["view", "click"], "click", "purchase")


# --- ordered ----------------------------------------------------------------------------------------


def _ranked(spark, sf, session):
    return memories(spark, sf).select(session.alias("session"), F.col("doc_id").alias("rank"), "id", token_estimate(F.col("content")).alias("tokens"))


RANKED_SQL = f", r AS (SELECT doc_id // 100 AS session, doc_id AS rank, id, {TOKENS_SQL.format('content')} AS tokens FROM memories)"


@query("win_01_budget_prefix", VIEWS + RANKED_SQL + " SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY session ORDER BY rank)::BIGINT AS spent FROM r) WHERE spent <= 5000")
def win_01(spark, sf):
    return O.budget_prefix(_ranked(spark, sf, F.floor(F.col("doc_id") / 100)), "session", 5000)


GREEDY_SQL = """, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY rank) AS k FROM r),
g AS (SELECT session, k, id, tokens <= {budget} AS took, {budget} - CASE WHEN tokens <= {budget} THEN tokens ELSE 0 END AS room FROM n WHERE k = 1
UNION ALL SELECT n.session, n.k, n.id, n.tokens <= g.room, g.room - CASE WHEN n.tokens <= g.room THEN n.tokens ELSE 0 END FROM g JOIN n ON n.session = g.session AND n.k = g.k + 1)
SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY k) - 1 AS INT) AS pos, id FROM g WHERE took"""
RECURSIVE = VIEWS.replace("WITH ", "WITH RECURSIVE ", 1)


@query("win_02_budget_greedy", RECURSIVE + RANKED_SQL + GREEDY_SQL.format(budget=5000))
def win_02(spark, sf):
    return O.budget_greedy(_ranked(spark, sf, F.floor(F.col("doc_id") / 100)), "session", 5000)


@query("win_03_chunk_turns", f"""WITH RECURSIVE r AS (SELECT conv_id, turn, {TOKENS_SQL.format('text')} AS tokens FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, tokens) AS k FROM r),
g AS (SELECT conv_id, turn, k, 0 AS chunk, CASE WHEN tokens > 600 THEN 0 ELSE tokens END AS held, tokens > 600 AS closed FROM n WHERE k = 1
UNION ALL SELECT n.conv_id, n.turn, n.k, g.chunk + CAST(n.tokens > 600 OR g.closed OR g.held + n.tokens > 400 AS INT), CASE WHEN n.tokens > 600 THEN 0 WHEN g.closed OR g.held + n.tokens > 400 THEN n.tokens ELSE g.held + n.tokens END, n.tokens > 600 FROM g JOIN n ON n.conv_id = g.conv_id AND n.k = g.k + 1)
SELECT conv_id, turn, chunk FROM g""")
def win_03(spark, sf):
    return O.chunk_turns(table(spark, sf, "conversations").select("conv_id", "turn", token_estimate(F.col("text")).alias("tokens")), 400)


LINE_SQL = "'[' || CASE WHEN role = 'user' THEN 'user' ELSE 'AI' END || '] ' || text"


@query("win_03_chunks", f"""WITH RECURSIVE r AS (SELECT conv_id, turn, {LINE_SQL} AS line, {TOKENS_SQL.format('(' + LINE_SQL + ')')} AS tokens, CASE WHEN turn % 3 = 0 THEN '' ELSE 't' || CAST(turn AS VARCHAR) END AS ts FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM r),
g AS (SELECT conv_id, turn, line, ts, k, 0 AS chunk, CASE WHEN tokens > 600 THEN 0 ELSE tokens END AS held, tokens > 600 AS closed FROM n WHERE k = 1
UNION ALL SELECT n.conv_id, n.turn, n.line, n.ts, n.k, g.chunk + CAST(n.tokens > 600 OR g.closed OR g.held + n.tokens > 400 AS INT), CASE WHEN n.tokens > 600 THEN 0 WHEN g.closed OR g.held + n.tokens > 400 THEN n.tokens ELSE g.held + n.tokens END, n.tokens > 600 FROM g JOIN n ON n.conv_id = g.conv_id AND n.k = g.k + 1)
SELECT conv_id, chunk, sha256(string_agg(line, chr(10) ORDER BY turn)) AS h, coalesce(min_by(ts, turn) FILTER (ts <> ''), '') AS start, max_by(ts, turn) AS "end", count(*) AS turn_count FROM g GROUP BY conv_id, chunk""")
def win_03_chunks(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("t"), F.col("turn").cast("string"))).alias("ts"))
    return O.chunks(turns, 400).withColumn("h", F.sha2("content", 256)).drop("content")


@query("win_04_importance_reserved", VIEWS + ", r AS (SELECT id, importance, row_number() OVER (PARTITION BY importance ORDER BY created DESC, id DESC) AS k, created FROM memories WHERE importance >= 7) SELECT id, importance FROM r ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, importance DESC, created DESC, id DESC LIMIT 20")
def win_04(spark, sf):
    return O.importance_reserved(memories(spark, sf), 7, 20)


@query("win_05_canonical_rows", VIEWS + ", f AS (SELECT CASE WHEN doc_id % 50 = 1 THEN '' ELSE 'm' || CAST(doc_id // 2 AS VARCHAR) END AS id, 'p' || CAST(doc_id AS VARCHAR) AS path FROM memories) SELECT id, path FROM f WHERE id = '' UNION ALL SELECT id, min(path) FROM f WHERE id <> '' GROUP BY id")
def win_05(spark, sf):
    d = F.col("doc_id")
    return O.canonical_rows(memories(spark, sf).select(F.when(d % 50 == 1, "").otherwise(mid(F.floor(d / 2))).alias("id"), F.concat(F.lit("p"), d.cast("string")).alias("path")))


@query("win_07_reflection", VIEWS + "SELECT id FROM memories WHERE created BETWEEN TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 48 HOUR AND TIMESTAMP '2024-01-02 00:00:00' AND NOT resolved AND NOT digested AND doc_id % 3 <> 0 ORDER BY created DESC, id LIMIT 2")
def win_07(spark, sf):
    m = memories(spark, sf)
    return O.reflection(m, m.filter("doc_id % 3 = 0"), F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'"))


@query("win_08_quota", VIEWS + "SELECT doc_id AS seq, id, row_number() OVER (ORDER BY doc_id) + 5 <= 24 AS admitted, row_number() OVER (ORDER BY doc_id) + 5 > 22 AS warned FROM memories WHERE importance >= 9")
def win_08(spark, sf):
    return O.admit(memories(spark, sf).filter("importance >= 9").select(F.col("doc_id").alias("seq"), "id"), 5, 24, 22)


@query("win_11_review_state", VIEWS + f", p AS (SELECT id, CASE WHEN resolved THEN 'resolved' ELSE 'active' END AS status, CASE WHEN doc_id % 3 = 0 THEN created + INTERVAL 9 DAY WHEN doc_id % 3 = 1 THEN created + INTERVAL 4 DAY ELSE created END AS c FROM memories WHERE type = 'plan') SELECT id, c AS last_confirmed_at, greatest(0, date_diff('second', c, {AT_SQL})) // 86400 AS days_since, c + INTERVAL 30 DAY AS next_review_at, status = 'active' AND {AT_SQL} >= c + INTERVAL 30 DAY AS is_stale FROM p")
def win_11(spark, sf):
    d, c = F.col("doc_id") % 3, F.col("created")
    entry = lambda days, a: F.struct((c + F.expr(f"INTERVAL {days} DAYS")).alias("ts"), F.lit(a).alias("action"))
    plans = memories(spark, sf).filter("type = 'plan'").select("id", "created", F.when(F.col("resolved"), "resolved").otherwise("active").alias("status"), F.when(d == 0, c + F.expr("INTERVAL 9 DAYS")).alias("last_confirmed_at"), F.when(d < 2, F.array(entry(2, "confirm"), entry(4, "edit"), entry(6, "note"))).otherwise(F.array(entry(1, "note"))).alias("change_log"))
    return A.review_state(plans, as_of())


@query("win_12_daily_sources", VIEWS + ", r AS (SELECT CAST(created - INTERVAL 4 HOUR AS DATE) AS day, doc_id AS pos, id, least(length(content), 4000) AS size FROM memories), c AS (SELECT *, greatest(0, least(size, 60000 - coalesce(sum(size) OVER (PARTITION BY day ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM r) SELECT day, id, CAST(take AS BIGINT) AS chars FROM c WHERE take > 0")
def win_12(spark, sf):
    from notegrid.functions.text import logical_day

    return O.daily_sources(memories(spark, sf).select(logical_day(F.col("created")).alias("day"), F.col("doc_id").alias("pos"), "id", "content"), 4000, 60000)


# --- sets and lifecycle -----------------------------------------------------------------------------


@query("set_01_id_sets", VIEWS + "SELECT id, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 5 = 1 THEN 'removed' ELSE 'common' END AS change FROM memories")
def set_01(spark, sf):
    k = F.col("doc_id") % 5
    old, new = memories(spark, sf).filter(k != 0).select("id"), memories(spark, sf).filter(k != 1).select("id")
    tag = lambda df, n: df.select("id", F.lit(n).alias("change"))
    return tag(new.exceptAll(old), "added").unionByName(tag(old.exceptAll(new), "removed")).unionByName(tag(old.intersect(new), "common"))


@query("set_02_tag_union", VIEWS + "SELECT id, CASE WHEN tags[1] < domain[1] THEN tags[1] || ',' || domain[1] ELSE domain[1] || ',' || tags[1] END AS merged FROM memories")
def set_02(spark, sf):
    return memories(spark, sf).select("id", F.array_join(F.array_sort(F.array_union(F.concat("tags", "domain"), "tags")), ",").alias("merged"))


@query("set_03_quotes_union", VIEWS + ", w AS (SELECT id, string_split(name, ' ') AS w FROM memories), b AS (SELECT id, list_concat(w[1:2], w[2:4]) AS b FROM w), d AS (SELECT id, list_filter(b, lambda x, i: list_position(b, x) = i) AS d FROM b) SELECT id, array_to_string(d[1:3], ',') AS quotes, greatest(0, len(d) - 3)::BIGINT AS dropped FROM d")
def set_03(spark, sf):
    words = F.split("name", " ")
    rows = memories(spark, sf).select("id", F.slice(words, 1, 2).alias("existing"), F.slice(words, 2, 3).alias("incoming"))
    return L.quotes_union(rows).withColumn("quotes", F.array_join("quotes", ","))


@query("lif_02_touch_many", VIEWS + "SELECT m.id, floor(activation_count + 0.6) + count(*) AS activation_count FROM memories m JOIN ledger l ON l.trace_id = m.id WHERE l.event_type = 'TraceTouched' GROUP BY m.id, activation_count")
def lif_02(spark, sf):
    m = memories(spark, sf).withColumn("activation_count", F.col("activation_count") + 0.6)
    return L.touch_many(m, ledger(spark, sf).filter("event_type = 'TraceTouched'").select(F.col("trace_id").alias("id")))


@query("lif_04_soft_delete", VIEWS + f"SELECT id, type, doc_id % 12 = 0 AS tombstone, CASE WHEN doc_id % 12 = 0 THEN {AT_SQL} END AS deleted_at FROM memories")
def lif_04(spark, sf):
    m = memories(spark, sf)
    return L.soft_delete(m, m.filter("doc_id % 12 = 0"), as_of()).select("id", "type", "tombstone", "deleted_at")


@query("lif_05_exact_dedup", VIEWS + ", live AS (SELECT sha256(content) AS h, min(id) AS live_id FROM memories WHERE doc_id % 2 = 0 GROUP BY 1), i AS (SELECT doc_id AS seq, sha256(content) AS h FROM memories WHERE doc_id % 2 = 1), f AS (SELECT h, min(seq) AS f FROM i GROUP BY 1) SELECT seq, CASE WHEN live_id IS NOT NULL OR seq > f THEN 'deduplicated' ELSE 'created' END AS disposition, coalesce(live_id, 'new' || CAST(f AS VARCHAR)) AS id FROM i JOIN f USING (h) LEFT JOIN live USING (h)")
def lif_05(spark, sf):
    m, k = memories(spark, sf), F.col("doc_id") % 2
    return L.exact_dedup(m.filter(k == 1).select(F.col("doc_id").alias("seq"), "content"), m.filter(k == 0))


@query("lif_06_create", VIEWS + f"SELECT 'b' || substring(sha256('b1|' || CAST(doc_id AS VARCHAR) || '|' || content), 1, 12) AS id, CASE WHEN pinned THEN 'permanent' ELSE 'dynamic' END AS type, CAST(CASE WHEN pinned THEN 10 ELSE least(10, importance + 3) END AS INT) AS importance, least(1.0::DOUBLE, valence * 1.5::DOUBLE) AS valence, pinned, {AT_SQL} AS created FROM memories")
def lif_06(spark, sf):
    return L.create(memories(spark, sf).select(F.col("doc_id").alias("seq"), "content", (F.col("importance") + 3).alias("importance"), F.lit(None).cast("string").alias("type"), "pinned", (F.col("valence") * 1.5).alias("valence")), "b1", as_of())


@query("lif_08_patch", VIEWS + "SELECT m.id, CASE WHEN doc_id % 8 = 0 THEN 'not_found' END AS reject_reason, CASE WHEN doc_id % 8 <> 0 THEN CASE WHEN doc_id % 8 = 4 THEN 'permanent' WHEN pinned AND type = 'permanent' THEN 'dynamic' ELSE type END END AS type, CASE WHEN doc_id % 8 <> 0 THEN CASE WHEN doc_id % 8 = 4 THEN 10 ELSE least(10, importance + 4) END END AS importance FROM (SELECT *, id AS old FROM (SELECT CASE WHEN doc_id % 8 = 0 THEN 'x' || id ELSE id END AS id, * EXCLUDE (id) FROM memories)) m WHERE doc_id % 4 = 0 OR doc_id % 25 = 0")
def lif_08(spark, sf):
    m, d = memories(spark, sf), F.col("doc_id")
    p = m.filter((d % 4 == 0) | (d % 25 == 0)).select(F.when(d % 8 == 0, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id")).alias("id"), (F.col("importance") + 4).alias("importance"), (d % 8 == 4).alias("pinned"))
    return L.patch(m, p)


@query("lif_09_fragment_patch", VIEWS + ", r AS (SELECT id, content, CASE WHEN doc_id % 3 = 0 THEN 'license' WHEN doc_id % 3 = 1 THEN 'the' ELSE domain[1] END AS o FROM memories) SELECT id, CASE WHEN instr(content, o) = 0 THEN 'not_found' WHEN instr(substring(content, instr(content, o) + 1), o) > 0 THEN 'ambiguous' ELSE 'replaced' END AS result, sha256(CASE WHEN instr(content, o) > 0 AND instr(substring(content, instr(content, o) + 1), o) = 0 THEN replace(content, o, '<new>') ELSE content END) AS h FROM r")
def lif_09(spark, sf):
    d = F.col("doc_id") % 3
    rows = memories(spark, sf).select("id", "content", F.when(d == 0, "license").when(d == 1, "the").otherwise(F.element_at("domain", 1)).alias("old"), F.lit("<new>").alias("new"))
    return L.fragment_patch(rows).select("id", "result", F.sha2("content", 256).alias("h"))


@query("lif_10_rename_term", VIEWS + "SELECT id, ((length(content) - length(replace(content, 'tion', ''))) // 4 + (length(name) - length(replace(name, 'tion', ''))) // 4) AS replacements, sha256(replace(content, 'tion', 'TION')) AS h FROM memories WHERE contains(content, 'tion') OR contains(name, 'tion')")
def lif_10(spark, sf):
    return L.rename_term(memories(spark, sf), "tion", "TION").select("id", "replacements", F.sha2("content", 256).alias("h"))


@query("lif_11_batch_actions", VIEWS + "SELECT CASE WHEN doc_id % 3 = 0 THEN 'q' || id ELSE id END AS id, 'archive' AS action, CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'updated' END AS status FROM memories WHERE doc_id % 2 = 0")
def lif_11(spark, sf):
    d, m = F.col("doc_id"), memories(spark, sf)
    return L.batch_actions(m, m.filter(d % 2 == 0).select(F.when(d % 3 == 0, F.concat(F.lit("q"), F.col("id"))).otherwise(F.col("id")).alias("id"), F.lit("archive").alias("action")))


@query("lif_18_feel_domain_fix", VIEWS + "SELECT id, 'feel' AS domain FROM memories WHERE type = 'feel' AND domain <> ['feel']")
def lif_18(spark, sf):
    return memories(spark, sf).filter((F.col("type") == "feel") & (F.array_join("domain", ",") != "feel")).select("id", F.lit("feel").alias("domain"))


@query("lif_19_versioned_notes", "WITH h AS (SELECT conv_id AS key, turn AS seq, sha256(role) AS h FROM conversations), c AS (SELECT *, lag(h) OVER (PARTITION BY key ORDER BY seq) AS was FROM h) SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) AS revision, seq AS valid_from, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS valid_to, h FROM c WHERE was IS NULL OR was <> h")
def lif_19(spark, sf):
    return L.versioned(table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.col("role").alias("content")))


@query("lif_20_purge_test_data", VIEWS + "SELECT id FROM memories WHERE NOT (doc_id % 97 = 0 AND doc_id % 2 = 0)")
def lif_20(spark, sf):
    m = memories(spark, sf)
    test = m.filter((F.col("doc_id") % 97 == 0) & (F.col("doc_id") % 2 == 0))
    return m.select("id").join(test.select("id"), "id", "left_anti")
