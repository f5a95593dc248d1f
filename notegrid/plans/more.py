"""Queries of session assemblies, clustering, merges, further sources and inference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from notegrid.functions import policy, scores
from notegrid.functions.policy import ALLOWED_SQL
from notegrid.functions.scores import SCORE_SQL
from notegrid.functions.text import token_estimate
from notegrid.operators import aggregates as A
from notegrid.operators import inference as I
from notegrid.operators import lifecycle as L
from notegrid.operators import ordered as O
from notegrid.operators import predicates as P
from notegrid.operators import ranking as K
from notegrid.operators import similarity as SI
from notegrid.operators.ranking import SEEDED_SQL
from notegrid.plans.grouped import GREEDY_SQL, RECURSIVE, TOKENS_SQL
from notegrid.plans.jobs import FILE_SQL, file_of
from notegrid.plans.joined import mid
from notegrid.plans.registry import query
from notegrid.plans.rows import AT_SQL
from notegrid.schema import VIEWS, as_of, ledger, memories, table, vectors
from notegrid.sources import files as S
from notegrid.storage import VersionedTable, new_path


def ranked(spark, sf, n=200):
    m = memories(spark, sf).filter(policy.allowed("spontaneous")).withColumn("score", scores.decay_score(as_of()))
    return K.top_rows(m, [F.desc("score"), F.col("id")], n)


NEGLECTED_SQL = f"((activation_count = 0 AND importance >= 8) OR (importance >= 9 AND last_active < {{}} - INTERVAL 7 DAY))"
STARTUP_SQL = f", pool AS (SELECT * FROM memories WHERE {ALLOWED_SQL['spontaneous']} AND NOT pinned)"
RANKED_SQL = f", ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT *, {SCORE_SQL} AS score FROM memories WHERE {ALLOWED_SQL['spontaneous']}))"
DAY_SQL = "TIMESTAMP '2024-01-02 00:00:00'"


@query("win_06_startup_selection", VIEWS + STARTUP_SQL + f""", one AS (SELECT id FROM pool WHERE created BETWEEN {DAY_SQL} - INTERVAL 24 HOUR AND {DAY_SQL} ORDER BY created DESC, id LIMIT 1),
two AS (SELECT id, row_number() OVER (ORDER BY importance DESC, created DESC, id) AS k FROM pool WHERE id NOT IN (SELECT id FROM one)),
old AS (SELECT id FROM pool WHERE id NOT IN (SELECT id FROM one) AND id NOT IN (SELECT id FROM two WHERE k <= 2) AND NOT resolved AND {NEGLECTED_SQL.format(DAY_SQL)} ORDER BY importance DESC, id LIMIT 20)
SELECT 1 AS slot, id FROM one UNION ALL SELECT CAST(k + 1 AS INT), id FROM two WHERE k <= 2 UNION ALL SELECT 4, id FROM (SELECT id FROM old ORDER BY {SEEDED_SQL.format(5, 'id')}, id LIMIT 1)""")
def win_06(spark, sf):
    return K.startup_slots(memories(spark, sf), F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'"), seed=5)


@query("top_08_shuffle_head", VIEWS + RANKED_SQL + f" SELECT row_number() OVER (ORDER BY CASE WHEN rank = 1 THEN 0 WHEN rank <= 20 THEN 1 ELSE 2 END, CASE WHEN rank BETWEEN 2 AND 20 THEN {SEEDED_SQL.format(3, 'id')} END, rank) AS pos, id FROM ranked WHERE rank <= 200")
def top_08(spark, sf):
    return K.shuffle_head(ranked(spark, sf).select("rank", "id"), 20, seed=3)


@query("top_09_passive_association", VIEWS + STARTUP_SQL + f" SELECT id FROM pool WHERE {NEGLECTED_SQL.format(AT_SQL)} ORDER BY {SEEDED_SQL.format(4, 'id')}, id LIMIT 2")
def top_09(spark, sf):
    return K.random_rows(P.startup_memories(memories(spark, sf)).filter(P.neglected(as_of())), 2, seed=4).select("id")


ENCOUNTER_SQL = """, slots AS (SELECT id, row_number() OVER (ORDER BY {pool_u}, id) - 1 AS slot FROM low), z AS (SELECT count(*) AS size FROM slots),
drawn AS (SELECT session, CAST(floor({start_u} * size) AS BIGINT) AS start, size FROM sessions, z WHERE {chance_u} < {chance} AND size > 0),
picks AS (SELECT session, (start + k) % size AS slot FROM (SELECT *, unnest(range(0, least(3, size))) AS k FROM drawn)) SELECT session, id FROM picks JOIN slots USING (slot)"""


@query("top_10_resolved_encounter", VIEWS + ", low AS (SELECT id FROM memories WHERE resolved), sessions AS (SELECT event_id AS session FROM events)" + ENCOUNTER_SQL.format(pool_u=SEEDED_SQL.format(9, "id"), start_u=SEEDED_SQL.format(9, "session"), chance_u=SEEDED_SQL.format(8, "session"), chance=0.03))
def top_10(spark, sf):
    sessions = table(spark, sf, "events").select(F.col("event_id").alias("session"))
    return K.encounters(sessions, _slots(memories(spark, sf).filter("resolved").select("id"), 9), 0.03, 3, seed=8)


def _slots(pool, seed):
    """Dense numbers of a pool in seeded hash order, by range ranks."""
    return S.append_events(pool.withColumn("_u", K.seeded(seed)), F.lit(-1), ["_u", "id"]).select("id", F.col("seq").alias("slot"))


@query("top_11_low_score_drift", VIEWS + f", low AS (SELECT id FROM memories WHERE {ALLOWED_SQL['search']} AND {SCORE_SQL} < 2), sessions AS (SELECT item_id AS session FROM benchmark)" + ENCOUNTER_SQL.format(pool_u=SEEDED_SQL.format(2, "id"), start_u=SEEDED_SQL.format(7, "session"), chance_u=SEEDED_SQL.format(6, "session"), chance=0.4))
def top_11(spark, sf):
    low = memories(spark, sf).filter(policy.allowed("search")).withColumn("score", scores.decay_score(as_of())).filter("score < 2").select("id")
    return K.encounters(table(spark, sf, "benchmark").select(F.col("item_id").alias("session")), _slots(low, 2), 0.4, 3, seed=6)


@query("top_12_letters_ranked", VIEWS + """, l AS (SELECT * FROM memories WHERE type = 'letter'), q AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'the' ELSE 'que' END AS query FROM benchmark),
v AS (SELECT query_id, l.id, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS score FROM q JOIN vectors x ON x.vec_id = q.query_id AND q.query_id % 4 < 2 JOIN vectors y ON TRUE JOIN l ON l.id = y.id),
c AS (SELECT query_id, id, round(score, 6) AS score, NULL AS created FROM v WHERE score >= 0.2 UNION ALL SELECT q.query_id, l.id, NULL, created FROM q JOIN l ON contains(lower(content), query) WHERE query_id NOT IN (SELECT query_id FROM v WHERE score >= 0.2))
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created DESC, id) AS rank FROM c) WHERE rank <= 50""")
def top_12(spark, sf):
    letters, v = memories(spark, sf).filter("type = 'letter'"), vectors(spark, sf)
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "the").otherwise("que").alias("query"))
    asked = v.join(q.filter("query_id % 4 < 2").select("query_id"), F.col("vec_id") == F.col("query_id")).select("query_id", "vec_id", "embedding")
    close = SI.vector_scores(asked, v.join(letters.select("id"), "id", "left_semi"), 0.2)
    return K.letters_ranked(letters, q, close, 50).withColumn("score", F.round("score", 6))


@query("top_14_dream_assembly", RECURSIVE + RANKED_SQL + f", r AS (SELECT CAST(0 AS BIGINT) AS session, rank, id, {TOKENS_SQL.format('content')} AS tokens FROM ranked WHERE rank <= 60)" + GREEDY_SQL.format(budget=20000))
def top_14(spark, sf):
    rows = ranked(spark, sf, 60).select(F.lit(0).cast("long").alias("session"), "rank", "id", token_estimate(F.col("content")).alias("tokens"))
    return O.budget_greedy(rows, "session", 20_000)


@query("top_15_briefing", VIEWS + f"SELECT part, id FROM (SELECT 'pinned' AS part, id, row_number() OVER (ORDER BY importance DESC, id) AS k, 20 AS most FROM memories WHERE pinned UNION ALL SELECT 'top', id, row_number() OVER (ORDER BY {SCORE_SQL} DESC, id), 10 FROM memories WHERE {ALLOWED_SQL['spontaneous']} AND NOT pinned UNION ALL SELECT 'self', id, row_number() OVER (ORDER BY created DESC, id), 3 FROM memories WHERE type = 'i') WHERE k <= most")
def top_15(spark, sf):
    m = memories(spark, sf).withColumn("score", scores.decay_score(as_of()))
    part = lambda df, n, most, *o: df.orderBy(*o).limit(most).select(F.lit(n).alias("part"), "id")
    return part(m.filter("pinned"), "pinned", 20, F.desc("importance"), "id").unionByName(part(m.filter(policy.allowed("spontaneous") & ~F.col("pinned")), "top", 10, F.desc("score"), "id")).unionByName(part(m.filter("type = 'i'"), "self", 3, F.desc("created"), "id"))


PREVIEW_SQL = f"""WITH RECURSIVE t AS (SELECT {FILE_SQL} AS path, row_number() OVER (PARTITION BY {FILE_SQL} ORDER BY turn) AS n, CASE WHEN role = 'system' THEN 'system' ELSE role END AS role, trim(text) AS said, '[' || CASE WHEN role = 'user' THEN 'user' ELSE 'AI' END || '] ' || trim(text) AS line FROM conversations),
r AS (SELECT *, {TOKENS_SQL.format('line')} AS tokens FROM t),
g AS (SELECT path, n, line, 0 AS chunk, CASE WHEN tokens > 600 THEN 0 ELSE tokens END AS held, tokens > 600 AS closed FROM r WHERE n = 1
UNION ALL SELECT r.path, r.n, r.line, g.chunk + CAST(r.tokens > 600 OR g.closed OR g.held + r.tokens > 400 AS INT), CASE WHEN r.tokens > 600 THEN 0 WHEN g.closed OR g.held + r.tokens > 400 THEN r.tokens ELSE g.held + r.tokens END, r.tokens > 600 FROM g JOIN r ON r.path = g.path AND r.n = g.n + 1),
c AS (SELECT path, chunk, string_agg(line, chr(10) ORDER BY n) AS content FROM g GROUP BY 1, 2),
p AS (SELECT path, count(*) AS chunks, sum({TOKENS_SQL.format('content')})::BIGINT AS tokens, substring(max(content) FILTER (chunk = 0), 1, 600) AS preview FROM c GROUP BY 1),
s AS (SELECT path, count(*) AS turns, string_agg(role || '=' || substring(said, 1, 160), '|' ORDER BY n) FILTER (n <= 3) AS samples FROM t GROUP BY 1)
SELECT path, 'transcript' AS format, turns, chunks, tokens, sha256(preview) AS preview, sha256(samples) AS samples, CAST(NULL AS VARCHAR) AS error FROM p JOIN s USING (path) UNION ALL SELECT 'blank', 'empty', 0, 0, 0, NULL, NULL, 'empty_file'"""


@query("agg_08_import_preview", PREVIEW_SQL)
def agg_08(spark, sf):
    from notegrid.operators.imports import preview

    c = table(spark, sf, "conversations").withColumn("m", F.struct(F.col("turn"), F.concat("role", F.lit(": "), "text").alias("line")))
    texts = c.groupBy(file_of().alias("path")).agg(F.array_sort(F.collect_list("m")).alias("ms")).select("path", F.array_join(F.transform("ms", lambda x: x["line"]), "\n").alias("value"))
    blank = table(spark, sf, "documents").agg(F.lit("blank").alias("path"), F.lit(" \n").alias("value"))  # one row
    seen = preview(texts.unionByName(blank), 400)
    samples = F.array_join(F.transform("samples", lambda x: F.concat(x["role"], F.lit("="), x["content"])), "|")
    return seen.withColumn("preview", F.sha2("preview", 256)).withColumn("samples", F.when(F.size("samples") > 0, F.sha2(samples, 256)))


@query("agg_10_index_drift", VIEWS + f"SELECT 'missing' AS part, id AS name, NULL AS type, NULL AS value FROM memories WHERE id NOT IN (SELECT id FROM vectors) AND doc_id % 11 <> 0 UNION ALL SELECT 'orphan', id, NULL, NULL FROM vectors WHERE id NOT IN (SELECT id FROM memories) UNION ALL SELECT 'type', type, type, count(*)::DOUBLE FROM memories GROUP BY type UNION ALL SELECT 'row', id, type, {SCORE_SQL} FROM memories")
def agg_10(spark, sf):
    m = memories(spark, sf)
    return A.index_drift(m, vectors(spark, sf), m.filter("doc_id % 11 = 0"), as_of())


@query("agg_13_cluster_patterns")
def agg_13(spark, sf):
    v = vectors(spark, sf)
    edges = SI.similarity_edges(v, 0.35)
    clusters = SI.leader_clusters(v.select("id", F.col("vec_id").alias("pos")), edges.select("a", "b"))
    return clusters.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).select("leader", "n", F.when(F.col("n") >= 5, "pin").otherwise("review").alias("suggestion")).orderBy(F.desc("n"), "leader").limit(20)


FEEL_PAIRS = ", f AS (SELECT v.*, m.pinned, m.created FROM vectors v JOIN memories m ON m.id = v.id WHERE m.type = 'feel'), p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS w FROM f a JOIN f b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.2)"


def _feels(spark, sf):
    return vectors(spark, sf).join(memories(spark, sf).filter("type = 'feel'").select("id", "pinned", "created"), "id")


@query("agg_14_crystallized", VIEWS + FEEL_PAIRS + ', c AS (SELECT id, count(*) AS "similar" FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY id HAVING count(*) >= 2) SELECT id, "similar", row_number() OVER (ORDER BY created, id) = 1 AS hint FROM c JOIN f USING (id) WHERE NOT pinned')
def agg_14(spark, sf):
    return SI.crystallized(_feels(spark, sf), 0.2)


@query("agg_15_best_connection", VIEWS + FEEL_PAIRS + " SELECT a, b, round(w, 3) AS weight FROM p ORDER BY round(w, 3) DESC, a, b LIMIT 1")
def agg_15(spark, sf):
    return SI.best_pair(_feels(spark, sf), 0.2)


@query("agg_25_decision_consistency", "SELECT event_id AS id, unnest(list_filter([CASE WHEN event_id % 6 = 0 THEN 'id_mismatch' END, CASE WHEN event_id % 5 = 0 THEN 'surface_missing' END], lambda x: x IS NOT NULL)) AS code FROM events")
def agg_25(spark, sf):
    e = F.col("event_id")
    want = F.sha2(F.concat_ws("|", "event_type", e.cast("string")), 256)
    r = table(spark, sf, "events").select(e.alias("id"), want.alias("want"), F.when(e % 6 == 0, "other").otherwise(want).alias("decision_id"), F.array(F.lit("memory"), F.lit("vector")).alias("planned"), F.when(e % 5 == 0, F.array(F.lit("memory"))).otherwise(F.array(F.lit("memory"), F.lit("vector"))).alias("seen"))
    return r.select("id", A.codes((F.col("want") != F.col("decision_id"), "id_mismatch"), (F.size(F.array_except("planned", "seen")) > 0, "surface_missing")))


@query("agg_26_shape_health", "SELECT event_id AS id, 'k_not_a_number' AS code FROM events WHERE event_id % 8 = 0")
def agg_26(spark, sf):
    e = F.col("event_id")
    js = F.when(e % 8 == 0, F.lit('{"k": "x"}')).otherwise(F.col("props"))
    v = F.try_parse_json(js)
    return table(spark, sf, "events").select(e.alias("id"), A.codes((v.isNull(), "unreadable"), (~F.schema_of_variant(v).isin("OBJECT<k: BIGINT>"), "k_not_a_number")))


@query("win_09_pinned_quota", VIEWS + "SELECT doc_id AS seq, id, row_number() OVER (ORDER BY doc_id) + 2 <= 20 AS admitted, row_number() OVER (ORDER BY doc_id) + 2 > 18 AS warned FROM memories WHERE pinned")
def win_09(spark, sf):
    return O.admit(memories(spark, sf).filter("pinned").select(F.col("doc_id").alias("seq"), "id"), 2, 20, 18)


@query("win_10_anchor_quota", VIEWS + "SELECT doc_id AS seq, id, row_number() OVER (ORDER BY doc_id) + 4 <= 24 AS admitted FROM memories WHERE doc_id % 3 = 0 AND NOT pinned AND NOT anchor")
def win_10(spark, sf):
    asked = memories(spark, sf).filter((F.col("doc_id") % 3 == 0) & ~F.col("pinned") & ~F.col("anchor")).select(F.col("doc_id").alias("seq"), "id")
    return O.admit(asked, 4, 24, 24).drop("warned")


@query("win_13_pending_days", "SELECT CAST(ts - INTERVAL 4 HOUR AS DATE) AS day FROM events GROUP BY 1 HAVING bool_or(event_id % 100 = 0)")
def win_13(spark, sf):
    from notegrid.functions.text import logical_day

    e = table(spark, sf, "events").select(logical_day(F.col("ts")).alias("day"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 100 == 0, "new").otherwise("old").alias("revision"))
    done = e.withColumn("revision", F.lit("old")).groupBy("day").agg(F.bit_xor(F.xxhash64("id", "revision")).alias("signature"))
    return O.pending_days(e, done)


@query("set_04_append_lists", VIEWS + "SELECT id, sha256(array_to_string(list_concat(string_split(substring(content, 1, 400), ' '), [CAST(doc_id % 3 AS VARCHAR)])[1:50], ',')) AS h FROM memories WHERE content IS NOT NULL")
def set_04(spark, sf):
    new = F.array((F.col("doc_id") % 3).cast("string"))
    held = F.split(F.substring("content", 1, 400), " ")
    return memories(spark, sf).filter("content IS NOT NULL").select("id", F.sha2(F.array_join(F.slice(F.concat(held, new), 1, 50), ","), 256).alias("h"))


@query("scr_12_feel_relevance", VIEWS + ", x AS (SELECT doc_id % 5 AS reference, id, CASE WHEN doc_id % 2 = 0 THEN valence END AS c, arousal AS o FROM memories WHERE type = 'feel'), s AS (SELECT reference, id, round(CASE WHEN c IS NOT NULL THEN 0.7::DOUBLE * c + 0.3::DOUBLE * o ELSE o END, 6) AS score FROM x) SELECT * FROM (SELECT reference, id, score, row_number() OVER (PARTITION BY reference ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.5) WHERE rank <= 5")
def scr_12(spark, sf):
    d = F.col("doc_id")
    return K.feel_relevance(memories(spark, sf).filter("type = 'feel'").select((d % 5).alias("reference"), "id", F.when(d % 2 == 0, F.col("valence")).alias("cosine"), F.col("arousal").alias("overlap")))


@query("scr_13_theme_similarity", VIEWS + ", t AS (SELECT id, doc_id, list_distinct(list_filter(string_split_regex(lower(name), '\\s+'), lambda x: x NOT IN ('the', 'and', ''))) AS w FROM memories) SELECT a.id, CASE WHEN len(list_intersect(a.w, b.w)) < 2 THEN 0.0::DOUBLE ELSE round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w))::DOUBLE, 6) END AS similarity FROM t a JOIN t b ON b.doc_id = a.doc_id + 1")
def scr_13(spark, sf):
    words = F.array_distinct(F.filter(F.split(F.lower("name"), r"\s+"), lambda x: ~x.isin("the", "and", "")))
    t = memories(spark, sf).select("id", "doc_id", words.alias("w"))
    nxt = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return t.join(nxt, "doc_id").select("id", F.round(K.keyword_overlap(F.col("w"), F.col("v")), 6).alias("similarity"))


@query("jon_10_duplicate_marking", VIEWS + ", p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS w FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id), e AS (SELECT a AS id, b AS other, round(w, 3) AS w FROM p WHERE w > 0.35 UNION ALL SELECT b, a, round(w, 3) FROM p WHERE w > 0.35) SELECT id, other, w AS weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, other DESC) AS k FROM e) WHERE k = 1")
def jon_10(spark, sf):
    return SI.nearest_other(vectors(spark, sf), 0.35)


@query("lif_03_archive", VIEWS + "SELECT id, CASE WHEN doc_id % 9 = 0 THEN 'archived' ELSE type END AS type FROM memories")
def lif_03(spark, sf):
    m = memories(spark, sf)
    gone = m.filter("doc_id % 9 = 0").select("id", F.lit(True).alias("gone"))
    return m.join(gone, "id", "left").select("id", F.when(F.col("gone"), "archived").otherwise(F.col("type")).alias("type"))


@query("lif_07_semantic_merge", VIEWS + """, t AS (SELECT *, content || chr(10) || '---' || chr(10) || 'note ' || CAST(doc_id AS VARCHAR) AS joined FROM memories WHERE doc_id % 6 = 0), f AS (SELECT *, coalesce(strlen(joined) <= 4096, FALSE) AS fits FROM t)
SELECT id AS target, sha256(CASE WHEN fits THEN joined ELSE content END) AS h, CASE WHEN fits THEN round((valence + 0.521::DOUBLE) / 2, 2) ELSE valence END AS valence, CASE WHEN fits THEN greatest(importance, 4) ELSE importance END AS importance, CASE WHEN fits THEN '' ELSE CAST(doc_id AS VARCHAR) END AS created FROM f""")
def lif_07(spark, sf):
    d, m = F.col("doc_id"), memories(spark, sf)
    new = m.filter(d % 6 == 0).select(d.alias("seq"), F.col("id").alias("target"), F.concat(F.lit("note "), d.cast("string")).alias("content"), F.array(F.lit("x")).alias("tags"), F.lit(0.521).alias("valence"), F.lit(4).alias("importance"))
    return L.semantic_merge(new, m).select("target", F.sha2("content", 256).alias("h"), "valence", "importance", F.array_join("created", ",").alias("created"))


@query("lif_12_review_decisions", VIEWS + "SELECT id, CASE WHEN doc_id % 4 = 3 THEN 'bad_decision' ELSE 'applied' END AS status, CASE doc_id % 4 WHEN 0 THEN 9 WHEN 1 THEN 10 WHEN 2 THEN 1 ELSE importance END AS importance, CASE WHEN doc_id % 4 = 1 THEN TRUE ELSE pinned END AS pinned, CASE WHEN doc_id % 4 = 2 THEN TRUE ELSE resolved END AS resolved FROM memories")
def lif_12(spark, sf):
    k, m = F.col("doc_id") % 4, memories(spark, sf)
    return L.review_decisions(m.select("id", F.when(k == 0, "important").when(k == 1, "pin").when(k == 2, "noise").otherwise("odd").alias("decision")), m)


@query("lif_13_plan_actions", VIEWS + f"SELECT id, CASE doc_id % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'active' ELSE 'abandoned' END AS status, CASE WHEN doc_id % 3 = 1 THEN {AT_SQL} END AS last_confirmed_at, 2 AS entries FROM memories WHERE type = 'plan'")
def lif_13(spark, sf):
    k, m = F.col("doc_id") % 3, memories(spark, sf).filter("type = 'plan'")
    entry = F.struct(F.col("created").alias("ts"), F.lit("create").alias("action"), F.lit("").alias("from"), F.lit("active").alias("to"))
    plans = m.select("id", F.lit("active").alias("status"), F.lit(None).cast("timestamp_ntz").alias("last_confirmed_at"), F.array(entry).alias("change_log"))
    acts = m.select("id", F.when(k == 0, "resolve").when(k == 1, "confirm").otherwise("abandon").alias("action"))
    return L.plan_actions(plans, acts, as_of()).select("id", "status", "last_confirmed_at", F.size("change_log").alias("entries"))


@query("lif_14_feel_ingest", VIEWS + "SELECT 'source' AS part, id, NULL AS triggered_by, valence AS value FROM memories WHERE doc_id % 10 = 4 UNION ALL SELECT 'feel', 'feel_' || CAST(doc_id AS VARCHAR), id, length(content)::DOUBLE FROM memories WHERE doc_id % 10 = 4")
def lif_14(spark, sf):
    m = memories(spark, sf)
    feels = m.filter("doc_id % 10 = 4").select(F.col("doc_id").alias("seq"), "content", F.col("id").alias("source"), "valence")
    new, marked = L.feel_ingest(feels, m)
    sources = marked.filter("digested").select(F.lit("source").alias("part"), "id", F.lit(None).cast("string").alias("triggered_by"), F.col("model_valence").alias("value"))
    return sources.unionByName(new.filter("type = 'feel'").select(F.lit("feel").alias("part"), "id", "triggered_by", F.length("content").cast("double").alias("value")))


@query("lif_15_batch_items", f"SELECT {FILE_SQL} AS batch, count(*) AS items, sum(length(trim(text)))::BIGINT AS chars FROM conversations WHERE turn % 3 <> 1 AND trim(text) <> '' GROUP BY 1")
def lif_15(spark, sf):
    c = table(spark, sf, "conversations").withColumn("i", F.struct("turn", F.when(F.col("turn") % 3 == 1, "  ").otherwise(F.col("text")).alias("t")))
    batches = c.groupBy(file_of().alias("batch")).agg(F.array_sort(F.collect_list("i")).alias("xs")).select("batch", F.transform("xs", lambda x: x["t"]).alias("items"))
    return L.split_batches(batches).groupBy("batch").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("content")).alias("chars"))


@query("lif_17_reclassify", "WITH k(domain, kw) AS (VALUES ('license', 'license'), ('license', 'mit'), ('license', 'released')), h AS (SELECT doc_id, count(*) AS hits FROM documents, k WHERE contains(lower(text), kw) GROUP BY 1 HAVING count(*) >= 2) SELECT doc_id, source AS old, 'license' AS new FROM h JOIN documents USING (doc_id)")
def lif_17(spark, sf):
    d = table(spark, sf, "documents")
    new = K.classify(d, {"license": ["license", "mit", "released"]}).filter("domains <> ''")
    return d.select("doc_id", F.col("source").alias("old")).join(new, "doc_id").filter("old <> domains").select("doc_id", "old", F.col("domains").alias("new"))


@query("lif_21_reembed", VIEWS + "SELECT id, CASE WHEN doc_id % 4 = 0 THEN 'kept' WHEN contains(coalesce(content, ''), 'MIT') THEN 'failed' ELSE 'made' END AS state, NOT EXISTS (SELECT 1 FROM memories WHERE doc_id % 4 <> 0 AND contains(coalesce(content, ''), 'MIT')) AS swapped FROM memories")
def lif_21(spark, sf):
    from notegrid.plans.jobs import stand_in

    m = memories(spark, sf)
    store = VersionedTable(spark, new_path(spark, "reembed"))
    store.write(m.select("id", F.lit("old").alias("signature")))
    done = m.filter("doc_id % 4 = 0").select("id")
    return I.reembed(m, done, stand_in, store, "new")


IMPORT_SQL = f""", f AS (SELECT {FILE_SQL} AS path, sha256('user' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS source, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS value FROM conversations GROUP BY 1),
k AS (SELECT source, min(path) AS path FROM f GROUP BY 1),
t AS (SELECT k.source, row_number() OVER (PARTITION BY k.source ORDER BY turn) AS n, '[' || CASE WHEN role = 'user' THEN 'user' ELSE 'AI' END || '] ' || trim(text) AS line FROM conversations JOIN k ON k.path = {FILE_SQL}),
r AS (SELECT *, {TOKENS_SQL.format('line')} AS tokens FROM t),
g AS (SELECT source, n, line, 0 AS chunk, CASE WHEN tokens > 600 THEN 0 ELSE tokens END AS held, tokens > 600 AS closed FROM r WHERE n = 1
UNION ALL SELECT r.source, r.n, r.line, g.chunk + CAST(r.tokens > 600 OR g.closed OR g.held + r.tokens > 400 AS INT), CASE WHEN r.tokens > 600 THEN 0 WHEN g.closed OR g.held + r.tokens > 400 THEN r.tokens ELSE g.held + r.tokens END, r.tokens > 600 FROM g JOIN r ON r.source = g.source AND r.n = g.n + 1),
c AS (SELECT source, chunk, string_agg(line, chr(10) ORDER BY n) AS content FROM g GROUP BY 1, 2),
i AS (SELECT source, chunk, 0 AS pos, trim(substring(content, 1, 60)) AS content, CASE WHEN length(content) % 2 = 1 THEN 9 ELSE 5 END AS importance FROM c UNION ALL SELECT source, chunk, 1, trim(right(content, 12)), 4 FROM c),
q AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY source, chunk, pos) = 1 AND content NOT IN (SELECT content FROM memories WHERE importance < 9) AS fresh FROM i WHERE content <> ''),
d AS (SELECT *, fresh AND importance = 9 AND row_number() OVER (PARTITION BY fresh AND importance = 9 ORDER BY source, chunk, pos) > 24 AS less FROM q)
SELECT c.source, c.chunk, count(*) FILTER (fresh) AS created, count(*) FILTER (NOT fresh) AS deduplicated, count(*) FILTER (less) AS degraded FROM c LEFT JOIN d ON d.source = c.source AND d.chunk = c.chunk GROUP BY 1, 2"""


@query("lif_22_import_job", VIEWS.replace("WITH ", "WITH RECURSIVE ", 1) + IMPORT_SQL)
def lif_22(spark, sf):
    """The progress of every chunk, of an import of all conversations as transcripts."""
    from notegrid.operators.imports import ImportJob

    def model(text):
        import json

        return json.dumps([{"content": text[:60], "importance": 9 if len(text) % 2 else 5}, {"content": text[-12:], "importance": 4}])

    c = table(spark, sf, "conversations").withColumn("m", F.struct(F.col("turn"), F.concat("role", F.lit(": "), "text").alias("line")))
    texts = c.groupBy(file_of().alias("path")).agg(F.array_sort(F.collect_list("m")).alias("ms")).select("path", F.array_join(F.transform("ms", lambda x: x["line"]), "\n").alias("value"))
    store = VersionedTable(spark, new_path(spark, "imported"))
    store.write(memories(spark, sf).filter("importance < 9").select("id", "type", "importance", "content", "created"))
    job = ImportJob(spark, new_path(spark, "import"), store, model, as_of(), target=400, quota=24, batches=2)
    job.run(texts)
    return job.done.read()


@query("src_10_chat_tree", f"SELECT {FILE_SQL} AS path, row_number() OVER (PARTITION BY {FILE_SQL} ORDER BY turn) - 1 AS turn, role, sha256(trim(text)) AS h FROM conversations")
def src_10(spark, sf):
    node = F.struct(F.struct(F.struct("role").alias("author"), F.struct(F.array("text").alias("parts")).alias("content"), (F.col("turn") * 10 + 1).cast("double").alias("create_time")).alias("message"))
    c = table(spark, sf, "conversations").select(file_of().alias("path"), F.concat(F.lit("k"), F.col("turn").cast("string")).alias("k"), node.alias("n"))
    f = c.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("mapping")).select("path", F.to_json(F.struct("mapping")).alias("value"))
    return S.parse_chat_tree(f).select("path", "turn", "role", F.sha2("content", 256).alias("h"))


@query("src_12_detect_format", "SELECT CAST(conv_id AS VARCHAR) AS path, CASE conv_id % 4 WHEN 0 THEN 'messages' WHEN 1 THEN 'tree' WHEN 2 THEN 'transcript' ELSE 'empty' END AS format FROM conversations GROUP BY conv_id")
def src_12(spark, sf):
    k = F.col("conv_id") % 4
    f = table(spark, sf, "conversations").select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("path"), F.when(k == 0, '{"chat_messages": []}').when(k == 1, ' {"mapping": {}}').when(k == 2, "user: hello").otherwise(" \n").alias("value"))
    return S.detect_format(f).select("path", "format")


@query("src_12_route_files", f"SELECT {FILE_SQL} AS path, CASE WHEN role = 'system' AND conv_id % 9 IN (0, 1, 2, 6) THEN 'user' ELSE role END AS role, sha256(trim(text)) AS h, row_number() OVER (PARTITION BY {FILE_SQL} ORDER BY turn) AS nth FROM conversations")
def src_12_route(spark, sf):
    """Files of every form that an export comes in, by conversation; through detection and the parsers back to turns."""
    form, cjk = F.col("conv_id") % 9, F.when(F.col("role") == "assistant", "Claude: ").when(F.col("role") == "system", "system: ").otherwise("我：")
    who = F.when(F.col("role") == "system", "user").otherwise(F.col("role"))
    said = F.struct(F.col("turn"), F.struct(who.alias("sender"), F.col("text").alias("text")).alias("plain"), F.struct(who.alias("role"), F.col("text").alias("content")).alias("simple"), F.struct(F.struct(F.col("role")).alias("author"), F.struct(F.array("text").alias("parts")).alias("content"), (F.col("turn") * 5 + 1.0).alias("create_time")).alias("deep"), F.concat(F.col("role"), F.lit(": "), "text").alias("line"), F.concat(cjk, "text").alias("other"))
    c = table(spark, sf, "conversations").groupBy("conv_id", file_of().alias("path")).agg(F.array_sort(F.collect_list(said)).alias("ms"))
    pick = lambda name, rows="ms": F.transform(rows, lambda x: x[name])
    js = lambda name, rows="ms": F.to_json(pick(name, rows))
    wrap = lambda key, inner: F.concat(F.lit(f'{{"{key}":'), inner, F.lit("}"))
    tree = wrap("mapping", F.to_json(F.map_from_entries(F.transform("ms", lambda x: F.struct(F.concat(F.lit("n"), x["turn"].cast("string")), F.struct(x["deep"].alias("message")))))))
    halves = F.concat(F.lit("["), wrap("chat_messages", js("plain", F.slice("ms", 1, 2))), F.lit(","), wrap("messages", js("simple", F.slice("ms", 3, 64))), F.lit("]"))
    value = F.when(form == 0, wrap("chat_messages", js("plain"))).when(form == 1, wrap("messages", js("simple"))).when(form == 2, halves).when(form == 3, tree).when(form == 4, F.concat(F.lit(" ["), tree, F.lit("]"))).when(form == 5, wrap("messages", js("deep"))).when(form == 6, js("simple")).when(form == 7, F.array_join(pick("line"), "\n")).otherwise(F.array_join(pick("other"), "\n"))
    turns = S.route(c.select("path", value.alias("value")))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("turn"))
    # the forms of plain messages know two roles
    told = turns.withColumn("nth", nth.cast("long")).withColumn("h", F.sha2("content", 256))
    return told.select("path", "role", "h", "nth")


@query("src_15_backup_diff", VIEWS + "SELECT id AS path, CASE doc_id % 4 WHEN 0 THEN 'remove' WHEN 1 THEN 'upload' WHEN 2 THEN 'upload' ELSE 'unchanged' END AS action FROM memories")
def src_15(spark, sf):
    k, m = F.col("doc_id") % 4, memories(spark, sf)
    local = S.manifest(m.filter(k != 0).select(F.col("id").alias("path"), F.col("content").alias("data")))
    remote = S.manifest(m.filter(k != 1).select(F.col("id").alias("path"), F.when(k == 2, F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("data")))
    return S.backup_diff(local, remote)


@query("src_18_catch_up", VIEWS + ", z AS (SELECT max(seq) AS last FROM ledger) SELECT seq AS index FROM ledger, z WHERE seq > last // 10 AND seq < last * 9 // 10")
def src_18(spark, sf):
    e = ledger(spark, sf).select(F.col("seq").alias("index"), "payload")
    last = e.agg(F.max("index").alias("last")).first()["last"]  # one row
    snapshot, log = e.filter(F.col("index") <= last // 2), e.filter((F.col("index") > last * 4 // 10) & (F.col("index") != last * 9 // 10))
    return S.catch_up(snapshot, log, last // 10).select("index")


@query("src_19_attachments", VIEWS + "SELECT id, id || '/' || substring(sha256(domain[1]), 1, 16) || '.txt' AS path, strlen(domain[1]) AS bytes FROM memories")
def src_19(spark, sf):
    item = F.struct(F.base64(F.element_at("domain", 1)).alias("payload"), F.lit("txt").alias("type"))
    return S.attachments(memories(spark, sf).select("id", F.array(item, item).alias("media")))


@query("src_20_eval_cases", "SELECT item_id AS pos, 2 AS n FROM benchmark")
def src_20(spark, sf):
    i = F.col("item_id")
    raw = table(spark, sf, "benchmark").select(i.alias("pos"), F.col("text").alias("query"), F.when(i % 2 == 0, '["a", "b"]').otherwise("a , b,").alias("expected"))
    return S.eval_cases(raw).select("pos", F.size("expected").alias("n"))


@query("src_21_merge_vectors", VIEWS + "SELECT 'n' || CAST(vec_id AS VARCHAR) AS id FROM vectors WHERE vec_id % 3 = 0 AND vec_id % 2 = 1")
def src_21(spark, sf):
    v = vectors(spark, sf)
    k = F.col("vec_id")
    other = v.select("id", F.when(k % 2 == 0, F.col("embedding")).otherwise(F.slice("embedding", 1, 3)).alias("embedding"))
    id_map = v.filter(k % 3 == 0).select(F.col("id").alias("old_id"), F.concat(F.lit("n"), k.cast("string")).alias("id"))
    return S.merge_vectors(v.select("id", "embedding"), other, id_map, 64)[1]


@query("udf_03_split", VIEWS + "SELECT id, CAST(len(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS items FROM memories")
def udf_03(spark, sf):
    return I.split(memories(spark, sf), lambda t: t.split("\n")).groupBy("id").agg(F.count(F.lit(1)).alias("items"))


@query("udf_05_judge", VIEWS + "SELECT p.id AS plan_id, e.trace_id AS event_id FROM memories p JOIN ledger e ON e.trace_id = 'm' || CAST(p.doc_id + 1 AS VARCHAR) AND e.event_type = 'TraceUpdated' WHERE p.type = 'plan' AND length(p.content) % 10 >= 7")
def udf_05(spark, sf):
    plans = memories(spark, sf).filter("type = 'plan'").select(F.col("id").alias("plan_id"), F.col("content").alias("plan"), mid(F.col("doc_id") + 1).alias("event_id"))
    events = ledger(spark, sf).filter("event_type = 'TraceUpdated'").select(F.col("trace_id").alias("event_id"), F.col("payload").alias("event"))
    return I.judge(plans.join(events, "event_id"), lambda a, b: len(a) % 10 / 10).select("plan_id", "event_id")


@query("udf_07_impressions", "SELECT CAST(ts - INTERVAL 4 HOUR AS DATE) AS day, 'u' || CAST(min(user_id) AS VARCHAR) AS cited FROM events GROUP BY 1")
def udf_07(spark, sf):
    from notegrid.functions.text import logical_day

    days = table(spark, sf, "events").groupBy(logical_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).cast("string").alias("text"), F.array(F.concat(F.lit("u"), F.min("user_id").cast("string"))).alias("known"))
    return I.impressions(days, lambda t: (f"{t} events", [f"u{i}" for i in range(2000)])).select("day", F.array_join("cited", ",").alias("cited"))


@query("txt_08_json_from_text", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS k FROM documents")
def txt_08(spark, sf):
    d = F.col("doc_id")
    rows = table(spark, sf, "documents").select(d.cast("string").alias("id"), F.when(d % 3 == 0, "nothing {here").otherwise(F.concat(F.lit('Here: ```json {"k": '), d.cast("string"), F.lit("} ``` done"))).alias("content"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "js": [I.first_json(t) for t in pdf["content"]]})

    return rows.mapInPandas(run, "id string, js string").select(F.col("id").cast("long").alias("doc_id"), F.get_json_object("js", "$.k").alias("k"))


@query("str_07_surfacing_log", "SELECT event_type AS kind, arg_max(user_id, event_id) AS newest_run, max(event_id) AS newest, count(*) AS entries FROM events GROUP BY 1")
def str_07(spark, sf):
    from notegrid.plans.jobs import _stream
    from notegrid.streaming.jobs import run_available

    log = run_available(_stream(spark, sf).select(F.col("user_id").alias("run"), F.col("event_type").alias("kind"), "event_id"), "append", "surfacing")
    return log.groupBy("kind").agg(F.max_by("run", "event_id").alias("newest_run"), F.max("event_id").alias("newest"), F.count(F.lit(1)).alias("entries"))
