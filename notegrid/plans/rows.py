"""Queries of row-wise operators: filters, scores, texts, top lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from notegrid.functions import policy, scores, text
from notegrid.functions.policy import ALLOWED_SQL, AUDIT_SQL, REASONS_SQL
from notegrid.functions.scores import DAYS_SQL, SCORE_SQL
from notegrid.operators import predicates as P
from notegrid.operators.ranking import SEEDED_SQL
from notegrid.plans.registry import query
from notegrid.schema import AS_OF, VIEWS, as_of, ledger, memories, table, vectors

AT_SQL = f"TIMESTAMP '{AS_OF}'"

for _mode in ("spontaneous", "importance", "dream", "search"):
    query(f"flt_01_surface_policy_{_mode}", VIEWS + f"SELECT id, {ALLOWED_SQL[_mode]} AS allowed, {REASONS_SQL[_mode]} AS reasons FROM memories")(lambda s, d, m=_mode: P.surface_policy(memories(s, d), m))


@query("flt_02_domain_prefilter", VIEWS + """, q AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN ['SRC1', 'src2'] WHEN 1 THEN ['nothing'] ELSE ['src3'] END AS domains FROM benchmark),
hits AS (SELECT query_id, id FROM q, memories WHERE list_has_any(list_transform(domains, lambda x: lower(x)), list_transform(domain, lambda x: lower(x))))
SELECT query_id, id FROM hits UNION ALL SELECT query_id, NULL FROM q WHERE query_id NOT IN (SELECT query_id FROM hits)""")
def flt_02(spark, sf):
    b = F.col("item_id") % 3
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.when(b == 0, F.array(F.lit("SRC1"), F.lit("src2"))).when(b == 1, F.array(F.lit("nothing"))).otherwise(F.array(F.lit("src3"))).alias("domains"))
    return P.domain_prefilter(memories(spark, sf), q)


@query("flt_03_tags_all", VIEWS + "SELECT id FROM memories WHERE list_has_all(tags, ['en'])")
def flt_03(spark, sf):
    return P.tags_all(memories(spark, sf), ["en"]).select("id")


@query("flt_04_exact_id", VIEWS + ", q AS (SELECT item_id AS query_id, ' m' || CAST(item_id * 7 AS VARCHAR) || ' ' AS query FROM benchmark) SELECT query_id, id, 1.0::DOUBLE AS score FROM q JOIN memories ON trim(query) = id")
def flt_04(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit(" m"), (F.col("item_id") * 7).cast("string"), F.lit(" ")).alias("query"))
    return P.exact_ids(memories(spark, sf), q)


@query("flt_05_literal_match", VIEWS + "SELECT item_id AS query_id, id FROM benchmark b JOIN memories m ON contains(lower(concat_ws(' ', m.name, array_to_string(m.tags, ' '), array_to_string(m.domain, ' '), m.content)), lower(trim(b.text)))")
def flt_05(spark, sf):
    return P.literal_matches(memories(spark, sf), table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


@query("flt_06_terminal", VIEWS + "SELECT id FROM memories WHERE type IN ('archived', 'tombstone') OR id IN (SELECT trace_id FROM ledger WHERE event_type IN ('TraceArchived', 'TraceDeletedToArchive'))")
def flt_06(spark, sf):
    ended = ledger(spark, sf).filter(F.col("event_type").isin("TraceArchived", "TraceDeletedToArchive")).select(F.col("trace_id").alias("id")).distinct()
    marked = memories(spark, sf).join(ended.withColumn("gone", F.lit(True)), "id", "left").withColumn("type", F.when(F.col("gone"), "archived").otherwise(F.col("type")))
    return marked.filter(policy.terminal()).select("id")


@query("flt_07_importance_audit", VIEWS + f"SELECT id, importance FROM memories WHERE {AUDIT_SQL.format(7)}")
def flt_07(spark, sf):
    return memories(spark, sf).filter(policy.audit_candidate(7)).select("id", "importance")


@query("flt_08_high_importance_slots", VIEWS + f"SELECT count(DISTINCT id) AS n FROM memories WHERE {AUDIT_SQL.format(9)} AND NOT pinned")
def flt_08(spark, sf):
    return memories(spark, sf).filter(policy.audit_candidate(9) & ~F.col("pinned")).agg(F.countDistinct("id").alias("n"))


@query("flt_09_startup_memories", VIEWS + f"SELECT id FROM memories WHERE ({REASONS_SQL['spontaneous']}) IN ('', 'digested') AND type NOT IN ('feel', 'plan', 'letter', 'self', 'i') AND NOT pinned")
def flt_09(spark, sf):
    return P.startup_memories(memories(spark, sf), True).select("id")


@query("flt_10_neglected", VIEWS + f"SELECT id FROM memories WHERE (activation_count = 0 AND importance >= 8) OR (importance >= 9 AND last_active < {AT_SQL} - INTERVAL 7 DAY)")
def flt_10(spark, sf):
    return memories(spark, sf).filter(P.neglected(as_of())).select("id")


@query("flt_11_recent_window", VIEWS + f"SELECT id FROM memories WHERE created BETWEEN {AT_SQL} - INTERVAL 48 HOUR AND {AT_SQL}")
def flt_11(spark, sf):
    return memories(spark, sf).filter(P.recent(as_of())).select("id")


@query("flt_12_letters", VIEWS + "SELECT id FROM memories WHERE type = 'letter' AND strftime(created, '%Y-%m-%d') BETWEEN '2024-01-01' AND '2024-01-03' AND contains(lower(content), 'the')")
def flt_12(spark, sf):
    return P.letters(memories(spark, sf), "2024-01-01", "2024-01-03", "the").select("id")


@query("flt_13_active_plans", VIEWS + "SELECT id FROM memories WHERE type = 'plan' AND NOT dont_surface AND NOT resolved")
def flt_13(spark, sf):
    return P.active_plans(memories(spark, sf)).select("id")


@query("flt_14_self_entries", VIEWS + "SELECT id, substring(tag, 8) AS aspect FROM (SELECT id, unnest(['aspect:' || tags[1]]) AS tag FROM memories WHERE type = 'i')")
def flt_14(spark, sf):
    tagged = memories(spark, sf).filter("type = 'i'").withColumn("tags", F.array(F.lit("other"), F.concat(F.lit("aspect:"), F.element_at("tags", 1))))
    return tagged.select("id", F.substring(F.try_element_at(F.filter("tags", lambda t: t.startswith("aspect:")), F.lit(1)), 8, 200).alias("aspect"))


@query("flt_15_catalog", VIEWS + "SELECT id, type AS section, CAST(list_position(['permanent', 'feel', 'plan', 'letter', 'i', 'self', 'dynamic'], type) AS BIGINT) AS section_order, importance, CASE WHEN superseded_by IS NOT NULL THEN '(old) ' ELSE '' END || name || ' [' || array_to_string(domain, '/') || '] ' || CAST(importance AS VARCHAR) AS line FROM memories")
def flt_15(spark, sf):
    return P.catalog(memories(spark, sf))


@query("flt_16_listing", VIEWS + f"SELECT id, name, type, importance, epoch_ms(created) AS created_ms, {SCORE_SQL} AS score, substring(content, 1, 200) AS preview FROM memories")
def flt_16(spark, sf):
    return P.listing(memories(spark, sf), as_of())


@query("flt_17_newest_preview", VIEWS + "SELECT id, created, substring(content, 1, 300) AS preview FROM memories ORDER BY created DESC, id LIMIT 50")
def flt_17(spark, sf):
    return memories(spark, sf).orderBy(F.desc("created"), "id").limit(50).select("id", "created", F.substring("content", 1, 300).alias("preview"))


@query("flt_18_metric_allowlist", "SELECT CASE WHEN event_type = 'error' THEN 'forbidden_label' WHEN event_type = 'view' THEN 'forbidden_name' WHEN event_type = 'signup' THEN 'unknown' ELSE 'allowed' END AS verdict, count(*) AS n FROM events GROUP BY 1")
def flt_18(spark, sf):
    metrics = table(spark, sf, "events").select(F.col("event_type").alias("name"), F.create_map(F.when(F.col("event_type") == "error", "content").otherwise("route"), F.lit("x")).alias("labels"))
    return P.metric_allowlist(metrics, ["click", "purchase", "error"], ["view"], ["content", "query"]).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("flt_19_test_data", VIEWS + "SELECT id FROM memories WHERE doc_id % 97 = 0 AND doc_id % 2 = 0")
def flt_19(spark, sf):
    d = F.col("doc_id")
    marked = memories(spark, sf).withColumn("provenance", F.struct(F.when(d % 97 == 0, "test").otherwise("user").alias("kind"), (d % 2 == 0).alias("erasable")))
    return marked.filter("provenance.kind = 'test' AND provenance.erasable").select("id")


@query("flt_20_day_listing", VIEWS + "SELECT CAST(created - INTERVAL 4 HOUR AS DATE) AS day, count(*) AS sources, sum(CAST(type = 'plan' AS INT))::BIGINT AS plans, substring(min(content), 1, 240) AS preview FROM memories GROUP BY 1")
def flt_20(spark, sf):
    days = memories(spark, sf).groupBy(text.logical_day(F.col("created")).alias("day"))
    return days.agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("type") == "plan").alias("plans"), F.substring(F.min("content"), 1, 240).alias("preview"))


@query("flt_21_events_by_type", VIEWS + "SELECT seq, trace_id FROM ledger WHERE event_type = 'TraceArchived'")
def flt_21(spark, sf):
    return ledger(spark, sf).filter("event_type = 'TraceArchived'").select("seq", "trace_id")


# --- scores -----------------------------------------------------------------------------------------


@query("scr_01_decay_score", VIEWS + f"SELECT id, {SCORE_SQL} AS score FROM memories")
def scr_01(spark, sf):
    return memories(spark, sf).select("id", scores.decay_score(as_of()).alias("score"))


@query("scr_02_freshness", VIEWS + f"SELECT id, round(1.0::DOUBLE + exp(-{DAYS_SQL} * 24.0::DOUBLE / 36.0::DOUBLE), 9) AS freshness FROM memories")
def scr_02(spark, sf):
    return memories(spark, sf).select("id", F.round(scores.freshness(scores.days_since(F.col("last_active"), as_of())), 9).alias("freshness"))


@query("scr_04_07_simple_scores", VIEWS + f"""SELECT id, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - sqrt(pow(0.4::DOUBLE - valence, 2) + pow(0.7::DOUBLE - arousal, 2)) / sqrt(2.0::DOUBLE)), 9) AS emotion, round(exp(-0.02::DOUBLE * {DAYS_SQL}), 9) AS time,
 least(activation_count / 10.0::DOUBLE, 1.0::DOUBLE) AS touch, importance / 10.0::DOUBLE AS importance_score FROM memories""")
def scr_04(spark, sf):
    return memories(spark, sf).select("id", F.round(scores.emotion_score(F.lit(0.4), F.lit(0.7)), 9).alias("emotion"), F.round(scores.time_score(as_of()), 9).alias("time"), scores.touch_score().alias("touch"), scores.importance_score().alias("importance_score"))


@query("scr_11_policy_gated_rank", VIEWS + f"""SELECT id, candidate, CASE WHEN {ALLOWED_SQL['dream']} THEN round(candidate * least(1.0, greatest(0.0, arousal * 1.5)), 6) ELSE 0.0 END AS surface FROM
 (SELECT *, round(valence * 2.0::DOUBLE + arousal + importance / 10.0::DOUBLE, 6) AS candidate FROM memories)""")
def scr_11(spark, sf):
    from notegrid.operators.ranking import gated_score

    return gated_score(memories(spark, sf), [(F.col("valence"), 2.0), (F.col("arousal"), 1.0), (F.col("importance") / 10.0, 1.0)], [F.col("arousal") * 1.5], "dream")


# --- texts ------------------------------------------------------------------------------------------


@query("txt_01_token_estimate", r"SELECT doc_id, CAST(trunc(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) * 1.5::DOUBLE + len(regexp_extract_all(text, '[a-zA-Z]+')) * 1.3::DOUBLE + length(text) * 0.05::DOUBLE) AS BIGINT) AS tokens FROM documents")
def txt_01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("txt_02_sanitize", r"SELECT doc_id, sha256(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{202A}-\x{202E}\x{2066}-\x{2069}]', '', 'g')) AS h FROM documents")
def txt_02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.sanitized(F.col("text")), 256).alias("h"))


@query("txt_03_wikilinks", "SELECT doc_id, source || ',' || lang AS links, 'see ' || source || ' and ' || lang || ' and ' || source AS plain FROM documents")
def txt_03(spark, sf):
    t = F.concat(F.lit("see [["), F.col("source"), F.lit("]] and [["), F.col("lang"), F.lit("|x]] and [["), F.col("source"), F.lit("#s]]"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.wikilinks(t), ",").alias("links"), text.without_wikilinks(t).alias("plain"))


@query("txt_04_slug", r"SELECT doc_id, CASE WHEN s = '' THEN 'unnamed' ELSE s END AS slug FROM (SELECT doc_id, substring(trim(regexp_replace(replace(substring(text, 1, 60), chr(10), ' '), '[^\p{L}\p{N}\p{M}_ \-]', '', 'g')), 1, 80) AS s FROM documents)")
def txt_04(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.slug(F.replace(F.substring("text", 1, 60), F.lit("\n"), F.lit(" "))).alias("slug"))


@query("txt_05_normalize_lists", "SELECT doc_id, source || ',' || lang AS items FROM documents")
def txt_05(spark, sf):
    values = F.array(F.concat(F.lit(" "), F.col("source")), F.lit("  "), F.col("lang"), F.col("source"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.normalized_list(values, 64, 128), ",").alias("items"))


@query("txt_06_state_key", "SELECT doc_id, lower(source) || ' of ' || lang AS key FROM documents")
def txt_06(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.state_key(F.concat(F.lit("  "), F.upper("source"), F.lit(" \t of   "), F.col("lang"))).alias("key"))


KEYWORDS = {"license": ["license", "mit", "released"], "contact": ["@", "+1", "token"], "function": ["the", "der", "que"]}


@query("txt_07_classify_domain", "WITH k(domain, kw) AS (VALUES ('license', 'license'), ('license', 'mit'), ('license', 'released'), ('contact', '@'), ('contact', '+1'), ('contact', 'token'), ('function', 'the'), ('function', 'der'), ('function', 'que')), h AS (SELECT doc_id, domain, count(*) AS hits FROM documents, k WHERE contains(lower(text), kw) GROUP BY 1, 2 HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, domain) AS n FROM h) SELECT doc_id, string_agg(domain, ',' ORDER BY n) AS domains FROM r WHERE n <= 2 GROUP BY doc_id")
def txt_07(spark, sf):
    from notegrid.operators.ranking import classify

    return classify(table(spark, sf, "documents"), KEYWORDS).filter("domains <> ''")


@query("txt_09_excerpt", r"SELECT doc_id, substring(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), 'you must|ignore|released under', '[redacted]', 'gi'), 1, 280) AS excerpt FROM documents")
def txt_09(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.excerpt(F.col("text"), ["you must", "ignore", "released under"]).alias("excerpt"))


@query("txt_09_affect", VIEWS + "SELECT id, CASE WHEN valence < 0.35 THEN 'negative' WHEN valence > 0.65 THEN 'positive' ELSE 'neutral' END || '/' || CASE WHEN arousal < 0.35 THEN 'calm' WHEN arousal > 0.65 THEN 'intense' ELSE 'moderate' END AS affect FROM memories")
def txt_09b(spark, sf):
    return memories(spark, sf).select("id", text.affect(F.col("valence"), F.col("arousal")).alias("affect"))


@query("txt_10_data_block", "SELECT doc_id, length(text) AS chars, sha256(text) AS digest, substring(sha256('note|' || sha256(text)), 1, 24) AS boundary, regexp_matches(text, '(?i)ignore|you must|released') AS imperative FROM documents")
def txt_10(spark, sf):
    digest = F.sha2("text", 256)
    return table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), digest.alias("digest"), F.substring(F.sha2(F.concat(F.lit("note|"), digest), 256), 1, 24).alias("boundary"), F.rlike("text", F.lit("(?i)ignore|you must|released")).alias("imperative"))


@query("txt_11_logical_day", "SELECT CAST(ts - INTERVAL 4 HOUR AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def txt_11(spark, sf):
    return table(spark, sf, "events").groupBy(text.logical_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("txt_12_summary_render", "SELECT event_id, 'Event ' || event_type || chr(10) || '- user ' || CAST(user_id AS VARCHAR) || chr(10) || '- type ' || event_type || chr(10) || 'Todo: none' AS rendered FROM events")
def txt_12(spark, sf):
    from notegrid.operators.ranking import render_summary

    js = F.to_json(F.struct(F.concat(F.lit("Event "), F.col("event_type")).alias("summary"), F.array(F.concat(F.lit("user "), F.col("user_id").cast("string")), F.concat(F.lit("type "), F.col("event_type"))).alias("facts"), F.lit("none").alias("todo")))
    return table(spark, sf, "events").select("event_id", render_summary(js).alias("rendered"))


# --- top lists --------------------------------------------------------------------------------------


@query("top_02_decay_topn", VIEWS + f"SELECT id, score FROM (SELECT id, round({SCORE_SQL} * CASE WHEN resolved THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END, 4) AS score FROM memories WHERE {ALLOWED_SQL['spontaneous']}) ORDER BY score DESC, id LIMIT 50")
def top_02(spark, sf):
    from notegrid.operators.ranking import decay_top

    return decay_top(memories(spark, sf), as_of(), 50)


@query("top_03_sort_modes", VIEWS + f"SELECT mode, rank, id FROM (SELECT 'score' AS mode, row_number() OVER (ORDER BY {SCORE_SQL} DESC, id) AS rank, id FROM memories UNION ALL SELECT 'created_desc', row_number() OVER (ORDER BY created DESC NULLS LAST, id), id FROM memories UNION ALL SELECT 'created_asc', row_number() OVER (ORDER BY created NULLS LAST, id), id FROM memories) WHERE rank <= 100")
def top_03(spark, sf):
    from notegrid.operators.ranking import top_rows

    m = memories(spark, sf).withColumn("score", scores.decay_score(as_of()))
    parts = [top_rows(m, order, 100).select(F.lit(n).alias("mode"), "rank", "id") for n, order in (("score", [F.desc("score"), F.col("id")]), ("created_desc", [F.desc_nulls_last("created"), F.col("id")]), ("created_asc", [F.asc_nulls_last("created"), F.col("id")]))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("top_04_dream_candidates", VIEWS + f", r AS (SELECT *, {SCORE_SQL} AS score FROM memories WHERE created BETWEEN TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 48 HOUR AND TIMESTAMP '2024-01-02 00:00:00' AND {ALLOWED_SQL['dream']}) SELECT id FROM (SELECT id, count(*) OVER () AS n, row_number() OVER (ORDER BY score DESC, id) AS k FROM r) WHERE n <= 40 OR k <= 40")
def top_04(spark, sf):
    at = F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'")
    m = memories(spark, sf).filter(P.recent(at) & policy.allowed("dream")).withColumn("score", scores.decay_score(as_of()))
    return m.orderBy(F.desc("score"), "id").limit(40).select("id")  # up to 40 rows: all of them


@query("top_05_core_context", VIEWS + "SELECT id FROM memories WHERE (pinned OR type = 'permanent') AND type NOT IN ('letter', 'self', 'i') AND NOT dont_surface AND superseded_by IS NULL ORDER BY importance DESC, last_active DESC, id DESC LIMIT 20")
def top_05(spark, sf):
    core = (F.col("pinned") | (F.col("type") == "permanent")) & ~F.col("type").isin("letter", "self", "i") & ~F.col("dont_surface") & F.col("superseded_by").isNull()
    return memories(spark, sf).filter(core).orderBy(F.desc("importance"), F.desc("last_active"), F.desc("id")).limit(20).select("id")


@query("top_06_surface_order", VIEWS + f""", u AS (SELECT *, {SCORE_SQL} AS score FROM memories WHERE {ALLOWED_SQL['spontaneous']} AND NOT resolved AND NOT pinned),
c AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM u WHERE activation_count = 0 AND importance >= 8 QUALIFY k <= 2),
a AS (SELECT u.*, CASE WHEN c.id IS NULL THEN 1 ELSE 0 END AS later FROM u LEFT JOIN c ON c.id = u.id)
SELECT rank, id FROM (SELECT row_number() OVER (ORDER BY later, CASE WHEN later = 0 THEN id END, score DESC, last_active DESC, arousal * valence DESC, importance DESC, id) AS rank, id FROM a) WHERE rank <= 100""")
def top_06(spark, sf):
    from notegrid.operators.ranking import surface_order

    return surface_order(memories(spark, sf), as_of(), 100)


@query("top_13_plans_ranked", VIEWS + f"SELECT id, total FROM (SELECT id, count(*) OVER () AS total, row_number() OVER (ORDER BY created + INTERVAL 20 DAY <= {AT_SQL} DESC, importance DESC, created, id) AS k FROM memories WHERE type = 'plan' AND NOT dont_surface AND NOT resolved) WHERE k <= 5")
def top_13(spark, sf):
    from notegrid.operators.ranking import plans_ranked

    return plans_ranked(memories(spark, sf), as_of(), 20, 5)


@query("top_07_weighted_sample", VIEWS + f"SELECT id, score FROM (SELECT id, {SCORE_SQL} AS score FROM memories WHERE {ALLOWED_SQL['spontaneous']} ORDER BY score DESC, id LIMIT 200) ORDER BY -ln({SEEDED_SQL.format(7, 'id')}) / greatest(score, 1e-9), id LIMIT 20")
def top_07(spark, sf):
    from notegrid.operators.ranking import weighted_sample

    m = memories(spark, sf).filter(policy.allowed("spontaneous")).withColumn("score", scores.decay_score(as_of()))
    return weighted_sample(m.orderBy(F.desc("score"), "id").limit(200), "score", 20, seed=7).select("id", "score")


@query("sim_01_cosine", VIEWS + "SELECT a.id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1")
def sim_01(spark, sf):
    from notegrid.operators.similarity import cosine

    v = vectors(spark, sf)
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after, "vec_id").select("id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("sim_02_vector_topk", VIEWS + "SELECT q.id AS query_id, v.id, rank FROM (SELECT a.vec_id AS qv, b.vec_id AS v, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM vectors a, vectors b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) t JOIN vectors q ON q.vec_id = t.qv JOIN vectors v ON v.vec_id = t.v WHERE rank <= 10")
def sim_02(spark, sf):
    from notegrid.operators.similarity import vector_topk

    v = vectors(spark, sf)
    return vector_topk(v.filter("vec_id % 50 = 0"), v, 10)


@query("sim_03_similarity_edges", VIEWS + "SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 3) AS weight FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.4")
def sim_03(spark, sf):
    from notegrid.operators.similarity import similarity_edges

    return similarity_edges(vectors(spark, sf), 0.4)
