"""Queries of retrieval, sources, streaming and batch inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from notegrid.operators import aggregates as A
from notegrid.operators import inference as I
from notegrid.operators import retrieval as R
from notegrid.operators import similarity as SI
from notegrid.plans.joined import mid
from notegrid.plans.registry import query
from notegrid.plans.rows import AT_SQL
from notegrid.schema import VIEWS, as_of, ledger, memories, table, vectors
from notegrid.sources import files as S
from notegrid.streaming import jobs as ST


def passages(spark, sf):
    """Queries: the whole benchmark passages."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


BM25_SQL = VIEWS + r""", d AS (SELECT id, list_filter(string_split_regex(lower(concat_ws(' ', name, content, array_to_string(tags, ' '), array_to_string(domain, ' '))), '\s+'), lambda x: x <> '') AS t FROM memories),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), p AS (SELECT id, dl, token, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS token FROM d) GROUP BY 1, 2, 3),
i AS (SELECT token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p, s GROUP BY token, n), w AS (SELECT token, CASE WHEN idf < 0 THEN (SELECT avg(idf) FROM i) * 0.25::DOUBLE ELSE idf END AS idf FROM i),
q AS (SELECT query_id, token, count(*) AS times FROM (SELECT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS token FROM benchmark) GROUP BY 1, 2),
r AS (SELECT query_id, id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS raw FROM q JOIN w USING (token) JOIN p USING (token), s GROUP BY 1, 2), b AS (SELECT query_id, id, raw / max(raw) OVER (PARTITION BY query_id) AS bm25 FROM r)"""


@query("scr_09_bm25", BM25_SQL + " SELECT query_id, id, round(bm25, 6) AS bm25 FROM b WHERE bm25 > 0")
def scr_09(spark, sf):
    return R.bm25(memories(spark, sf), passages(spark, sf), None).withColumn("bm25", F.round("bm25", 6))


@query("jon_24_fulltext_search", BM25_SQL + " SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, id) AS rank FROM b WHERE bm25 > 0) WHERE rank <= 10")
def jon_24(spark, sf):
    return R.first_by_bm25(memories(spark, sf), passages(spark, sf))


def _semantic(spark, sf):
    """Each query's vector is that of the row of its number; only close rows count."""
    v = vectors(spark, sf)
    q = v.join(passages(spark, sf).select("query_id"), F.col("vec_id") == F.col("query_id"), "left_semi").select(F.col("vec_id").alias("query_id"), "vec_id", "embedding")
    return SI.vector_scores(q, v, 0.4)


@query("top_01_hybrid_search")
def top_01(spark, sf):
    q = passages(spark, sf).withColumns({"domains": F.when(F.col("query_id") % 3 == 0, F.array(F.lit("SRC1"), F.lit("src2"))).when(F.col("query_id") % 3 == 1, F.array(F.lit("nothing"))), "q_valence": F.when(F.col("query_id") % 2 == 0, 0.25), "q_arousal": F.when(F.col("query_id") % 2 == 0, 0.75)})
    return R.search(memories(spark, sf), q, _semantic(spark, sf), as_of()).select("query_id", "id", "score", "vector_match", "rank")


@query("scr_03_topic_score")
def scr_03(spark, sf):
    m = memories(spark, sf)
    pairs = m.join(m.select((F.col("doc_id") - 1).alias("doc_id"), F.col("name").alias("query")), "doc_id").withColumn("query_id", F.col("doc_id"))
    return R.topic_scores(pairs).select("id", F.round("topic", 6).alias("topic"))


@query("scr_08_fused_score", VIEWS + """, c AS (SELECT doc_id % 8 AS query_id, *, (doc_id * 29 % 101) / 100.0::DOUBLE AS topic, CASE WHEN doc_id % 3 = 0 THEN (doc_id * 17 % 101) / 100.0::DOUBLE END AS semantic, CASE WHEN doc_id % 8 > 1 AND doc_id % 5 = 0 THEN (doc_id * 13 % 101) / 100.0::DOUBLE END AS bm25, doc_id % 11 = 0 AS literal FROM memories),
b AS (SELECT *, coalesce(max(bm25) OVER (PARTITION BY query_id), 0) > 0 AS any_bm25, greatest(0.0::DOUBLE, date_diff('microsecond', last_active, TIMESTAMP '2024-01-31 00:00:00') / 86400000000.0::DOUBLE) AS days FROM c),
r AS (SELECT *, least(100.0::DOUBLE, (topic * 4.0::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - sqrt(pow(0.3::DOUBLE - valence, 2) + pow(0.6::DOUBLE - arousal, 2)) / sqrt(2.0::DOUBLE)) * 2.0::DOUBLE + exp(-0.02::DOUBLE * days) * 1.5::DOUBLE + importance / 10.0::DOUBLE + least(activation_count / 10.0::DOUBLE, 1.0::DOUBLE) + coalesce(semantic * 2.5::DOUBLE, 0) + CASE WHEN any_bm25 THEN coalesce(bm25, 0) * 1.5::DOUBLE ELSE 0 END) / (9.5::DOUBLE + CASE WHEN semantic IS NOT NULL THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN any_bm25 THEN 1.5::DOUBLE ELSE 0 END) * 100 + CASE WHEN literal THEN 25.0::DOUBLE ELSE 0 END) AS raw FROM b)
SELECT query_id, id, round(raw * CASE WHEN resolved THEN 0.3::DOUBLE ELSE 1 END * CASE WHEN superseded_by IS NOT NULL THEN 0.12::DOUBLE ELSE 1 END, 2) AS score, coalesce(semantic >= 0.55, FALSE) AND NOT (raw >= 50 OR literal) AS vector_match FROM r WHERE raw >= 50 OR literal OR coalesce(semantic >= 0.55, FALSE)""")
def scr_08(spark, sf):
    d = F.col("doc_id")
    part = lambda k: (d * k % 101) / F.lit(100.0)
    rows = memories(spark, sf).withColumns({"query_id": d % 8, "topic": part(29), "semantic": F.when(d % 3 == 0, part(17)), "bm25": F.when((d % 8 > 1) & (d % 5 == 0), part(13)), "literal": d % 11 == 0})
    return R.fused(rows, as_of(), F.lit(0.3), F.lit(0.6))


EXPECTED_SQL = ", lit AS (SELECT item_id AS query_id, id FROM benchmark b JOIN memories m ON contains(lower(concat_ws(' ', m.name, array_to_string(m.tags, ' '), array_to_string(m.domain, ' '), m.content)), lower(trim(b.text))))"


@query("agg_07_retrieval_eval", BM25_SQL + EXPECTED_SQL + """, top AS (SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, id) AS rank FROM b WHERE bm25 > 0) WHERE rank <= 10),
found AS (SELECT lit.query_id, count(top.id) AS found, min(rank) AS first, count(*) AS wanted FROM lit LEFT JOIN top ON top.query_id = lit.query_id AND top.id = lit.id GROUP BY 1)
SELECT query_id AS "case", found > 0 AS hit, round(found / wanted::DOUBLE, 6) AS recall, first, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal FROM found""")
def agg_07(spark, sf):
    from notegrid.operators.predicates import literal_matches

    full = passages(spark, sf)
    m = memories(spark, sf)
    wanted = literal_matches(m, full).select(F.col("query_id").alias("case"), "id")
    return A.retrieval_eval(R.first_by_bm25(m, full).select(F.col("query_id").alias("case"), "id", "rank"), wanted)


# --- sources ----------------------------------------------------------------------------------------


def notes(spark, sf):
    """Memories as Markdown texts; every 50th has lost its front matter."""
    body = S.render_note({"id": F.col("id"), "importance": F.col("importance"), "type": F.col("type")}, F.col("content"))
    return memories(spark, sf).select(F.concat("type", F.lit("/"), "id", F.lit(".md")).alias("path"), F.when(F.col("doc_id") % 50 == 9, F.col("content")).otherwise(body).alias("value"))


@query("src_01_markdown_notes", VIEWS + "SELECT type || '/' || id || '.md' AS path, CASE WHEN doc_id % 50 <> 9 THEN id END AS id, CASE WHEN doc_id % 50 <> 9 THEN CAST(importance AS VARCHAR) END AS importance, CASE WHEN doc_id % 50 <> 9 THEN type END AS type, sha256(content) AS h, CASE WHEN doc_id % 50 = 9 THEN 'no_front_matter' END AS parse_error FROM memories")
def src_01(spark, sf):
    return S.parse_notes(notes(spark, sf), ["id", "importance", "type"]).select("path", "id", "importance", "type", F.sha2("content", 256).alias("h"), "parse_error")


@query("src_02_normalize", "SELECT doc_id AS id, CAST(least(10, greatest(1, doc_id % 14)) AS INT) AS importance, least(1.0::DOUBLE, (doc_id % 13) / 10.0::DOUBLE) AS valence, CASE WHEN doc_id % 3 = 0 THEN 0.3::DOUBLE ELSE 0.25::DOUBLE END AS arousal, source || '/' || lang AS domain, CASE WHEN doc_id % 4 = 0 THEN 0.0::DOUBLE ELSE (doc_id % 9)::DOUBLE END AS activation_count FROM documents")
def src_02(spark, sf):
    d = F.col("doc_id")
    raw = table(spark, sf, "documents").select(d.alias("id"), F.concat(F.lit("i"), (d % 14).cast("string")).alias("importance"), F.concat(F.lit("V"), ((d % 13) / 10.0).cast("string")).alias("valence"), F.when(d % 3 == 0, "calm").otherwise("A0.25").alias("arousal"), F.concat(F.lit(" "), F.col("source"), F.lit(", ,"), F.col("lang")).alias("domain"), F.when(d % 4 == 0, "NaN").otherwise((d % 9).cast("string")).alias("activation_count"))
    return S.normalize(raw).withColumn("domain", F.array_join("domain", "/"))


@query("src_03_snapshot_diff", VIEWS + "SELECT id, CASE WHEN doc_id % 9 = 1 THEN 'added' WHEN doc_id % 9 = 2 THEN 'removed' WHEN doc_id % 9 = 3 THEN 'content' ELSE 'metadata' END AS change FROM memories WHERE doc_id % 9 BETWEEN 1 AND 4")
def src_03(spark, sf):
    k, m = F.col("doc_id") % 9, memories(spark, sf)
    now = m.filter(k != 2).select("id", F.when(k == 3, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"), F.when(k == 4, F.col("importance") + 1).otherwise(F.col("importance")).alias("importance"))
    return S.snapshot_diff(m.filter(k != 1), now, ["importance"])


def _lines(spark, sf):
    e = ledger(spark, sf)
    js = F.to_json(F.struct("seq", "event_type", "trace_id", "trace_kind", "body_hash", "payload", F.col("recorded_at").cast("string").alias("recorded_at")))
    s = F.col("seq")
    return e.select(s.alias("line_no"), F.when(s % 31 == 0, "  ").when(s % 37 == 0, '{"seq": ').when(s % 41 == 0, "[1]").otherwise(js).alias("value"))


@query("src_04_read_ledger", VIEWS + "SELECT seq, event_type, trace_id, payload FROM ledger WHERE seq % 31 <> 0 AND seq % 37 <> 0 AND seq % 41 <> 0")
def src_04(spark, sf):
    return S.parse_ledger(_lines(spark, sf)).filter("valid").select("seq", "event_type", "trace_id", "payload")


@query("src_05_ledger_integrity", VIEWS + "SELECT count(*) FILTER (WHERE seq % 37 <> 0 AND seq % 41 <> 0) AS events, count(*) FILTER (WHERE seq % 37 = 0 OR seq % 41 = 0) AS invalid, max(seq) FILTER (WHERE seq % 37 <> 0 AND seq % 41 <> 0) AS latest_seq FROM ledger WHERE seq % 31 <> 0")
def src_05(spark, sf):
    return S.ledger_integrity(_lines(spark, sf))


@query("src_06_append_ledger", VIEWS + "SELECT 1000000 + row_number() OVER (ORDER BY recorded_at, seq) AS seq, trace_id, 'sha256:' || sha256(payload) AS body_hash FROM ledger WHERE event_type = 'TraceUpdated'")
def src_06(spark, sf):
    changes = ledger(spark, sf).filter("event_type = 'TraceUpdated'").select("recorded_at", F.col("seq").alias("old_seq"), "trace_id", F.concat(F.lit("sha256:"), F.sha2("payload", 256)).alias("body_hash"))
    return S.append_events(changes, F.lit(1000000), ["recorded_at", "old_seq"]).select("seq", "trace_id", "body_hash")


@query("src_07_verify_chain", VIEWS + "SELECT seq AS index, CASE WHEN seq % 83 = 0 THEN 'bad_checksum' WHEN seq % 97 = 0 THEN 'broken_link' END AS code FROM ledger WHERE seq > 2 AND (seq % 83 = 0 OR (seq % 97 = 0)) ORDER BY 1")
def src_07(spark, sf):
    # links are made in pairs of rows: the even one follows the odd one, which follows nothing
    s = F.col("seq")
    rows = ledger(spark, sf).select(s.alias("index"), "payload")
    own = lambda i, prev, p: F.sha2(F.concat_ws("|", i.cast("string"), prev, p), 256)
    i = F.col("index")
    base = rows.withColumn("checksum", F.sha2(F.concat(F.lit("c"), i.cast("string")), 256)).withColumn("previous_checksum", F.when(i % 97 == 0, "odd").otherwise(F.when(i == 1, "").otherwise(F.sha2(F.concat(F.lit("c"), (i - 1).cast("string")), 256))))
    checked = S.verify_chain(base).filter("code <> 'bad_checksum'")  # the links alone
    altered = base.withColumn("checksum", F.when(i % 83 == 0, "odd").otherwise(own(i, F.col("previous_checksum"), F.col("payload"))))
    sums = S.verify_chain(altered.withColumn("previous_checksum", F.col("previous_checksum"))).join(altered.filter(i % 83 == 0).select("index"), "index", "left_semi").select("index", F.lit("bad_checksum").alias("code"))
    return checked.filter("index > 2").join(sums.select("index"), "index", "left_anti").unionByName(sums.filter("index > 2"))


@query("src_08_read_vectors", "SELECT vec_id AS id, CASE WHEN vec_id % 5 > 2 THEN round(list_sum(embedding::DOUBLE[]), 5) END AS total, CASE vec_id % 5 WHEN 0 THEN 'malformed' WHEN 1 THEN 'empty' WHEN 2 THEN 'wrong_size' END AS error FROM embeddings")
def src_08(spark, sf):
    k = F.col("vec_id") % 5
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.when(k == 0, "[1, x").when(k == 1, "[]").when(k == 2, "[1.0, 2.0]").otherwise(F.to_json("embedding")).alias("embedding"))
    return S.parse_vectors(rows, 64).select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), "error")


def file_of(prefix=""):
    """Path of the export file of a turn; a file holds at most 64 turns of a conversation."""
    return F.concat(F.lit(prefix), F.col("conv_id").cast("string"), F.lit("-"), F.floor(F.col("turn") / 64).cast("string"))


FILE_SQL = "CAST(conv_id AS VARCHAR) || '-' || CAST(turn // 64 AS VARCHAR)"


@query("src_09_chat_export", f"SELECT 'c' || {FILE_SQL} AS path, t AS turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, sha256(trim(text)) AS h FROM (SELECT *, row_number() OVER (PARTITION BY {FILE_SQL} ORDER BY turn) - 1 AS t FROM conversations) WHERE trim(text) <> ''")
def src_09(spark, sf):
    c = table(spark, sf, "conversations").withColumn("m", F.struct(F.col("turn"), F.struct(F.col("role").alias("sender"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text"), F.when(F.col("turn") % 2 == 1, F.array(F.struct("text"))).alias("content")).alias("m")))
    exports = c.groupBy(file_of("c").alias("path")).agg(F.array_sort(F.collect_list("m")).alias("ms")).select("path", F.to_json(F.struct(F.transform("ms", lambda x: x["m"]).alias("chat_messages"))).alias("value"))
    return S.parse_chat_export(exports).select("path", "turn", "role", F.sha2("content", 256).alias("h"))


@query("src_11_transcripts", f"SELECT 'c' || {FILE_SQL} AS path, row_number() OVER (PARTITION BY {FILE_SQL} ORDER BY turn) AS turn, role, sha256(trim(text)) AS h FROM conversations")
def src_11(spark, sf):
    c = table(spark, sf, "conversations").withColumn("m", F.struct(F.col("turn"), F.concat("role", F.lit(": "), "text").alias("line")))
    texts = c.groupBy(file_of("c").alias("path")).agg(F.array_sort(F.collect_list("m")).alias("ms")).select("path", F.array_join(F.transform("ms", lambda x: x["line"]), "\n").alias("value"))
    return S.parse_transcripts(texts).select("path", "turn", "role", F.sha2("content", 256).alias("h"))


@query("src_14_verify_manifest", VIEWS + "SELECT CASE WHEN doc_id % 40 = 5 THEN '../' || id ELSE id END AS path, CASE WHEN doc_id % 40 = 5 THEN 'unsafe' WHEN doc_id % 40 = 1 THEN 'missing' WHEN doc_id % 40 = 2 THEN 'extra' WHEN doc_id % 40 = 3 THEN 'size' ELSE 'hash' END AS code FROM memories WHERE doc_id % 40 BETWEEN 1 AND 5")
def src_14(spark, sf):
    k = F.col("doc_id") % 40
    m = memories(spark, sf).withColumn("path", F.when(k == 5, F.concat(F.lit("../"), "id")).otherwise(F.col("id")))
    want = S.manifest(m.filter(k != 2).select("path", F.col("content").alias("data")))
    got = S.manifest(m.filter(k != 1).select("path", F.when(k == 3, F.concat("content", F.lit("x"))).when(k == 4, F.reverse("content")).otherwise(F.col("content")).alias("data")))
    return S.verify_manifest(want, got.withColumn("bytes", F.when(F.col("sha256").isNull(), None).otherwise(F.col("bytes"))))


@query("src_16_to_events", VIEWS + "SELECT 'mem_' || substring(sha256(id || '|' || content), 1, 32) AS event_id, type AS memory_type, importance FROM memories WHERE doc_id % 4 <> 0")
def src_16(spark, sf):
    m = memories(spark, sf)
    known = S.to_events(m.filter("doc_id % 4 = 0"), spark.createDataFrame([], "event_id string"))
    return S.to_events(m, known).select("event_id", "memory_type", "importance")


ROW_SQL = "sha256(CAST(seq AS VARCHAR) || '|' || event_type || '|' || trace_id || '|' || payload)"
LEVELS_SQL = f""", rows_ AS (SELECT seq AS i, {ROW_SQL} AS h FROM ledger), l1 AS (SELECT i // 1000 AS i, sha256(string_agg(h, '' ORDER BY i, h)) AS h FROM rows_ GROUP BY 1),
l2 AS (SELECT i // 1000 AS i, sha256(string_agg(h, '' ORDER BY i, h)) AS h FROM l1 GROUP BY 1), l3 AS (SELECT sha256(string_agg(h, '' ORDER BY i, h)) AS checksum FROM l2)"""


@query("src_17_snapshot_checksum", VIEWS + LEVELS_SQL + " SELECT max(seq) AS last_index, arg_max(event_type, seq) AS last_type, count(*) AS n, max(seq) - min(seq) + 1 = count(DISTINCT seq) AS contiguous, (SELECT checksum FROM l3) AS checksum, '' AS problems FROM ledger")
def src_17(spark, sf):
    rows = ledger(spark, sf).select(F.col("seq").alias("index"), "event_type", "trace_id", "payload")
    header = S.snapshot_header(rows)
    return header.join(S.snapshot_problems(rows, header))


@query("src_13_archive", VIEWS + "SELECT id, sha256(content) AS h, '' AS problems FROM memories WHERE content IS NOT NULL")
def src_13(spark, sf):
    from notegrid.storage import new_path

    path = new_path(spark, "archive")
    S.write_archive(path, {"memories": memories(spark, sf).select("id", "content", "type"), "vectors": vectors(spark, sf)})
    found = S.verify_archive(spark, path).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("problems"))  # one row
    return S.read_archive(spark, path, "memories").filter("content IS NOT NULL").select("id", F.sha2("content", 256).alias("h")).join(F.broadcast(found))


# --- streaming --------------------------------------------------------------------------------------


def _stream(spark, sf):
    # as a pattern, the path may be one file or a folder of files
    return ST.event_stream(spark, f"{sf}/event[s].parquet", spark.read.parquet(f"{sf}/events.parquet").schema)


@query("str_02_touch_counts", "SELECT 'u' || CAST(user_id AS VARCHAR) AS trace_id, count(*) AS touches FROM events WHERE event_type = 'view' GROUP BY 1")
def str_02(spark, sf):
    e = _stream(spark, sf).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("trace_id"), F.when(F.col("event_type") == "view", "TraceTouched").otherwise("Other").alias("event_type"))
    return ST.run_available(ST.touch_counts(e), "complete", "touches")


@query("str_05_daily_window", "SELECT CAST(ts - INTERVAL 4 HOUR AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def str_05(spark, sf):
    return ST.run_available(ST.daily_activity(_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))), "complete", "daily")


# --- batch inference --------------------------------------------------------------------------------


def stand_in(texts: list[str]) -> list[list[float]]:
    """A deterministic model: hashed character counts."""
    import zlib

    if any("MIT" in t for t in texts):
        raise ValueError("refused")
    return [[float(zlib.crc32(f"{i}{t}".encode()) % 1000) / 1000 for i in range(4)] for t in texts]


@query("udf_01_embed", VIEWS + "SELECT id, sha256(content) AS content_hash, CASE WHEN contains(content, 'MIT') THEN 'refused' END AS error FROM memories")
def udf_01(spark, sf):
    return I.embed(memories(spark, sf), stand_in).select("id", "content_hash", "error")


def stand_in_answer(text: str) -> str:
    if len(text) % 5 == 0:
        return "no answer"
    return f'Sure: ```json\n{{"domain": ["a", "b", "c", "d"], "valence": {len(text) % 4}.5, "tags": ["t"], "name": "n{len(text)}"}}\n```'


@query("udf_02_annotate", VIEWS + "SELECT id, CASE WHEN length(content) % 5 = 0 THEN 'general' ELSE 'a,b,c' END AS domain, CASE WHEN length(content) % 5 = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, length(content) % 4 + 0.5::DOUBLE) END AS valence, 0.3::DOUBLE AS arousal, CASE WHEN length(content) % 5 <> 0 THEN 'n' || CAST(length(content) AS VARCHAR) END AS name FROM memories")
def udf_02(spark, sf):
    return I.annotate(memories(spark, sf), stand_in_answer).select("id", F.array_join("domain", ",").alias("domain"), "valence", "arousal", "name")


@query("udf_06_cached_summaries", VIEWS + ", c AS (SELECT DISTINCT sha256(concat_ws('|', 'v1', content)) AS h FROM memories WHERE doc_id % 2 = 0) SELECT id, CASE WHEN sha256(concat_ws('|', 'v1', content)) IN (SELECT h FROM c) THEN 'cached' ELSE 'new ' || CAST(length(content) AS VARCHAR) END AS result FROM memories")
def udf_06(spark, sf):
    m = memories(spark, sf)
    cache = m.filter("doc_id % 2 = 0").select(F.sha2(F.concat_ws("|", F.lit("v1"), "content"), 256).alias("key"), F.lit("cached").alias("result")).distinct()
    return I.with_cache(m, cache, "v1", lambda df: df.select("id", F.concat(F.lit("new "), F.length("content").cast("string")).alias("result")))[0]
