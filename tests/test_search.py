"""Literal search against a plain loop."""

import random

from pyspark.sql import functions as F

from notegrid.operators.predicates import literal_matches


def test_literal_matches(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["ab", "abc", "b", "cab", "Über", "x\ny", "", "\U0001f600z", "zz%_"])
    rows = [(f"m{i}", word(), [word()], [word(), word()], " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(200)]
    rows.append(("m900", None, None, None, None))
    asked = [" ".join(word() for _ in range(k)) for k in (1, 1, 2, 2, 2, 3, 3, 4, 5) for _ in range(6)] + ["a", "ü", "%", "zz%_ a", "nothing", "none of these stands", "", "  ", None, "ab", "b\n"]
    for i in rng.sample(range(200), 12):
        text = rows[i][4]
        asked.append(text[rng.randint(0, 3) : rng.randint(4, 30)])
    memories = spark.createDataFrame(rows, "id string, name string, tags array<string>, domain array<string>, content string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    want = set()
    for i, name, tags, domain, content in rows:
        text = " ".join([x for x in (name, " ".join(tags or []), " ".join(domain or []), content) if x is not None]).lower()
        want |= {(q, i) for q, t in enumerate(asked) if t and t.strip(" ") and t.strip(" ").lower() in text}
    found = literal_matches(memories, queries)
    got = [tuple(r) for r in found.collect()]
    assert not set(got) - want, [(asked[q], q, i) for q, i in set(got) - want][:4]
    assert not want - set(got), [(asked[q], q, i) for q, i in want - set(got)][:9]
    assert len(got) == len(want) and len(want) > 300
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert literal_matches(memories.limit(0), queries).count() == literal_matches(memories, queries.limit(0)).count() == 0
    many = memories.select(F.col("id").alias("query_id"), F.col("content").alias("query"))  # as many queries as texts
    assert literal_matches(memories, many).filter("query_id = id").count() == len({r[0] for r in rows if (r[4] or "").strip(" ")})


def test_postings_of_a_text_lie_in_one_task(spark, monkeypatch):
    from notegrid.operators import retrieval as R

    monkeypatch.setattr(R, "TEXTS_A_TASK", 16)
    rng = random.Random(6)
    rows = [(f"m{i}", "n", [], [], " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(20))) for i in range(100)]
    memories = spark.createDataFrame(rows, "id string, name string, tags array<string>, domain array<string>, content string")
    files = R.postings(memories).withColumn("file", F.input_file_name()).groupBy("id").agg(F.count_distinct("file").alias("n"))
    assert files.count() == 100 and files.filter("n > 1").count() == 0
    asked = spark.createDataFrame([(1, "aa b c"), (2, "hhh"), (3, "nowhere"), (4, "n n")], "query_id long, query string")
    want = {}
    for r in R.bm25(memories, asked).collect():
        want.setdefault(r.query_id, []).append((-round(r.bm25, 9), r.id))
    got = {}
    for r in R.first_by_bm25(memories, asked, 7, slices=3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    assert got and got == {q: {k + 1: i for k, (_, i) in enumerate(sorted(x)[:7])} for q, x in want.items()}


def test_search_compares_contents_only_where_they_could_count(spark, sf, monkeypatch):
    from notegrid.operators import retrieval as R
    from notegrid.schema import as_of, memories

    m = memories(spark, sf).filter("doc_id < 120")
    queries = spark.createDataFrame([(1, "the of", 0.2, 0.9), (2, "que de la", None, None)], "query_id long, query string, q_valence double, q_arousal double")
    near = m.filter("doc_id % 7 = 1").select(F.lit(2).cast("long").alias("query_id"), "id", ((F.col("doc_id") % 10) / 10.0).alias("semantic"))
    compared, plain = [], R.content_scores
    monkeypatch.setattr(R, "content_scores", lambda pairs: compared.append(pairs.count()) or plain(pairs))
    found = lambda k: {(r.query_id, r.id, r.score, r["rank"]) for r in R.search(m, queries, near, as_of(), k=k, rows=50).collect()}
    whole = found(1000)
    every = sum(compared)
    compared.clear()
    assert found(3) == {x for x in whole if x[3] <= 3}
    assert sum(compared) < every / 4, (sum(compared), every)


def bm25_tables(spark, at):
    """Folder of tables whose long texts hold what is asked for only behind their first 1,200 characters; and its SQL."""
    import duckdb

    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice(["river", "stone", "lamp", "moss", "tale", "wind"]) for _ in range(n))
    docs = [(i, words(300 + 40 * i) + (f" mark{i} far behind  the{i}\tbeginning " + words(5) if i % 3 == 0 else ""), "web", "en") for i in range(12)]
    docs += [(12, "mark3 river", "web", "en"), (13, None, "web", "en"), (14, "", "web", "en"), (15, "lamp " * 20000 + "last", "web", "en")]
    asked = [(i, f"mark{i} far behind") for i in (0, 3, 6, 9)] + [(20, "last"), (21, "lamp moss"), (22, "nowhere")]
    assert all(text.index(f"mark{i}") > 1200 for i, text, *_ in docs[:12:3])
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{at}/events.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet/*.parquet')")
    return con


def test_retrieval_eval_finds_what_stands_behind_the_beginning(spark, tmp_path):
    from notegrid.plans.registry import oracle_sql, queries

    con = bm25_tables(spark, tmp_path)
    got = queries()["agg_07_retrieval_eval"](spark, str(tmp_path)).collect()
    assert {(r.case, r.hit, r.recall, r["first"]) for r in got if r.case < 21} == {(0, True, 1.0, 1), (3, True, 1.0, 1), (6, True, 1.0, 1), (9, True, 1.0, 1), (20, True, 1.0, 1)}
    want = con.sql(oracle_sql()["agg_07_retrieval_eval"]).fetchall()
    assert sorted((r.case, r.hit, r.recall, r["first"], r.reciprocal) for r in got) == sorted(want)


def test_fulltext_search_finds_what_stands_behind_the_beginning(spark, tmp_path):
    from notegrid.plans.registry import oracle_sql, queries

    con = bm25_tables(spark, tmp_path)
    got = sorted(tuple(r) for r in queries()["jon_24_fulltext_search"](spark, str(tmp_path)).select("query_id", "id", "rank").collect())
    assert {(q, f"m{q}", 1) for q in (0, 6, 9)} <= set(got) and (20, "m15", 1) in got and (3, "m3", 1) in got and not any(q == 22 for q, *_ in got)
    assert got == sorted(con.sql(oracle_sql()["jon_24_fulltext_search"]).fetchall())


def test_first_by_bm25_keeps_ties_and_short_lists(spark):
    from notegrid.operators import retrieval as R

    rows = [(f"m{i:03}", "n", [], [], "filler " * (i % 3 + 1) + ("same" if i % 4 else "other")) for i in range(120)]
    memories = spark.createDataFrame(rows, "id string, name string, tags array<string>, domain array<string>, content string")
    asked = spark.createDataFrame([(1, "other"), (2, "same other"), (3, "filler"), (4, "nowhere"), (None, "other")], "query_id long, query string")
    want: dict = {}
    for r in R.bm25(memories, asked).collect():
        want.setdefault(r.query_id, []).append((-round(r.bm25, 9), r.id))
    assert want and len({s for s, _ in want[1]}) == 3
    for most, slices in ((5, 64), (5, 3), (40, 8), (500, 64)):
        got: dict = {}
        for r in R.first_by_bm25(memories, asked, most, slices).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.id
        assert got == {q: {k + 1: i for k, (_, i) in enumerate(sorted(x)[:most])} for q, x in want.items()}, (most, slices)


def test_bm25_scores_whole_texts(spark, tmp_path):
    import math
    from collections import Counter

    from notegrid.plans.registry import oracle_sql, queries

    con = bm25_tables(spark, tmp_path)
    docs, asked = con.sql("SELECT doc_id, text, lang, source FROM documents").fetchall(), con.sql("SELECT item_id, text FROM benchmark").fetchall()
    held = {f"m{i}": Counter(" ".join(x for x in ((text or "")[:40], text, lang, source) if x is not None).lower().split()) for i, text, lang, source in docs}
    n, size = len(held), sum(sum(c.values()) for c in held.values()) / len(held)
    idf = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in Counter(t for c in held.values() for t in c).items()}
    idf = {t: 0.25 * sum(idf.values()) / len(idf) if x < 0 else x for t, x in idf.items()}
    want = {}
    for q, text in asked:
        raw = {i: sum(idf.get(t, 0.0) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / size)) for t in text.split() if c[t]) for i, c in held.items()}
        want |= {(q, i): x / max(raw.values()) for i, x in raw.items() if x > 0}
    got = {(r.query_id, r.id): r.bm25 for r in queries()["scr_09_bm25"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - x) < 1e-6 for k, x in want.items())
    assert {(0, "m0"), (6, "m6"), (9, "m9"), (20, "m15")} <= got.keys()
    assert sorted((*k, x) for k, x in got.items()) == sorted(con.sql(oracle_sql()["scr_09_bm25"]).fetchall())
