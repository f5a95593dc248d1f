"""Operators that SQL can't express, against sequential versions; storage, sources and inference."""

import hashlib
import itertools
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from notegrid.operators import inference, joins, ordered, retrieval, similarity
from notegrid.sources import files
from notegrid.storage import VersionedTable, new_path


def test_budget_greedy(spark):
    rng = random.Random(3)
    rows = [(g, r, f"x{g}-{r}", rng.randint(1, 60)) for g in range(5) for r in range(30)]
    got = ordered.budget_greedy(spark.createDataFrame(rows, "s long, rank long, id string, tokens long"), "s", 200).collect()
    for g in range(5):
        left, want = 200, []
        for _, _, i, t in [x for x in rows if x[0] == g]:
            if t <= left:
                left -= t
                want.append(i)
        assert [r.id for r in sorted((r for r in got if r.s == g), key=lambda r: r.pos)] == want
    with pytest.raises(Exception, match="cap the candidates"):
        ordered.budget_greedy(spark.createDataFrame(rows, "s long, rank long, id string, tokens long"), "s", 200, most=10).collect()


def test_partial_ratios():
    rng = random.Random(6)
    pairs = [tuple("".join(rng.choice("abc d") for _ in range(rng.randint(0, n))) for n in (9, 30)) for _ in range(200)] + [("", ""), ("a", "a"), ("ab", "xab")]
    assert all(abs(x - retrieval.partial_ratio(a, b)) < 1e-9 for x, (a, b) in zip(retrieval.partial_ratios(pairs, most=64), pairs))


def test_search_scores_every_memory(spark, sf):
    from notegrid.schema import as_of, memories

    # "tale" is in every text, so BM25 ranks the short ones first; m30 alone has the query's letters in its name
    m = memories(spark, sf).filter("doc_id < 40").withColumn("content", F.when(F.col("doc_id") == 30, F.lit("a tale of winding riverbanks " + "filler words " * 60)).otherwise(F.lit("tale")))
    m = m.withColumn("name", F.when(F.col("doc_id") == 30, "windingriverbank").otherwise("x")).withColumn("resolved", F.lit(False)).withColumn("superseded_by", F.lit(None).cast("string"))
    m = m.withColumn("domain", F.array(F.lit("winding"))).withColumn("tags", F.array(F.lit("river")))
    queries = spark.createDataFrame([(1, "tale winding riverbank")], "query_id long, query string")
    near = m.filter("doc_id in (30, 31)").select(F.lit(1).cast("long").alias("query_id"), "id", F.lit(0.6).alias("semantic"))
    none = near.limit(0)
    full = {r.id: r.score for r in retrieval.search(m, queries, none, as_of(), k=100).collect()}
    assert "m30" in full and len(full) > 20
    few = {r.id: r.score for r in retrieval.search(m, queries, near, as_of(), k=100, fuzzy=1).collect()}
    whole = {r.id: r.score for r in retrieval.search(m, queries, near, as_of(), k=100).collect()}
    assert {"m30", "m31"} <= set(few) and all(whole[i] == x for i, x in few.items())


def test_budget_greedy_reads_the_whole_table(spark, tmp_path):
    from notegrid.plans.registry import queries

    docs = [(i, "word " * (1 + i % 90), "web", "en") for i in range(1500)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = queries()["win_02_budget_greedy"](spark, str(tmp_path)).collect()
    assert {r.session for r in got} == set(range(15))
    tokens = lambda i: int((1 + i % 90) * 1.3 + 5 * (1 + i % 90) * 0.05)
    left, want = 5000, []
    for i in range(1400, 1500):
        if tokens(i) <= left:
            left -= tokens(i)
            want.append(f"m{i}")
    assert [r.id for r in sorted((r for r in got if r.session == 14), key=lambda r: r.pos)] == want


def test_lineage_goes_to_the_root(spark):
    chain = [(f"e{i}", f"e{i - 1}") for i in range(1, 61)] + [("x", "y"), ("y", "z"), ("z", "x")]
    edges = spark.createDataFrame(chain, "child string, parent string")
    got = {(r.id, r.ancestor): r.depth for r in joins.lineage(edges, spark.createDataFrame([("e60",), ("x",)], "id string")).collect()}
    assert got == {("e60", f"e{60 - d}"): d for d in range(1, 61)} | {("x", "y"): 1, ("x", "z"): 2, ("x", "x"): 3}


def test_chunk_turns(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice([1, 30, 50, 99, 151, 400])) for c in range(4) for t in range(25)]
    got = {(r.conv_id, r.turn): r.chunk for r in ordered.chunk_turns(spark.createDataFrame(rows, "conv_id long, turn long, tokens long"), 100).collect()}
    for c in range(4):
        chunk, held, closed = -1, 0, True
        for _, t, n in [x for x in rows if x[0] == c]:
            if n > 150:
                chunk, held, closed = chunk + 1, 0, True
            elif closed or held + n > 100:
                chunk, held, closed = chunk + 1, n, False
            else:
                held += n
            assert got[c, t] == chunk


def folded(tokens, target):
    chunk, held, out = -1, target + 1, []
    for n in tokens:
        if n > target * 1.5:
            chunk, held = chunk + 1, target + 1
        elif held + n > target:
            chunk, held = chunk + 1, n
        else:
            held += n
        out.append(chunk)
    return out


def test_steps_equal_the_fold():
    rng = random.Random(12)
    for _ in range(300):
        target = rng.choice([1, 5, 20, 60])
        tokens = [rng.choice([0, 1, 2, 5, 9, 20, 31, 95]) for _ in range(rng.randint(1, 40))]
        steps = ordered._steps(np.array(tokens), target, int(target * 1.5))
        assert sum(hi - lo + 1 for lo, hi, *_ in steps) == target + 2
        for h in range(target + 2):
            (_, _, out, begun, adds), = [s for s in steps if s[0] <= h <= s[1]]
            chunk, held = 0, h
            for n in tokens:
                if n > int(target * 1.5):
                    chunk, held = chunk + 1, target + 1
                elif held + n > target:
                    chunk, held = chunk + 1, n
                else:
                    held += n
            assert (min(held, target + 1), chunk) == (out + (h if adds else 0), begun)


def test_chunk_turns_deals_a_long_dialogue(spark):
    """One dialogue has two thirds of all turns; it lies in many ranges, as do nulls and turns without tokens."""
    rng = random.Random(13)
    data = {c: [rng.choice([0, 1, 3, 7, 40, 151, 400]) for _ in range(n)] for c, n in [(None, 900), (1, 40), (2, 6000), (3, 1), (4, 1500), (5, 600)]}
    data[5] = [0] * 600
    rows = [(c, t, n if n or t % 2 else None) for c, ns in data.items() for t, n in enumerate(ns)]
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = ordered.chunk_turns(spark.createDataFrame(rows, "conv_id long, turn long, tokens long"), 100)
        got = {(r.conv_id, r.turn): r.chunk for r in found.collect()}
        empty = ordered.chunk_turns(spark.createDataFrame([], "conv_id string, turn int, tokens int"), 100).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {(c, t): k for c, ns in data.items() for t, k in enumerate(folded(ns, 100))}
    assert not empty


def test_chunks(spark):
    rows = [("a", 0, "human", "x" * 40, None), ("a", 1, "assistant", None, "t1"), ("a", 2, "user", "y" * 4000, "t2"), ("a", 3, "user", "z", "")]
    got = [tuple(r) for r in ordered.chunks(spark.createDataFrame(rows, "conv_id string, turn int, role string, content string, ts string"), 100, "Kim").orderBy("chunk").collect()]
    assert got == [("a", 0, "[Kim] " + "x" * 40 + "\n[AI] ", "t1", "t1", 2), ("a", 1, "[Kim] " + "y" * 4000, "t2", "t2", 1), ("a", 2, "[Kim] z", "", "", 1)]


def test_partial_ratio():
    assert retrieval.partial_ratio("", "abc") == 0
    assert retrieval.partial_ratio("abc", "xxabcxx") == 100
    assert retrieval.partial_ratio("xxabcxx", "abc") == 100

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(5)
    for _ in range(60):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(1, 12))) for _ in range(2))
        s, t = (a, b) if len(a) <= len(b) else (b, a)
        want = max(200 * lcs(s, t[max(0, i) : i + len(s)]) / (len(s) + len(t[max(0, i) : i + len(s)])) for i in range(1 - len(s), len(t)) if t[max(0, i) : i + len(s)])
        assert abs(retrieval.partial_ratio(a, b) - want) < 1e-9


def test_supersession_chain_equals_a_walk(spark):
    rng = random.Random(8)
    rows = [("a", "b", "k"), ("b", "c", " "), ("c", None, "k"), ("s", "s", None), ("x", "y", None), ("y", "x", None), ("t", "x", None), ("g", "gone", None), ("h", "g", None), ("p", "q", "1"), ("q", None, "2"), (None, "a", None), ("", "a", None)]
    rows += [(f"n{i}", f"n{i + 1}" if i < 130 else "", None) for i in range(131)]
    rows += [(f"c{i}", f"c{(i + 1) % 101}", None) for i in range(101)] + [(f"d{i}", f"d{(i + 1) % 100}", None) for i in range(100)]
    rows += [(f"r{i}", f"r{rng.randrange(260)}" if rng.random() < 0.9 else None, rng.choice(["u", "u", "u", "v", None])) for i in range(250)]
    data = {i: ((n or "").strip() or None, (k or "").strip() or None) for i, n, k in rows if i}
    want = {}
    for i, (n, _) in data.items():
        if not n:
            continue
        seen, at, code, mixed, hops = {i}, n, None, False, 1
        last = i
        while True:
            if at in seen:
                code, hops = ("self_link" if n == i else "cycle"), 100
                break
            seen.add(at)
            if at not in data:
                code = "missing_target"
                break
            mixed |= bool(data[last][1] and data[at][1] and data[last][1] != data[at][1])
            if not data[at][0]:
                code = "key_mismatch" if mixed else None
                break
            if hops == 100:
                code = "too_long"
                break
            last, at, hops = at, data[at][0], hops + 1
        want[i] = (None if code else at, hops, code)
    got = {r.id: (r.current_id, r.hops, r.code) for r in joins.supersession_chain(spark.createDataFrame(rows, "id string, superseded_by string, state_key string")).collect()}
    assert got == want
    assert {c for *_, c in want.values()} == {None, "self_link", "cycle", "too_long", "missing_target", "key_mismatch"}
    assert joins.supersession_chain(spark.createDataFrame([], "id string, superseded_by string, state_key string")).count() == 0


def test_set_supersessions_equals_one_by_one(spark):
    rng = random.Random(9)
    rows = {f"r{i}": ["dynamic" if rng.random() < 0.9 else "plan", f"r{rng.randrange(300)}" if rng.random() < 0.1 else None, "k" if rng.random() < 0.95 else "other"] for i in range(300)}
    asked = [(s, f"r{o}" if rng.random() < 0.97 else rng.choice(["no", " "]), f"r{rng.choice([(o + 1) % 310, rng.randrange(310)])}", None) for s, o in enumerate(rng.sample(range(300), 300))]
    got = {r.seq: r.status for r in joins.set_supersessions(spark.createDataFrame([(i, *v) for i, v in rows.items()], "id string, type string, superseded_by string, state_key string"), spark.createDataFrame(asked, "seq long, old_id string, new_id string, state_key string")).collect()}
    now = {i: list(v) for i, v in rows.items()}
    for s, o, n, _ in asked:
        if not o.strip():
            status = "blank_id"
        elif o == n:
            status = "self_link"
        elif o not in now:
            status = "missing_old"
        elif n not in now:
            status = "missing_new"
        elif now[o][0] == "plan" or now[n][0] == "plan":
            status = "not_ordinary"
        elif now[o][1]:
            status = "unchanged" if now[o][1] == n else "already_superseded"
        elif now[n][1]:
            status = "historical_target"
        elif now[o][2] != now[n][2]:
            status = "key_mismatch"
        else:
            status, now[o][1] = "superseded", n
        assert got[s] == status, (s, o, n)
    assert sum(v == "superseded" for v in got.values()) > 50


def test_set_supersessions_keys_and_repeats(spark):
    rows = spark.createDataFrame([(i, None, None, k) for i, k in [("a", "k"), ("b", None), ("c", None), ("d", "z"), ("e", None), ("g", "k")]] + [("f", "dynamic", "e", "k")], "id string, type string, superseded_by string, state_key string")
    asked = [(1, "a", "b", None), (2, "d", "b", None), (3, "a", "b", None), (4, "a", "c", "k"), (5, "c", "e", None), (6, "c", "e", "new"), (7, "f", "e", "k"), (8, "f", "e", "x"), (9, "f", "b", "k"), (10, "a", "b", "x"), (11, "e", "c", "new"), (12, "e", "b", "k"), (13, "b", "a", "k"), (14, "g", "a", None), (15, "g", "b", None)]
    got = {r.seq: (r.status, r.state_key) for r in joins.set_supersessions(rows, spark.createDataFrame(asked, "seq long, old_id string, new_id string, state_key string")).collect()}
    assert got == {1: ("superseded", "k"), 2: ("key_mismatch", None), 3: ("unchanged", "k"), 4: ("already_superseded", None), 5: ("no_key", None), 6: ("superseded", "new"), 7: ("unchanged", "k"), 8: ("key_mismatch", None), 9: ("already_superseded", None), 10: ("key_mismatch", None), 11: ("historical_target", None), 12: ("superseded", "k"), 13: ("historical_target", None), 14: ("historical_target", None), 15: ("deferred", None)}


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(similarity.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0, 0]


def test_similarity_edges_blocks(spark):
    rng = random.Random(6)
    rows = [(f"v{i}", i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, vec_id long, embedding array<double>")
    norm = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for _, i, v in rows}
    want = {(f"v{i}", f"v{j}") for i in range(60) for j in range(i + 1, 60) if sum(p * q for p, q in zip(norm[i], norm[j], strict=True)) > 0.7}
    for size in (7, 1000):
        got = [(r.a, r.b) for r in similarity.similarity_edges(df, 0.7, rows=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_versioned_table(spark):
    t = VersionedTable(spark, new_path(spark, "vt"))
    assert t.write(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")) == 1
    assert t.upsert(spark.createDataFrame([("b", 5), ("c", 6)], "id string, n int")) == 2
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 5), ("c", 6)]
    assert sorted(map(tuple, t.read(1).collect())) == [("a", 1), ("b", 2)]


def test_hash_chain(spark):
    rows, prev = [], ""
    for i in range(1, 8):
        own = hashlib.sha256(f"{i}|{prev}|p{i}".encode()).hexdigest()
        rows.append((i, prev, own, f"p{i}"))
        prev = own
    schema = "index long, previous_checksum string, checksum string, payload string"
    assert files.verify_chain(spark.createDataFrame(rows, schema)).count() == 0
    bad = [*rows[:3], (4, rows[3][1], rows[3][2], "other"), *rows[5:]]
    assert sorted(map(tuple, files.verify_chain(spark.createDataFrame(bad, schema)).collect())) == [(4, "bad_checksum"), (6, "gap")]


def test_notes_on_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.md").write_text('---\nid: x1\nname: "My note"\n---\nbody\nmore')
    (tmp_path / "b.md").write_text("plain")
    (tmp_path / "c.txt").write_text("no")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.parse_notes(files.read_notes(spark, str(tmp_path)), ["id", "name"]).collect()}
    assert set(got) == {"a.md", "b.md"} and got["a.md"].id == "x1" and got["a.md"].name == "My note" and got["a.md"].content == "body\nmore"
    assert got["b.md"].parse_error == "no_front_matter"


def test_inference(spark):
    assert inference.first_json('say {"a": [1, 2]} and {') == '{"a": [1, 2]}' and inference.first_json("none {x") is None
    df = spark.createDataFrame([("a", "1"), ("b", "bad"), ("c", None)], "id string, content string")

    def model(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    got = {r.id: r for r in inference.embed(df, model).collect()}
    assert got["a"].vector == [1.0] and got["b"].vector is None and got["b"].error == "no" and got["c"].vector == [0.0]



def test_first_json_equals_trying_every_bracket():
    decoder = json.JSONDecoder()

    def plain(text):
        for i, c in enumerate(text):
            if c in "{[":
                try:
                    return json.dumps(decoder.raw_decode(text, i)[0], ensure_ascii=False)
                except ValueError:
                    continue
        return None

    rng = random.Random(14)
    parts = ["[", "]", "{", "}", '"', '"a"', ":", ",", " ", "1", "-0.5e3", "01", "true", "nul", "NaN", "-Infinity", "\\", '\\"', "\\u12aF", "\n", "x", '"k": ', "[1, 2]", '{"a": [', "é"]
    found = 0
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert inference.first_json(text) == plain(text), text
        found += inference.first_json(text) is not None
    assert found > 2000
    assert inference.first_json(None) is None


@pytest.mark.parametrize("part", ["[", '{"a":', '["', '{"[":', "[1,", '"[', '[{"', '["\\"', "[[]"])
def test_first_json_reads_long_texts_once(part):
    start = time.process_time()
    text = part * (1_000_000 // len(part))
    inference.first_json(text)
    assert inference.first_json("[[[" + "[1]," * 250_000 + "{") == "[1]"
    assert time.process_time() - start < 30
    deep = "[" * 200_000 + "]" * 200_000
    assert inference.first_json(f"so {deep}!") == deep


def test_leader_clusters(spark):
    rng = random.Random(8)
    for _ in range(3):
        n = 40
        edges = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.08]
        near = {i: set() for i in range(n)}
        for i, j in edges:
            near[i].add(j)
            near[j].add(i)
        leader = {}
        for i in range(n):
            heads = [h for h in sorted(set(leader.values())) if leader.get(h) == h and h in near[i]]
            leader[i] = heads[0] if heads else i
        want = {(f"r{h}", f"r{i}") for i, h in leader.items() if sum(x == h for x in leader.values()) >= 3}
        rows = spark.createDataFrame([(f"r{i}", i) for i in range(n)], "id string, pos long")
        df = spark.createDataFrame([(f"r{i}", f"r{j}") for i, j in edges], "a string, b string")
        assert {(r.leader, r.id) for r in similarity.leader_clusters(rows, df).collect()} == want


def test_catch_up_stops_at_a_gap(spark):
    snap = spark.createDataFrame([(i, "s") for i in range(1, 6)], "index long, payload string")
    log = spark.createDataFrame([(i, "l") for i in (4, 5, 6, 7, 9)], "index long, payload string")
    assert sorted(r["index"] for r in files.catch_up(snap, log, 2).collect()) == [3, 4, 5, 6, 7]
    assert files.catch_up(snap.filter("index > 3"), log, 0).count() == 0


def test_semantic_merge_refuses_long_rows(spark):
    from notegrid.operators.lifecycle import semantic_merge

    new = spark.createDataFrame([(1, "t", "x" * 50, ["b"], 0.5, 3), (2, "t", "y" * 5000, ["c"], 0.5, 9)], "seq long, target string, content string, tags array<string>, valence double, importance int")
    old = spark.createDataFrame([("t", "old", ["a"], 0.1, 4)], "id string, content string, tags array<string>, valence double, importance int")
    r = semantic_merge(new, old).first()
    assert r.content == "old\n---\n" + "x" * 50 and r.tags == ["a", "b"] and r.importance == 4 and r.created == [2]


def test_policy_is_never_bypassed(spark, sf):
    from notegrid.functions import policy
    from notegrid.operators.ranking import gated_score
    from notegrid.schema import memories

    m = memories(spark, sf)
    scored = gated_score(m, [(F.lit(1.0), 1.0)], [F.lit(5.0)], "dream").join(m.filter(~policy.allowed("dream")).select("id"), "id", "left_semi")
    assert scored.count() > 0 and scored.filter("surface <> 0").count() == 0


def test_time_ripple_equals_brute_force(spark):
    import datetime as dt

    rng = random.Random(12)
    start = dt.datetime(2024, 1, 5, 7, 0, 0)
    at = [start + dt.timedelta(seconds=rng.choice([0, 60, 3600, 172800, 172801, rng.randint(0, 400000)])) for _ in range(150)]
    rows = [(f"m{i:03d}", at[i], i % 17 == 0, "dynamic" if i % 5 else "plan") for i in range(150)]
    df = spark.createDataFrame(rows, "id string, created timestamp_ntz, pinned boolean, type string")
    touched = [r for i, r in enumerate(rows) if i % 3 == 0]
    want: dict = {}
    for t in touched:
        near = sorted(r[0] for r in rows if r[0] != t[0] and not r[2] and r[3] == "dynamic" and abs((r[1] - t[1]).total_seconds()) <= 48 * 3600)[:5]
        for i in near:
            want[i] = want.get(i, 0) + 0.3
    got = {r.id: r.credit for r in joins.time_ripple(df.filter("int(substring(id, 2, 3)) % 3 = 0"), df).collect()}
    assert got == {k: round(v, 1) for k, v in want.items()}


def shipped(spark, work):
    """What work() returns, and the most rows that one stage of it ships."""
    sc = spark.sparkContext
    sc.setJobGroup("shipped", "")
    try:
        out = work()
    finally:
        sc._jsc.clearJobGroup()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
    stages = {i for j in tracker.getJobIdsForGroup("shipped") for i in tracker.getJobInfo(j).stageIds}
    known = [i for i in stages if tracker.getStageInfo(i)]  # Spark forgets skipped stages first
    return out, max(store.lastStageAttempt(i).shuffleWriteRecords() for i in known)


def test_time_ripple_ships_no_row_for_a_minute_of_a_span(spark):
    import datetime as dt

    start = dt.datetime(2024, 1, 5, 20, 30, 0)
    at = [start + dt.timedelta(minutes=(i % 600) + 2880 * (i % 7 > 3), seconds=i % 3 * 20) for i in range(2400)]
    rows = [(f"m{i:04d}", at[i], i % 50 == 0, "dynamic" if i % 9 else "plan") for i in range(2400)]
    df = spark.createDataFrame(rows, "id string, created timestamp_ntz, pinned boolean, type string")
    got, most = shipped(spark, lambda: {r.id: r.credit for r in joins.time_ripple(df, df).collect()})
    able = [(r[0], r[1]) for r in rows if not r[2] and r[3] == "dynamic"]
    want: dict = {}
    for i, t, *_ in rows:
        near = (a for a, u in able if a != i and abs(u - t) <= dt.timedelta(hours=48))
        for a in itertools.islice(near, 5):
            want[a] = want.get(a, 0) + 0.3
    assert got == {k: round(v, 1) for k, v in want.items()}
    assert most <= 2 * len(rows)


def test_time_ripple_with_repeated_and_missing_values(spark):
    import datetime as dt

    start = dt.datetime(2024, 1, 5, 20, 30, 0)
    rows = [("a", start + dt.timedelta(minutes=i), False, "dynamic") for i in range(8)]
    rows += [(f"b{i}", start + dt.timedelta(minutes=i), False, "dynamic") for i in range(6)]
    rows += [(None, start, False, "dynamic"), ("a0", None, False, "dynamic"), ("a1", start, None, "dynamic"), ("a2", start, False, None)]
    df = spark.createDataFrame(rows, "id string, created timestamp_ntz, pinned boolean, type string")
    for at in (0, 36, 47 * 60, 48 * 60 - 10):
        touched = spark.createDataFrame([("b1", start + dt.timedelta(minutes=at)), ("z", None), (None, start)], "id string, created timestamp_ntz")
        assert {r.id: r.credit for r in joins.time_ripple(touched, df).collect()} == {k: 0.3 for k in ("a", "b0", "b2", "b3", "b4")}


def test_state_keys_equal_brute_force(spark):
    import datetime as dt

    rng = random.Random(13)
    rows = [(f"m{i}", rng.choice("abc") if i % 2 else "hot", dt.datetime(2024, 1, 1 + rng.randint(0, 3)), rng.random() < 0.6) for i in range(80)]
    got = {r.id: (r.candidates, r.newest) for r in joins.state_key_candidates(spark.createDataFrame(rows, "id string, key string, created timestamp_ntz, current boolean")).collect()}
    want = {}
    for i, k, _, _ in rows:
        others = sorted(((r[2], r[0]) for r in rows if r[1] == k and r[3] and r[0] != i), key=lambda x: (-x[0].timestamp(), x[1]))
        if others:
            want[i] = len(others), others[0][1]
    assert got == want


def test_archive_finds_tampering(spark, tmp_path):
    import glob
    import os

    path = f"{tmp_path}/archive"
    files.write_archive(path, {"a": spark.range(50), "b": spark.range(7).repartition(2)})
    assert files.verify_archive(spark, path).count() == 0
    assert files.read_archive(spark, path, "a").count() == 50
    victim = sorted(glob.glob(f"{path}/data/a/*.parquet"))[0]
    with open(victim, "ab") as f:
        f.write(b"x")
    os.remove(os.path.join(os.path.dirname(victim), f".{os.path.basename(victim)}.crc"))  # the local file system's own checksum
    gone = sorted(glob.glob(f"{path}/data/b/*.parquet"))[0]
    os.remove(gone)
    spark.range(3).write.parquet(f"{path}/data/c")
    got = {r.code for r in files.verify_archive(spark, path).collect()}
    assert got == {"size", "missing", "extra"}


def test_snapshot_checksum(spark):
    rows = spark.range(1, 2501).select(F.col("id").alias("index"), F.lit("x").alias("event_type"), F.col("id").cast("string").alias("payload"))
    header = files.snapshot_header(rows)
    level = {i: hashlib.sha256(f"{i}|x|{i}".encode()).hexdigest() for i in range(1, 2501)}
    for _ in range(2):
        up: dict = {}
        for i in sorted(level):
            up[i // 1000] = up.get(i // 1000, "") + level[i]
        level = {k: hashlib.sha256(v.encode()).hexdigest() for k, v in up.items()}
    assert header.first()["checksum"] == hashlib.sha256("".join(level[k] for k in sorted(level)).encode()).hexdigest()
    assert files.snapshot_problems(rows, header).first()["problems"] == ""
    assert files.snapshot_problems(rows.filter("index <> 7"), header).first()["problems"] == "gap,bad_n,bad_checksum"
    other = rows.withColumn("payload", F.when(F.col("index") == 9, "z").otherwise(F.col("payload")))
    assert files.snapshot_problems(other, header).first()["problems"] == "bad_checksum"


def test_two_upserts_at_once_both_survive(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from notegrid.storage import Conflict

    store = VersionedTable(spark, f"{tmp_path}/table")
    assert store.latest() == 0 and store.write(spark.range(20).withColumn("v", F.lit("old"))) == 1
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda k: VersionedTable(spark, store.path).upsert(spark.range(k * 3, k * 3 + 3).withColumn("v", F.lit(f"w{k}"))), range(4)))
    assert sorted(done) == [2, 3, 4, 5]
    assert {r.id: r.v for r in store.read().collect()} == {i: f"w{i // 3}" if i < 12 else "old" for i in range(20)}
    with pytest.raises(Conflict):
        store.write(spark.range(1).withColumn("v", F.lit("stale")), base=3)
    assert store.latest() == 5 and store.read(1).filter("v = 'old'").count() == 20
    (tmp_path / "table/commits/6").touch()  # its writer died
    assert store.latest() == 5
    with pytest.raises(Conflict):
        store.upsert(spark.range(1).withColumn("v", F.lit("x")), tries=2)


def test_saved_notes(spark, tmp_path):
    import datetime

    from notegrid.operators.lifecycle import save_notes

    day = datetime.date(2024, 1, 2)
    store = VersionedTable(spark, f"{tmp_path}/notes")
    store.write(spark.createDataFrame([], "key string, day date, revision long, content string, h string"))
    schema = "key string, day date, content string, expected_revision long"
    save = lambda *rows: {(r.key, r.expected, r.revision, r.fate) for r in save_notes(store, spark.createDataFrame(rows, schema)).collect()}
    text = "# 2024-01-02\n"
    assert save(("a", day, text + "one", None), ("b", day, "no date", None), ("c", day, " ", None), ("d", day, text, 3), ("e", day, "2024-01-03 x", 0)) == {("a", None, 1, "created"), ("b", None, 0, "bad_title"), ("c", None, 0, "empty"), ("d", 3, 0, "conflict"), ("e", 0, 0, "bad_title")}
    assert save(("a", day, text + "one", 1), ("d", day, text, 0)) == {("a", 1, 1, "unchanged"), ("d", 0, 1, "created")}
    assert save(("a", day, text + "two", 1), ("a", day, text + "three", None), ("a", day, text + "four", 0)) == {("a", 1, 2, "updated"), ("a", None, 1, "superseded"), ("a", 0, 1, "conflict")}
    assert {(r.key, r.revision, r.content) for r in store.read().collect()} == {("a", 2, text + "two"), ("d", 1, text)}



def test_diverse_pick(spark):
    rng = random.Random(15)
    rows = []
    for s in range(6):
        for r in range(12):
            words = list(dict.fromkeys(rng.choice("abcdef") for _ in range(rng.randint(0, 4))))
            vector = [rng.choice([0.0, 1.0]) for _ in range(3)] if r % 3 else None
            rows.append((s, r, f"x{s}-{r}", words, vector, rng.choice([0.1, 0.6])))
    got = ordered.diverse_pick(spark.createDataFrame(rows, "s long, rank long, id string, words array<string>, embedding array<double>, valence double"), "s").collect()

    def alike(a, b):
        if a[4] is not None and b[4] is not None:
            na, nb = sum(x * x for x in a[4]) ** 0.5, sum(x * x for x in b[4]) ** 0.5
            if na and nb and sum(x * y for x, y in zip(a[4], b[4])) / na / nb >= 0.8 - 1e-12:
                return True
        shared = len(set(a[3]) & set(b[3]))
        return shared >= 2 and shared >= 0.6 * min(len(a[3]), len(b[3]))

    for s in range(6):
        kept: list = []
        for r in (x for x in rows if x[0] == s):
            if len(kept) < 3 and not any(alike(k, r) for k in kept) and sum(k[5] < 0.4 for k in kept) + (r[5] < 0.4) <= 2:
                kept.append(r)
        assert [x.id for x in sorted((x for x in got if x.s == s), key=lambda x: x.pos)] == [k[2] for k in kept]


def test_search_equals_a_sequential_version(spark, sf):
    from notegrid.schema import as_of, memories

    m = memories(spark, sf).filter("doc_id < 60")
    queries = spark.createDataFrame([(1, "the of", ["src1"], 0.2, 0.9), (2, "que de la", ["nowhere"], None, None), (3, "src2 en", None, 0.5, 0.5)], "query_id long, query string, domains array<string>, q_valence double, q_arousal double")
    near = m.filter("doc_id % 7 = 1").select(F.lit(3).cast("long").alias("query_id"), "id", ((F.col("doc_id") % 10) / 10.0).alias("semantic"))
    got = {(r.query_id, r.id): (r.score, r.rank) for r in retrieval.search(m, queries, near, as_of(), k=100).collect()}
    small = retrieval.search(m, queries, near, as_of(), k=100, rows=7, query_rows=2)
    assert {(r.query_id, r.id): (r.score, r.rank) for r in small.collect()} == got
    assert retrieval.search(m, queries.limit(0), near, as_of()).count() == retrieval.search(m.limit(0), queries, near, as_of()).count() == 0
    lexical = {(r.query_id, r.id): r.bm25 for r in retrieval.bm25(m, queries).collect()}
    from notegrid.functions import scores

    want: dict = {}
    rows = m.withColumns({"t": scores.time_score(as_of()), "i": scores.importance_score(), "u": scores.touch_score()}).collect()
    close = {(r.query_id, r.id): r.semantic for r in near.collect()}
    for q in queries.collect():
        asked = {d.lower() for d in q.domains or []}
        pool = [r for r in rows if asked & {d.lower() for d in r.domain}] or rows
        for r in pool:
            ratio = lambda xs: max((retrieval.partial_ratio(q.query, x or "") for x in xs), default=0.0)
            topic = (3 * ratio([r["name"]]) + 2.5 * ratio(r.domain) + 2 * ratio(r.tags) + ratio([(r.content or "")[:1000]])) / 850
            emotion = 0.5 if q.q_valence is None else max(0.0, 1 - ((q.q_valence - r.valence) ** 2 + (q.q_arousal - r.arousal) ** 2) ** 0.5 / 2**0.5)
            total, weights = topic * 4 + emotion * 2 + r.t * 1.5 + r.i + r.u, 9.5
            semantic = close.get((q.query_id, r.id))
            if semantic is not None:
                total, weights = total + 2.5 * semantic, weights + 2.5
            if any(k[0] == q.query_id for k in lexical):
                total, weights = total + 1.5 * lexical.get((q.query_id, r.id), 0.0), weights + 1.5
            text = " ".join([r["name"] or "", *r.tags, *r.domain, r.content or ""]).lower()
            literal = q.query.lower() in text
            raw = min(100.0, total / weights * 100 + (25 if literal else 0))
            if raw >= 50 or literal or (semantic or 0) >= 0.55:
                want[q.query_id, r.id] = raw * (0.3 if r.resolved else 1) * (0.12 if r.superseded_by else 1)
    assert set(got) == set(want) and len(want) > 10
    assert all(abs(got[k][0] - v) < 0.011 for k, v in want.items())
