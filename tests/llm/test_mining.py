"""Collocations, mixing and hard negatives against brute force, and their edges."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_collocations(rows, least, top):
    count, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    count[lang or "und"][tuple(w[i : i + k])] += 1
    out = set()
    for lang, f in count.items():
        found = []
        long = [p for p, a in f.items() if len(p) > 1 and a >= least]
        within = {q for p in long for i in range(len(p)) for j in range(i + 2, len(p) + 1) if (q := p[i:j]) != p and f[p] >= f[q]}
        for p in long:
            if p not in within:
                score, k = min((1000 * f[p] * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.add((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return out


def phrase_rows(seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "γάμμα", "de lta", "\U0001f600", "x", "Y\x00z", "é"] + [f"w{i}" for i in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice([" ", "  ", "\t"]).join(rng.choices(words, [9, 5, 3, 2, 2, 1, 1, 1] + [1] * 12, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice([". ", ",", "\n", ": "]).join(parts), rng.choice(["en", "en", None, "x y\nz"])))
    fixed = "the common passage that stands everywhere with one more word"
    rows += [(f"{fixed} w{i % 3}", "en") for i in range(40)] + [(None, None), ("", "en"), ("...", "de"), ("alpha x " * 3000, "en")]
    return rows


@pytest.mark.parametrize("bucket", [40, 1 << 20])
def test_collocations(spark, monkeypatch, bucket):
    from notegrid.llm import collocations as c

    monkeypatch.setattr(c, "BUCKET_WORDS", bucket)  # many buckets, and many prefixes dealt by more words
    monkeypatch.setattr(c, "BATCH_BYTES", 2000)
    monkeypatch.setattr(c, "LISTED", 5)
    rows = phrase_rows(bucket)
    df = spark.createDataFrame([(t, lang, 1.5, "x") for t, lang in rows], "text string, lang string, score double, phrase string").repartition(3)
    for least, top in ((4, 2000), (9, 7)):
        got = {tuple(r) for r in c.mine(df, least, top).collect()}
        assert got == brute_collocations(rows, least, top)


def test_collocation_edges(spark):
    from notegrid.llm import collocations as c

    df = spark.createDataFrame([("a b", "en"), (None, "en")], "text string, lang string")
    assert c.mine(df.limit(0)).count() == 0 and c.mine(df).count() == 0
    assert [tuple(r) for r in c.mine(df, 1).collect()] == [("en", 1, "a b", 1, 1, 1, 2, 2000)]
    long = ("up and down " * 40_000).strip()  # 480 kB
    got = c.mine(spark.createDataFrame([(long, "en")], "text string, lang string"), 100)
    assert {tuple(r) for r in got.collect()} == brute_collocations([(long, "en")], 100, 2000)


def test_quicksort_counts():
    from notegrid.llm.collocations import quicksort_counts

    rng = np.random.default_rng(3)
    for least in (1, 3, 20):
        matrix = rng.zipf(1.7, (400, 5)).clip(1, 9).astype(np.int32)
        for row in matrix[::7]:
            row[rng.integers(1, 5) :] = 0
        counts, root = rng.integers(1, 4, 400), rng.integers(0, 3, 400)
        want = Counter()
        for row, n, r in zip(matrix, counts, root, strict=True):
            for k in range(2, 6):
                if row[k - 1]:
                    want[r, *row[:k]] += n
        got = {(root[i], *matrix[i, :k]): n for rows, k, ns in quicksort_counts(matrix, counts, root, least) for i, n in zip(rows, ns, strict=True)}
        assert got == {p: n for p, n in want.items() if n >= least}


def test_score_beyond_64_bits(spark):
    from notegrid.llm.collocations import scores

    rng = random.Random(1)
    rows = [(f"p{i}", 1, *(rng.randint(100, 10**12) for _ in range(3)), rng.randint(10**14, 10**15)) for i in range(200)] + [("q", 1, 10**6, 10**6, 10**6, 10**15)]
    got = {r.phrase: r.score for r in scores(spark.createDataFrame(rows, "phrase string, k int, a long, l long, r long, n long")).collect()}
    assert got == {p: 1000 * a * n // (left * right) for p, _, a, left, right, n in rows}


def brute_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * each > 2 * sizes[s]]
        for s in over or open_:
            out[s] = 2 * sizes[s] if over else weight[s] * each
            left -= out[s]
        open_ -= set(over or open_)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    from notegrid.llm.mixing import mix

    rng = random.Random(seed)
    names = ["b", "a", "é", "\U0001f600", "￮", "", None][: 7 - seed]
    rows = [(rng.choice([None, i, i % 50]), " ".join(["w"] * rng.choice([0, 1, 5, 40, rng.randint(0, 300)])) if i % 9 else None, names[int(rng.random() ** 2 * len(names))], 1, "x") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, row string")
    sizes, most = Counter(), Counter()
    for _, t, s, *_ in rows:
        n = len((t or "").split())
        sizes[s] += n
        most[s] = max(most[s], n)
    want, got = brute_targets(sizes), mix(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(df.repartition(5)).collect()), key=str)
    assert all(r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"] for r in got)
    by = defaultdict(int)
    for r in got:
        by[r.source_size, r.target] += r.taken
    assert {k[0]: k[1] for k in by} == {sizes[s]: pytest.approx(t) for s, t in want.items()}
    for s, t in want.items():
        assert abs(sum(n for k, n in by.items() if k[0] == sizes[s]) - t) <= most[s] + 1, s


def test_mix_edges(spark):
    from notegrid.llm.mixing import mix

    df = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, " \t\n", None)], "doc_id long, text string, source string")
    assert mix(df.limit(0)).count() == 0
    assert sorted(map(tuple, mix(df).select("size", "source_size", "target", "taken").collect())) == [(0, 0, 0.0, 0)] * 3
    same = spark.createDataFrame([(7, "one two three", "hot")] * 400 + [(8, "x " * 400_000, "cold")], "doc_id long, text string, source string")
    got = mix(same).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("copies").alias("copies")).collect()
    by = {r.doc_id: r for r in got}  # cold comes first and weighs three times as much
    assert by[7].target == 2 * 1200 and by[7].taken == 2400
    assert by[8].target == 1.5 * 401_200 - 2400 and by[8].copies in (1, 2)


def brute_negatives(rows, scale=256, percent=80):
    from math import floor, isfinite

    good = [(i, lab, [floor(scale * x) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and len(v) == 3 and all(x is not None and isfinite(x) for x in v)]
    out = set()
    for i, lab, v in good:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in good if j != i)
            for s, j, _ in [x for x in scored if x[2] == lab][:5]:
                band = [x for x in scored if x[2] != lab and percent * -s <= 100 * -x[0] <= 100 * -s][:5]
                out |= {(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(band)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_negatives(spark, seed):
    from notegrid.llm.negatives import mine

    rng = random.Random(seed)
    point = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(6)]
    rows = []
    for i in range(900):
        v = [x + rng.gauss(0, 0.2) for x in rng.choice(point)]
        size = 10 ** rng.uniform(-2, 2) if seed else 1
        rows.append((i * 5, rng.choice([1, 1, 1, 2, 3, i % 40]), rng.choice([v, point[0]]) if i % 5 == 0 else [x * size for x in v]))
    rows += [(5000, 1, None), (5100, None, [1.0, 2.0, 3.0]), (5200, 1, [1.0, None, 2.0]), (5300, 1, [float("nan"), 1.0, 1.0]), (5400, 1, [float("inf"), 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0]), (5500, 1, [1.0]), (5600, 1, []), (5700, 99, [0.5, 0.5, 0.5]), (5800, 1, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, v string, bucket int")
    got = [tuple(r) for r in mine(df, F.col("vid") % 100 == 0, bucket_rows=60).collect()]
    assert set(got) == brute_negatives(rows) and len(got) == len(set(got))
    assert mine(df.limit(0), F.col("vid") % 100 == 0).count() == 0


def test_negatives_large_and_repeated(spark):
    from notegrid.llm.negatives import mine

    rng = random.Random(5)
    rows = [(i * 50, i % 2, [float(rng.randint(-(2**20), 2**20)) + 0.5 for _ in range(3)]) for i in range(40)]  # products beyond 2^53
    df = spark.createDataFrame(rows + rows[:7], "vec_id long, label long, embedding array<double>")
    assert {tuple(r) for r in mine(df, F.col("vid") % 100 == 0).collect()} == brute_negatives(rows)
    same = [(i * 20, i % 3, [0.5, 0.25, 0.0]) for i in range(60)]
    df = spark.createDataFrame(same, "vec_id long, label long, embedding array<float>")
    assert {tuple(r) for r in mine(df, F.col("vid") % 100 == 0, bucket_rows=9).collect()} == brute_negatives(same)


@pytest.mark.parametrize("size", [1, 3e4, 1e6])  # with products times 100 beyond 2^53 and 2^63
def test_negatives_in_many_partitions(spark, size):
    from notegrid.llm.negatives import mine

    rng = random.Random(8)
    rows = [(i * 5, rng.choice([1, 2]), [rng.gauss(0.3, 1) * size for _ in range(3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    old = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("7", "false"), strict=True):  # as large tables fill them
        spark.conf.set(n, v)
    try:
        got = [tuple(r) for r in mine(df, F.col("vid") % 100 == 0, bucket_rows=60).collect()]
    finally:
        for n, v in zip(names, old, strict=True):
            spark.conf.set(n, v)
    assert got and set(got) == brute_negatives(rows) and len(got) == len(set(got))


def test_candidates_lose_nothing():
    from notegrid.llm.negatives import Bucket

    rng = np.random.default_rng(2)
    for dims in (1, 2, 5, 20):
        rows = np.floor(rng.standard_normal((500, dims)) * 100 * rng.exponential(1, (500, 1)))
        rows[::50] = 0
        anchors = np.floor(rng.standard_normal((60, dims)) * 100)
        anchors[0] = 0
        scores = anchors @ rows.T
        bounds = np.array([np.sort(s)[-1 - rng.integers(0, 60)] for s in scores])
        pruned = 0
        for i, found in enumerate(Bucket(rows).candidates(anchors, bounds)):
            if found is not None:
                pruned += 1
                assert set(np.flatnonzero(scores[i] >= bounds[i])) <= set(found)
        assert pruned or dims > 2


@pytest.mark.parametrize("name", ["op11_collocations", "op12_mix", "op13_hard_negatives"])
def test_queries_equal_sql(spark, duck, sf, name):
    from notegrid.llm.queries import oracle_sql, queries

    got, want = queries()[name](spark, sf).toPandas(), duck.sql(oracle_sql()[name]).df()
    key = list(want.columns)
    assert set(got.columns) == set(key) and len(got) == len(want)
    got, want = (x[key].sort_values(key).reset_index(drop=True) for x in (got, want))
    for c in key:
        assert np.allclose(got[c], want[c]) if got[c].dtype.kind == "f" else (got[c] == want[c]).all(), c
