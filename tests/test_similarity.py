"""Similarity in pruned blocks against brute force."""

import math
import random

import numpy as np
import pytest

from notegrid.operators import similarity as S

SCHEMA = "id string, vec_id long, embedding array<double>"


def clustered(n, clusters, dims, spread, seed):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(clusters, dims))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    part = np.minimum(g.integers(0, clusters * 3 // 2, n), clusters - 1)  # the last cluster holds a third
    return centres[part] + spread * g.normal(size=(n, dims)) / math.sqrt(dims)


def table(spark, vectors):
    return spark.createDataFrame([(f"v{i:05d}", i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)], SCHEMA)


def odd_vectors(seed):
    """Clusters, copies, opposite vectors, zeros, nulls, non-finite components, other sizes."""
    rng = random.Random(seed)
    rows = list(clustered(120, 6, 5, 0.3, seed)) + [np.ones(5)] * 30 + [-np.ones(5), np.zeros(5), np.zeros(5), None, None]
    rows += [[1.0, None, 0, 0, 0], [float("nan"), 1, 1, 1, 1], [float("inf"), 1, 1, 1, 1], [1.0, 2.0], [2.0, 4.1], [-1.0, 0.5], []]
    rng.shuffle(rows)
    return rows


def cosines(rows):
    """Cosine of every pair, None where there is none."""
    unit = []
    for v in rows:
        a = None if v is None or any(x is None for x in v) else np.asarray(v, float)
        unit.append(None if a is None or not len(a) or not np.isfinite(a).all() else a / np.linalg.norm(a) if a.any() else a)
    return {(i, j): float(a @ b) for i, a in enumerate(unit) for j, b in enumerate(unit) if a is not None and b is not None and len(a) == len(b)}


@pytest.mark.parametrize("threshold", [0.8, 0.0, -0.2])
def test_pairs_equal_brute_force(spark, threshold):
    rows = odd_vectors(3)
    df, cos = table(spark, rows), cosines(rows)
    name = lambda i: f"v{i:05d}"
    near = {p: w for p, w in cos.items() if p[0] != p[1] and w > threshold and abs(w - threshold) > 1e-9}
    blur = {(name(i), name(j)) for (i, j), w in cos.items() if abs(w - threshold) <= 1e-9}  # rounding decides these
    for size in (9, 1000):
        got = [(r.a, r.b) for r in S.similarity_edges(df, threshold, rows=size).collect()]
        want = {(name(i), name(j)) for i, j in near if i < j}
        assert len(got) == len(set(got)) and set(got) - blur == want - blur
    if threshold == 0.8:
        counts = {r.id: r.similar for r in S.similar_counts(df, threshold, rows=9).collect()}
        assert counts == {name(i): sum(p[0] == i for p in near) for i in {p[0] for p in near}}
        best = {r.id: (r.other, r.weight) for r in S.nearest_other(df, threshold, rows=9).collect()}
        want = {}
        for (i, j), w in near.items():
            want[name(i)] = max(want.get(name(i), (-2, "")), (round(w, 3), name(j)))
        assert {k: v[1] for k, v in best.items()} == {k: v[0] for k, v in want.items()}
        assert best == {k: (v[1], v[0]) for k, v in want.items()}


def test_scores_of_stated_queries(spark):
    rows = odd_vectors(5)
    df, cos = table(spark, rows), cosines(rows)
    asked = df.filter("vec_id % 4 = 0").selectExpr("vec_id AS query_id", "vec_id", "embedding")
    for least in (0.7, -1.0):
        want = {(i, f"v{j:05d}") for (i, j), w in cos.items() if i % 4 == 0 and w >= least + (1e-9 if least > 0 else -1e-9)}
        got = [(r.query_id, r.id) for r in S.vector_scores(asked, df, least, rows=11, query_rows=5).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    few = {}
    for r in S.vector_scores(asked, df, 0.7, rows=11, query_rows=5, k=2).collect():
        few.setdefault(r.query_id, []).append((-round(r.semantic, 6), r.id))
    for q, found in few.items():
        best = sorted((-round(w, 6), f"v{j:05d}") for (i, j), w in cos.items() if i == q and w >= 0.7)[:2]
        assert sorted(found)[:2] == best


def test_bounds_discard_blocks_of_clusters_and_lose_no_pair(spark):
    rows = clustered(3000, 25, 32, 0.35, 1)
    df = table(spark, rows)
    left, all_ = S.block_share(df, 0.8, rows=64)
    assert left < all_ / 4
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    assert S.similarity_edges(df, 0.8, rows=64).count() == int((np.triu(unit @ unit.T, 1) > 0.8).sum())
    loose = table(spark, np.random.default_rng(2).normal(size=(500, 32)))  # no structure: nothing to discard
    left, all_ = S.block_share(loose, 0.3, rows=64)
    assert left <= all_


def test_a_direction_with_most_rows_fills_many_blocks(spark):
    df = table(spark, [[1.0, 0.001 * (i % 7)] for i in range(400)])
    blocks = S.arrange(df, S.directions(df, 16), 32)
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert max(sizes) <= 32 and sum(sizes) == 400
    assert {r.similar for r in S.similar_counts(df, 0.9, rows=32).collect()} == {399}


def test_empty(spark):
    none = table(spark, [[1.0, 2.0]]).limit(0)
    assert S.similarity_edges(none, 0.5).count() == S.nearest_other(none, 0.5).count() == S.similar_counts(none, 0.5).count() == 0
    assert S.vector_scores(none.selectExpr("vec_id AS query_id", "vec_id", "embedding"), none, 0.5).count() == 0


def test_topk_of_two_vectors_among_allowed_rows(spark):
    g = np.random.default_rng(9)
    rows = [(f"v{i:03d}", i, None if i % 11 == 0 else g.normal(size=4).tolist(), None if i % 3 else g.normal(size=4).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id string, vec_id long, embedding array<double>, meaning array<double>")
    allowed = df.filter("vec_id % 5 <> 0").select("id")
    queries = df.filter("vec_id % 9 = 1 AND embedding IS NOT NULL")
    cos = lambda a, b: -2.0 if a is None or b is None else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = set()
    for q, qv, e, _ in rows:
        if qv % 9 == 1 and e is not None:
            ranked = sorted((-max(cos(e, x), cos(e, y)), v, i) for i, v, x, y in rows if v % 5 and v != qv and (x or y))
            want |= {(q, i, k + 1) for k, (_, _, i) in enumerate(ranked[:6])}
    got = {tuple(r) for r in S.vector_topk(queries, df, 6, rows=17, query_rows=3, allowed=allowed).collect()}
    assert got == want


def test_ranges_ship_blocks_once(spark, monkeypatch):
    rows = np.random.default_rng(12).normal(size=(600, 16))  # no structure, so all blocks meet
    df = table(spark, rows)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = {(f"v{i:05d}", f"v{j:05d}") for i, j in zip(*np.nonzero(np.triu(unit @ unit.T, 1) > 0.5), strict=True)}
    blocks, shipped = [], []
    plain = S._met

    def met(left, right, pairs, task, schema):
        blocks.append(pairs.count())
        out = plain(left, right, pairs, task, schema)
        shipped.append(pairs.selectExpr("block", "shiftright(other, 32) AS h").distinct().count())
        return out

    monkeypatch.setattr(S, "_met", met)
    monkeypatch.setattr(S, "RANGES", 4)
    got = {(r.a, r.b) for r in S.similarity_edges(df, 0.5, rows=16).collect()}
    assert got == want and len(want) > 50
    assert shipped[0] < blocks[0] / 3, (shipped, blocks)


def test_rounds_of_leaders_grow_smaller(spark, monkeypatch):
    sizes, plain = [], S.materialize

    def written(df, name):
        out = plain(df, name)
        if name in ("earlier", "waiting"):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(S, "materialize", written)
    rows = spark.createDataFrame([(f"v{i:03d}", i) for i in range(12)], "id string, pos long")
    edges = spark.createDataFrame([(f"v{i:03d}", f"v{i + 1:03d}") for i in range(11)], "a string, b string")  # the longest chain there is
    got = {(r.leader, r.id) for r in S.leader_clusters(rows, edges, 1).collect()}
    assert got == {(f"v{i - i % 2:03d}", f"v{i:03d}") for i in range(12)}
    assert len(sizes) > 5 and all(b < a or not a for a, b in zip(sizes, sizes[1:])) and sizes[-1] == 0
