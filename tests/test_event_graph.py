"""The graph of events against recursive walks."""

import random

from notegrid.operators import joins as J

SCHEMA = "id string, seq long, actor string, parents array<string>, sources array<string>"


def chain(events, start):
    seen, out = set(), []

    def visit(x):
        if x in seen:
            return
        seen.add(x)
        for p in events[x][0] or []:
            if p in events:
                visit(p)
        out.extend(s for s in events[x][1] or [] if s is not None and s not in out)

    visit(start)
    return out


def graph(rng, n):
    events = {}
    for i in range(n):
        pool = [f"e{j}" for j in range(max(0, i - 9), i)] + ["gone", None, f"e{i}"]
        parents = None if rng.random() < 0.1 else [rng.choice(pool) for _ in range(rng.randint(0, 4))]
        sources = None if rng.random() < 0.1 else [rng.choice(["a", "b", "c", "d", "e", "f", None]) for _ in range(rng.randint(0, 2))]
        events[f"e{i}"] = (parents, sources)
    return events


def table(spark, events):
    return spark.createDataFrame([(k, i, None if i % 9 == 8 else f"u{i % 3}", p, s) for i, (k, (p, s)) in enumerate(events.items())], SCHEMA)


def test_source_chains_equal_a_recursive_walk(spark):
    for seed in (1, 2):
        events = graph(random.Random(seed), 30)
        got = {}
        for r in sorted(J.source_chains(table(spark, events)).collect(), key=lambda r: r.place):
            got.setdefault(r.id, []).append(r.source)
        assert got == {k: c for k in events if (c := chain(events, k))}


def test_given_starts_cycles_and_empty_tables(spark):
    events = {"a": (["b"], ["sa"]), "b": (["c", "d"], ["sb"]), "c": (["a"], ["sc"]), "d": ([], ["sd", "sa"])}
    df = table(spark, events)
    start = spark.createDataFrame([("a",), ("nobody",), (None,)], "id string")
    got = [r.source for r in sorted(J.source_chains(df, start).collect(), key=lambda r: r.place)]
    assert got == chain(events, "a") == ["sc", "sd", "sa", "sb"]
    assert J.source_chains(df.limit(0)).count() == J.event_children(df.limit(0)).count() == J.actor_events(df.limit(0)).count() == 0


def test_children_actors_and_repeated_ids(spark):
    events = graph(random.Random(5), 40)
    df = table(spark, events)
    want = {(p, k) for k, (ps, _) in events.items() for p in ps or [] if p in events and p != k}
    got = [(r.parent, r.child) for r in J.event_children(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    places = {}
    for r in J.actor_events(df).collect():
        places.setdefault(r.actor, {})[r.place] = r.id
    for actor in (None, "u0", "u1", "u2"):
        own = [f"e{i}" for i in range(40) if (None if i % 9 == 8 else f"u{i % 3}") == actor]
        assert places[actor] == {k + 1: x for k, x in enumerate(own)}
    assert [tuple(r) for r in J.duplicate_events(df.unionByName(df.filter("seq < 1"))).collect()] == [("e0", 2)]


def written_rows(monkeypatch):
    """What operators of joins write from now on: [rows, tables]."""
    told, write = [0, 0], J.materialize

    def count(df, name):
        out = write(df, name)
        told[0], told[1] = told[0] + out.count(), told[1] + 1
        return out

    monkeypatch.setattr(J, "materialize", count)
    return told


def test_source_chains_write_no_row_for_an_ancestor(spark, monkeypatch):
    events = {f"e{i}": ([f"e{j}" for j in range(max(0, i - 60), i, 8)], ["a"]) for i in range(80)}
    told = written_rows(monkeypatch)
    got = [tuple(r) for r in J.source_chains(table(spark, events)).collect()]
    assert sorted(got) == sorted((k, 1, "a") for k in events)
    assert told[0] < 20 * len(events)


def test_source_chains_behind_a_cycle_and_beside_it(spark):
    events = {"a": (["b"], ["sa"]), "b": (["a", "d"], ["sb"]), "c": (["d", "b"], ["sc", "sd"]), "d": ([], ["sd", "sa"]), "f": (["d", "f"], ["sf"])}
    got = {}
    for r in sorted(J.source_chains(table(spark, events)).collect(), key=lambda r: r.place):
        got.setdefault(r.id, []).append(r.source)
    assert got == {k: chain(events, k) for k in events}


def test_lineage_doubles_its_distances(spark, monkeypatch):
    rng = random.Random(4)
    up = {i: {rng.randrange(max(0, i - 4), i) for _ in range(2)} for i in range(1, 70)} | {0: {3}, 100: {100}}
    edges = spark.createDataFrame([(f"e{c}", f"e{p}") for c, ps in up.items() for p in ps], "child string, parent string")

    def walk(i, most):
        out, front, depth = {}, {i}, 0
        while front and (most is None or depth < most):
            depth, front = depth + 1, {p for c in front for p in up.get(c, ())} - set(out)
            out |= dict.fromkeys(front, depth)
        return {(f"e{i}", f"e{p}", d) for p, d in out.items()}

    told = written_rows(monkeypatch)
    all_, few = (spark.createDataFrame([(f"e{i}",) for i in x], "id string") for x in (up, (69, 100, 7, 500)))
    for most in (None, 5):
        assert sorted(map(tuple, J.lineage(edges, all_, most).collect())) == sorted(r for i in up for r in walk(i, most))
        assert told[1] < 12
        assert sorted(map(tuple, J.lineage(edges, few, most).collect())) == sorted(r for i in (69, 100, 7) for r in walk(i, most))
        told[1] = 0
