"""The import job, stopped at each of its steps and run again."""

import json

import pytest

from notegrid.operators.imports import ImportJob
from notegrid.schema import as_of
from notegrid.storage import AppendedTable, VersionedTable


class Stopped(Exception):
    pass


def files(spark):
    talk = lambda *turns: "\n".join(f"{r}: {t}" for r, t in turns)
    export = json.dumps({"messages": [{"role": "user", "content": f"note {k} " + "word " * 30} for k in range(6)]})
    rows = [("a.txt", talk(("user", "hello there " * 20), ("assistant", "yes " * 60), ("user", "same text"))), ("b.json", export), ("copy-of-a.txt", talk(("user", "hello there " * 20), ("assistant", "yes " * 60), ("user", "same text"))), ("c.txt", "no roles at all"), ("blank.txt", " \n "), ("d.txt", talk(("user", "known before")))]
    return spark.createDataFrame(rows, "path string, value string")


def model():
    def answer(text):
        import json

        return "Here: " + json.dumps([{"content": text[:30], "importance": 9}, {"content": "everywhere", "importance": 4}, {"content": " "}]) + " done"

    return answer


def store(spark, path):
    memories = VersionedTable(spark, path)
    memories.write(spark.createDataFrame([("m1", "dynamic", 9, "[user] known before", None, "x"), ("m2", "archived", 9, "[user] no roles at all", None, "y")], "id string, type string, importance int, content string, created timestamp_ntz, name string"))
    return memories


def state(job):
    held = sorted((r.id, r.type, r.importance, r.content) for r in job.memories.read().collect())
    return held, sorted(tuple(r) for r in job.report().collect())


def job_at(spark, root, memories, on_step=None, with_model=None):
    return ImportJob(spark, f"{root}/job", memories, with_model or model(), as_of(), target=60, quota=4, batches=2, on_step=on_step)


def test_stopped_at_every_step(spark, tmp_path):
    steps = []
    whole = job_at(spark, tmp_path / "whole", store(spark, str(tmp_path / "whole/m")), steps.append)
    whole.run(files(spark))
    want = state(whole)
    held, report = want
    assert steps == ["chunks", "extracted 0", "extracted 1", "written", "progress"]
    assert len(report) == 4 and all(r[-1] == "completed" for r in report)  # one of two equal files, no blank one
    assert len({i for i, *_ in held}) == len(held)
    assert [c for *_, c in held].count("everywhere") == 1 and [c for *_, c in held].count("[user] known before") == 1
    assert [c for *_, c in held].count("[user] no roles at all") == 2  # an archived row is no copy
    assert sum(n >= 9 for _, t, n, _ in held if t == "dynamic") == 4  # one before, three of the others
    assert sum(r[5] for r in report) == sum(n == 8 for _, _, n, _ in held) > 0
    whole.run(files(spark))
    assert state(whole) == want and whole.memories.latest() == 2

    for k, step in enumerate(steps):

        def stop(name, step=step):
            if name == step:
                raise Stopped

        root = tmp_path / f"stop{k}"
        memories = store(spark, str(root / "m"))
        with pytest.raises(Stopped):
            job_at(spark, root, memories, stop).run(files(spark))
        again = job_at(spark, root, memories)
        again.run(files(spark))
        assert state(again) == want, step
        assert again.memories.latest() == 2, step


def test_failed_chunks_are_tried_again(spark, tmp_path):
    whole = model()

    def broken(text):
        if "note 2" in text:
            raise ValueError("no answer")
        return whole(text) if "note" in text else "nothing of use {["

    memories = store(spark, str(tmp_path / "m"))
    first = {r.status for r in job_at(spark, tmp_path, memories, with_model=broken).run(files(spark)).collect()}
    assert first == {"completed", "incomplete"}
    report = job_at(spark, tmp_path, memories).run(files(spark)).collect()
    assert {r.status for r in report} == {"completed"}
    texts = [r.content for r in memories.read().collect()]
    assert sum("note 2" in t for t in texts) == 1 and not any("hello" in t for t in texts)


def test_parts_without_a_marker_do_not_count(spark, tmp_path):
    table = AppendedTable(spark, str(tmp_path / "t"), "k int, v string", ["k"])
    assert table.read().count() == 0
    table.append(spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, other int"))
    spark.createDataFrame([(3, "c")], "k int, v string").write.parquet(str(tmp_path / "t/part-x"))
    table.append(spark.createDataFrame([(2, "b")], "k int, v string"))
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "b")]
