"""Streams with keyed state against sequential versions: late, repeated and unknown events, restarts."""

import json
import random

from notegrid.operators.aggregates import KNOWN, trace_projection
from notegrid.streaming import stateful

SCHEMA = "seq long, trace_id string, event_type string, trace_kind string, body_hash string, payload string"


def walk(events):
    """One event after the other, as the log has them."""
    traces, unknown = {}, 0
    for seq, trace, kind, of, body, payload in events:
        said = json.loads(payload) if payload else {}
        if not trace or kind not in KNOWN:
            unknown += 1
            continue
        gone = bool(said.get("tombstone")) or str(said.get("erasure_mode", "")).lower() == "tombstone_only"
        if kind == "TraceCreated" or trace not in traces:
            traces[trace] = {"kind": of or said.get("type") or "dynamic", "body": "", "created": seq, "touches": int(kind == "TraceTouched"), "resolved": False, "deleted": False, "tombstone": False}
        t = traces[trace]
        t["kind"], t["body"] = of or t["kind"], body or t["body"]
        t["state"] = "tombstone" if gone else "deleted_to_archive" if kind == "TraceDeletedToArchive" else "archived" if kind == "TraceArchived" or of == "archived" else "active"
        t["seq"], t["last"] = seq, kind
        t["touches"] += kind == "TraceTouched"
        t["resolved"] = bool(said["resolved"]) if "resolved" in said else t["resolved"]
        t["deleted"] |= kind == "TraceDeletedToArchive"
        t["tombstone"] |= gone
    return sorted((k, t["kind"], t["state"], t["body"], t["created"], t["seq"], t["last"], t["touches"], t["resolved"], t["deleted"], t["tombstone"]) for k, t in traces.items()), unknown


def some_events(n, seed):
    rng = random.Random(seed)
    say = lambda: json.dumps({k: v for k, v in (("resolved", rng.random() < 0.5), ("tombstone", True), ("erasure_mode", "TOMBSTONE_ONLY"), ("type", "plan")) if rng.random() < 0.2})
    return [(s, rng.choice(["", None, *(f"t{i}" for i in range(9))]), rng.choice([*KNOWN, *KNOWN[1:3], "TraceOther"]), rng.choice(["", None, "feel", "archived"]), rng.choice(["", None, f"h{s}"]), rng.choice([None, say()])) for s in range(1, n + 1)]


def show(df):
    return sorted(map(tuple, df.collect()))


def test_catalog_stream_restarts(spark, tmp_path):
    events = some_events(240, 5)
    rng = random.Random(6)
    dealt = events + rng.sample(events, 40)
    rng.shuffle(dealt)
    files = [dealt[i::7] for i in range(7)]
    add = lambda k: spark.createDataFrame(files[k], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    source = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    before = spark.conf.get(stateful.STORE)
    done = []
    for part in ([0, 1, 2], [3], [4, 5, 6]):
        for k in part:
            add(k)
            done += files[k]
        log = stateful.stream_catalog(source(), f"{tmp_path}/out")  # goes on from its checkpoint
        have = sorted(set(done))
        want, unknown = walk(have)
        assert show(stateful.catalog_rows(log)) == want
        assert show(trace_projection(spark.createDataFrame(have, SCHEMA))) == want
        report = stateful.catalog_report(log, spark.createDataFrame([(300,)], "latest long")).first()
        assert (report.trace_count, report.tombstone_count, report.applied_seq, report.lag, report.unknown_event_count) == (len(want), sum(r[-1] for r in want), have[-1][0], 300 - have[-1][0], unknown)
    assert spark.conf.get(stateful.STORE) == before
    newest = log.changes().agg({"batch": "max"}).first()[0]
    # a batch holds what it changed, not the catalog
    assert newest == 6 and log.changes().filter(f"batch = {newest}").count() <= len({(e[1], e[2]) for e in files[6]}) + 1
    small = log.compact(newest, f"{tmp_path}/small")
    assert show(stateful.catalog_rows(small)) == want and small.changes().select("batch").distinct().count() == 1


def test_catalog_fold_of_long_traces(spark, tmp_path):
    events = [(s, "t", "TraceTouched" if s % 3 else "TraceUpdated", "", f"h{s}", None) for s in range(1, 3001)]
    for k in (1, 0):  # the second half first
        spark.createDataFrame(events[k * 1500 : k * 1500 + 1500], SCHEMA).coalesce(2).write.mode("append").parquet(f"{tmp_path}/log")
    log = stateful.stream_catalog(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log"), f"{tmp_path}/out")
    assert show(stateful.catalog_rows(log)) == walk(events)[0]


def test_order_stream_restarts(spark, tmp_path):
    rng = random.Random(14)
    sent = [(rng.randint(0, 2), n, rng.choice([n, n, n - 5, 0, -2])) for n in range(90)]
    schema = "source long, arrival long, seq long"
    top, want = {}, []
    for source, n, seq in sent:
        if seq <= top.get(source, -1):
            want.append((source, n, seq))
        top[source] = max(seq, top.get(source, -1))
    for i in range(3):
        spark.createDataFrame(sent[i * 30 : i * 30 + 30], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/sent")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/sent")
        log = stateful.order_violations(stream, f"{tmp_path}/out")
        assert show(log.read()) == sorted(w for w in want if w[1] < 30 * (i + 1))


def walk_queue(commands, waits):
    """One command after the other: items, circuit and what would be tried at each time."""
    items, c = {}, {"failures": 0, "last": None, "open": 0.0, "trips": 0, "processed": 0}
    for id_, n, op, digest, at, error, reset in commands:
        if op == "discard" or (op == "enqueue" and not digest):
            items.pop(id_, None)
        elif op == "enqueue":
            old = items.get(id_, {})
            same = old.get("hash") == digest
            items[id_] = {"hash": digest, "queued": old["queued"] if same else at, "attempts": old["attempts"] if same and not reset else 0, "due": 0.0 if reset else old.get("due", 0.0), "tried": old.get("tried"), "error": "" if reset else old.get("error", "")}
        elif items.get(id_, {}).get("hash") == digest:
            if op == "done":
                items.pop(id_)
                c.update(failures=0, last=None, open=0.0, processed=c["processed"] + 1)
            else:
                i = items[id_]
                i["attempts"] += 1
                i.update(due=at + min(waits.most, waits.base * 2 ** (i["attempts"] - 1)), tried=at, error=error[:300])
                if c["last"] != id_:
                    c.update(last=id_, failures=c["failures"] + 1)
                    if c["failures"] >= waits.threshold:
                        c["trips"] += c["open"] <= at
                        c["open"] = max(c["open"], at + min(waits.circuit_most, waits.circuit_base * 2 ** (c["failures"] - waits.threshold)))
    return {k: (i["hash"], i["queued"], i["attempts"], i["due"], i["tried"], i["error"]) for k, i in items.items()}, c


def test_queue_restarts(spark, tmp_path):
    rng = random.Random(8)
    schema = "id string, n long, op string, content_hash string, at double, error string, reset boolean"
    waits, commands = stateful.Waits(threshold=3), []
    for n in range(260):
        op = rng.choice(["enqueue", "enqueue", "failed", "failed", "failed", "done" if n % 100 < 60 else "failed", "discard" if n % 9 == 0 else "failed"])
        commands.append((f"i{rng.randint(0, 6)}", n, op, rng.choice(["a", "a", "b", "" if n % 11 == 0 else "a"]), n * 7.0, "no " * 150, n % 3 == 0))
    at = 0
    for k, size in enumerate((40, 1, 90, 9, 120)):
        part = commands[at : at + size] + commands[max(0, at - 5) : at]  # some come again
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        at += size
        items, circuit = stateful.stream_queue(spark.readStream.schema(schema).parquet(f"{tmp_path}/log"), f"{tmp_path}/out", waits)
        want, c = walk_queue(commands[:at], waits)
        got = {r.id: (r.content_hash, r.queued_at, r.attempts, r.next_attempt_at, r.last_attempt_at, r.last_error) for r in items.read().filter("pending").collect()}
        assert got == want, k
        now = circuit.read().first()
        assert (now.failures, now.last_id, now.open_until, now.trips, now.processed) == (c["failures"], c["last"], c["open"], c["trips"], c["processed"]), k
        for moment in (at * 7.0, at * 7.0 + 700):
            ready = sorted((due, queued, i) for i, (_, queued, _, due, _, _) in want.items() if due <= moment) if c["open"] <= moment else []
            assert [r.id for r in stateful.due(items, circuit, moment).collect()] == [i for *_, i in ready]
    assert c["trips"] and c["processed"]


def test_a_key_costs_one_read_and_one_write_and_no_frames():
    from pyspark.sql import Row

    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    queue = stateful.Queue(stateful.Waits())
    queue.item = Value()
    command = lambda n, op: Row(id="a", n=n, op=op, content_hash="h", at=n * 1.0, error="no", reset=False)
    first = list(queue.handleInputRows(("a",), iter([command(2, "failed"), command(1, "enqueue")]), None))
    again = list(queue.handleInputRows(("a",), iter([command(2, "failed"), command(3, "done")]), None))
    assert [(r.pending, r.attempts, [(o.n, o.ok) for o in r.outcomes]) for r in first + again] == [(True, 1, [(2, False)]), (False, 0, [(3, True)])]
    assert calls == ["get", "update"] * 2
