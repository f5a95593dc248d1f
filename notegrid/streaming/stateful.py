"""Streams that keep their state by key in Spark's state store: the catalog of traces, the order of sources, the re-embedding queue.

A batch costs what it brings: a key's state is read and written only when the batch names it, results are
appended under the batch's number (a batch that comes again replaces its own), and readers take the newest row
of each key. compact() folds the batches into one when a reader has too many to look through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from notegrid.operators.aggregates import KNOWN, ledger_fields
from notegrid.operators.ordered import running_max

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Keyed state needs the store that can hold several states of a key; the session's own setting comes back."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


class ChangeLog:
    """A table as the rows that changed in each batch: folders batch=0, 1, ... under path; the newest row of a key counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str | None = None):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def put(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def changes(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch long").option("basePath", self.path).parquet(f"{self.path}/batch=*")

    def read(self) -> DataFrame:
        """All rows, or the newest of each key."""
        rows = self.changes()
        if self.key is None:
            return rows.drop("batch")
        names = [c for c in rows.columns if c != "batch"]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*names), "batch").alias("r")).select("r.*")

    def compact(self, number: int, path: str) -> ChangeLog:
        """The same table at another path with one batch, `number`; a stream that goes on writes batches above it there."""
        out = ChangeLog(self.spark, path, self.schema, self.key)
        out.put(self.read(), number)
        return out


def run_keyed(events: DataFrame, key: str, processor: StatefulProcessor, schema: str, put: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that has arrived since the checkpoint."""
    with keyed_state(events.sparkSession):
        out = events.groupBy(key).transformWithState(processor, schema, "Update", "None")
        out.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


# --- catalog ----------------------------------------------------------------------------------------

EVENT = "seq long, event_type string, kind string, payload_kind string, body_hash string, resolved boolean, tombstone boolean"
FOLD = "trace_kind string, state string, body_hash string, created_seq long, latest_seq long, latest_event_type string, touch_count long, resolved boolean, deleted boolean, tombstone boolean, applied_seq long, unknown long"
CATALOG = f"trace_id string, {FOLD}"
#: Events that name no trace or no known type are counted under this many keys.
UNKNOWN_KEYS = 64
SEEN, SHOWN = columns(EVENT), columns(CATALOG)


def state_of(e: tuple) -> str:
    _, event_type, kind, _, _, _, tombstone = e
    if tombstone:
        return "tombstone"
    if event_type == "TraceDeletedToArchive":
        return "deleted_to_archive"
    return "archived" if event_type == "TraceArchived" or kind == "archived" else "active"


def fold(state: tuple | None, e: tuple) -> tuple:
    """The trace after one more event, in the order of FOLD."""
    seq, event_type, kind, payload_kind, body_hash, resolved, tombstone = e
    if event_type not in KNOWN:
        return (None,) * 10 + (max(seq, state[10]) if state else seq, 1 + (state[11] if state else 0))
    touched, first = int(event_type == "TraceTouched"), state is None or event_type == "TraceCreated"
    if first:
        state = (kind or payload_kind or "dynamic", None, body_hash or "", seq, seq, None, touched, False, False, False, state[10] if state else seq, 0)
    return (kind or state[0], state_of(e), body_hash or state[2], state[3], seq, event_type, state[6] + touched, state[7] if resolved is None else resolved, state[8] or event_type == "TraceDeletedToArchive", state[9] or tombstone, max(seq, state[10]), 0)


class TraceFold(StatefulProcessor):
    """Keeps the fold of each trace and its events; only events that come late make it fold anew."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fold, self.seen = handle.getValueState("fold", FOLD), handle.getListState("seen", EVENT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = {e[0]: e for e in (tuple(r[c] for c in SEEN) for r in rows)}
        held = self.fold.get()  # None: a new trace
        state = tuple(held) if held else None
        if state is None or min(new) > state[10]:
            self.seen.appendList(list(new.values())) if state else self.seen.put(list(new.values()))
        else:
            old = {e[0]: e for e in map(tuple, self.seen.get())}
            if all(s in old for s in new):
                return  # all repeated
            new, state = {**new, **old}, None
            self.seen.put(list(new.values()))
        for s in sorted(new):
            state = fold(state, new[s])
        self.fold.update(state)
        yield Row(**dict(zip(SHOWN, (key[0], *state), strict=True)))

    def close(self) -> None:
        pass


def stream_catalog(events: DataFrame, path: str) -> ChangeLog:
    """Bring the catalog under `path` up to date with a stream of ledger events; equal to trace_projection() of the log.

    Events may come late, in any order and again (a seq counts once in its trace). The state is in `path` too, so a
    later call goes on where this one ended, or failed.
    """
    e = ledger_fields(events)
    unknown = ~F.col("event_type").isin(*KNOWN) | (F.coalesce("trace_id", F.lit("")) == "")
    # counted apart, under names that no trace has
    name = F.concat(F.lit("\0"), F.pmod("seq", F.lit(UNKNOWN_KEYS)).cast("string"))
    e = e.withColumns({"trace_id": F.when(unknown, name).otherwise(F.col("trace_id")), "event_type": F.when(unknown, F.lit("unknown")).otherwise(F.col("event_type"))})
    log = ChangeLog(events.sparkSession, f"{path}/catalog", CATALOG, "trace_id")
    run_keyed(e, "trace_id", TraceFold(), CATALOG, log.put, f"{path}/state")
    return log


def catalog_rows(log: ChangeLog) -> DataFrame:
    return log.read().filter("trace_id NOT LIKE '\\0%'").drop("applied_seq", "unknown")


def catalog_report(log: ChangeLog, source_latest_seq: DataFrame) -> DataFrame:
    """One row: traces, tombstones, applied seq, lag behind source_latest_seq(latest), events that were not understood."""
    told = log.read().agg(F.count("created_seq").alias("trace_count"), F.count_if("tombstone").alias("tombstone_count"), F.coalesce(F.max("applied_seq"), F.lit(0)).alias("applied_seq"), F.coalesce(F.sum("unknown"), F.lit(0)).alias("unknown_event_count"))
    return told.crossJoin(source_latest_seq.select(F.coalesce("latest", F.lit(0)).alias("source_latest_seq"))).withColumn("lag", F.greatest(F.lit(0), F.col("source_latest_seq") - F.col("applied_seq")))  # one row each


# --- order ------------------------------------------------------------------------------------------

VIOLATION = "source long, arrival long, seq long"


class Rising(StatefulProcessor):
    """Keeps the highest seq of each source; gives the rows that aren't above it. A source's rows of one batch are put in order in memory."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.top.get()
        known = top = held[0] if held else -1
        for arrival, seq in sorted(((r["arrival"], r["seq"]) for r in rows), key=lambda x: x[0]):
            if seq <= top:
                yield Row(source=key[0], arrival=arrival, seq=seq)
            top = max(top, seq)
        if top > known:
            self.top.update((top,))

    def close(self) -> None:
        pass


def order_violations(events: DataFrame, path: str) -> ChangeLog:
    """events(source, arrival, seq): rows whose seq isn't above the highest that the source sent before.

    Within a batch rows go by arrival; a seq below 0 is always one. A batch is as large as the trigger lets it be.
    """
    log = ChangeLog(events.sparkSession, f"{path}/violations", VIOLATION)
    run_keyed(events.filter("source IS NOT NULL AND seq IS NOT NULL"), "source", Rising(), VIOLATION, log.put, f"{path}/state")
    return log


# --- re-embedding queue -----------------------------------------------------------------------------

ITEM = "pending boolean, content_hash string, queued_at double, updated_at double, attempts long, next_attempt_at double, last_attempt_at double, last_error string, n long"
OUTCOMES = "outcomes array<struct<n: bigint, ok: boolean, at: double>>"
COMMAND, HELD = ("n", "op", "content_hash", "at", "error", "reset"), ["id", *columns(ITEM), "outcomes"]
CIRCUIT = "failures long, last_id string, open_until double, trips long, processed long"


class Waits:
    """Waiting times in seconds: of an item, doubling from base to most; of all work after `threshold` failures in a row on changing items."""

    def __init__(self, base: float = 5.0, most: float = 300.0, threshold: int = 3, circuit_base: float = 30.0, circuit_most: float = 600.0):
        self.base, self.most, self.threshold, self.circuit_base, self.circuit_most = base, max(base, most), threshold, circuit_base, max(circuit_base, circuit_most)


def queue_step(item: tuple | None, c: tuple, waits: Waits) -> tuple[tuple, bool | None]:
    """(item, outcome) after a command (n, op, content_hash, at, error, reset); outcome: whether an attempt on the wanted text went well, None if there was none."""
    n, op, wanted, at, error, reset = c
    pending, digest, queued, updated, attempts, due, tried, said, _ = item or (False, None, None, None, 0, 0.0, None, "", None)
    gone = (False, None, None, at, 0, 0.0, None, "", n)
    if op == "discard" or (op == "enqueue" and not wanted):
        return gone, None
    if op == "enqueue":
        same = pending and digest == wanted
        if not pending:
            tried = None
        return (True, wanted, queued if same else at, at, attempts if same and not reset else 0, 0.0 if reset or not pending else due, tried, "" if reset or not pending else said, n), None
    if not pending or digest != wanted:  # of a text that isn't wanted any more
        return (pending, digest, queued, updated, attempts, due, tried, said, n), None
    if op == "done":
        return gone, True
    attempts += 1
    return (True, digest, queued, at, attempts, at + min(waits.most, waits.base * 2.0 ** min(attempts - 1, 16)), at, (error or "")[:300], n), False


class Queue(StatefulProcessor):
    """Keeps the wanted text of each id; a command that comes again is passed over by its number."""

    def __init__(self, waits: Waits):
        self.waits = waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.item = handle.getValueState("item", ITEM)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, outcomes = self.item.get(), []
        item = tuple(held) if held else None
        for c in sorted((tuple(r[c] for c in COMMAND) for r in rows), key=lambda c: c[0]):
            if item is None or c[0] > item[8]:
                item, ok = queue_step(item, c, self.waits)
                if ok is not None:
                    outcomes.append(Row(n=c[0], ok=ok, at=c[3]))
        self.item.update(item)
        yield Row(**dict(zip(HELD, (key[0], *item, outcomes), strict=True)))

    def close(self) -> None:
        pass


def circuit_step(outcomes: DataFrame, before: DataFrame, waits: Waits) -> DataFrame:
    """CIRCUIT after outcomes(id, n, ok, at), from the row before it: one row.

    Failures in a row count when they fall on another item than the last one; from `threshold` on each opens the
    circuit for longer; a success closes it. Outcomes are put in order in a run of failures at a time; as work
    pauses while the circuit is open, such a run is short.
    """
    rows = running_max(outcomes.withColumns({"all": F.lit(0), "good": F.when(F.col("ok"), F.col("n"))}), "all", "n", "good").withColumnRenamed("before", "run")
    rows = rows.crossJoin(before.select([F.col(c).alias(f"old_{c}") for c in before.columns]))  # one row
    first, order = F.col("run").isNull(), Window.partitionBy("run").orderBy("n")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    failed = rows.filter("NOT ok")
    failed = failed.withColumn("counts", (F.coalesce(F.lag("id").over(order), F.when(first, F.col("old_last_id"))).eqNullSafe(F.col("id")) == F.lit(False)).cast("long"))
    failed = failed.withColumn("k", F.sum("counts").over(order) + F.when(first, F.col("old_failures")).otherwise(0))
    wait = F.least(F.lit(waits.circuit_most), waits.circuit_base * F.pow(F.lit(2.0), F.least(F.col("k") - waits.threshold, F.lit(16))))
    failed = failed.withColumn("until", F.when((F.col("counts") == 1) & (F.col("k") >= waits.threshold), F.col("at") + wait))
    open_until = F.greatest(F.coalesce(F.max("until").over(earlier), F.lit(0.0)), F.when(first, F.col("old_open_until")).otherwise(0.0))
    failed = failed.withColumn("trip", (F.col("until").isNotNull() & (open_until <= F.col("at"))).cast("long"))
    runs = failed.groupBy("run").agg(F.max("k").alias("failures"), F.max_by("id", "n").alias("last_id"), F.greatest(F.coalesce(F.max("until"), F.lit(0.0)), F.when(F.col("run").isNull(), F.max("old_open_until")).otherwise(0.0)).alias("open_until"), F.sum("trip").alias("trips"))
    good = outcomes.agg(F.max(F.when(F.col("ok"), F.col("n"))).alias("last_good"), F.count_if("ok").alias("done"))
    last = runs.crossJoin(good).filter(F.col("run").eqNullSafe(F.col("last_good"))).select("failures", "last_id", "open_until")  # at most one row each
    trips = runs.agg(F.coalesce(F.sum("trips"), F.lit(0)).alias("more"))
    state = before.crossJoin(good).crossJoin(trips).join(last.select(*[F.col(c).alias(f"new_{c}") for c in last.columns]), F.lit(True), "left")
    now = lambda c, none: F.when(F.col("new_failures").isNotNull(), F.col(f"new_{c}")).when(F.col("last_good").isNotNull(), F.lit(none)).otherwise(F.col(c))
    return state.select(now("failures", 0).alias("failures"), now("last_id", None).alias("last_id"), now("open_until", 0.0).alias("open_until"), (F.col("trips") + F.col("more")).alias("trips"), (F.col("processed") + F.col("done")).alias("processed"))


def stream_queue(commands: DataFrame, path: str, waits: Waits | None = None) -> tuple[ChangeLog, ChangeLog]:
    """Bring the queue under `path` up to date with a stream of commands(id, n, op, content_hash, at, error, reset): (items, circuit).

    op: enqueue (no text hash: discard), discard, done, failed. n numbers the commands; those of one id come in
    order. The newest text of an id replaces an older one; results for older texts are passed over.
    """
    spark, waits = commands.sparkSession, waits or Waits()
    items, circuit = ChangeLog(spark, f"{path}/items", f"id string, {ITEM}", "id"), ChangeLog(spark, f"{path}/circuit", f"one int, {CIRCUIT}", "one")
    start = spark.createDataFrame([(1, 0, None, 0.0, 0, 0)], f"one int, {CIRCUIT}")

    def put(batch: DataFrame, number: int) -> None:
        held = spark.read.schema(batch.schema)
        raw = ChangeLog(spark, f"{path}/steps", "id string", None)
        raw.put(batch, number)  # worked out once
        rows = held.parquet(f"{path}/steps/batch={number}")
        items.put(rows.drop("outcomes"), number)
        known = circuit.changes().filter(F.col("batch") < number) if number else None
        before = known.groupBy().agg(F.max_by(F.struct(*start.columns), "batch").alias("r")).select("r.*") if number else start
        told = rows.select("id", F.inline("outcomes").alias("n", "ok", "at"))
        circuit.put(circuit_step(told, before.drop("one"), waits).select(F.lit(1).alias("one"), "*"), number)

    run_keyed(commands.filter("id IS NOT NULL AND id <> ''"), "id", Queue(waits), f"id string, {ITEM}, {OUTCOMES}", put, f"{path}/state")
    return items, circuit


def due(items: ChangeLog, circuit: ChangeLog, at: float) -> DataFrame:
    """Items to try now, first the one that waits longest: none while the circuit is open."""
    open_ = circuit.read().filter(F.col("open_until") > at).select("one")
    ready = items.read().filter(F.col("pending") & (F.col("next_attempt_at") <= at))
    return ready.join(open_, F.lit(True), "left_anti").orderBy("next_attempt_at", "queued_at", "id").select("id", "content_hash", "attempts")
