"""Aggregations and audits over memories and the event log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrid.functions import scores

KNOWN = ("TraceCreated", "TraceUpdated", "TraceTouched", "TraceArchived", "TraceDeletedToArchive")


def codes(*tests: tuple[Column, str]) -> Column:
    """One row for each test that holds."""
    return F.explode(F.filter(F.array(*[F.when(t, F.lit(c)) for t, c in tests]), lambda x: x.isNotNull())).alias("code")


def vault_stats(memories: DataFrame) -> DataFrame:
    """Rows and bytes by type and by first domain."""
    size = F.octet_length("content").alias("bytes")
    by = lambda kind, c: memories.select(F.lit(kind).alias("kind"), c.alias("name"), size).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    return by("type", F.col("type")).unionByName(by("domain", F.element_at("domain", 1)))


def concept_tokens(memories: DataFrame) -> DataFrame:
    """(id, key, label, kind, anchor): wikilink targets and tags of each memory."""
    from notegrid.functions.text import wikilinks

    links = memories.select("id", "anchor", F.explode(wikilinks(F.col("content"))).alias("label"), F.lit("wiki").alias("kind"))
    tags = memories.select("id", "anchor", F.explode(F.concat("tags", "domain")).alias("label"), F.lit("tag").alias("kind"))
    return links.unionByName(tags).withColumn("key", F.lower("label"))


def concept_nodes(tokens: DataFrame) -> DataFrame:
    kinds = F.collect_set("kind")
    return tokens.groupBy("key").agg(F.min_by("label", F.struct("id", "label")).alias("label"), F.when(F.size(kinds) > 1, "mixed").otherwise(F.element_at(kinds, 1)).alias("kind"), F.countDistinct("id").alias("freq"), F.bool_or("anchor").alias("anchor"))


def cooccurrence(tokens: DataFrame, most: int = 64) -> DataFrame:
    """Pairs of tokens in one memory with the number of memories; pairs are formed inside each memory's own short token list.

    Lists are bounded by the caps on tags and domains; longer ones (most) are refused rather than cut.
    """
    lists = tokens.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    checked = lists.select(F.when(F.size("keys") > most, F.raise_error(F.lit("more tokens in a memory than its caps allow"))).otherwise(F.col("keys")).alias("keys"))
    pairs = F.flatten(F.transform("keys", lambda a: F.transform(F.filter("keys", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return checked.select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def trace_catalog(ledger: DataFrame) -> DataFrame:
    """State of each trace after all its events; a new TraceCreated starts afresh.

    A trace that begins with a touch counts that touch twice.
    """
    known = ledger.filter(F.col("event_type").isin(*KNOWN))
    made = known.groupBy("trace_id").agg(F.coalesce(F.max(F.when(F.col("event_type") == "TraceCreated", F.col("seq"))), F.min("seq")).alias("created_seq"))
    live = known.join(made, "trace_id").filter("seq >= created_seq")
    last = F.max_by("event_type", "seq")
    state = F.when(last == "TraceDeletedToArchive", "deleted_to_archive").when(last == "TraceArchived", "archived").otherwise("active")
    touches = F.count_if(F.col("event_type") == "TraceTouched") + F.when(F.min_by("event_type", "seq") == "TraceTouched", 1).otherwise(0)
    return live.groupBy("trace_id").agg(state.alias("state"), F.max_by("body_hash", "seq").alias("body_hash"), F.min("created_seq").alias("created_seq"), F.max("seq").alias("latest_seq"), last.alias("latest_event_type"), touches.cast("long").alias("touch_count"), F.bool_or(F.col("event_type") == "TraceDeletedToArchive").alias("deleted"))


def ledger_fields(ledger: DataFrame) -> DataFrame:
    """Events with what the catalog takes from their payload: kind and payload_kind (null: none), body_hash, resolved (null: not said), tombstone."""
    said = lambda name: F.get_json_object("payload", f"$.{name}")
    some = lambda c: F.when(c != "", c)
    true = lambda c: ~F.coalesce(c, F.lit("")).isin("", "false", "0", "[]", "{}")
    tombstone = true(said("tombstone")) | F.coalesce(F.lower(said("erasure_mode")) == "tombstone_only", F.lit(False))
    return ledger.select("seq", "trace_id", "event_type", some(F.col("trace_kind")).alias("kind"), some(said("type")).alias("payload_kind"), some(F.col("body_hash")).alias("body_hash"), F.when(said("resolved").isNotNull(), true(said("resolved"))).alias("resolved"), tombstone.alias("tombstone"))


def trace_projection(ledger: DataFrame) -> DataFrame:
    """The whole catalog row of each trace after all its events: kind, state, body hash, seqs, touches, resolved, deleted, tombstone.

    A new TraceCreated starts afresh; a trace that begins with a touch counts that touch twice; a kind or body hash
    that an event doesn't say stays.
    """
    known = ledger_fields(ledger).filter(F.col("event_type").isin(*KNOWN) & (F.coalesce("trace_id", F.lit("")) != ""))
    made = known.groupBy("trace_id").agg(F.coalesce(F.max(F.when(F.col("event_type") == "TraceCreated", F.col("seq"))), F.min("seq")).alias("created_seq"))
    live = known.join(made, "trace_id").filter("seq >= created_seq")
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    state = F.when(F.col("tombstone"), "tombstone").when(F.col("event_type") == "TraceDeletedToArchive", "deleted_to_archive").when((F.col("event_type") == "TraceArchived") | (F.coalesce("kind", F.lit("")) == "archived"), "archived").otherwise("active")
    touches = F.count_if(F.col("event_type") == "TraceTouched") + F.when(F.min_by("event_type", "seq") == "TraceTouched", 1).otherwise(0)
    return live.withColumn("now", state).groupBy("trace_id").agg(
        F.coalesce(newest("kind"), F.min_by("payload_kind", "seq"), F.lit("dynamic")).alias("trace_kind"), F.max_by("now", "seq").alias("state"), F.coalesce(newest("body_hash"), F.lit("")).alias("body_hash"), F.min("created_seq").alias("created_seq"), F.max("seq").alias("latest_seq"), F.max_by("event_type", "seq").alias("latest_event_type"),
        touches.cast("long").alias("touch_count"), F.coalesce(newest("resolved"), F.lit(False)).alias("resolved"), F.bool_or(F.col("event_type") == "TraceDeletedToArchive").alias("deleted"), F.bool_or("tombstone").alias("tombstone"),
    )


def trace_metadata(ledger: DataFrame) -> DataFrame:
    """Merged payload of each trace: the latest value of every key since its last creation."""
    known = ledger.filter(F.col("event_type").isin(*KNOWN))
    made = known.groupBy("trace_id").agg(F.coalesce(F.max(F.when(F.col("event_type") == "TraceCreated", F.col("seq"))), F.min("seq")).alias("created_seq"))
    live = known.join(made, "trace_id").filter("seq >= created_seq")
    fields = live.select("trace_id", "seq", F.explode(F.from_json("payload", "map<string,string>")).alias("key", "value"))
    return fields.groupBy("trace_id", "key").agg(F.max_by("value", "seq").alias("value"))


def retrieval_eval(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """ranked(case, id, rank), expected(case, id): hit, recall, first rank and reciprocal rank of each case."""
    total = expected.groupBy("case").agg(F.countDistinct("id").alias("wanted"))
    hits = ranked.join(expected, ["case", "id"], "left_semi").groupBy("case").agg(F.countDistinct("id").alias("found"), F.min("rank").alias("first"))
    return total.join(hits, "case", "left").select("case", F.col("found").isNotNull().alias("hit"), F.round(F.coalesce(F.col("found") / F.col("wanted"), F.lit(0.0)), 6).alias("recall"), F.col("first").cast("long").alias("first"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal"))


def ledger_invariants(ledger: DataFrame) -> DataFrame:
    """Traces that end deleted without ever being archived, or whose body hash changes without an update."""
    t = ledger.groupBy("trace_id").agg(F.bool_or(F.col("event_type") == "TraceDeletedToArchive").alias("gone"), F.bool_or(F.col("event_type") == "TraceArchived").alias("kept"), F.min("body_hash").alias("lo"), F.max("body_hash").alias("hi"))
    return t.select("trace_id", codes((F.col("gone") & ~F.col("kept"), "erased_without_archive"), (F.col("lo") != F.col("hi"), "hash_changed")))


# fixed values of the log: kinds of events, and the words that count as true
CREATES = ("TraceCreated", "MemoryCreated", "BucketCreated")
TOMBSTONES = ("TombstoneWritten", "TraceDeletedToArchive")
PHYSICAL_ERASURES = ("TracePhysicallyErased", "TracePurged", "TraceHardDeleted", "PhysicalErase", "StoragePurged")
ADMIN_ERASURES = ("AdminErasure", "AdminErasureRequested", "AdminErasurePerformed", "AdminErase", "TraceAdminErased")
RECONSTRUCTIONS = ("TraceReconstructed", "TraceReconstruction", "TraceReconsolidated", "ReconstructionWritten")
TRUE = ("1", "true", "yes", "on")


def erasure_violations(events: DataFrame) -> DataFrame:
    """events(seq, trace_id, event_type, body_hash, payload), payload a JSON text: (seq, trace_id, code) of what the log mustn't hold.

    no_silent_erasure: a physical erasure of a trace that has no tombstone anywhere in the log and wasn't created as
    erasable test data. admin_erasure_logged_as_internal_forgetting: an admin erasure that says it forgets, or doesn't
    say it is an external storage action. reconstruction_overwrote_original_trace: a reconstruction that says it
    replaces the original, or updates it with another hash than the original's (its payload's, or that of the first
    creation before it). Blank trace ids, null and broken payloads say nothing.

    A trace's facts are one aggregate; only erasures and reconstructions are joined to them.
    """
    said = lambda k: F.coalesce(F.lower(F.trim(F.get_json_object("payload", f"$.{k}"))).isin(*TRUE), F.lit(False))
    text = lambda k: F.coalesce(F.get_json_object("payload", f"$.{k}"), F.lit(""))
    kind, named = F.col("event_type"), events.filter(F.trim("trace_id") != "").withColumn("trace_id", F.trim("trace_id"))
    erased = F.coalesce(kind.isin(*PHYSICAL_ERASURES), F.lit(False)) | said("physical_erasure")
    created = kind.isin(*CREATES)
    hashed = F.when(created & (F.col("body_hash") != ""), F.col("seq"))
    test = created & (F.get_json_object("payload", "$.provenance.kind") == "test") & (F.get_json_object("payload", "$.provenance.erasable") == "true")
    facts = named.groupBy("trace_id").agg(F.bool_or(F.coalesce(kind.isin(*TOMBSTONES), F.lit(False)) | said("tombstone")).alias("kept"), F.bool_or(F.coalesce(test, F.lit(False))).alias("test"), F.min(hashed).alias("first"), F.min_by("body_hash", hashed).alias("first_hash"))
    action = F.lower(F.when(text("storage_action") != "", text("storage_action")).otherwise(text("action")))
    outside = said("external_storage_action") | action.isin("external", "external_storage", "external_storage_action")
    inside = said("internal_forgetting") | action.isin("internal_forgetting", "forgetting", "forget")
    acts = named.filter(erased | kind.isin(*ADMIN_ERASURES, *RECONSTRUCTIONS)).join(facts.hint("merge"), "trace_id")
    own = F.when(text("original_body_hash") != "", text("original_body_hash")).when(F.col("first") <= F.col("seq"), F.col("first_hash"))
    replaced = said("overwrites_original") | said("replaces_original") | said("falsifies_original") | F.coalesce((F.col("body_hash") != "") & (F.col("body_hash") != own) & said("updates_original"), F.lit(False))
    return acts.select("seq", "trace_id", codes(
        (erased & ~F.col("kept") & ~F.col("test"), "no_silent_erasure"),
        (kind.isin(*ADMIN_ERASURES) & (inside | ~outside), "admin_erasure_logged_as_internal_forgetting"),
        (kind.isin(*RECONSTRUCTIONS) & replaced, "reconstruction_overwrote_original_trace"),
    ))


def replay_validation(ledger: DataFrame, order: str = "pos") -> DataFrame:
    """ledger with a dense file position: rows whose seq doesn't grow, traces missing, malformed body hashes.

    The row before comes by an equi join on the position, not by one window over the log.
    """
    before = ledger.select((F.col(order) + 1).alias(order), F.col("seq").alias("prev_seq"))
    rows = ledger.join(before, order, "left")
    return rows.select("seq", codes((F.col("prev_seq") >= F.col("seq"), "seq_not_increasing"), (F.coalesce("trace_id", F.lit("")) == "", "missing_trace_id"), (~F.rlike("body_hash", F.lit("^sha256:[0-9a-f]{64}$")), "bad_body_hash")))


def decision_audit(decisions: DataFrame, reasons: Column) -> DataFrame:
    """Rows that were let through against the policy."""
    bad = decisions.withColumn("reasons", reasons).filter(F.col("allowed") & (F.size("reasons") > 0))
    return bad.select("id", F.when(F.array_contains("reasons", "dont_surface"), "dont_surface_leak").otherwise("policy_bypass").alias("code"))


def surfacing_summary(entries: DataFrame) -> DataFrame:
    """entries(run, kind, outcome, tokens): counts and tokens of each run."""
    of = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return entries.groupBy("run", "kind").agg(of("returned"), of("pointer"), of("omitted"), F.sum(F.when(F.col("outcome") == "returned", F.col("tokens")).otherwise(0)).alias("tokens"))


def plan_board(plans: DataFrame, at: Column, stale_days: int = 20) -> DataFrame:
    """plans(id, status, importance, created): column of the board and whether the plan is stale."""
    status = F.when(F.lower("status").isin("active", "resolved", "abandoned"), F.lower("status")).otherwise("active")
    stale = (status == "active") & (F.col("created") + F.expr(f"INTERVAL {stale_days} DAYS") <= at)
    return plans.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(stale).alias("stale"))


def review_state(plans: DataFrame, at: Column, days: int = 30) -> DataFrame:
    """plans(id, status, last_confirmed_at, change_log, created): last confirmation, age in days, next review, staleness."""
    confirming = F.filter("change_log", lambda x: x["action"].isin("confirm", "reopen", "edit"))
    last = F.coalesce("last_confirmed_at", F.try_element_at(F.transform(confirming, lambda x: x["ts"]), F.lit(-1)), "created")
    following = last + F.expr(f"INTERVAL {max(1, min(3650, days))} DAYS")
    return plans.select("id", last.alias("last_confirmed_at"), F.floor(F.greatest(F.lit(0), F.timestamp_diff("SECOND", last, at)) / 86400).cast("long").alias("days_since"), following.alias("next_review_at"), ((F.col("status") == "active") & (at >= following)).alias("is_stale"))


def decay_report(memories: DataFrame, at: Column) -> DataFrame:
    """Counts of one decay cycle and its lowest score."""
    from notegrid.operators.lifecycle import decay_cycle

    return decay_cycle(memories, at).agg(F.count(F.lit(1)).alias("checked"), F.count_if("archive").alias("archived"), F.count_if("auto_resolved").alias("auto_resolved"), F.min("score").alias("lowest"))


def health(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """Checks with their counts and an overall status for each."""
    twice = memories.groupBy("id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_ids").alias("check"), "n")
    orphan = vectors.join(memories.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphan_vectors").alias("check"), "n")
    missing = memories.select("id").join(vectors.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing_vectors").alias("check"), "n")
    status = F.when(F.col("n") == 0, "ok").when(F.col("check") == "duplicate_ids", "error").otherwise("warning")
    return twice.unionByName(orphan).unionByName(missing).withColumn("status", status)


def vector_sizes(vectors: DataFrame, target: int) -> DataFrame:
    return vectors.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).withColumn("matches", F.col("size") == target)


def receipt_audit(receipts: DataFrame, required: list[str]) -> DataFrame:
    """receipts(id, stages): missing or misordered stages."""
    want = F.array(*map(F.lit, required))
    places = F.transform(F.filter(want, lambda x: F.array_contains("stages", x)), lambda x: F.array_position("stages", x))
    return receipts.select("id", codes((F.size(F.array_except(want, "stages")) > 0, "missing_stage"), (places != F.array_sort(places), "misordered")))


def boundary_audit(receipts: DataFrame, mutating: list[str], mutation_stages: list[str], read_stages: list[str], validation: str, append: str) -> DataFrame:
    """receipts(id, kind, stages, events, ledger_appended, preflight_allowed, validation_allowed, direct_write): (id, code, stage) of every issue.

    A command mutates if its kind is one of `mutating`, it names events or has appended to the ledger; then
    mutation_stages are asked for, else read_stages. Codes: adapter_direct_memory_write, missing_boundary_stage (one row for each
    stage), boundary_stage_order_invalid (by where a stage first stands), ledger_append_after_policy_denial,
    mutation_without_events, mutation_without_ledger_append, and ledger_append_without_event_policy_validation (the
    validation is missing, failed or comes after the append). Null flags are false, null lists empty.
    """
    words = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = receipts.select("id", "kind", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("stages", "events")], *[true(c).alias(c) for c in ("ledger_appended", "preflight_allowed", "validation_allowed", "direct_write")])
    some = F.size("events") > 0
    rows = rows.withColumn("mutates", F.coalesce(F.col("kind").isin(*mutating), F.lit(False)) | some | F.col("ledger_appended"))
    rows = rows.withColumn("want", F.when(F.col("mutates"), words(mutation_stages)).otherwise(words(read_stages)))
    at = lambda x: F.array_position("stages", x)
    places = F.transform(F.filter("want", lambda x: F.array_contains("stages", x)), at)
    valid = F.col("validation_allowed") & (at(validation) > 0) & (at(validation) < at(append))
    issue = lambda test, code: F.when(test, F.struct(F.lit(code).alias("code"), F.lit(None).cast("string").alias("stage")))
    missing = F.transform(F.array_except("want", "stages"), lambda x: F.struct(F.lit("missing_boundary_stage").alias("code"), x.alias("stage")))
    single = F.array_compact(F.array(
        issue(F.col("direct_write"), "adapter_direct_memory_write"),
        issue(places != F.array_sort(places), "boundary_stage_order_invalid"),
        issue(F.col("ledger_appended") & ~F.col("preflight_allowed"), "ledger_append_after_policy_denial"),
        issue(F.col("mutates") & ~some, "mutation_without_events"),
        issue(F.col("mutates") & ~F.col("ledger_appended"), "mutation_without_ledger_append"),
        issue(F.col("ledger_appended") & ~valid, "ledger_append_without_event_policy_validation"),
    ))
    return rows.select("id", F.explode(F.concat(missing, single)).alias("i")).select("id", "i.code", "i.stage")


def marked_texts(items: DataFrame, markers: dict[str, str]) -> DataFrame:
    """items(id, text): codes of the markers (regular expressions) that stand in the text."""
    return items.select("id", codes(*[(F.rlike("text", F.lit(p)), c) for c, p in markers.items()]))


def index_drift(memories: DataFrame, vectors: DataFrame, pending: DataFrame, at: Column) -> DataFrame:
    """(part, name, type, value): memories without a vector that aren't pending, orphan vectors, counts by type, and the listing of all rows with their score."""
    text = lambda c: F.lit(c).cast("string")
    none = F.lit(None).cast("double")
    missing = memories.select("id").join(vectors.select("id"), "id", "left_anti").join(pending.select("id"), "id", "left_anti")
    orphan = vectors.select("id").join(memories.select("id"), "id", "left_anti")
    parts = [df.select(text(name).alias("part"), F.col("id").alias("name"), text(None).alias("type"), none.alias("value")) for name, df in (("missing", missing), ("orphan", orphan))]
    parts.append(memories.groupBy("type").agg(F.count(F.lit(1)).cast("double").alias("value")).select(text("type").alias("part"), F.col("type").alias("name"), "type", "value"))
    parts.append(memories.select(text("row").alias("part"), F.col("id").alias("name"), "type", scores.decay_score(at).alias("value")))
    return reduce(DataFrame.unionByName, parts)
