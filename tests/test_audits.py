"""Audits of the log and of commands on rows made for each rule, nulls and broken payloads among them."""

from notegrid.operators import aggregates as A


def test_erasure_violations(spark):
    rows = [
        (1, "a", "TraceCreated", "h1", '{"provenance": {"kind": "test", "erasable": true}}'),
        (2, "a", "TracePurged", None, None),  # test data
        (3, "b", "TracePurged", None, "{}"),  # its tombstone comes later
        (4, "b", "TombstoneWritten", None, None),
        (5, "c", "Other", None, '{"physical_erasure": "Yes"}'),
        (6, "d", "AdminErase", None, "{broken"),
        (7, "d", "AdminErase", None, '{"storage_action": "External"}'),
        (8, "d", "AdminErase", None, '{"external_storage_action": true, "action": "forget"}'),
        (9, "e", "TraceReconstructed", "h2", '{"updates_original": true}'),  # created later
        (10, "e", "TraceCreated", "h1", None),
        (11, "e", "TraceReconstructed", "h2", '{"updates_original": true}'),
        (12, "e", "TraceReconstructed", "h1", '{"updates_original": true}'),
        (13, "e", "TraceReconstructed", None, '{"falsifies_original": "on"}'),
        (14, "e", "TraceReconstructed", "h1", '{"updates_original": 1, "original_body_hash": "h0"}'),
        (15, " ", "TracePurged", None, None),
        (16, None, "TracePurged", None, None),
        (17, "f", None, None, None),
        (18, "g", "TraceCreated", "h", '{"provenance": {"kind": "test", "erasable": "no"}}'),
        (19, " g ", "PhysicalErase", None, None),
    ]
    df = spark.createDataFrame(rows, "seq long, trace_id string, event_type string, body_hash string, payload string")
    silent, admin, again = "no_silent_erasure", "admin_erasure_logged_as_internal_forgetting", "reconstruction_overwrote_original_trace"
    want = [(5, "c", silent), (6, "d", admin), (8, "d", admin), (11, "e", again), (13, "e", again), (14, "e", again), (19, "g", silent)]
    assert sorted(map(tuple, A.erasure_violations(df).collect())) == want
    assert A.erasure_violations(df.limit(0)).count() == 0


def test_boundary_audit(spark):
    ok = ["command", "policy", "check", "append", "receipt"]
    rows = [
        ("good", "write", ok, ["e"], True, True, True, False),
        ("read", "read", ["command", "receipt"], [], False, False, False, None),
        ("late", "write", ["command", "policy", "append", "check", "receipt"], ["e"], True, True, True, False),
        ("denied", "write", ok, ["e"], True, False, False, True),
        ("none", None, None, None, None, None, None, None),
        ("empty", "write", ok, None, False, True, True, False),
        ("again", "read", ["command", "receipt", "command"], [], False, True, True, False),
    ]
    df = spark.createDataFrame(rows, "id string, kind string, stages array<string>, events array<string>, ledger_appended boolean, preflight_allowed boolean, validation_allowed boolean, direct_write boolean")
    got = sorted((r.id, r.code, r.stage or "") for r in A.boundary_audit(df, ["write"], ok, ["command", "receipt"], "check", "append").collect())
    unchecked = "ledger_append_without_event_policy_validation"
    assert got == sorted([
        ("late", "boundary_stage_order_invalid", ""), ("late", unchecked, ""),
        ("denied", "adapter_direct_memory_write", ""), ("denied", "ledger_append_after_policy_denial", ""), ("denied", unchecked, ""),
        ("none", "missing_boundary_stage", "command"), ("none", "missing_boundary_stage", "receipt"),
        ("empty", "mutation_without_events", ""), ("empty", "mutation_without_ledger_append", ""),
    ])
