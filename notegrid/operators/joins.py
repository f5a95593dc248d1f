"""Joins over memories, vectors and the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrid.storage import materialize


def attach_scores(memories: DataFrame, semantic: DataFrame, weight: float = 2.5, rest: float = 9.5) -> DataFrame:
    """semantic(id, semantic): a missing score leaves its weight out of the denominator."""
    return memories.select("id").join(semantic, "id", "left").select("id", "semantic", F.when(F.col("semantic").isNull(), rest).otherwise(rest + weight).alias("weight_sum"))


def triggered_feels(memories: DataFrame) -> DataFrame:
    """Feels of each source, newest first."""
    feels = memories.filter("type = 'feel' AND triggered_by IS NOT NULL").select(F.col("triggered_by").alias("source_id"), F.col("id").alias("feel_id"), "created")
    found = feels.join(memories.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("created"), "feel_id")).cast("long"))


def repair_digested(memories: DataFrame) -> DataFrame:
    """Sources of feels with what is to be done: missing, already, repaired."""
    sources = memories.filter("type = 'feel' AND triggered_by IS NOT NULL").select(F.col("triggered_by").alias("source_id")).distinct()
    known = memories.select(F.col("id").alias("source_id"), "digested")
    status = F.when(F.col("digested").isNull(), "missing").when(F.col("digested"), "already").otherwise("repaired")
    return sources.join(known, "source_id", "left").select("source_id", status.alias("status"))


def orphan_vectors(vectors: DataFrame, memories: DataFrame) -> DataFrame:
    return vectors.join(memories.select("id"), "id", "left_anti").select("id")


def vectors_to_do(memories: DataFrame, stored: DataFrame, pending: DataFrame) -> DataFrame:
    """Memories with no vector, or with one of another text; stored(id, content_hash); pending ones are skipped."""
    joined = memories.filter("trim(content) <> ''").select("id", F.sha2("content", 256).alias("h")).join(stored.select("id", "content_hash"), "id", "left")
    reason = F.when(F.col("content_hash").isNull(), "missing").when((F.col("content_hash") != "") & (F.col("content_hash") != F.col("h")), "stale")
    return joined.select("id", reason.alias("reason")).filter("reason IS NOT NULL").join(pending.select("id"), "id", "left_anti")


def plan_cascade(memories: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows to resolve with their plans: plans(related_bucket, resolved_by)."""
    ids = plans.select(F.explode(F.array_distinct(F.filter(F.array(F.trim("related_bucket"), F.trim("resolved_by")), lambda x: x.isNotNull() & ~x.isin("", "manual", "llm_judge")))).alias("id")).distinct()
    return memories.filter(~F.col("resolved") & ~F.col("type").isin("plan", "letter")).join(ids, "id", "left_semi")


def import_conflicts(incoming: DataFrame, memories: DataFrame) -> DataFrame:
    old = memories.select("id", F.col("name").alias("old_name"), F.col("created").alias("old_created"))
    return incoming.select("id", F.col("name").alias("new_name"), F.col("created").alias("new_created")).join(old, "id")


def apply_decisions(incoming: DataFrame, memories: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, action, new_id): skip by default, overwrite, keep_both under an id made from the old one, insert without conflict."""
    known = memories.select("id", F.lit(True).alias("known"))
    rows = incoming.select("id").join(known, "id", "left").join(decisions, "id", "left")
    action = F.when(F.col("known").isNull(), "insert").when(F.col("decision").isin("overwrite", "keep_both"), F.col("decision")).otherwise("skip")
    new_id = F.when(action == "keep_both", F.concat(F.lit("k"), F.substring(F.sha2("id", 256), 1, 12))).otherwise(F.col("id"))
    return rows.select("id", action.alias("action"), new_id.alias("new_id"))


def duplicate_pairs(marked: DataFrame, memories: DataFrame) -> DataFrame:
    """marked(id, dup_candidate, dup_score): unordered pairs of known rows, best score each."""
    pair = marked.select(F.least("id", "dup_candidate").alias("a"), F.greatest("id", "dup_candidate").alias("b"), "dup_score").filter("a <> b").groupBy("a", "b").agg(F.max("dup_score").alias("score"))
    names = memories.select("id", "name")
    with_a = pair.join(names.select(F.col("id").alias("a"), F.col("name").alias("a_name")), "a")
    return with_a.join(names.select(F.col("id").alias("b"), F.col("name").alias("b_name")), "b")


def surface_context(decisions: DataFrame, memories: DataFrame, most: int = 8) -> DataFrame:
    """decisions(session, pos, id, allowed, reasons): the first allowed rows of each session, and whether more were cut."""
    found = decisions.filter("allowed").join(memories.select("id", "name"), "id")
    by = Window.partitionBy("session")
    ranked = found.withColumn("rank", F.row_number().over(by.orderBy("pos")).cast("long")).withColumn("truncated", F.count(F.lit(1)).over(by) > most)
    return ranked.filter(F.col("rank") <= most).select("session", "rank", "id", "name", "truncated")


def state_key_candidates(keyed: DataFrame) -> DataFrame:
    """keyed(id, key, created, current): for each row the number of other current rows of its state key and the newest of them.

    A key's rows meet its two newest current rows, not one another; the whole list of a key is current_rows().
    """
    age = -F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("created"))
    now = keyed.filter("current").select("key", F.struct(age.alias("age"), "id").alias("r"))
    first = materialize(now.groupBy("key").agg(F.min("r").alias("first"), F.count(F.lit(1)).alias("n")), "first")
    second = now.join(first.hint("merge"), "key").filter(F.col("r") != F.col("first")).groupBy("key").agg(F.min("r").alias("second"))
    heads = materialize(first.join(second, "key", "left"), "heads")
    met = keyed.join(heads.hint("merge"), "key")
    own = F.col("current").cast("long")
    newest = F.when(F.col("first.id") == F.col("id"), F.col("second.id")).otherwise(F.col("first.id"))
    return met.select("id", (F.col("n") - own).alias("candidates"), newest.alias("newest")).filter("candidates > 0")


def current_rows(keyed: DataFrame) -> DataFrame:
    """(key, rank, id): the current rows of each state key, newest first."""
    return keyed.filter("current").select("key", "id", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("created"), "id")).cast("long").alias("rank"))


def supersession_chain(rows: DataFrame, most: int = 100) -> DataFrame:
    """rows(id, superseded_by, state_key), id unique: (id, current_id, hops, code) of every row that is superseded.

    code says why a chain has no current row: self_link, cycle (a row comes again within `most` hops), too_long,
    missing_target (it leads to no row), key_mismatch (two neighbours of it have different keys; blank ones fit all);
    else it is null. hops counts as far as the chain was followed. Blank ids and links are none.

    Paths are doubled: each round joins a path's last row to that row's own path, so about log2(most) written tables
    do. A path holds at most `most` + 1 ids, and as many as its chain is long where that is shorter.
    """
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    keyed = materialize(rows.filter(blank(F.col("id")).isNotNull()).select(blank(F.col("id")).alias("id"), blank(F.col("superseded_by")).alias("next"), blank(F.col("state_key")).alias("key")), "chains")
    links = keyed.filter("next IS NOT NULL")
    after = keyed.select(F.col("id").alias("next"), F.col("key").alias("next_key"), F.lit(True).alias("there"))
    mixed = F.coalesce(F.col("key") != F.col("next_key"), F.lit(False))
    paths = materialize(links.join(after.hint("merge"), "next", "left").select("id", F.array("next").alias("path"), F.col("there").isNull().alias("lost"), mixed.alias("mixed"), F.lit(True).alias("moved")), "chains")
    for _ in range((most + 1).bit_length()):
        ahead = paths.select(F.col("id").alias("at"), F.col("path").alias("more"), F.col("lost").alias("lost_on"), F.col("mixed").alias("mixed_on"))
        met = paths.withColumn("at", F.element_at("path", -1)).join(ahead.hint("merge"), "at", "left")
        open_ = F.col("more").isNotNull() & (F.size("path") <= most)
        path = F.when(open_, F.slice(F.concat("path", "more"), 1, most + 1)).otherwise(F.col("path"))
        paths = materialize(met.select("id", path.alias("path"), F.coalesce("lost_on", "lost").alias("lost"), (F.col("mixed") | F.coalesce("mixed_on", F.lit(False))).alias("mixed"), open_.alias("moved")), "chains")
        if not paths.filter("moved").limit(1).count():
            break
    walked = F.concat(F.array("id"), F.slice("path", 1, most))
    code = (
        F.when(F.col("id") == F.col("path")[0], "self_link")
        .when((F.size("path") > most) & (F.size(F.array_distinct(walked)) < F.size(walked)), "cycle")
        .when(F.size("path") > most, "too_long")
        .when(F.col("lost"), "missing_target")
        .when(F.col("mixed"), "key_mismatch")
    )
    return paths.select("id", F.when(code.isNull(), F.element_at("path", -1)).alias("current_id"), F.least(F.size("path"), F.lit(most)).cast("long").alias("hops"), code.alias("code"))


#: Kinds of rows that may be superseded.
ORDINARY = ("dynamic", "permanent")


def set_supersessions(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """rows(id, type, superseded_by, state_key), asked(seq, old_id, new_id, state_key), seq unique: what becomes of each.

    (seq, old_id, new_id, status, state_key): superseded, unchanged (the link is there already, with the key asked for),
    or the first rule that turns it down: blank_id, self_link, missing_old, missing_new, not_ordinary,
    already_superseded, historical_target, no_key, key_mismatch. state_key is what both rows then hold.

    Requests count in the order of seq. Links and keys are those before the batch, but for what its earlier accepted
    requests change: a row that one of them supersedes is no target any more, and has its link already; of requests
    for one target without a key the first that passes by itself names the key. Of requests for one old row that pass by
    themselves, the first stands for all: where it is turned down because of another one, the later ones are `deferred`, to be asked again.
    A request waits for the earlier one that supersedes its target, and holds if that doesn't, so it holds if the
    number of requests it waits for, one behind the other, is even; doubling counts them. An accepted target is
    current, so no accepted link closes a cycle.
    """
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    side = lambda p: rows.select(blank(F.col("id")).alias(f"{p}_id"), F.coalesce("type", F.lit("dynamic")).alias(f"{p}_type"), blank(F.col("superseded_by")).alias(f"{p}_next"), blank(F.col("state_key")).alias(f"{p}_key"))
    want = asked.select("seq", blank(F.col("old_id")).alias("old_id"), blank(F.col("new_id")).alias("new_id"), blank(F.col("state_key")).alias("key"))
    met = want.join(side("old").hint("merge"), "old_id", "left").join(side("new").hint("merge"), "new_id", "left")
    keys = F.array_distinct(F.array_compact(F.array("key", "old_key", "new_key")))
    again = F.when(F.col("key").isNull() | F.col("key").eqNullSafe(F.col("old_key")), "unchanged").otherwise("key_mismatch")
    reason = (
        F.when(F.col("old_id").isNull() | F.col("new_id").isNull(), "blank_id")
        .when(F.col("old_id") == F.col("new_id"), "self_link")
        .when(F.col("old_type").isNull(), "missing_old")
        .when(F.col("new_type").isNull(), "missing_new")
        .when(~F.col("old_type").isin(*ORDINARY) | ~F.col("new_type").isin(*ORDINARY), "not_ordinary")
        .when(F.col("old_next") == F.col("new_id"), again)
        .when(F.col("old_next").isNotNull(), "already_superseded")
        .when(F.col("new_next").isNotNull(), "historical_target")
        .when(F.size(keys) == 0, "no_key")
        .when(F.size(keys) > 1, "key_mismatch")
    )
    held = F.when(reason.isNull(), keys[0]).when(reason == "unchanged", F.col("old_key"))
    fixed = F.col("old_next").isNotNull() | F.coalesce(~reason.isin("historical_target", "no_key", "key_mismatch"), F.lit(False))
    judged = materialize(met.select("seq", "old_id", "new_id", "key", reason.alias("reason"), fixed.alias("fixed"), held.alias("state_key"), F.col("new_key").isNull().alias("fills")), "asked")
    named = judged.filter("reason IS NULL AND fills").groupBy("new_id").agg(F.min_by("state_key", "seq").alias("named"))
    fit = judged.join(named.hint("merge"), "new_id", "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("fills") & (F.col("named") != F.col("state_key")), "key_mismatch").otherwise(F.col("reason")))
    fit = materialize(fit.drop("named", "fills"), "asked")
    firsts = materialize(fit.filter("reason IS NULL").groupBy("old_id").agg(F.min("seq").alias("first"), F.min_by("new_id", "seq").alias("target")), "asked")
    # waits: the request that supersedes this one's target and comes before it
    open_ = firsts.select(F.col("first").alias("seq"), F.col("target"))
    waits = materialize(open_.join(firsts.select(F.col("old_id").alias("target"), F.col("first").alias("before")).hint("merge"), "target", "left").select("seq", F.when(F.col("before") < F.col("seq"), F.col("before")).alias("before")), "waits")
    waits = waits.withColumn("odd", F.col("before").isNotNull())
    while not waits.filter("before IS NOT NULL").isEmpty():
        ahead = waits.select(F.col("seq").alias("before"), F.col("before").alias("further"), F.col("odd").alias("odd_on"))
        met = waits.join(ahead.hint("merge"), "before", "left")
        waits = materialize(met.select("seq", F.col("further").alias("before"), (F.col("odd") != F.coalesce("odd_on", F.lit(False))).alias("odd")), "waits")
    kept = materialize(waits.filter("NOT odd").select("seq").join(fit.hint("merge"), "seq").select(F.col("seq").alias("own_seq"), "old_id", F.col("new_id").alias("own_target"), F.col("state_key").alias("own_key")), "kept")
    own = kept.dropDuplicates(["old_id"])  # where numbers repeat, what holds comes several times
    out = fit.join(own.hint("merge"), "old_id", "left").join(kept.select(F.col("old_id").alias("new_id"), F.col("own_seq").alias("gone_seq")).hint("merge"), "new_id", "left")
    reason, late = F.col("reason"), F.col("own_seq") < F.col("seq")
    same = F.when(F.col("key") != F.col("own_key"), "key_mismatch").otherwise("unchanged")
    status = (
        F.when(F.col("fixed"), reason)
        .when(late, F.when(F.col("own_target") == F.col("new_id"), same).otherwise("already_superseded"))
        .when((reason == "historical_target") | (F.col("gone_seq") < F.col("seq")), "historical_target")
        .when(reason.isNotNull(), reason)
        .when(F.col("own_seq") == F.col("seq"), "superseded")
        .otherwise("deferred")
    )
    key = F.when(status == "superseded", F.col("state_key")).when(status == "unchanged", F.when(late, F.col("own_key")).otherwise(F.col("state_key")))
    return out.select("seq", "old_id", "new_id", status.alias("status"), key.alias("state_key"))


def preservation(source: DataFrame, target: DataFrame) -> DataFrame:
    """Violations between source and target records(trace_id, kind, state, tombstone, anchor)."""
    t = target.select("trace_id", *[F.col(c).alias(f"t_{c}") for c in ("kind", "state", "tombstone", "anchor")], F.lit(True).alias("there"))
    changed = [F.when(~F.col(c).eqNullSafe(F.col(f"t_{c}")), f"{c}_changed") for c in ("kind", "state", "tombstone", "anchor")]
    codes = F.when(F.col("there").isNull(), F.array(F.lit("missing_target"))).otherwise(F.filter(F.array(*changed), lambda x: x.isNotNull()))
    return source.join(t, "trace_id", "left").select("trace_id", F.explode(codes).alias("code"))


def rebuild_diff(canonical: DataFrame, projected: DataFrame) -> DataFrame:
    """Ids that a projection lost or made up."""
    lost = canonical.select("id").join(projected.select("id"), "id", "left_anti").select("id", F.lit("lost").alias("change"))
    return lost.unionByName(projected.select("id").join(canonical.select("id"), "id", "left_anti").select("id", F.lit("created").alias("change")))


def vector_manifest(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """stored(id, valid): counts of missing, orphan and malformed vectors with their first 20 ids."""
    both = expected.select("id", F.lit(True).alias("want")).join(stored, "id", "full_outer")
    kind = F.when(F.col("valid").isNull(), "missing").when(F.col("want").isNull(), "orphan").when(~F.col("valid"), "malformed")
    found = both.select("id", kind.alias("kind")).filter("kind IS NOT NULL")
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("id"))).filter("n <= 20")
    heads = ranked.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("first_ids"))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(heads, "kind")


def time_ripple(touched: DataFrame, memories: DataFrame, hours: int = 48, most: int = 5, credit: float = 0.3) -> DataFrame:
    """Credit for up to `most` rows created within `hours` of each touched row (by id).

    Of days' hours, hours' minutes and moments only the most + 1 smallest ids are kept, as no touched row takes more. A
    span is its whole hours, the whole minutes of its two edge hours, and the moments of its two edge minutes. A day is
    one row with the ids of its hours, an hour one with those of its minutes; an asked hour or minute takes its own
    part of the few such rows it meets, and isn't dealt out into all the hours and minutes that it covers.
    """
    few = most + 1
    moment = lambda c: F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(c))
    minute, hour, span, inner = 60_000_000, 3_600_000_000, hours * 3_600_000_000, hours - 1

    def smallest(rows: DataFrame, key: str) -> DataFrame:
        once = rows.select(key, "id").distinct()
        return once.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("id"))).filter(F.col("n") <= few).select(key, "id")

    def held(rows: DataFrame, part: str, whole: str, width: int) -> DataFrame:
        return rows.groupBy(F.floor(F.col(part) / width).alias(whole)).agg(F.array_sort(F.collect_list(F.struct("id", part))).alias("held"))

    def first_of(held: str, keep) -> Column:
        return F.slice(F.array_distinct(F.transform(F.filter(held, keep), lambda x: x["id"])), 1, few)

    def least(*ids: str) -> Column:
        return F.slice(F.array_sort(F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in ids]))), 1, few)

    target = memories.filter(~F.col("pinned") & ~F.col("type").isin("permanent", "feel", "plan", "letter", "i")).select(moment("created").alias("t"), "id").dropna()
    moments = materialize(smallest(target, "t"), "moments")
    whole = materialize(held(smallest(moments.select(F.floor(F.col("t") / minute).alias("m"), "id"), "m"), "m", "h", 60), "hours")
    days = held(whole.select("h", F.explode(F.slice(F.array_distinct("held.id"), 1, few)).alias("id")), "h", "d", 24)
    asked = materialize(touched.select("id", moment("created").alias("at")), "asked")
    times = materialize(asked.select("at").distinct().select("at", F.floor(F.col("at") / minute).alias("m"), F.floor(F.col("at") / hour).alias("h")), "times")
    edges = times.select("m", "h").distinct()
    # hours wholly inside for any moment of hour h; what hours h - `hours` and h + `hours` add comes by minutes and moments
    around = edges.select("h").distinct().withColumn("d", F.explode(F.sequence(F.floor((F.col("h") - inner) / 24), F.floor((F.col("h") + inner) / 24))))
    inside = around.join(days, "d").select("h", first_of("held", lambda x: F.abs(x["h"] - F.col("h")) <= inner).alias("inside"))
    inside = inside.groupBy("h").agg(F.flatten(F.collect_list("inside")).alias("inside"))  # few days an hour
    early = whole.select((F.col("h") + hours).alias("h"), "held").hint("merge")
    late = whole.select((F.col("h") - hours).alias("h"), "held").hint("merge")
    by_minute = edges.join(early, "h", "left").select("m", "h", first_of("held", lambda x: x["m"] > F.col("m") - 60 * hours).alias("early"))
    by_minute = by_minute.join(late, "h", "left").select("m", "h", "early", first_of("held", lambda x: x["m"] < F.col("m") + 60 * hours).alias("late"))
    by_minute = materialize(by_minute.join(inside, "h", "left").select("m", least("inside", "early", "late").alias("around")), "around")
    ends = times.withColumn("m", F.explode(F.array(F.col("m") - 60 * hours, F.col("m") + 60 * hours)))
    close = moments.withColumn("m", F.floor(F.col("t") / minute))
    by_moment = ends.join(close, "m").filter(F.abs(F.col("t") - F.col("at")) <= span).select("at", "id")
    by_moment = smallest(by_moment, "at").groupBy("at").agg(F.collect_list("id").alias("close"))
    near = materialize(times.join(by_minute, "m").join(by_moment, "at", "left").select("at", least("around", "close").alias("near")), "near")
    first = asked.join(near.hint("merge"), "at").select(F.explode(F.slice(F.filter("near", lambda x: x != F.col("id")), 1, most)).alias("id"))
    return first.groupBy("id").agg(F.round(F.sum(F.lit(credit)), 1).alias("credit"))


def journal_audit(plan: DataFrame, journal: DataFrame) -> DataFrame:
    """Planned against observed projection keys(command, key): missing, duplicate or unexpected."""
    a = plan.groupBy("command", "key").agg(F.count(F.lit(1)).alias("planned"))
    b = journal.groupBy("command", "key").agg(F.count(F.lit(1)).alias("seen"))
    code = F.when(F.col("seen").isNull(), "missing").when(F.col("planned").isNull(), "unexpected").when(F.col("seen") > F.col("planned"), "duplicate")
    return a.join(b, ["command", "key"], "full_outer").select("command", "key", code.alias("code")).filter("code IS NOT NULL")


def first_of_kind(new: DataFrame, old: DataFrame) -> DataFrame:
    """new(id, pos, tags): rows whose tags share nothing with old rows nor with earlier new ones."""
    tags = new.select("id", "pos", F.explode("tags").alias("tag"))
    earlier = tags.groupBy("tag").agg(F.min("pos").alias("first_pos"))
    known = old.select(F.explode("tags").alias("tag")).distinct().withColumn("known", F.lit(True))
    seen = tags.join(earlier, "tag").join(known, "tag", "left").filter(F.col("known") | (F.col("first_pos") < F.col("pos")))
    return new.join(seen.select("id").distinct(), "id", "left_anti").select("id")


def observe(entries: DataFrame, memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """entries(command, kind, id): observed, missing or unknown."""
    rows = entries.join(memories.select("id", F.lit(True).alias("m")), "id", "left").join(vectors.select("id", F.lit(True).alias("v")), "id", "left")
    status = F.when(F.col("kind") == "memory", F.when(F.col("m"), "observed").otherwise("missing")).when(F.col("kind") == "vector", F.when(F.col("v"), "observed").otherwise("missing")).otherwise("unknown")
    return rows.select("command", "kind", "id", status.alias("status"))


def merge_decision(pairs: DataFrame) -> DataFrame:
    """pairs of an existing and an incoming event (hash, term, index of each): which of them holds."""
    older = F.struct("in_term", "in_index") < F.struct("ex_term", "ex_index")
    newer = F.struct("in_term", "in_index") > F.struct("ex_term", "ex_index")
    rule = F.when(F.col("ex_hash") == F.col("in_hash"), "prefer_existing").when(newer, "prefer_new").when(older, "keep_both").otherwise("mark_conflict")
    return pairs.select("id", rule.alias("decision"))


def lineage(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """edges(child, parent), start(id): all ancestors of each start with their least distance.

    Where all children are starts, distances are doubled: all within `reach` are known, and those at just `reach`
    lead on to what is within `reach` of them, so the rounds are as many as the longest least distance has binary
    digits. Otherwise a round takes a generation of the starts alone. It goes on until a round finds no new pair (or
    up to the distance `most`), so a cycle ends by itself; each round is a written table.
    """
    steps = edges.filter("child IS NOT NULL AND parent IS NOT NULL").select(F.col("child").alias("id"), F.col("parent").alias("at")).distinct()
    steps = materialize(steps.withColumn("depth", F.lit(1).cast("long")), "lineage")
    own = materialize(start.select("id").distinct(), "lineage")
    whole = steps.join(own, "id", "left_anti").isEmpty()
    found = front = steps if whole else steps.join(own, "id", "left_semi")
    if most is not None and most < 1:
        return found.limit(0).select("id", F.col("at").alias("ancestor"), "depth")
    reach = 1
    while most is None or reach < most:
        on = (found if whole else steps).select(F.col("id").alias("at"), F.col("at").alias("further"), F.col("depth").alias("more"))
        ahead = front.filter(F.col("depth") == reach).join(on, "at").select("id", F.col("further").alias("at"), (F.col("depth") + F.col("more")).alias("depth"))
        if most is not None:
            ahead = ahead.filter(F.col("depth") <= most)
        least = ahead.groupBy("id", "at").agg(F.min("depth").alias("depth"))
        front = materialize(least.join(found.select("id", "at"), ["id", "at"], "left_anti"), "lineage")
        if front.isEmpty():
            break
        found, reach = found.unionByName(front), 2 * reach if whole else reach + 1
    return found.select("id", F.col("at").alias("ancestor"), "depth")


def duplicate_events(events: DataFrame) -> DataFrame:
    """Ids that more than one event has, with their number; the operators of the graph below take ids as unique."""
    return events.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def parent_links(events: DataFrame) -> DataFrame:
    """events(id, seq, parents): (child, pos, parent) of the parents that are events, at their place in the list (from 0).

    A parent that is named twice counts where it comes first; null lists and ids, unknown parents and an event that
    names itself give nothing.
    """
    named = events.select(F.col("id").alias("child"), F.posexplode("parents").alias("pos", "parent")).filter("parent IS NOT NULL AND child <> parent")
    first = named.groupBy("child", "parent").agg(F.min("pos").alias("pos"))
    known = events.filter("id IS NOT NULL").select(F.col("id").alias("parent")).distinct()
    return first.join(known, "parent", "left_semi").select("child", "pos", "parent")


def event_children(events: DataFrame) -> DataFrame:
    """(parent, child, seq): the events that name a known event as a parent, once each; seq is their order."""
    seqs = events.select(F.col("id").alias("child"), "seq")
    return parent_links(events).join(seqs, "child").select("parent", "child", "seq")


def actor_events(events: DataFrame) -> DataFrame:
    """events(id, seq, actor): (actor, place, id), the place of each event among its actor's, in order of seq.

    Places come from counts of ranges of (actor, seq), so an actor with most of the events fills many tasks.
    """
    laid = materialize(events.select("id", "seq", "actor").repartitionByRange("actor", "seq", "id").sortWithinPartitions("actor", "seq", "id").withColumn("part", F.spark_partition_id()), "actors")
    by = Window.partitionBy("part", "actor").orderBy("seq", "id")
    sizes = laid.groupBy("actor", "part").agg(F.count(F.lit(1)).alias("n"))  # a row for each actor and range that it lies in
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("actor").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    placed = laid.withColumn("k", F.row_number().over(by)).alias("l")
    met = placed.join(before.alias("b"), (F.col("l.part") == F.col("b.part")) & F.col("l.actor").eqNullSafe(F.col("b.actor")))
    return met.select("l.actor", (F.col("k") + F.coalesce("before", F.lit(0))).cast("long").alias("place"), "l.id")


#: Stands behind the path of an event, so that it comes after all whose paths go on from there.
AFTER_ALL = 2147483647


def least_paths(links: DataFrame, start: DataFrame) -> DataFrame:
    """links(child, pos, parent), start(id): (id, ancestor, path), each start's ancestors and itself with the least path to them.

    A path is the list of places that lead from the start to the ancestor; the least one by place is that by which a
    depth-first walk comes there first. A path whose end has a lesser one already isn't followed any further, so each
    round only goes on from what the last one bettered, and a cycle ends by itself (in one the order is still that
    of the least paths). A round is a written table; there are as many as the longest least path is long.
    """
    best = materialize(start.select("id").distinct().select("id", F.col("id").alias("ancestor"), F.array().cast("array<int>").alias("path")), "paths")
    front = best
    while True:
        ahead = front.select("id", F.col("ancestor").alias("child"), "path").join(links.hint("merge"), "child")
        found = ahead.select("id", F.col("parent").alias("ancestor"), F.array_append("path", F.col("pos")).alias("path")).groupBy("id", "ancestor").agg(F.min("path").alias("path"))
        held = best.select("id", "ancestor", F.col("path").alias("had"))
        front = materialize(found.join(held.hint("merge"), ["id", "ancestor"], "left").filter("had IS NULL OR path < had").drop("had"), "paths")
        if front.isEmpty():
            return best
        kept = best.join(front.select("id", "ancestor").hint("merge"), ["id", "ancestor"], "left_anti")
        best = materialize(kept.unionByName(front), "paths")


def by_place(rows: DataFrame) -> DataFrame:
    """rows(id, pos, k, source): (id, place, source), each source of an id once, where it comes first by (pos, k)."""
    first = rows.repartition("id").groupBy("id", "source").agg(F.min(F.struct("pos", "k")).alias("first"))
    return first.select("id", F.row_number().over(Window.partitionBy("id").orderBy("first")).cast("long").alias("place"), "source")


def chains_by_generation(links: DataFrame, ids: DataFrame, own: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """links(child, pos, parent), ids(id), own(id, k, source): (chains(id, place, source), rest(id)).

    An event's turn comes when all its parents have theirs, so its chain is worked out once, from those of its
    parents; what is written is the chains and the links, whatever the number of ancestors. A round takes a
    generation; rest are the events on a cycle or behind one, whose turn never comes.
    """
    need = materialize(links.groupBy("child").agg(F.count(F.lit(1)).alias("n")), "need")
    front = materialize(ids.join(need, F.col("id") == F.col("child"), "left_anti").select("id", F.array().cast("array<int>").alias("gens")), "turn")
    rest = materialize(ids.join(front, "id", "left_anti"), "rest")
    waiting, chains = None, []
    while not front.isEmpty():
        rows = own.join(front, "id", "left_semi").select("id", F.lit(AFTER_ALL).alias("pos"), "k", "source")
        used = sorted(r[0] for r in front.select(F.explode("gens")).distinct().collect())  # numbers of generations
        if used:
            known = chains[used[0]]
            for g in used[1:]:
                known = known.unionByName(chains[g])
            asked = links.join(front.select(F.col("id").alias("child")), "child", "left_semi")
            rows = rows.unionByName(asked.join(known.withColumnRenamed("id", "parent"), "parent").select(F.col("child").alias("id"), "pos", F.col("place").alias("k"), "source"))
        arrived = links.join(front.select(F.col("id").alias("parent")), "parent", "left_semi").groupBy("child").agg(F.count(F.lit(1)).alias("got")).withColumn("gens", F.array(F.lit(len(chains))))
        chains.append(materialize(by_place(rows), "chains"))
        if waiting is not None:
            both = waiting.unionByName(arrived).groupBy("child")
            arrived = both.agg(F.sum("got").alias("got"), F.flatten(F.collect_list("gens")).alias("gens"))  # one of each generation
        told = materialize(arrived.join(need, "child"), "turn")
        front = told.filter("got = n").select(F.col("child").alias("id"), "gens")
        waiting = told.filter("got < n").select("child", "got", "gens")
        rest = rest.join(front, "id", "left_anti")
        if len(chains) % 16 == 0:
            rest = materialize(rest, "rest")
    out = chains[0] if chains else None
    for c in chains[1:]:
        out = out.unionByName(c)
    return out, materialize(rest, "rest")


def source_chains(events: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """events(id, seq, parents, sources): (id, place, source), the sources that each event (or those of start(id)) comes from.

    They are those of its parents, depth first in the order of the lists, and then its own; each source once, where
    it comes first. Null sources and starts that aren't events give nothing. Events on a cycle or behind one go by
    their least paths, a row for each ancestor; all others by their parents' chains.
    """
    ids = events.filter("id IS NOT NULL").select("id").distinct()
    asked = materialize(ids if start is None else ids.join(start.select("id"), "id", "left_semi"), "starts")
    links = materialize(parent_links(events), "links")
    own = materialize(events.select("id", F.posexplode("sources").alias("k", "source")).filter("id IS NOT NULL AND source IS NOT NULL").withColumn("k", F.col("k").cast("long")), "own")
    used, needed = asked, links
    if start is not None:  # they and their ancestors
        front = asked
        while not front.isEmpty():
            above = links.join(front.select(F.col("id").alias("child")), "child", "left_semi").select(F.col("parent").alias("id")).distinct()
            front = materialize(above.join(used, "id", "left_anti"), "above")
            used = materialize(used.unionByName(front), "used")
        needed = materialize(links.join(used.select(F.col("id").alias("child")), "child", "left_semi"), "links")
    chains, rest = chains_by_generation(needed, used, own)
    behind = asked.join(rest, "id", "left_semi")
    out = by_place(own.limit(0).withColumn("pos", F.lit(AFTER_ALL))) if chains is None else chains if start is None else chains.join(asked, "id", "left_semi")
    if behind.isEmpty():
        return out
    order = F.struct(F.array_append("path", F.lit(AFTER_ALL)).alias("path"), "k")
    first = least_paths(needed, behind).join(own.withColumnRenamed("id", "ancestor").hint("merge"), "ancestor").groupBy("id", "source").agg(F.min(order).alias("first"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("first"))
    return out.unionByName(first.select("id", place.cast("long").alias("place"), "source"))
