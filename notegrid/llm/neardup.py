"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full sets.

1. Every whole text gives the set of its distinct word shingles (64-bit hashes) and two small collections
   of half-keys, SIDE each of ROWS minhash values. Texts of equal sets are one class from then on.
2. The SIDE x SIDE table keys combine one half-key of either collection: 2 * SIDE * ROWS minhash values do
   the work of SIDE * SIDE * 2 * ROWS. A pair at a similarity of 0.8 shares a key with probability 0.9996,
   above it sooner. Half-keys that nobody shares are dropped before the keys are formed.
3. Each bucket has a hub, the member that meets most others over all its buckets; every member is compared
   with its hubs, so there are no more comparisons than rows in buckets. Members under one hub are a group.
   Links with hubs give components.
4. What a group holds of different components is settled by what the members have in common with their hub h:
   |x & y| is at most min(|x & h|, |y & h|) + min(s(x), s(y)), where s counts the shingles outside h that
   another member has too. Only pairs whose bound reaches the threshold are compared, found by a join on
   steps of |x & h|; all others of the group surely aren't linked. Copies with edits of their own, or texts
   that share a passage, leave next to none. No bucket is cut, and no pair of one component is compared again.
5. Components are the fixed point of minimum labels with pointer jumping.

Groups of one hub are dealt in slices of about SLICE members, so a hub with a third of all rows fills many tasks.

Defined results: a text that is null or has no word has an empty set and no links; fewer words than a
shingle make one shingle of the whole; very long texts are taken whole; rows without doc_id take no part
(component_id null, kept true); repeated rows are linked; rows that repeat a doc_id with another text follow
their own text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrid.llm.common import map_text, materialize
from notegrid.storage import Workspace

SIDE, ROWS = 12, 3
#: Members of a group that are dealt together, about.
SLICE = 512
#: Steps of what members share with their hub.
STEPS = 64
#: Bytes of words that a worker remembers, about.
REMEMBER = 24 << 20
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_rng = np.random.default_rng(20)
_ODD = ((_rng.integers(0, 2**63, 2 * SIDE * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1))[:, None]
_XOR = _rng.integers(0, 2**63, 2 * SIDE * ROWS, dtype=np.uint64)[:, None]
_words: dict[bytes, int] = {}
_held = 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[5]
    x = (x ^ (x >> np.uint64(33))) * _MIX[6]
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; A-Z is lower-cased, words end at ASCII white space."""
    import xxhash

    global _words, _held
    cut = text.encode("utf-8", "surrogatepass").lower().split()
    if not cut:
        return np.zeros(0, np.uint64)
    if _held > REMEMBER:
        _words, _held = {}, 0
    held, digest = _words, xxhash.xxh3_64_intdigest
    try:
        ids = [held[w] for w in cut]
    except KeyError:
        for w in set(cut):
            if w not in held:
                held[w] = digest(w)
                _held += len(w) + 150
        ids = [held[w] for w in cut]
    h = np.array(ids, np.uint64)
    n = len(h)
    take = min(size, n)
    total = np.full(n - take + 1, np.uint64(take * int(_MIX[4]) % 2**64))
    for k in range(take):
        total = _mixed(total + h[k : n - take + 1 + k] * _MIX[k % 4])
    return np.unique(total)


def half_keys(own: np.ndarray) -> np.ndarray:
    """2 * SIDE half-keys, each of ROWS minhash values."""
    low = np.full(len(_XOR), np.uint64(2**64 - 1))
    for s in range(0, len(own), 512):
        low = np.minimum(low, ((own[s : s + 512] ^ _XOR) * _ODD).min(axis=1))
    low = low.reshape(-1, ROWS)
    key = np.arange(len(low), dtype=np.uint64)
    for r in range(ROWS):
        key = _mixed(key * _MIX[0] + low[:, r])
    return key.view(np.int64)


def set_digest(own: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(own.tobytes())


SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("halves", T.ArrayType(T.LongType()))])


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, set size, 128-bit digest of the set, half-keys (both null for an empty set)."""

    def run(texts: list[str], part) -> dict:
        sets = [shingle_set(t, size) for t in texts]
        return {"doc_id": part.column("doc_id"), "n": [len(s) for s in sets], "digest": [set_digest(s) if len(s) else None for s in sets], "halves": [half_keys(s) if len(s) else None for s in sets]}

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SIGNED)


def components(edges: DataFrame, keep: Workspace | None = None) -> DataFrame:
    """(id, component): the smallest id reachable from each id of edges(a, b)."""
    write = keep.write if keep else materialize
    both = write(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")), "edges")
    labels = write(both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("id"), F.least("u", "w").alias("component")), "labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)")).alias("s")).first()["s"]
        if now is None or now == total:
            return labels
        total = now
        near = both.join(labels, both["v"] == labels["id"]).select(F.col("u").alias("id"), "component")
        up = labels.select(F.col("id").alias("top"), F.col("component").alias("higher"))
        jump = labels.join(up, labels["component"] == up["top"]).select("id", F.col("higher").alias("component"))
        labels = write(labels.unionByName(near).unionByName(jump).groupBy("id").agg(F.min("component").alias("component")), "labels")


#: Size of the filter on wanted ids, in bits; 8 MB, whatever the input.
FILTER_BITS = 1 << 26


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def marked(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows(doc_id, ...) with a boolean column, false where the doc_id surely isn't one of ids(doc_id).

    It is read from a bitmap of hashed ids of fixed size, FILTER_BITS / 8 bytes at most.
    """
    h, bucket, bits = (unused(rows, x) for x in ("_slot", "_bucket", "_bits"))
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS))
    marks = ids.select(slot.alias(h)).groupBy(F.bitmap_bucket_number(h).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias(bits))
    near = rows.withColumn(h, slot).join(F.broadcast(marks), F.bitmap_bucket_number(h) == F.col(bucket), "left")
    hit = F.expr(f"getbit(cast(conv(hex(substring({bits}, cast(bitmap_bit_position({h}) div 8 as int) + 1, 1)), 16, 10) as bigint), cast(bitmap_bit_position({h}) % 8 as int)) = 1")
    return near.withColumn(column, F.coalesce(hit, F.lit(False))).drop(h, bucket, bits)


def picked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the documents with a doc_id of wanted(doc_id, ...), beside the columns of wanted; few other texts are shuffled."""
    near = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted, "_near")
    # an inner join on distinct ids stays above the filter; a semi join would be pushed below it
    return near.filter("_near").drop("_near").join(wanted, "doc_id")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of gone(doc_id); rows that surely stay aren't shuffled. Other columns, of any name, stay."""
    flag, other = unused(docs, "_near"), unused(docs, "_gone")
    near = marked(docs, gone, flag)
    left_out = gone.select(F.col("doc_id").alias(other)).distinct()
    doubtful = near.filter(flag).drop(flag).join(left_out.hint("merge"), F.col("doc_id") == F.col(other), "left_anti")
    return near.filter(~F.col(flag)).drop(flag).unionByName(doubtful)


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, own) of wanted(doc_id, digest, id): the set of the text that has the digest; repeated rows repeat."""

    def run(texts: list[str], part) -> dict:
        sets = [shingle_set(t, size) for t in texts]
        fits = [set_digest(s) == d for s, d in zip(sets, part.column("digest").to_pylist(), strict=True)]
        return {"id": part.column("id"), "own": [s.view(np.int64) if ok else None for s, ok in zip(sets, fits, strict=True)]}

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("own", T.ArrayType(T.LongType(), False))])
    return map_text(picked(docs, wanted), run, schema).filter("own IS NOT NULL")


def sliced(pairs: DataFrame, keep: Workspace) -> DataFrame:
    """pairs(hub, id, ...) with the number of slices of each hub and the slice of each id."""
    counts = keep.write(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices")), "slices")
    return pairs.join(counts.hint("merge"), "hub").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")))


def beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(hub, slice, slices, id, ...) with the sets of either side, own and hub_own; a hub's set goes once to each of its slices."""
    heads = pairs.select("hub", "slices").distinct().join(sets.select(F.col("id").alias("hub"), F.col("own").alias("hub_own")), "hub")
    heads = heads.select("hub", "hub_own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    return pairs.join(sets, "id").join(heads.hint("merge"), ["hub", "slice"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs of sliced() with the sizes n and hub_n of the sets and the size of what both have."""
    return beside(pairs, sets).select(*pairs.columns, F.size("own").cast("long").alias("n"), F.size("hub_own").cast("long").alias("hub_n"), F.size(F.array_intersect("own", "hub_own")).cast("long").alias("both"))


def linked(percent: int):
    return (100 + percent) * F.col("both") >= percent * (F.col("n") + F.col("hub_n"))


def hub_pairs(classes: DataFrame, keep: Workspace) -> DataFrame:
    """(hub, id): each class id with the hubs of its buckets."""
    # half-keys that nobody shares can't be part of a shared table key
    halves = classes.select("id", F.posexplode("halves").alias("at", "half"))
    met = halves.groupBy("half").count().filter("count > 1").select("half")
    left, right = F.collect_list(F.when(F.col("at") < SIDE, F.col("half"))), F.collect_list(F.when(F.col("at") >= SIDE, F.col("half")))
    sides = halves.join(met.hint("merge"), "half").groupBy("id").agg(left.alias("left"), right.alias("right"))  # SIDE each at most
    keys = keep.write(sides.select("id", F.explode(F.flatten(F.transform("left", lambda a: F.transform("right", lambda b: F.xxhash64(a, b))))).alias("key")), "keys")
    # read from written tables, the rows of a hot key can be split in the joins
    sizes = keep.write(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    rows = keep.write(keys.join(sizes.hint("merge"), "key"), "buckets")
    meets = rows.groupBy("id").agg(F.sum("size").alias("meets"))
    rows = keep.write(rows.join(meets, "id").select("key", "id", F.struct((-F.col("meets")).alias("m"), F.xxhash64("id").alias("o"), "id").alias("place")), "places")
    hubs = keep.write(rows.groupBy("key").agg(F.min("place").alias("h")).select("key", F.col("h.id").alias("hub")), "hubs")
    return rows.join(hubs.hint("merge"), "key").filter("id <> hub").select("hub", "id").distinct()


def open_groups(stats: DataFrame, labels: DataFrame, percent: int, keep: Workspace) -> DataFrame:
    """Members of the groups that hold several components: hub, hub_n, slices, slice, id, n, both, lone (not linked with the hub), comp."""
    rows = stats.select("hub", "hub_n", "slices", "slice", "id", "n", "both", (~linked(percent)).alias("lone"))
    now = keep.write(rows.join(labels.hint("merge"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), "members")
    mixed = keep.write(now.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("hub"), "mixed")
    return keep.write(now.join(mixed.hint("merge"), "hub", "left_semi"), "open")


def with_shared(members: DataFrame, sets: DataFrame, keep: Workspace) -> DataFrame:
    """members with s: how many of their shingles outside the hub's set another member of the group has too."""
    outside = keep.write(beside(members, sets).select("hub", "id", F.explode(F.array_except("own", "hub_own")).alias("shingle")), "outside")
    shared = keep.write(outside.groupBy("hub", "shingle").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("hub", "shingle"), "shared")
    counts = outside.join(shared.hint("merge"), ["hub", "shingle"], "left_semi").groupBy("hub", "id").agg(F.count(F.lit(1)).alias("s"))
    return members.join(counts, ["hub", "id"], "left").withColumn("s", F.coalesce("s", F.lit(0)).cast("long"))


def bounded_pairs(members: DataFrame, percent: int, keep: Workspace) -> DataFrame:
    """(hub, id): pairs of members of one group and different components whose bound allows a link.

    One of the two (here the hub) isn't linked with the group's hub. Members stand in steps of what they share with
    the group's hub, STEPS at most; the bounds of a step tell whether a member has to meet any of it.
    """
    held = keep.write(members.withColumn("step", F.floor(F.col("both") * STEPS / (F.col("hub_n") + 1))), "profiles")
    reach = lambda n, both, s: (100 + percent) * (F.least("x_both", both) + F.least("x_s", s)) >= percent * (F.col("x_n") + n)
    steps = held.groupBy("hub", "step").agg(F.max("both").alias("both"), F.min("n").alias("n"), F.max("s").alias("s"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    steps = keep.write(steps.groupBy("hub").agg(F.collect_list(F.struct("step", "both", "n", "s", "lo", "hi")).alias("steps")), "steps")  # STEPS a hub at most
    lone = held.filter("lone").select("hub", "slices", *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "both", "s", "comp")])
    near = F.filter("steps", lambda t: reach(t["n"], t["both"], t["s"]) & ((t["lo"] != F.col("x_comp")) | (t["hi"] != F.col("x_comp"))))
    asked = lone.join(steps.hint("merge"), "hub").withColumn("t", F.explode(near)).withColumn("step", F.col("t.step")).drop("t", "steps")
    asked = keep.write(asked.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices"), "asked")
    once = ~F.col("lone") | (F.col("x_id") < F.col("id"))
    met = asked.join(held.drop("slices", "hub_n").hint("merge"), ["hub", "step", "slice"]).filter((F.col("comp") != F.col("x_comp")) & once & reach(F.col("n"), F.col("both"), F.col("s")))
    return met.select(F.col("x_id").alias("hub"), "id").distinct()


def joined_labels(labels: DataFrame, links: DataFrame, keep: Workspace) -> DataFrame:
    """labels(id, component) after new links(a, b): components of a graph of components, then both steps in one."""
    side = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"top_{c}"))
    named = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("top_a", "a").alias("a"), F.coalesce("top_b", "b").alias("b"))
    tops = components(named.filter("a <> b").distinct(), keep).select(F.col("id").alias("component"), F.col("component").alias("higher"))
    lone = tops.join(labels.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("higher").alias("component"))
    return keep.write(labels.join(tops, "component", "left").select("id", F.coalesce("higher", "component").alias("component")).unionByName(lone), "labels")


def with_digest(docs: DataFrame, column: str, size: int = 5) -> DataFrame:
    """docs with the digest of each row's set (null for an empty one) in a column of its own."""

    def run(texts: list[str], part) -> dict:
        sets = [shingle_set(t, size) for t in texts]
        return {c: part.column(c) for c in part.schema.names} | {column: [set_digest(s) if len(s) else None for s in sets]}

    return map_text(docs, run, T.StructType([*docs.schema.fields, T.StructField(column, T.BinaryType())]))


def link(docs: DataFrame, size: int = 5, percent: int = 80, digests: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept; with `digests` also the digest of the row's set."""
    keep = Workspace(docs.sparkSession, "neardup")
    signed = materialize(signatures(docs, size), "signed")
    known = signed.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("halves").alias("halves"))
    classes = keep.write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    pairs = keep.write(sliced(keep.write(hub_pairs(classes, keep), "pairs"), keep), "sliced")
    ids = pairs.select(F.col("hub").alias("id")).union(pairs.select("id")).distinct()
    wanted = keep.write(classes.join(ids, "id").select("doc_id", "digest", "id"), "wanted")
    sets = keep.write(shingle_sets(docs, wanted, size), "sets")
    if known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("count")).filter("count > 1").limit(1).count():  # repeated rows
        sets = keep.write(sets.dropDuplicates(["id"]), "sets")

    stats = keep.write(compared(pairs, sets), "compared")
    labels = components(stats.filter(linked(percent)).select(F.col("hub").alias("a"), F.col("id").alias("b")), keep)
    members = open_groups(stats, labels, percent, keep)
    if members.limit(1).count():
        left = keep.write(bounded_pairs(with_shared(members, sets, keep), percent, keep), "pairs")
        found = keep.write(compared(keep.write(sliced(left, keep), "sliced"), sets).filter(linked(percent)).select(F.col("hub").alias("a"), F.col("id").alias("b")), "links")
        labels = joined_labels(labels, found, keep)

    # the component of a class is named by its smallest doc_id
    named = keep.write(classes.select("id", "digest", "doc_id").join(labels.hint("merge"), "id"), "named")
    tops = keep.write(named.groupBy("component").agg(F.min("doc_id").alias("top")), "tops")
    linked_to = named.join(tops.hint("merge"), "component").select("digest", "top")
    to = materialize(classes.select("digest", "doc_id").join(linked_to, "digest", "left").select("digest", F.coalesce("top", "doc_id").alias("top")), "to")
    keep.close()
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "doc_id"))
    return signed.select("doc_id", "n", "digest").join(to.hint("merge"), "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"), *(["digest"] if digests else []))
