"""Operator 4: MinHash near-duplicates, verified, joined to components by large and small stars."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm import texts as T
from concordia.llm.scratch import Scratch, small_batches

WIDTH = 5
MINIMA = 128
#: The largest probability with which banding, or the comparison of signatures, misses a pair
#: that is just similar enough.
BAND_MISS, SIGNATURE_MISS = 1e-5, 1e-8
#: A group with more pairs across components than so many times its members is wide.
WIDE = 8
#: Shingles that this share of a cloud's members have come last among those by which members meet.
FREQUENT = 16
#: Members of one cloud that meet the hub's set in one task.
SALT_ROWS = 128

_A, _B = T.odd(1, MINIMA, np.uint32), T.odd(2, MINIMA, np.uint32)
_MIX = T.odd(3, WIDTH, np.uint64)
_BAND = T.odd(4, MINIMA, np.uint64)
_CACHE_WORDS = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < _CACHE_WORDS:
            self[word] = h
        return h


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads sums over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word windows; one of the whole if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += h[k : k + n] * _MIX[k]
    return np.unique(_mixed(total))


def signature(found: np.ndarray) -> np.ndarray:
    """For each universal hash a*x + b the minimum over the set, in blocks that fit the cache."""
    x, low = (found >> np.uint64(32)).astype(np.uint32), None
    for i in range(0, len(x), 2048):
        part = (x[i : i + 2048, None] * _A + _B).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return low


def banding(percent: int) -> tuple[int, int]:
    """(minima in a band, bands): the longest bands that miss a pair of ``percent`` by BAND_MISS at most; 4 and 32 at 75."""
    t = percent / 100
    fits = [r for r in range(1, MINIMA + 1) if (1 - t**r) ** (MINIMA // r) <= BAND_MISS]
    if not fits:
        raise ValueError(f"{MINIMA} minima cannot find pairs of {percent} percent")
    return fits[-1], MINIMA // fits[-1]


def least_agreeing(percent: int) -> int:
    """Minima on which two sets of ``percent`` similarity agree at least, but for SIGNATURE_MISS; 67 of 128 at 75."""
    t, below, k = percent / 100, 0.0, 0
    while k < MINIMA and (below := below + math.comb(MINIMA, k) * t**k * (1 - t) ** (MINIMA - k)) <= SIGNATURE_MISS:
        k += 1
    return k


def _features(percent: int):
    """Digest of the words, set size, signature and band keys of every text; nulls without words."""
    rows, bands_of = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, size, sig, bands = [], [], [], []
            for text in batch.column(1):
                words = T.lower_words(text.as_py())
                if not words:
                    for out in (digest, sig, bands):
                        out.append(None)
                    size.append(0)
                    continue
                found = shingles(words)
                low = signature(found)
                used = low[: rows * bands_of].reshape(bands_of, rows).astype(np.uint64)
                keys = _mixed((used * _BAND[:rows]).sum(axis=1) + np.arange(bands_of, dtype=np.uint64))
                digest.append(xxhash.xxh3_128_digest(b" ".join(words)))
                size.append(len(found))
                sig.append(low.tobytes())
                bands.append(keys.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "digest", "n_shingles", "sig", "bands"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [shingles(T.lower_words(t.as_py())).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "shingles"])


def _agree(percent: int):
    """Pairs whose signatures agree on as many minima as a link's nearly always do."""
    least = least_agreeing(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                same = np.frombuffer(x.as_buffer(), np.uint32) == np.frombuffer(y.as_buffer(), np.uint32)
                keep.append(bool(same.sum() >= least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


#: Ids of eight bytes that may be broadcast; more of them are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def _sized(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast while they have at most BROADCAST_IDS rows, else to be shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")


def semi(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows whose id is in ids: without a shuffle while ids has at most BROADCAST_IDS rows."""
    return rows.join(_sized(ids), "id", "left_semi")


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(id, root): the smallest id each id reaches, by alternating large-star and small-star.

    Minima are pre-aggregated and joined back, so no neighbourhood is ever collected; each
    round is written to the shared folder.  It ends when a round changes no edge.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        # large: every node sends its larger neighbours to its least; small: the smaller ones.
        both = e.union(e.select("v", "u")).toDF("u", "v") if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        sent = both.join(least, "u")
        if large:
            return sent.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return sent.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))

    # u > v in every edge.
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{tag}0", spread=False)
    mark = None
    for i in itertools.count(1):
        nxt = star(star(now, True).where("u <> v").distinct(), False).where("u <> v").distinct()
        old, now = now, scratch.keep(nxt, f"{tag}{i}", spread=False)
        scratch.drop(f"{tag}{i - 1}")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hub, id, weight, the sizes of both sets and the shingles that only one of them has."""
    for batch in batches:
        n, of_hub, only = [], [], []
        for x, h in zip(batch.column(3), batch.column(4), strict=True):
            x, h = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(h.as_buffer(), np.uint64)
            n.append(len(x))
            of_hub.append(len(h))
            only.append(np.setxor1d(x, h, assume_unique=True).view(np.int64))
        made = [pa.array(n, pa.int64()), pa.array(of_hub, pa.int64()), pa.array(only, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["hub", "id", "weight", "n", "nh", "only"])


def _frequent(slot: pa.Table) -> pa.Table:
    """hub, shingle and times of the differences that two members of a slot, and one in 2 * FREQUENT of them, have."""
    shingle, times = np.unique(slot.column("only").combine_chunks().flatten().to_numpy(), return_counts=True)
    held = times >= max(2, slot.num_rows / (2 * FREQUENT))
    hub = np.full(np.count_nonzero(held), slot.column("hub")[0].as_py(), np.int64)
    return pa.table({"hub": hub, "shingle": shingle[held], "times": times[held].astype(np.int64)})


def _meetings(percent: int):
    """hub, id, weight, n, d and the first elements of the difference, rarest of the cloud first.

    Let D(x) = x xor hub, q = (100 - percent) / (100 + percent) and s(x) = |D(x)| - q |x|.  Since
    |a xor b| = |D(a)| + |D(b)| - 2 |D(a) & D(b)|, a and b are linked if and only if their
    differences share at least (s(a) + s(b)) / 2 elements.  Where a is not linked to the hub, that is more
    than 0 whatever b is.  A lower bound of it over all b tells how many of a's elements, in any
    order that the cloud has in common, hold one that b has too (prefix filtering).
    """
    q = (100 - percent) / (100 + percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hub, ids, of_ids, n, of_hub, only, widest, shingle, times = batch.columns
            first = []
            for i in range(batch.num_rows):
                x, size, hub_size = only[i].values.to_numpy(), n[i].as_py(), of_hub[i].as_py()
                d, partner = len(x), min(widest[i].as_py(), size * 100 // percent)
                s = d - q * size
                linked = s <= q * hub_size
                need = max(1.0, d - q * (size + partner), (s + (q if linked else -q) * hub_size) / 2)
                count = max(0, d - math.ceil(need - 1e-6) + 1)
                weight = np.zeros(d, np.int64)
                if times[i].is_valid:
                    known = shingle[i].values.to_numpy()
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    weight = np.where(known[at] == x, times[i].values.to_numpy()[at], 0)
                first.append(x[np.lexsort((x, weight))[:count]])
            d = pa.array([len(v) for v in only], pa.int64())
            yield pa.RecordBatch.from_arrays([hub, ids, of_ids, n, d, pa.array(first, pa.list_(pa.int64()))], names=["hub", "id", "weight", "n", "d", "first"])

    return run


def _clouds(members: DataFrame, sets_of, percent: int, scratch: Scratch) -> DataFrame:
    """(hub, id, weight, n, d, first): the shingles by which members of wide buckets can meet.

    Shingles that one in FREQUENT members have are counted and come last, so groups are small but
    where members have little else.  They are counted inside slots, without a row for each member's
    shingles: what is frequent in a cloud is so in some slot, and a count that lacks slots where it is
    seldom changes the order alone, which may be any.  Members are dealt by (hub, salt), so a large cloud is many tasks;
    the pair is one key, as Spark else deals by the hub alone where a side is dealt so already.
    """
    counted = members.groupBy("hub").agg(F.count("*").alias("k"))
    salts = F.floor(F.col("k") / SALT_ROWS).cast("int")
    salted = members.join(counted, "hub").select("hub", "id", "weight", F.struct("hub", F.pmod(F.xxhash64("id"), salts + 1).cast("int").alias("salt")).alias("slot"))
    sets = sets_of(scratch.keep(members.select("id").union(members.select("hub")).distinct(), "cloud-ids", spread=False), "cloud")
    slots = counted.select("hub", F.explode(F.sequence(F.lit(0), salts)).alias("salt")).select("hub", F.struct("hub", "salt").alias("slot"))
    hubs = slots.join(sets.toDF("hub", "hub_shingles"), "hub").select("slot", "hub_shingles")
    rows = salted.join(sets, "id").join(hubs, "slot").select("hub", "id", "weight", "shingles", "hub_shingles")
    apart = scratch.keep(rows.mapInArrow(_differences, "hub bigint, id bigint, weight bigint, n bigint, nh bigint, only array<bigint>"), "apart")
    slotted = apart.join(salted.select("hub", "id", "slot"), ["hub", "id"])
    often = slotted.select("slot", "hub", "only").groupBy("slot").applyInArrow(_frequent, "hub bigint, shingle bigint, times bigint")
    often = often.groupBy("hub", "shingle").agg(F.sum("times").alias("times")).join(counted, "hub").where(F.col("times") * FREQUENT >= F.col("k")).groupBy("hub")
    often = often.agg(F.sort_array(F.collect_list(F.struct("shingle", "times"))).alias("often"))
    cloud = apart.groupBy("hub").agg(F.max("n").alias("widest")).join(counted, "hub").join(often, "hub", "left")
    cloud = slots.join(cloud, "hub").select("slot", "widest", F.col("often.shingle").alias("shingle"), F.col("often.times").alias("times"))
    rows = slotted.join(cloud, "slot")
    rows = rows.select("hub", "id", "weight", "n", "nh", "only", "widest", "shingle", "times")
    return rows.mapInArrow(_meetings(percent), "hub bigint, id bigint, weight bigint, n bigint, d bigint, first array<bigint>")


def _places(meet: DataFrame) -> DataFrame:
    """(hub, shingle, id, weight, n, d, left); left counts a member's elements from here on.

    Members are dealt evenly before, as those of one slot lie together.
    """
    each = meet.repartition("hub", "id").select("hub", "id", "weight", "n", "d", F.posexplode("first").alias("place", "shingle"))
    return each.withColumn("left", F.col("d") - F.col("place")).drop("place")


def _enough(percent: int):
    """Whether two differences can share what a link needs, of what both have left."""
    need = (100 + percent) * (F.col("da") + F.col("db")) - (100 - percent) * (F.col("na") + F.col("nb"))
    return 2 * (100 + percent) * F.least("la", "lb") >= need


def _side(each: DataFrame, c: str) -> DataFrame:
    """each with its columns named for one side of a pair: c, rc, nc, dc and lc."""
    return each.select("hub", "shingle", F.col("id").alias(c), *(F.col(x).alias(f"{x[0]}{c}") for x in ("root", "n", "d", "left")))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept.

    Links join documents whose sets of distinct 5-word shingles (words lower-cased in A-Z)
    have 100 * intersection >= percent * union.  Texts with the same words form a class, of
    which the smallest id stands for all, so exact copies never meet in a bucket.  Class
    representatives are banded by 128 universal minima (32 bands of 4 at 75 percent).  In each
    bucket every member is compared with the one that shares most bands with others, its hub,
    ties to the smallest id; what verifies is joined to components.  Buckets whose members are
    then still apart compare the members of different components: all pairs where those are
    few, else the pairs whose differences from the hub can have in common what a link needs
    (see _meetings).  Where that still leaves many, the heaviest member of each group serves as
    a further hub before.  A bucket of variants is one component by then, so its pairs are never
    listed.  Candidates are compared by signature and confirmed on their full sets.

    Null or wordless texts have no shingles and stay alone; with fewer than five words the
    whole is one shingle; texts of any length count as a whole.  Rows without an id are linked
    with nothing: their component is null and they are kept.  Rows with the same doc_id should
    be alike; each is returned.  Other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    made = docs.mapInArrow(_features(percent), "doc_id bigint, digest binary, n_shingles bigint, sig binary, bands array<bigint>")
    member = scratch.keep(made, "member")
    named = member.where("doc_id is not null")
    n, n_ids = named.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    scratch.expect(n)
    once = (lambda df: df) if n == n_ids else (lambda df: df.dropDuplicates(["id"]))
    heads = scratch.keep(named.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id")), "heads")
    all_sketches = named.select(F.col("doc_id").alias("id"), "n_shingles", "sig", "bands")
    sketch = scratch.keep(once(semi(all_sketches, heads.select("id"))), "sketch")

    banded = sketch.select("id", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    crowd = scratch.keep(banded.join(least, "band"), "crowd")
    # In a group of variants of one text, the original shares most bands with the others; a
    # document's weight is the size of its buckets, and the heaviest member is compared with all.
    weight = scratch.keep(crowd.groupBy("id").agg(F.sum("n").alias("weight")), "weight", spread=False)
    crowd = scratch.keep(crowd.select("band", "id").join(weight, "id"), "weighed")

    def heaviest(*also):
        return F.max(F.struct("weight", (-F.col("id")).alias("minus"), *also))

    def sets_of(ids: DataFrame, tag: str) -> DataFrame:
        texts = semi(docs.select(F.col("doc_id").alias("id"), "text"), ids)
        return scratch.keep(once(texts.mapInArrow(_sets, "id bigint, shingles binary")), f"sets-{tag}", join=False)

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        sig = sketch.select("id", "sig")
        near = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
        near = scratch.keep(near.mapInArrow(_agree(percent), "a bigint, b bigint"), f"near-{tag}")
        wanted = scratch.keep(near.select("a").union(near.select("b")).toDF("id").distinct(), f"wanted-{tag}", spread=False)
        sets = sets_of(wanted, tag)
        held = near.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").select("a", "b", "xa", "xb")
        held = scratch.keep(held.mapInArrow(_confirm(percent), "a bigint, b bigint"), f"held-{tag}")
        scratch.drop(f"near-{tag}", f"wanted-{tag}", f"sets-{tag}")
        return held

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))

    def pairs_of(rows: DataFrame) -> DataFrame:
        return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    top = crowd.groupBy("band").agg(heaviest().alias("top")).select("band", (-F.col("top.minus")).alias("hub"))
    crowd = scratch.keep(crowd.join(top, "band").select("band", "id", "hub"), "named")
    compared = scratch.keep(pairs_of(crowd.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))), "compared", spread=False)
    links = verified(compared, "hub")
    roots = components(links, scratch, "hub")
    # Buckets that still hold more than one component: pairs across components.
    marked = rooted(crowd, roots)
    sizes = marked.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band")
    sizes = sizes.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("k")).where("k > 1")
    open_ = marked.join(sizes.select("band", ((F.col("n") * F.col("n") - F.col("squares")) / 2 > WIDE * F.col("n")).alias("wide")), "band")
    open_ = scratch.keep(open_.select("band", "id", "hub", "wide"), "open")
    members = scratch.keep(open_.where("wide and id <> hub").select("hub", "id").distinct().join(weight, "id"), "members", spread=False)
    far = []
    if not members.isEmpty():
        meet = scratch.keep(_clouds(members, sets_of, percent, scratch), "meet")
        scratch.drop("apart", "sets-cloud", "cloud-ids")
        # Made once; later turns read what the turn before has left of it, as groups only lose parts.
        places = scratch.keep(_places(meet), "places")
        for turn in itertools.count():
            each = rooted(places, roots)
            groups = each.groupBy("hub", "shingle", "root").agg(F.count("*").alias("k"), heaviest("n", "d", "left").alias("top")).groupBy("hub", "shingle")
            groups = groups.agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.count("*").alias("parts"), F.max("top").alias("top"))
            groups = scratch.keep(groups.where("parts > 1").drop("parts"), f"groups{turn}", spread=False)
            each = scratch.keep(each.join(groups.select("hub", "shingle"), ["hub", "shingle"]), f"each{turn}")
            places = each.drop("root")
            n_rows, n_pairs = groups.agg(F.sum("k"), F.sum((F.col("k") * F.col("k") - F.col("squares")) / 2)).first()
            if not n_rows or n_pairs <= WIDE * n_rows:
                break
            # Members far from their hub and near to each other: the heaviest that has a shingle is
            # compared with the others that have it and can be links, and joins them to a component.
            top = groups.select("hub", "shingle", (-F.col("top.minus")).alias("b"), *(F.col(f"top.{c}").alias(f"{c[0]}b") for c in ("n", "d", "left")))
            found = _side(each, "a").join(top, ["hub", "shingle"]).where(_enough(percent) & (F.col("a") != F.col("b"))).select("a", "b", "ra")
            found = found.join(roots.toDF("b", "rb"), "b", "left").where(F.col("ra") != F.coalesce("rb", "b"))
            found = scratch.keep(pairs_of(found).join(compared, ["a", "b"], "left_anti"), f"pairs{turn}", spread=False)
            more = verified(found, f"turn{turn}")
            compared, links = compared.union(found), links.union(more)
            n_found, n_more = found.count(), more.count()
            if n_more:
                roots = components(links, scratch, f"turn{turn}")
            if n_more * WIDE <= n_found:
                each = rooted(places, roots)
                break
        far.append(_side(each, "a").join(_side(each, "b"), ["hub", "shingle"]).where((F.col("ra") < F.col("rb")) & _enough(percent)).select("a", "b"))
    narrow = rooted(open_.where("not wide").select("band", "id"), roots)
    x, y = (narrow.select("band", F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    cross = x.join(y, "band").where("ra < rb").select("a", "b")
    for pairs in far:
        cross = cross.union(pairs)
    cross = pairs_of(cross)
    more = verified(scratch.keep(cross.join(compared, ["a", "b"], "left_anti"), "cross"), "cross")
    roots = components(links.union(more), scratch, "all")

    classes = rooted(heads, roots).join(sketch.select("id", "n_shingles"), "id").select("digest", "n_shingles", F.col("root").alias("class_id"))
    out = member.join(classes.withColumnRenamed("n_shingles", "size"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    out = out.select(
        "doc_id",
        F.col("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
    return scratch.finish(out)


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each component, the one with the smallest id, with its columns as they were.

    Rows without an id or without words all stay, as do repeated rows of a document that stays.
    """
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    helper = T.fresh(docs.columns, "gone_id")
    gone = _sized(gone.withColumnRenamed("doc_id", helper))
    return docs.join(gone, F.col("doc_id") == F.col(helper), "left_anti")
