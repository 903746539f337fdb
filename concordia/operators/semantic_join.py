"""Semantic join: normalized keys, exact matches, fuzzy matches for the rest, confidence, outer rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.functions import keys
from concordia.functions.similarity import edit_similarity
from concordia.operators import confidence as conf

META = "_semantic_join_meta"
#: Normalizers of semantic types.
TYPE_NORMALIZERS = {
    "email_address": "email", "phone_number": "phone", "display_name": "name", "monetary_value": "numeric", "temporal": "date",
    "categorical_attribute": "categorical", "categorical_code": "categorical",
}


@dataclass(frozen=True)
class Options:
    how: str = "inner"
    confidence_threshold: float = 0.7
    fuzzy: bool = True
    fuzzy_threshold: float = 0.8
    null_equal: bool = False
    keep_names: bool = True


#: Options for usual tasks.
PRESETS = {
    "customer_matching": Options(confidence_threshold=0.8, fuzzy_threshold=0.7),
    "product_catalog": Options(confidence_threshold=0.9, fuzzy=False),
    "general": Options(confidence_threshold=0.7, fuzzy_threshold=0.8),
}


def choose_normalizer(left: conf.Context, right: conf.Context, left_name: str = "", right_name: str = "") -> str:
    """The normalizer of the shared semantic type; names that say 'address' get the address one."""
    if all(re.search(r"(^|_)addr(ess)?$", n.lower()) for n in (left_name, right_name) if n) and left_name and right_name:
        return "address"
    kinds = [TYPE_NORMALIZERS.get(c.semantic_type) for c in (left, right)]
    if kinds[0] == kinds[1] and kinds[0]:
        # Text that merely is called an amount keeps its characters.
        return "default" if kinds[0] == "numeric" and {left.kind, right.kind} == {"string"} else kinds[0]
    return "numeric" if {left.kind, right.kind} == {"numeric"} else "default"


def key(df: DataFrame, columns: Sequence[str], kinds: Sequence[str], null_equal: bool = False) -> Column:
    """Normalized key columns joined by '|'.  Null if a part is, unless ``null_equal`` makes it empty."""
    parts = [keys.normalize(F.col(f"`{c}`"), k) for c, k in zip(columns, kinds, strict=True)]
    if null_equal:
        return F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))
    whole = F.concat_ws("|", *parts)
    gaps = [F.col(f"`{c}`").isNull() for c in columns]
    any_gap = gaps[0]
    for g in gaps[1:]:
        any_gap = any_gap | g
    return F.when(~any_gap, whole)


def raw_key(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns))


def _segments(n: Column, edits: Column) -> Column:
    """(i, place, width) of edits + 1 even segments of a string of length n; places from 1."""
    parts = edits + 1
    width, longer = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    return F.transform(
        F.sequence(F.lit(0), edits),
        lambda i: F.struct(
            i.alias("i"),
            (i * width + F.greatest(i - (parts - longer), F.lit(0)) + 1).cast("int").alias("place"),
            (width + F.when(i >= parts - longer, 1).otherwise(0)).cast("int").alias("width"),
        ),
    )


#: Keys that may differ in so many edits at most meet by what is left without as many characters.
DELETIONS = 2


def _without(c: Column, most: Column) -> Column:
    """Hashes of a string and of what is left of it without one character, or two, as ``most`` allows."""
    n = F.length(c)
    one = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, n)))
    none = F.array().cast("array<string>")
    first = F.when((most >= 1) & (n >= 1), one(c)).otherwise(none)
    second = F.when((most >= 2) & (n >= 2), F.array_distinct(F.flatten(F.transform(first, one)))).otherwise(none)
    return F.transform(F.array_distinct(F.concat(F.array(c), first, second)), lambda s: F.xxhash64(s))


def _near(lefts: DataFrame, rights: DataFrame, t: float) -> DataFrame:
    """(lk, rk) of keys that share what is left of them without some characters, of lengths that allow a match.

    With e edits, of which s are changes, a key of n characters loses s + d <= e - (m - n) of them
    to what it shares with one of m >= n: at most (1 - t) n, as many as its own length allows.
    """
    edits = lambda n: F.floor((1 - t) * F.col(n) + 1e-9)
    a = lefts.select("lk", "n", F.explode(_without(F.col("lk"), edits("n"))).alias("rest"))
    b = rights.where(edits("m") <= DELETIONS).select("rk", "m", F.explode(_without(F.col("rk"), edits("m"))).alias("rest"))
    apart = F.abs(F.col("n") - F.col("m")) <= (1 - t) * F.greatest("n", "m") + 1e-9
    return a.join(b, "rest").where(apart).select("lk", "rk").distinct()


def fuzzy_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(lk, rk, similarity) of all distinct keys with edit similarity >= threshold; nothing is lost.

    Strings of length n whose partner may be up to n / threshold long differ in at most k
    edits.  With k up to DELETIONS, both are equal without at most k characters of each, so candidates
    come from an equi-join on what is left; a start that all keys share does not make them
    candidates.  With more, of k + 1 segments of one, one occurs unchanged in the other, shifted
    by no more than the edits on its sides allow: an equi-join on (length, segment number,
    segment).  The few left are compared.  Keys shorter than their segments meet by length alone.
    """
    t = threshold
    n = F.length("lk")
    longest = F.floor(n / t + 1e-9)
    most = F.floor((1 - t) * longest + 1e-9).cast("int")
    lefts = left.where("lk is not null").select("lk", n.alias("n"), most.alias("k"))
    m = F.length("rk")
    every = right.where("rk is not null").select("rk", m.alias("m"))
    near = _near(lefts.where(F.col("k") <= DELETIONS), every, t)
    lefts = lefts.where(F.col("k") > DELETIONS)
    segment = F.explode(F.when(F.col("k") < F.col("n"), _segments(F.col("n"), F.col("k"))))
    indexed = lefts.where("k < n").select("lk", "n", segment.alias("s")).select(
        "lk", "n", F.col("s.i").alias("i"), F.substring(F.col("lk"), F.col("s.place"), F.col("s.width")).alias("part")
    )
    tiny = lefts.where("k >= n").select("lk", "n", F.lit(-1).alias("i"), F.lit("").alias("part"))

    m = F.col("m")
    lengths = F.explode(F.sequence(F.ceil(m * t - 1e-9).cast("int"), F.floor(m / t + 1e-9).cast("int")))
    rights = every.select("rk", "m", lengths.alias("n")).where("n >= 0")
    rights = rights.withColumn("k", F.floor((1 - t) * F.floor(F.col("n") / t + 1e-9) + 1e-9).cast("int")).where(F.col("k") > DELETIONS)
    shift = F.col("m") - F.col("n")
    probe = rights.where("k < n").select("rk", "n", "m", "k", shift.alias("d"), F.explode(_segments(F.col("n"), F.col("k"))).alias("s"))
    low = F.greatest(F.col("s.place") - F.col("s.i"), F.col("s.place") + F.col("d") - (F.col("k") - F.col("s.i")), F.lit(1))
    high = F.least(F.col("s.place") + F.col("s.i"), F.col("s.place") + F.col("d") + (F.col("k") - F.col("s.i")), F.col("m") - F.col("s.width") + 1)
    probe = probe.select("rk", "n", "s", low.alias("low"), high.alias("high")).where("low <= high")
    probe = probe.select("rk", "n", "s", F.explode(F.sequence("low", "high")).alias("at")).select(
        "rk", "n", F.col("s.i").alias("i"), F.substring(F.col("rk"), F.col("at"), F.col("s.width")).alias("part")
    )
    probe = probe.union(rights.where("k >= n").select("rk", "n", F.lit(-1).alias("i"), F.lit("").alias("part"))).distinct()
    found = near.union(indexed.union(tiny).join(probe, ["n", "i", "part"]).select("lk", "rk").distinct())
    return found.withColumn("similarity", edit_similarity(F.col("lk"), F.col("rk"))).where(F.col("similarity") >= t - 1e-12)


def _combined(models: list[conf.Model]) -> conf.Model:
    """Components of several key pairs averaged, factors too."""
    n = len(models)
    names = {k for m in models for k in m.factors}
    return conf.Model(
        {k: sum(m.components[k] for m in models) / n for k in models[0].components},
        {k: sum(m.factors.get(k, 0.0) for m in models) / n for k in names},
    )


@dataclass(frozen=True)
class Keys:
    """How the key columns of both sides are normalized and scored."""

    kinds: tuple[str, ...]
    model: conf.Model


def prepare(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], normalizers: Sequence[str] | None = None) -> Keys:
    """One small aggregate job a side; normalizers are chosen where none are given."""
    if len(left_on) != len(right_on) or not left_on:
        raise ValueError("as many key columns are needed on either side, and one at least")
    a, b = conf.contexts(left, list(left_on)), conf.contexts(right, list(right_on))
    kinds = normalizers or [choose_normalizer(a[x], b[y], x, y) for x, y in zip(left_on, right_on, strict=True)]
    return Keys(tuple(kinds), _combined([conf.model(a[x], b[y]) for x, y in zip(left_on, right_on, strict=True)]))


def semantic_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str | Sequence[str],
    right_on: str | Sequence[str],
    options: Options | None = None,
    normalizers: Sequence[str] | None = None,
    prepared: Keys | None = None,
    **changes,
) -> DataFrame:
    """Rows of both sides whose keys mean the same, with ``_semantic_join_meta``.

    Equal normalized keys are joined first (shuffle or broadcast, as Catalyst and AQE
    choose).  Only right keys without an exact partner take part in the fuzzy match, which
    works on distinct keys.  The meta struct holds confidence, match_type ('exact', 'normalized',
    'fuzzy' or 'no_match') and the normalizers.  Columns become left_x and right_x, or, with
    ``keep_names=False``, x and, where both sides have it, x_right.
    """
    o = replace(options or Options(), **changes)
    left_on, right_on = ([c] if isinstance(c, str) else list(c) for c in (left_on, right_on))
    ready = prepared or prepare(left, right, left_on, right_on, normalizers)
    if o.keep_names:
        lnames, rnames = {c: f"left_{c}" for c in left.columns}, {c: f"right_{c}" for c in right.columns}
    else:
        lnames, rnames = {c: c for c in left.columns}, {c: (f"{c}_right" if c in left.columns else c) for c in right.columns}
    lside = left.select(key(left, left_on, ready.kinds, o.null_equal).alias("__lk"), raw_key(left_on).alias("__lr"), *(F.col(f"`{c}`").alias(n) for c, n in lnames.items()))
    rside = right.select(key(right, right_on, ready.kinds, o.null_equal).alias("__rk"), raw_key(right_on).alias("__rr"), *(F.col(f"`{c}`").alias(n) for c, n in rnames.items()))
    shown = [*lnames.values(), *rnames.values()]
    label = F.lit("|".join(ready.kinds))

    def meta(confidence: Column, kind: Column) -> Column:
        return F.struct(confidence.cast("double").alias("confidence"), kind.alias("match_type"), label.alias("normalizer")).alias(META)

    none = F.struct(F.lit(0.0).alias("confidence"), F.lit("no_match").alias("match_type"), F.lit(None).cast("string").alias("normalizer")).alias(META)
    sure = conf.exact_confidence(ready.model)
    parts, met_left, met_right = [], [], []
    if sure >= o.confidence_threshold:
        exact = lside.join(rside, F.col("__lk") == F.col("__rk"))
        kind = F.when(F.col("__lr") == F.col("__rr"), "exact").otherwise("normalized")
        parts.append(exact.select(*shown, meta(F.lit(sure), kind)))
        met_left.append(rside.select(F.col("__rk").alias("__m")))
        met_right.append(lside.select(F.col("__lk").alias("__m")))
    if o.fuzzy:
        lkeys = lside.select(F.col("__lk").alias("lk")).distinct()
        rest = rside.join(lkeys, F.col("__rk") == F.col("lk"), "left_anti")
        pairs = fuzzy_pairs(lkeys, rest.select(F.col("__rk").alias("rk")).distinct(), o.fuzzy_threshold)
        # Confidence also looks at the raw spellings, of these keys only.
        raw_l, raw_r = lside.select("__lk", "__lr").distinct(), rest.select("__rk", "__rr").distinct()
        scored = pairs.join(raw_l, F.col("lk") == F.col("__lk")).join(raw_r, F.col("rk") == F.col("__rk"))
        score = conf.fuzzy_confidence(ready.model, F.col("similarity"), edit_similarity(F.col("__lr"), F.col("__rr")))
        scored = scored.select(F.col("lk").alias("p_lk"), F.col("rk").alias("p_rk"), F.col("__lr").alias("p_lr"), F.col("__rr").alias("p_rr"), score.alias("p_score"))
        scored = scored.where(F.col("p_score") >= o.confidence_threshold)
        fuzzy = scored.join(lside, (F.col("p_lk") == F.col("__lk")) & (F.col("p_lr") == F.col("__lr")))
        fuzzy = fuzzy.join(rside, (F.col("p_rk") == F.col("__rk")) & (F.col("p_rr") == F.col("__rr")))
        parts.append(fuzzy.select(*shown, meta(F.col("p_score"), F.lit("fuzzy"))))
        fuzzy_left, fuzzy_right = scored.select("p_lk", "p_lr").distinct(), scored.select("p_rk", "p_rr").distinct()
    if o.how in ("left", "outer"):
        alone = lside
        for m in met_left:
            alone = alone.join(m, F.col("__lk") == F.col("__m"), "left_anti")
        if o.fuzzy:
            alone = alone.join(fuzzy_left, (F.col("__lk") == F.col("p_lk")) & (F.col("__lr") == F.col("p_lr")), "left_anti")
        parts.append(alone.select(*(F.col(f"`{n}`") for n in lnames.values()), *(F.lit(None).cast(right.schema[c].dataType).alias(n) for c, n in rnames.items()), none))
    if o.how in ("right", "outer"):
        alone = rside
        for m in met_right:
            alone = alone.join(m, F.col("__rk") == F.col("__m"), "left_anti")
        if o.fuzzy:
            alone = alone.join(fuzzy_right, (F.col("__rk") == F.col("p_rk")) & (F.col("__rr") == F.col("p_rr")), "left_anti")
        parts.append(alone.select(*(F.lit(None).cast(left.schema[c].dataType).alias(n) for c, n in lnames.items()), *(F.col(f"`{n}`") for n in rnames.values()), none))
    if not parts:
        return lside.join(rside, F.lit(False)).select(*shown, none)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def match_statistics(joined: DataFrame) -> DataFrame:
    """rows, matched, avg and median confidence, and a histogram by level bounds .25, .5 and .75."""
    c = F.when(F.col(f"{META}.match_type") != "no_match", F.col(f"{META}.confidence"))
    return joined.agg(
        F.count("*").alias("rows"),
        F.count(c).alias("matched"),
        F.avg(c).alias("avg_confidence"),
        F.percentile(c, 0.5).alias("median_confidence"),
        F.count_if(c < 0.25).alias("below_25"),
        F.count_if((c >= 0.25) & (c < 0.5)).alias("from_25"),
        F.count_if((c >= 0.5) & (c < 0.75)).alias("from_50"),
        F.count_if(c >= 0.75).alias("from_75"),
    )


def advise(left: DataFrame, right: DataFrame, left_on: str, right_on: str, options: Options | None = None) -> Options:
    """Options for keys that are nearly unique on both sides: no fuzzy match, threshold 0.9."""
    o = options or Options()
    a, b = conf.contexts(left, [left_on])[left_on], conf.contexts(right, [right_on])[right_on]
    unique = all(c.rows and c.unique_count / c.rows > 0.9 for c in (a, b))
    return replace(o, fuzzy=False, confidence_threshold=0.9) if unique else o
