"""Stable column anchors: fingerprints, match scores, reconciliation, the anchor store."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions.similarity import jaccard, tokens
from concordia.operators import profile

#: Name patterns of a fingerprint.
PATTERNS = (
    "(^|_)(id|pk|key)$", "(^|_)(cust|customer|user|person)(_id)?$", "(^|_)(email|mail)$", "(^|_)(phone|tel|mobile)$",
    "(^|_)(amount|price|cost|value)$", "(^|_)(date|time|timestamp)$", "(^|_)(name|title|label)$", "(^|_)(code|cd|abbr)$",
)
GENERIC = "(^|_)(id|pk|key)$"
#: Weights of the parts of a match score.
WEIGHTS = {"dtype": 0.3, "cardinality": 0.25, "regex": 0.2, "stats": 0.15, "name": 0.1}
#: Threshold and tolerance of the strategies.
STRATEGIES = {"conservative": (0.9, 0.1), "balanced": (0.8, 0.2), "aggressive": (0.7, 0.3), "semantic_first": (0.75, 0.25)}
SAMPLES = 200
_INT, _FLOAT = "^-?[0-9]+$", r"^-?[0-9]*\.[0-9]+$"
_DATE = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}([ T].*)?|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}.*)$"


def patterns_of(name: str, values: list[str] = ()) -> list[str]:
    """Name patterns that the name, or four of five sample values, match."""
    out = []
    for p in PATTERNS:
        hits = sum(bool(re.search(p, v.lower())) for v in values)
        if re.search(p, name.lower()) or (values and hits / len(values) >= 0.8):
            out.append(p)
    return out


def fingerprints(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, dtype, min, max, min_num, max_num, cardinality, null_ratio, unique_ratio, regex_patterns, sample_values.

    One pass for the figures of all columns; samples are the values with the smallest hashes,
    found in two steps, so no task collects a column's distinct values.
    """
    columns = columns or df.columns
    made = {}
    for name in columns:
        c = F.col(f"`{name}`")
        s = F.when(~profile.missing(c), F.trim(c.cast("string")))
        number = s.try_cast("double")
        share = lambda cond, s=s: F.avg(F.when(s.isNotNull(), cond.cast("int")))
        declared = {"bigint": "int64", "int": "int64", "smallint": "int64", "double": "float64", "float": "float64", "boolean": "boolean", "timestamp": "datetime", "date": "datetime"}.get(dict(df.dtypes)[name])
        guess = F.when(share(s.rlike(_FLOAT)) >= 0.8, "float64").when(share(s.rlike(_INT)) >= 0.8, "int64").when(share(s.isin("true", "false")) > 0.8, "boolean")
        guess = guess.when(share(s.rlike(_DATE)) > 0.8, "datetime").when(F.count(s) == 0, "unknown").otherwise("string")
        n = F.count(F.lit(1))
        made[name] = {
            "dtype": F.lit(declared) if declared else guess,
            "min": F.min(s), "max": F.max(s), "min_num": F.min(number), "max_num": F.max(number),
            "cardinality": F.count_distinct(s),
            "null_ratio": F.try_divide((n - F.count(s)).cast("double"), n), "unique_ratio": F.try_divide(F.count_distinct(s).cast("double"), n),
            "regex_patterns": F.array(*map(F.lit, patterns_of(name))).cast("array<string>"),
        }
    cells = profile.unpivoted(df, columns).where("value is not null and value <> ''").distinct()
    cells = cells.withColumn("h", F.xxhash64("value")).withColumn("b", F.pmod("h", F.lit(64)))
    first = cells.withColumn("r", F.row_number().over(Window.partitionBy("column", "b").orderBy("h", "value"))).where(F.col("r") <= SAMPLES)
    second = first.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("h", "value"))).where(F.col("r") <= SAMPLES)
    samples = second.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
    return profile._tall(df, columns, made).join(samples, "column", "left").withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))


def encode(fp: Column) -> Column:
    """A fingerprint struct as text: key=value parts with ';' between."""
    return F.concat_ws(
        ";",
        F.concat(F.lit("min="), F.coalesce(fp["min"], F.lit("null"))),
        F.concat(F.lit("max="), F.coalesce(fp["max"], F.lit("null"))),
        F.concat(F.lit("dtype="), fp["dtype"]),
        F.concat(F.lit("card="), fp["cardinality"].cast("string")),
        F.concat(F.lit("null_ratio="), F.format_string("%.3f", fp["null_ratio"])),
        F.concat(F.lit("unique_ratio="), F.format_string("%.3f", fp["unique_ratio"])),
        F.when(F.size(fp["regex_patterns"]) > 0, F.concat(F.lit("patterns="), F.array_join(fp["regex_patterns"], ","))),
    )


def decode(text: Column) -> Column:
    """The struct of an encoded fingerprint; values may hold '='."""
    part = lambda k: F.nullif(F.regexp_extract(text, rf"(?:^|;){k}=((?:(?!;[a-z_]+=).)*)", 1), F.lit(""))
    value = lambda k: F.nullif(part(k), F.lit("null"))
    return F.struct(
        value("min").alias("min"), value("max").alias("max"), part("dtype").alias("dtype"), part("card").cast("long").alias("cardinality"),
        part("null_ratio").cast("double").alias("null_ratio"), part("unique_ratio").cast("double").alias("unique_ratio"),
        F.coalesce(F.split(part("patterns"), ","), F.array().cast("array<string>")).alias("regex_patterns"),
    )


def anchor_id(dataset: Column, column: Column) -> Column:
    return F.concat(F.lit("sca_"), F.substring(F.sha2(F.concat_ws("|", dataset, column), 256), 1, 16))


def create(prints: DataFrame, dataset: str, seen: str, confidence: float | None = None) -> DataFrame:
    """Anchors of fingerprints: the same with anchor_id, dataset, first_seen, last_seen, mapped_cid, confidence."""
    name = F.lit(dataset)
    return prints.select(
        anchor_id(name, F.col("column")).alias("anchor_id"), name.alias("dataset"), F.col("column").alias("column_name"),
        *(c for c in prints.columns if c != "column"), F.lit(seen).cast("date").alias("first_seen"), F.lit(seen).cast("date").alias("last_seen"),
        F.lit(None).cast("string").alias("mapped_cid"), F.lit(confidence).cast("double").alias("confidence"),
    )


def _named(c: Column) -> Column:
    return F.filter(tokens(c), lambda t: ~t.isin("id", "pk", "key"))


def match_scores(prints: DataFrame, anchors: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """column, anchor_id, the five parts, score and overlap of every column with every anchor.

    Both sides have a row per column of a table, which bounds them; the smaller is broadcast.
    """
    a = anchors.select("anchor_id", *(F.col(c).alias(f"a_{c}") for c in ("column_name", "dtype", "cardinality", "null_ratio", "unique_ratio", "regex_patterns")))
    p = prints.join(F.broadcast(a), how="cross")
    dtype = (F.col("dtype") == F.col("a_dtype")).cast("int").cast("double")
    x, y = F.col("cardinality"), F.col("a_cardinality")
    card = F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(F.least(x, y) / F.greatest(x, y))
    pa, pb = F.col("regex_patterns"), F.col("a_regex_patterns")
    shared = F.array_intersect(pa, pb)
    generic = (F.size(shared) == 1) & F.array_contains(shared, GENERIC)
    regex = F.when((F.size(pa) == 0) & (F.size(pb) == 0), 1.0).when(generic, 0.0).otherwise(jaccard(pa, pb))
    near = lambda d: F.when(d <= tolerance, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (d - tolerance) / (1 - tolerance)))
    stats = (near(F.abs(F.col("null_ratio") - F.col("a_null_ratio"))) + near(F.abs(F.col("unique_ratio") - F.col("a_unique_ratio")))) / 2
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    name = F.when(plain(F.col("column")) == plain(F.col("a_column_name")), 1.0).otherwise(jaccard(_named(F.col("column")), _named(F.col("a_column_name"))))
    both = (F.size(pa) > 0) & (F.size(pb) > 0)
    only_generic = both & generic & ((F.size(pa) == 1) | (F.size(pb) == 1))
    common = F.size(F.array_intersect(_named(F.col("column")), _named(F.col("a_column_name")))) > 0
    p = p.select(
        "column", "anchor_id", F.col("a_column_name").alias("anchor_column"), dtype.alias("dtype"), card.alias("cardinality"), regex.alias("regex"), stats.alias("stats"),
        name.alias("name"), both.alias("both"), only_generic.alias("only_generic"), common.alias("common"), F.size(shared).alias("overlap"), generic.alias("generic"),
    )
    weak = (F.col("regex") <= 0.25) & (F.col("name") < 0.4)
    total = (
        F.col("dtype") * WEIGHTS["dtype"] + F.col("cardinality") * F.when(weak, 0.2).otherwise(1.0) * WEIGHTS["cardinality"] + F.col("regex") * WEIGHTS["regex"]
        + F.col("stats") * F.when(weak, 0.5).otherwise(1.0) * WEIGHTS["stats"] + F.col("name") * WEIGHTS["name"]
    )
    total = F.when(F.col("both") & (F.col("regex") == 0) & (F.col("name") < 0.6), 0.0).otherwise(total)
    total = F.when((F.col("dtype") == 1) & (F.col("stats") >= 0.9) & (F.col("regex") >= 0.95) & (F.col("name") >= 0.95), 1.0).otherwise(total)
    total = F.when(F.col("only_generic") & (F.col("name") < 0.6), F.least(total, F.lit(0.6))).otherwise(total)
    total = F.when(F.col("only_generic") & ~F.col("common"), F.least(total, F.lit(0.49))).otherwise(total)
    p = p.withColumn("score", F.least(total, F.lit(1.0)))
    allowed = ~(F.col("both") & ((F.col("overlap") == 0) | F.col("generic"))) & ((F.col("regex") > 0) | (F.col("name") >= 0.8))
    return p.select("column", "anchor_id", "anchor_column", "dtype", "cardinality", "regex", "stats", "name", "score", allowed.alias("allowed"))


@dataclass(frozen=True)
class Reconciliation:
    """matched: (column, anchor_id, confidence, reasons); new and unmatched: column names."""

    matched: list[tuple[str, str, float, tuple[str, ...]]]
    new: list[str] = field(default_factory=list)
    unmatched: list[str] = field(default_factory=list)

    def metrics(self) -> dict:
        scores = [c for _, _, c, _ in self.matched]
        return {
            "strong": sum(c >= 0.9 for c in scores), "weak": sum(0.7 <= c < 0.9 for c in scores), "none": len(self.unmatched), "new": len(self.new),
            "mean_confidence": sum(scores) / len(scores) if scores else None,
        }


def reasons(row) -> tuple[str, ...]:
    bounds = (("dtype", 1.0, "dtype_match"), ("cardinality", 0.8, "cardinality_match"), ("regex", 0.8, "pattern_match"), ("stats", 0.8, "statistical_match"), ("name", 0.6, "name_similarity"))
    return tuple(label for part, least, label in bounds if row[part] >= least)


def reconcile(prints: DataFrame, anchors: DataFrame, strategy: str = "balanced", create_new: bool = True, threshold: float | None = None, tolerance: float | None = None) -> Reconciliation:
    """Assign columns to anchors one to one, the clearest pairs first.

    Scores come from Spark; the assignment runs over the candidate pairs of one table's
    columns.  A second, laxer look by name takes what the first left over.
    """
    least, width = STRATEGIES[strategy]
    least, width = threshold if threshold is not None else least, tolerance if tolerance is not None else width
    rows = match_scores(prints, anchors, width).where("allowed").collect()
    order = lambda r: (-r["regex"], -r["dtype"], -r["stats"], -r["name"], -r["score"], r["column"], r["anchor_id"])
    columns = [r["column"] for r in prints.select("column").collect()]
    used: set[str] = set()
    taken: dict[str, tuple] = {}
    for fits in (lambda r: r["score"] >= least, lambda r: r["name"] >= 0.8 and r["score"] >= least * 0.8):
        for r in sorted(filter(fits, rows), key=order):
            if r["column"] not in taken and r["anchor_id"] not in used:
                taken[r["column"]] = (r["column"], r["anchor_id"], r["score"], reasons(r))
                used.add(r["anchor_id"])
    rest = [c for c in columns if c not in taken]
    result = Reconciliation([taken[c] for c in columns if c in taken])
    return replace(result, new=rest) if create_new else replace(result, unmatched=rest)


# --- the store --------------------------------------------------------------


def upsert(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The store with changed anchors; the latest last_seen of an id wins, the change on a tie."""
    both = store.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    latest = Window.partitionBy("anchor_id").orderBy(F.col("last_seen").desc(), F.col("__new").desc())
    return both.withColumn("__r", F.row_number().over(latest)).where("__r = 1").drop("__r", "__new")


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("anchor_id"), "anchor_id", "left_anti")


def search(store: DataFrame, dataset: str | None = None, anchor: str | None = None, pattern: str | None = None) -> DataFrame:
    """Anchors of a dataset, by id, or whose name or concept matches a pattern."""
    if dataset is not None:
        store = store.where(F.col("dataset") == dataset)
    if anchor is not None:
        store = store.where(F.col("anchor_id") == anchor)
    if pattern is not None:
        store = store.where(F.col("column_name").rlike(pattern) | F.coalesce(F.col("mapped_cid").rlike(pattern), F.lit(False)))
    return store


def store_statistics(store: DataFrame) -> DataFrame:
    """dataset, anchors, last_seen over a rollup (null: all)."""
    return store.rollup("dataset").agg(F.count("*").alias("anchors"), F.max("last_seen").alias("last_seen"))


def evolution(snapshots: DataFrame) -> DataFrame:
    """snapshot, added, removed, stability and kind against the snapshot before (snapshot, anchor_id)."""
    sizes = snapshots.groupBy("snapshot").agg(F.count_distinct("anchor_id").alias("n"))
    order = Window.orderBy("snapshot")
    steps = sizes.select("snapshot", "n", F.lag("snapshot").over(order).alias("before"), F.lag("n").over(order).alias("old_n"))
    old = snapshots.select(F.col("snapshot").alias("before"), "anchor_id").distinct()
    kept = steps.join(old, "before").join(snapshots.distinct(), ["snapshot", "anchor_id"]).groupBy("snapshot").agg(F.count("*").alias("kept"))
    rows = steps.where("before is not null").join(kept, "snapshot", "left")
    added, removed = F.col("n") - F.coalesce("kept", F.lit(0)), F.col("old_n") - F.coalesce("kept", F.lit(0))
    kind = F.when(added > removed, "expansion").when(added < removed, "consolidation").otherwise("steady")
    return rows.select("snapshot", added.alias("added"), removed.alias("removed"), (1 - (added + removed) / F.greatest("n", "old_n")).alias("stability"), kind.alias("kind"))


# --- side metadata ----------------------------------------------------------


def attach(df: DataFrame, contexts: dict[str, dict]) -> DataFrame:
    """df with a semantic context in the metadata of each column; values do not change."""
    for name, context in contexts.items():
        old = df.schema[name].metadata or {}
        df = df.withMetadata(name, {**old, "semantic": context})
    return df


def attached(df: DataFrame) -> dict[str, dict]:
    """The contexts of the columns that have one."""
    return {f.name: f.metadata["semantic"] for f in df.schema if "semantic" in (f.metadata or {})}


def detach(df: DataFrame, *names: str) -> DataFrame:
    for name in names or df.columns:
        old = {k: v for k, v in (df.schema[name].metadata or {}).items() if k != "semantic"}
        df = df.withMetadata(name, old)
    return df
