"""Concepts and packs: lookup by label and criteria, rules, dependencies, validation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.functions.similarity import edit_similarity, jaccard

FACETS = ("pii", "temporal", "numerical", "categorical", "identifier")
CONCEPT = (
    "cid string, pack string, labels array<string>, description string, facets struct<pii:boolean,temporal:boolean,numerical:boolean,"
    "categorical:boolean,identifier:boolean>, parent_cid string, rules array<struct<kind:string,pattern:string,facet:string,confidence:double>>"
)
RULE_KINDS = ("name", "value", "facet", "dtype")


@dataclass(frozen=True)
class Rule:
    """name: a name pattern matches; value: a sample value does; facet: a facet is set and a label matches; dtype: the type is."""

    kind: str
    confidence: float
    pattern: str | None = None
    facet: str | None = None


@dataclass(frozen=True)
class Concept:
    cid: str
    labels: tuple[str, ...]
    facets: dict[str, bool] = field(default_factory=dict)
    description: str = ""
    parent: str | None = None
    rules: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class Pack:
    name: str
    version: str
    concepts: tuple[Concept, ...]
    depends_on: tuple[str, ...] = ()
    description: str = ""


def pack_from(data: dict) -> Pack:
    """A pack from parsed YAML: pack, version, depends_on, concepts; rules are of the four kinds, never code."""
    concepts = []
    for c in data.get("concepts", []):
        rules = tuple(Rule(r["kind"], float(r["confidence"]), r.get("pattern"), r.get("facet")) for r in c.get("rules", []))
        concepts.append(Concept(c["cid"], tuple(c.get("labels", ())), dict(c.get("facets", {})), c.get("description", ""), c.get("parent_cid"), rules))
    return Pack(data["pack"], str(data["version"]), tuple(concepts), tuple(data.get("depends_on", ())), data.get("description", ""))


#: The concepts that come with the engine, with the labels by which columns are known.
IDENTITY = Pack(
    "common.identity", "0.1.0",
    (
        Concept("identity.person", ("customer_id", "user_id", "person_pk", "person_id", "member_id", "client_id", "individual_id"), {"pii": True, "identifier": True}, "A person", None, (Rule("name", 0.85, "customer|user|person|member|client|individual"), Rule("facet", 0.75, "id$", "identifier"))),
        Concept("identity.organization", ("company_id", "org_id", "organization_id", "corp_id", "enterprise_id", "business_id"), {"identifier": True}, "An organization", None, (Rule("name", 0.9, "company|org|corp|enterprise|business"),)),
        Concept("identity.account", ("account_id", "account_number", "account_pk", "acc_id", "account_ref"), {"pii": True, "identifier": True}, "An account", None, (Rule("name", 0.95, "account"),)),
        Concept("identity.email", ("email", "email_address", "user_email", "contact_email", "email_addr"), {"pii": True, "identifier": True}, "An e-mail address", "identity.person", (Rule("name", 0.9, "@"), Rule("value", 0.95, "@"))),
        Concept("identity.phone", ("phone", "phone_number", "mobile", "telephone", "contact_phone"), {"pii": True, "identifier": True}, "A phone number", "identity.person", (Rule("name", 0.9, "phone|mobile|tel"),)),
    ),
    ("common.units>=0.1.0",),
)
TIME = Pack(
    "common.time", "0.1.0",
    (
        Concept("time.event", ("timestamp", "event_time", "created_at", "ts", "datetime"), {"temporal": True}, "When something happened", None, (Rule("dtype", 0.8, "datetime"), Rule("name", 0.8, "time|created|updated"))),
        Concept("time.date", ("date", "order_date", "birth_date", "day"), {"temporal": True}, "A day", "time.event", (Rule("name", 0.8, "date"),)),
    ),
)
UNITS = Pack(
    "common.units", "0.1.0",
    (
        Concept("units.money", ("price", "amount", "cost", "revenue", "total_price"), {"numerical": True}, "An amount of money", None, (Rule("name", 0.85, "price|amount|cost|revenue"),)),
        Concept("units.quantity", ("quantity", "qty", "count", "number_of_items"), {"numerical": True}, "A count", None, (Rule("name", 0.8, "quantity|qty|count"),)),
    ),
)


# --- packs ------------------------------------------------------------------


def version(text: str) -> tuple[int, int, int]:
    m = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)(?:[-+].*)?", text)
    if not m:
        raise ValueError(f"{text} is not a version")
    return int(m[1]), int(m[2]), int(m[3])


def satisfies(found: str, constraint: str) -> bool:
    """>=, <=, >, <, = and ^ (same major version) constraints."""
    m = re.fullmatch(r"(>=|<=|>|<|=|\^)?\s*(.+)", constraint)
    op, a, b = m[1] or "=", version(found), version(m[2])
    return {">=": a >= b, "<=": a <= b, ">": a > b, "<": a < b, "=": a == b, "^": a[0] == b[0] and a >= b}[op]


def load_order(packs: dict[str, Pack]) -> list[str]:
    """Packs with those they depend on before them; cycles, gaps and version conflicts are errors."""
    state: dict[str, int] = {}
    out: list[str] = []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if state.get(name) == 2:
            return
        if state.get(name) == 1:
            raise ValueError("packs depend on each other: " + " > ".join((*path, name)))
        state[name] = 1
        for need in packs[name].depends_on:
            other, constraint = re.fullmatch(r"([\w.\-]+)\s*(.*)", need).groups()
            if other not in packs:
                raise ValueError(f"{name} needs {other}, which is missing")
            if constraint and not satisfies(packs[other].version, constraint):
                raise ValueError(f"{name} needs {need}, found {packs[other].version}")
            visit(other, (*path, name))
        state[name] = 2
        out.append(name)

    for name in sorted(packs):
        visit(name, ())
    return out


def unload(packs: dict[str, Pack], name: str) -> dict[str, Pack]:
    """The packs without one that no other depends on."""
    users = [p.name for p in packs.values() if any(re.match(r"[\w.\-]+", d)[0] == name for d in p.depends_on)]
    if users:
        raise ValueError(f"{name} is needed by {', '.join(users)}")
    return {k: v for k, v in packs.items() if k != name}


def validate(pack: Pack) -> list[str]:
    """What is wrong with a pack."""
    out = []
    if not re.fullmatch(r"[a-z][\w]*(\.[a-z][\w]*)*", pack.name):
        out.append(f"name {pack.name!r}")
    try:
        version(pack.version)
    except ValueError as e:
        out.append(str(e))
    cids = [c.cid for c in pack.concepts]
    out += [f"concept {c} twice" for c in sorted({c for c in cids if cids.count(c) > 1})]
    for c in pack.concepts:
        if not c.labels:
            out.append(f"{c.cid} without labels")
        out += [f"{c.cid}: facet {f}" for f in c.facets if f not in FACETS]
        for r in c.rules:
            if r.kind not in RULE_KINDS or not 0 <= r.confidence <= 1:
                out.append(f"{c.cid}: rule {r.kind}")
    return out


# --- concepts as tables -----------------------------------------------------


def concepts(spark: SparkSession, *packs: Pack) -> DataFrame:
    rows = []
    for p in packs:
        for c in p.concepts:
            rows.append((c.cid, p.name, list(c.labels), c.description, tuple(bool(c.facets.get(f)) for f in FACETS), c.parent, [(r.kind, r.pattern, r.facet, r.confidence) for r in c.rules]))
    return spark.createDataFrame(rows, CONCEPT)


def normal(label):
    """Lower case; marks and blanks as one underscore."""
    return F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "_")


def duplicate_labels(table: DataFrame) -> DataFrame:
    """label, n, cids of labels that several concepts have."""
    rows = table.select("cid", F.explode("labels").alias("label")).select(F.col("cid"), normal(F.col("label")).alias("label")).distinct()
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("cid")), ",").alias("cids")).where("n > 1")


def lookup(names: DataFrame, table: DataFrame) -> DataFrame:
    """name, cid, confidence, match_type: exact labels score 1; names without one are compared with all labels.

    The score of the others is the larger of term overlap and edit similarity, above 0.5.
    Concepts are a small dimension, so labels are broadcast.
    """
    labels = table.select("cid", F.explode("labels").alias("label")).select("cid", normal(F.col("label")).alias("label"))
    asked = names.select("name", normal(F.col("name")).alias("key")).distinct()
    exact = asked.join(F.broadcast(labels), F.col("key") == F.col("label"))
    rest = asked.join(exact.select(F.col("name").alias("met")).distinct(), F.col("name") == F.col("met"), "left_anti")
    terms = lambda c: F.array_distinct(F.split(c, "_"))
    score = F.greatest(jaccard(terms(F.col("key")), terms(F.col("label"))), edit_similarity(F.col("key"), F.col("label")))
    fuzzy = rest.join(F.broadcast(labels), how="cross").withColumn("score", score).where("score > 0.5").groupBy("name", "cid").agg(F.max("score").alias("confidence"))
    return exact.select("name", "cid", F.lit(1.0).alias("confidence"), F.lit("exact").alias("match_type")).distinct().unionByName(
        fuzzy.select("name", "cid", "confidence", F.lit("fuzzy").alias("match_type"))
    )


def by_criteria(table: DataFrame, facets: dict[str, bool] | None = None, pattern: str | None = None, values: list[str] | None = None, dtype: str | None = None) -> DataFrame:
    """cid, confidence, match_type of concepts whose facets, labels and rules fit; above 0.3, at most 1.

    Rules are data of four kinds and compiled to expressions; nothing is evaluated as code.
    """
    facets = facets or {}
    hits = [(F.col(f"facets.{f}") == v).cast("int") for f, v in facets.items()]
    facet_score = sum(hits[1:], hits[0]) / len(hits) if hits else F.lit(0.0)
    if pattern is not None:
        each = F.transform("labels", lambda label: F.when(label.rlike(f"(?i){pattern}"), 0.9).otherwise(edit_similarity(label, F.lit(pattern))))
        pattern_score = F.array_max(each)
    else:
        pattern_score = F.lit(0.0)
    asked, samples, kind = F.lit(pattern or ""), F.array(*map(F.lit, values or [""])), F.lit(dtype or "")
    fits = lambda r: (
        F.when(r.kind == "name", F.regexp_like(asked, r.pattern))
        .when(r.kind == "value", F.exists(samples, lambda v: F.regexp_like(v, r.pattern)))
        .when(r.kind == "facet", F.lit("identifier" in facets and bool(facets["identifier"])) & F.regexp_like(asked, r.pattern))
        .when(r.kind == "dtype", kind == r.pattern)
    )
    rule_score = F.coalesce(F.array_max(F.transform("rules", lambda r: F.when(fits(r), r.confidence).otherwise(0.0))), F.lit(0.0))
    scored = table.select("cid", (facet_score + F.coalesce(pattern_score, F.lit(0.0)) * 0.8 + rule_score * 0.9).alias("c"), (rule_score > 0).alias("ruled"))
    return scored.where("c > 0.3").select("cid", F.least("c", F.lit(1.0)).alias("confidence"), F.when(F.col("ruled"), "inference").otherwise("semantic").alias("match_type"))
