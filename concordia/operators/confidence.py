"""The confidence of a match: seven weighted components and additive factors.

Statistics of the two key columns are constants of a join, so most of the model is computed
once from one small aggregate; only what depends on the pair stays in the expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordia.operators import profile

#: The weights of the components.
WEIGHTS = {
    "semantic_type": 0.25, "statistical": 0.20, "value_pattern": 0.15, "cardinality": 0.10, "domain": 0.10, "quality": 0.10, "normalization": 0.10,
}
#: How far different semantic types go together.
COMPATIBLE = {
    ("identifier", "high_cardinality_attribute"): 0.7, ("email_address", "contact_method"): 0.8, ("email_address", "user_identifier"): 0.6,
    ("phone_number", "contact_method"): 0.8, ("monetary_value", "numeric_value"): 0.9, ("monetary_value", "quantitative_measure"): 0.7,
    ("temporal", "datetime"): 0.95, ("temporal", "timestamp"): 0.9, ("temporal", "event_timestamp"): 0.8,
    ("display_name", "generic_attribute"): 0.6, ("display_name", "categorical_attribute"): 0.4, ("categorical_attribute", "categorical_code"): 0.8,
}
#: Semantic types by column name.
NAME_TYPES = (
    (r"(^|_)(id|pk|key)$", "identifier"), (r"(^|_)(email|mail)$", "email_address"), (r"(^|_)(phone|tel|mobile)$", "phone_number"),
    (r"(^|_)(name|title|label)$", "display_name"), (r"(^|_)(amount|price|cost|value)$", "monetary_value"),
    (r"(^|_)(date|time|timestamp)$", "temporal"), (r"(^|_)(code|cd|abbr)$", "categorical_code"),
)
#: Domain tags by parts of a column name.
NAME_TAGS = (
    (r"cust|customer|user", "customer_domain"), (r"order|purchase|transaction", "transaction_domain"), (r"product|item|sku", "product_domain"),
    (r"account|balance|payment", "financial_domain"), (r"address|location|geo", "geographic_domain"),
)
#: Relations of semantic types.
RELATIONS = {
    "identifier": ("primary_key_candidate",), "email_address": ("user_identifier", "contact_method"),
    "monetary_value": ("quantitative_measure",), "temporal": ("event_timestamp", "temporal_dimension"),
}


@dataclass(frozen=True)
class Context:
    """What a key column is about and how it is distributed."""

    semantic_type: str = "generic_attribute"
    confidence: float = 0.6
    tags: frozenset[str] = frozenset()
    kind: str = "string"
    unique_count: int = 0
    unique_percent: float = 0.0
    null_percent: float = 0.0
    avg_length: float = 0.0
    low: float | None = None
    high: float | None = None
    rows: int = 0


def semantic_type(name: str, kind: str, unique_ratio: float) -> str:
    """By name, then by kind, then by uniqueness."""
    for pattern, found in NAME_TYPES:
        if re.search(pattern, name.lower()):
            return found
    if kind == "date":
        return "temporal"
    if kind == "boolean":
        return "boolean_flag"
    if unique_ratio > 0.9:
        return "high_cardinality_attribute"
    return "categorical_attribute" if unique_ratio < 0.1 else "generic_attribute"


def tags_of(name: str, kind: str) -> frozenset[str]:
    found = {tag for pattern, tag in NAME_TAGS if re.search(pattern, name.lower())}
    return frozenset(found | ({"pii_sensitive"} if kind in ("email_address", "phone_number") else set()))


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, profile.NUMERIC):
        return "numeric"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "boolean" if isinstance(data_type, T.BooleanType) else "string"


def contexts(df: DataFrame, columns: list[str]) -> dict[str, Context]:
    """One aggregate job over the key columns."""
    rows = {r["column"]: r for r in profile.column_metrics(df, columns).collect()}
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, profile.NUMERIC)]
    spans = {r["column"]: r for r in profile.numeric_stats(df, numeric).collect()} if numeric else {}
    out = {}
    for c in columns:
        r, kind = rows[c], kind_of(df.schema[c].dataType)
        ratio = (r["unique_count"] / r["total"]) if r["total"] else 0.0
        meaning = semantic_type(c, kind, ratio)
        out[c] = Context(
            meaning, 0.6, tags_of(c, meaning), kind, r["unique_count"], r["unique_percent"] or 0.0, r["null_percent"] or 0.0, r["avg_length"] or 0.0,
            spans[c]["min"] if c in spans else None, spans[c]["max"] if c in spans else None, r["total"],
        )
    return out


def _ratio(a: float, b: float) -> float:
    return min(a, b) / max(a, b) if max(a, b) else 0.0


def type_score(a: Context | None, b: Context | None) -> float:
    if a is None or b is None:
        return 0.3
    mean = (a.confidence + b.confidence) / 2
    if a.semantic_type == b.semantic_type:
        return min(0.95, mean * 1.1)
    pair = (a.semantic_type, b.semantic_type)
    if fit := COMPATIBLE.get(pair) or COMPATIBLE.get(pair[::-1]):
        return mean * fit * 0.8
    shared = tag_overlap(a, b)
    return shared * 0.6 if shared > 0.3 else max(0.1, mean / 2)


def tag_overlap(a: Context, b: Context) -> float:
    return len(a.tags & b.tags) / len(a.tags | b.tags) if a.tags and b.tags else 0.0


def statistical_score(a: Context, b: Context) -> float:
    """A sum of shares, not an average: kinds, cardinalities, null shares, lengths, ranges."""
    kinds = {a.kind, b.kind}
    score = 0.3 if len(kinds) == 1 else 0.15 if kinds in ({"numeric", "mixed"}, {"string", "mixed"}, {"date", "string"}) else 0.0
    score += 0.25 * _ratio(a.unique_count, b.unique_count) + 0.15 * (1 - abs(a.null_percent - b.null_percent) / 100)
    if a.avg_length and b.avg_length:
        score += 0.2 * _ratio(a.avg_length, b.avg_length)
    if None not in (a.low, a.high, b.low, b.high):
        shared, whole = min(a.high, b.high) - max(a.low, b.low), max(a.high, b.high) - min(a.low, b.low)
        score += 0.1 * (shared / whole if shared > 0 and whole > 0 else 0.0)
    return score


def cardinality_score(a: Context, b: Context) -> float:
    if not a.unique_count or not b.unique_count:
        return 0.0
    r = _ratio(a.unique_count, b.unique_count)
    return r * 0.5 if r < 0.1 else min(0.95, r * 1.1) if r > 0.8 else r


def domain_score(a: Context | None, b: Context | None, related: float = 0.0) -> float:
    """At least 0.5; ``related`` is the score of shared or related concepts."""
    return max(0.5, related, tag_overlap(a, b) if a and b else 0.0)


def quality_score(a: Context, b: Context) -> float:
    score = max(0.2, 1 - (a.null_percent + b.null_percent) / 200)
    score *= 0.5 if min(a.unique_percent, b.unique_percent) < 5 else 1.0
    score *= 0.7 if min(a.unique_percent, b.unique_percent) > 99 else 1.0
    return max(0.1, score)


@dataclass(frozen=True)
class Model:
    """The constant part of the score of a key pair."""

    components: dict[str, float]
    factors: dict[str, float] = field(default_factory=dict)

    @property
    def base(self) -> float:
        return sum(WEIGHTS[k] * v for k, v in self.components.items()) + sum(self.factors.values())


def model(a: Context, b: Context, related: float = 0.0) -> Model:
    factors = {}
    if a.semantic_type == b.semantic_type:
        factors["same_type"] = 0.3 * 0.9 * min(a.confidence, b.confidence)
    else:
        factors["different_type"] = -0.2 * 0.7 * 0.8
    if (a.null_percent + b.null_percent) / 2 > 20:
        factors["many_nulls"] = -0.3 * 0.8 * 0.9
    if a.unique_count and b.unique_count and _ratio(a.unique_count, b.unique_count) < 0.1:
        factors["cardinality_mismatch"] = -0.4 * 0.8 * 0.9
    parts = {
        "semantic_type": type_score(a, b), "statistical": statistical_score(a, b), "cardinality": cardinality_score(a, b),
        "domain": domain_score(a, b, related), "quality": quality_score(a, b),
    }
    return Model(parts, factors)


#: The factor of exact and of fuzzy pairs.
EXACT_FACTOR, FUZZY_FACTOR = 0.25 * 0.9 * 0.95, -0.15 * 0.7 * 0.85


def exact_confidence(m: Model) -> float:
    """Of a pair whose normalized keys are equal."""
    return max(0.0, min(1.0, m.base + WEIGHTS["value_pattern"] + WEIGHTS["normalization"] * 0.8 + EXACT_FACTOR))


def fuzzy_confidence(m: Model, similarity: Column, raw_similarity: Column) -> Column:
    """Of a fuzzy pair, from the similarities of its normalized and of its raw keys."""
    gain = similarity - raw_similarity
    effect = F.when(gain > 0, F.least(F.lit(0.95), gain + 0.3)).otherwise(0.5)
    score = F.lit(m.base + FUZZY_FACTOR) + similarity * 0.6 * WEIGHTS["value_pattern"] + effect * WEIGHTS["normalization"]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def level(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.9, "very_high").when(confidence >= 0.75, "high").when(confidence >= 0.5, "medium").when(confidence >= 0.25, "low").otherwise("very_low")
    )


def reliability(components: Column, n_evidence: Column, n_sure_factors: Column) -> Column:
    """0.5, more with evidence, with components that agree and with factors that are sure."""
    mean = F.aggregate(components, F.lit(0.0), lambda t, x: t + x) / F.size(components)
    spread = F.sqrt(F.aggregate(components, F.lit(0.0), lambda t, x: t + F.pow(x - mean, 2)) / F.size(components))
    score = 0.5 + F.when(n_evidence > 10, 0.2).when(n_evidence > 5, 0.1).otherwise(0.0) + F.greatest(F.lit(0.0), 0.3 - spread) + n_sure_factors * 0.05
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def explain(confidence: Column, match_type: Column, kind: Column) -> Column:
    """A sentence about a match."""
    return F.format_string("%s match by %s keys, confidence %.2f (%s)", match_type, kind, confidence, level(confidence))


def calibration(feedback: DataFrame) -> DataFrame:
    """Precision by join_type of (join_type, predicted boolean, actual boolean)."""
    hit = F.count_if(F.col("predicted") & F.col("actual"))
    false = F.count_if(F.col("predicted") & ~F.col("actual"))
    return feedback.groupBy("join_type").agg(
        hit.alias("true_positives"),
        false.alias("false_positives"),
        F.count_if(~F.col("predicted") & F.col("actual")).alias("false_negatives"),
        F.count_if(~F.col("predicted") & ~F.col("actual")).alias("true_negatives"),
        F.try_divide(hit, hit + false).alias("precision"),
    )


def calibrated(raw: Column, precision: Column) -> Column:
    return F.least(F.lit(1.0), raw * F.coalesce(precision, F.lit(1.0)))
