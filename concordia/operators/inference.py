"""Semantic types of columns from value patterns, statistics and names."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.operators import profile

#: Detectors by name with their pattern, weight and semantic type.
DETECTORS = {
    "email": (r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", 0.95, "email"),
    "currency_usd": (r"^\$[0-9,]+\.?[0-9]*$", 0.9, "currency"),
    "currency_euro": (r"^€[0-9,]+\.?[0-9]*$|^[0-9,]+\.?[0-9]*\s*€$", 0.9, "currency"),
    "currency_generic": (r"^[0-9,]+\.[0-9]{2}$", 0.7, "currency"),
    "iso_datetime": (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{3})?(?:Z|[+-][0-9]{2}:[0-9]{2})$", 0.95, "timestamp"),
    "iso_date": (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", 0.9, "date"),
    "us_date": (r"^(0[1-9]|1[0-2])/(0[1-9]|[12][0-9]|3[01])/[0-9]{4}$", 0.85, "date"),
    "unix_timestamp": (r"^[0-9]{10}$", 0.8, "timestamp"),
    "unix_timestamp_ms": (r"^[0-9]{13}$", 0.8, "timestamp"),
    "uuid": (r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$", 0.95, "identifier"),
    "auto_increment_id": (r"^[0-9]+$", 0.6, "identifier"),
    "alphanumeric_id": (r"^[A-Za-z]+[_-]?[A-Za-z0-9]{3,}$", 0.8, "identifier"),
    "prefixed_id": (r"^[A-Za-z]{2,}_[A-Za-z0-9]{3,}$", 0.85, "identifier"),
    "us_zip_code": (r"^[0-9]{5}(-[0-9]{4})?$", 0.9, "postal_code"),
    "us_zip_plus4": (r"^[0-9]{5}-[0-9]{4}$", 0.95, "postal_code"),
    "postal_code_ca": (r"^[A-Za-z][0-9][A-Za-z] [0-9][A-Za-z][0-9]$", 0.9, "postal_code"),
    "postal_code_uk": (r"^[A-Za-z]{1,2}[0-9][A-Za-z0-9]?\s[0-9][A-Za-z]{2}$", 0.9, "postal_code"),
    "phone_us": (r"^(\+1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})$", 0.85, "phone"),
    "phone_international": (r"^\+[1-9][0-9]{1,14}$", 0.8, "phone"),
    "ipv4": (r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$", 0.95, "ip_address"),
    "ipv6": (r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$", 0.95, "ip_address"),
    "url": (r"^https?://(?:[-\w.])+(?::[0-9]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:[\w.])*)?)?$", 0.9, "url"),
    "ssn": (r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", 0.95, "ssn"),
    "credit_card": (r"^[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}$", 0.8, "credit_card"),
    "percentage": (r"^[0-9]+(\.[0-9]+)?%$", 0.8, "percentage"),
    "boolean": (r"(?i)^(true|false|yes|no|y|n|1|0)$", 0.9, "boolean"),
}
#: Types that a column's name hints at, first match wins.
NAME_HINTS = (
    (r"^id$|_id$|^id_", "identifier", 0.95), (r"email", "email", 0.9), (r"phone|tel", "phone", 0.85), (r"date|time", "timestamp", 0.8),
    (r"price|cost|amount", "currency", 0.8),
)
#: Contextual evidence by name; all that match count.
NAME_EVIDENCE = (
    (r"id$|_id$|^id_", "identifier", 0.9), (r"email|mail", "email", 0.95), (r"phone|tel|mobile", "phone", 0.9),
    (r"date|time|created|updated", "timestamp", 0.85), (r"price|cost|amount|salary|revenue", "currency", 0.8), (r"name|title|label", "text", 0.7),
    (r"url|link|href", "url", 0.9), (r"zip|postal", "postal_code", 0.9), (r"status|state|flag", "categorical", 0.8),
    (r"count|number|qty|quantity", "numeric", 0.8),
)
NUMBER = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
DATE = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}.*)?|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})$"


def luhn(c: Column) -> Column:
    """Whether the digits pass the mod-10 check."""
    return F.call_function("luhn_check", c)


def detects(name: str, c: Column) -> Column:
    """The detector's pattern and, where it has one, its validator."""
    hit = c.rlike(DETECTORS[name][0])
    number = c.try_cast("decimal(20,0)")
    if name == "email":
        return hit & (F.length(F.split_part(c, F.lit("@"), F.lit(1))) <= 64) & (F.length(F.split_part(c, F.lit("@"), F.lit(2))) <= 255)
    if name in ("iso_datetime", "iso_date"):
        return hit & F.substring(c, 1, 10).try_cast("date").isNotNull()
    if name == "unix_timestamp":
        return hit & number.between(946684801, 4102444799)
    if name == "unix_timestamp_ms":
        return hit & number.between(946684800001, 4102444799999)
    if name == "auto_increment_id":
        return hit & (F.length(c) < 20) & number.between(1, 999999999)
    if name == "credit_card":
        return hit & luhn(F.regexp_replace(c, r"[-\s]", ""))
    return hit


def pattern_ratios(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, detector, ratio (of the non-missing values) and confidence (ratio times weight), where above 0.

    One aggregate per column and detector in a single pass.
    """
    columns = columns or df.columns
    made = {}
    for name in columns:
        c = F.col(f"`{name}`").cast("string")
        there = F.when(~profile.missing(c), c)
        made[name] = {d: F.avg(F.when(there.isNotNull(), F.coalesce(detects(d, there), F.lit(False)).cast("int"))) for d in DETECTORS}
    tall = profile._tall(df, columns, made)
    cells = F.array(*(F.struct(F.lit(d).alias("detector"), F.col(d).alias("ratio"), (F.col(d) * w).alias("confidence")) for d, (_, w, _) in DETECTORS.items()))
    return tall.select("column", F.explode(cells).alias("x")).where("x.ratio > 0").select("column", "x.detector", "x.ratio", "x.confidence")


def kind_ratios(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, total, unique and null percents, and the shares of numeric, date and boolean values."""
    columns = columns or df.columns
    made = {}
    for name in columns:
        c = F.col(f"`{name}`").cast("string")
        there = F.when(~profile.missing(c), c)
        n = F.count(F.lit(1))
        made[name] = {
            "total": n,
            "unique_percent": F.try_divide(F.count_distinct(there) * 100.0, F.count(there)),
            "null_percent": F.try_divide((n - F.count(there)) * 100.0, n),
            "numeric": F.avg(there.rlike(NUMBER).cast("int")),
            "date": F.avg(there.rlike(DATE).cast("int")),
            "boolean": F.avg(there.rlike("(?i)^(true|false|yes|no|0|1)$").cast("int")),
            "integer": F.avg(there.rlike("^[-+]?[0-9]+$").cast("int")),
        }
    return profile._tall(df, columns, made)


def data_kind(numeric: Column, date: Column, boolean: Column) -> Column:
    """The kind that the shares vote for; dates go before numbers."""
    return F.when(date > 0.7, "date").when(numeric > 0.8, "numeric").when(boolean > 0.9, "boolean").when(numeric > 0.5, "mixed").otherwise("string")


@dataclass(frozen=True)
class Inference:
    column: str
    semantic_type: str
    confidence: float
    kind: str
    best_detector: str | None
    alternatives: tuple[tuple[str, float], ...]


def _by_kind(kind: str, integer: float, unique: float) -> str:
    if kind == "numeric":
        return "identifier" if integer == 1.0 and unique > 95 else "numeric"
    if kind == "string":
        return "categorical" if unique < 20 else "text"
    return {"date": "timestamp", "boolean": "boolean"}.get(kind, "unknown")


def decide(name: str, row: dict, patterns: list[dict]) -> Inference:
    """The decision over one column's small aggregates: patterns, then statistics, then the name."""
    best = max(patterns, key=lambda p: p["confidence"], default=None)
    found, sure = ("unknown", 0.0)
    if best and best["confidence"] > 0.5:
        found, sure = DETECTORS[best["detector"]][2], best["confidence"]
    unique, nulls, total = row["unique_percent"] or 0.0, row["null_percent"] or 0.0, row["total"]
    by_kind = _by_kind(row["kind"], row["integer"] or 0.0, unique)
    statistical = {"numeric": 0.7, "date": 0.8, "boolean": 0.9, "string": 0.5}.get(row["kind"], 0.3)
    statistical = min(1.0, statistical + 0.1 * (nulls < 10) + 0.05 * (unique > 90) + 0.05 * (total > 1000))
    if (statistical > sure * 1.5 and sure < 0.7) or (found == "unknown" and statistical > 0.3):
        found, sure = by_kind, statistical
    hint = next(((t, c) for p, t, c in NAME_HINTS if re.search(p, name.lower())), None)
    if hint and hint[0] == found:
        sure = min(1.0, sure * 1.2)
    elif hint and sure < 0.5:
        found, sure = hint
    sure *= (0.95 if total < 100 else 1.0) * (0.9 if nulls > 50 else 1.0) * (0.95 if unique < 5 else 1.0)
    sure = min(1.0, sure * 1.1) if sure > 0.8 else sure
    votes: dict[str, float] = {}
    for p in patterns:
        kind = DETECTORS[p["detector"]][2]
        votes[kind] = votes.get(kind, 0.0) + p["confidence"] * 0.8
    votes[by_kind] = votes.get(by_kind, 0.0) + statistical * 0.6
    for p, t, c in NAME_EVIDENCE:
        if re.search(p, name.lower()):
            votes[t] = votes.get(t, 0.0) + c * 0.5
    rest = sorted(((t, round(v, 6)) for t, v in votes.items() if t != found and v > 0.3), key=lambda x: (-x[1], x[0]))
    return Inference(name, found, round(sure, 6), row["kind"], best["detector"] if best else None, tuple(rest[:3]))


def infer_types(df: DataFrame, columns: list[str] | None = None) -> list[Inference]:
    """Inferences for all columns: two aggregate jobs, decisions on their few rows."""
    columns = columns or df.columns
    ratios = kind_ratios(df, columns).withColumn("kind", data_kind(F.col("numeric"), F.col("date"), F.col("boolean"))).collect()
    patterns: dict[str, list[dict]] = {}
    for r in pattern_ratios(df, columns).collect():
        patterns.setdefault(r["column"], []).append(r.asDict())
    return [decide(r["column"], r.asDict(), patterns.get(r["column"], [])) for r in ratios]


def systematic_sample(df: DataFrame, order: list[str], size: int = 1000) -> DataFrame:
    """Every k-th row in a hash order, about ``size`` rows: the row's hash decides, so no sort is needed."""
    n = df.count()
    if n <= size:
        return df
    keep = size / n
    return df.where(F.pmod(F.xxhash64(*order), F.lit(1_000_000)) < int(keep * 1_000_000))
