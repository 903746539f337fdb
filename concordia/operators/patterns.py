"""Format drift: which value patterns two samples have, and how their shapes changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.operators.profile import missing

#: Common patterns, kept above a tenth of the values.
COMMON = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^[\+]?[1-9][0-9\-\(\)\s\+\.]{7,15}$",
    "uuid": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$",
    "date_iso": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "date_us": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "credit_card": r"^[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}$",
    "ip_address": r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$",
    "url": r"^https?://(www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b([-a-zA-Z0-9()@:%_\+.~#?&/=]*)$",
    "numeric": r"^-?[0-9]+(\.[0-9]+)?$",
    "alphanumeric": r"^[a-zA-Z0-9]+$",
    "alpha": r"^[a-zA-Z]+$",
}
#: Patterns of meaning, kept above a twentieth.
MEANING = {
    "person_name": r"^[A-Z][a-z]+ [A-Z][a-z]+$",
    "company_name": r"^[A-Z][a-zA-Z0-9\s&\.,\-']+$",
    "address": r"^[0-9]+\s+[A-Za-z0-9\s\.,\-\#]+$",
    "postal_code": r"^[A-Z0-9\-\s]{3,10}$",
    "currency": r"^\$?[0-9]{1,3}(,[0-9]{3})*(\.[0-9]{2})?$",
    "percentage": r"^[0-9]{1,3}(\.[0-9]+)?%$",
}


def shape(c: Column) -> Column:
    """Runs of letters, digits and blanks as single marks; other characters as they are."""
    out = F.regexp_replace(c, "[a-z]+", "a")
    out = F.regexp_replace(out, "[A-Z]+", "A")
    return F.regexp_replace(F.regexp_replace(out, "[0-9]+", "9"), r"\s+", " ")


def pattern_frequencies(df: DataFrame, column: str) -> DataFrame:
    """pattern, frequency: the common and meaningful patterns of the non-missing values, in one pass."""
    c = F.col(f"`{column}`").cast("string")
    values = df.where(~missing(F.col(f"`{column}`"))).select(c.alias("v"))
    bounds = {**dict.fromkeys(COMMON, 0.1), **dict.fromkeys(MEANING, 0.05)}
    shares = values.agg(*(F.avg(F.col("v").rlike(p).cast("int")).alias(n) for n, p in {**COMMON, **MEANING}.items()))
    cells = F.array(*(F.struct(F.lit(n).alias("pattern"), F.col(n).alias("frequency"), F.lit(b).alias("least")) for n, b in bounds.items()))
    return shares.select(F.explode(cells).alias("x")).where("x.frequency > x.least").select("x.pattern", "x.frequency")


def shape_frequencies(df: DataFrame, column: str, least: float = 0.3) -> DataFrame:
    """pattern, frequency: shapes with more than that share of the values."""
    c = F.col(f"`{column}`").cast("string")
    values = df.where(~missing(F.col(f"`{column}`"))).select(shape(c).alias("pattern"))
    total = values.agg(F.count("*").alias("total"))
    return values.groupBy("pattern").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("pattern", (F.col("n") / F.col("total")).alias("frequency")).where(F.col("frequency") > least)


def length_frequencies(df: DataFrame, column: str, least: float = 0.2, most: int = 3) -> DataFrame:
    """length, frequency: fixed lengths with more than that share, if there are at most three."""
    c = F.length(F.col(f"`{column}`").cast("string"))
    counts = df.where(~missing(F.col(f"`{column}`"))).groupBy(c.alias("length")).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return counts.join(F.broadcast(totals)).where(F.col("kinds") <= most).select("length", (F.col("n") / F.col("total")).alias("frequency")).where(F.col("frequency") > least)


def pattern_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """pattern, old_frequency, new_frequency, change ('new', 'lost', 'kept') of two frequency tables."""
    a, b = old.withColumnRenamed("frequency", "old_frequency"), new.withColumnRenamed("frequency", "new_frequency")
    both = a.join(b, "pattern", "full")
    change = F.when(F.col("old_frequency").isNull(), "new").when(F.col("new_frequency").isNull(), "lost").otherwise("kept")
    return both.select("pattern", F.coalesce("old_frequency", F.lit(0.0)).alias("old_frequency"), F.coalesce("new_frequency", F.lit(0.0)).alias("new_frequency"), change.alias("change"))


def similarity(changes: DataFrame) -> DataFrame:
    """similarity (weighted Jaccard of the frequencies), new_patterns, lost_patterns, stability."""
    score = F.coalesce(F.sum(F.least("old_frequency", "new_frequency")) / F.sum(F.greatest("old_frequency", "new_frequency")), F.lit(1.0))
    out = changes.agg(score.alias("similarity"), F.count_if(F.col("change") == "new").alias("new_patterns"), F.count_if(F.col("change") == "lost").alias("lost_patterns"))
    moved = F.col("new_patterns") + F.col("lost_patterns")
    stability = F.when((F.col("similarity") > 0.9) & (moved == 0), "stable").when(F.col("similarity") > 0.7, "evolving").otherwise("unstable")
    return out.withColumn("stability", stability)


def sample_changes(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """avg_length_change, upper/lower/digit share changes and delimiter share changes between two samples."""
    c = F.col(f"`{column}`").cast("string")
    measures = {
        "avg_length": F.avg(F.length(c)), "upper": F.avg(c.rlike("^[^a-z]*[A-Z][^a-z]*$").cast("int")), "lower": F.avg(c.rlike("^[^A-Z]*[a-z][^A-Z]*$").cast("int")),
        "digits": F.avg(c.rlike("[0-9]").cast("int")), "comma": F.avg(c.contains(",").cast("int")), "semicolon": F.avg(c.contains(";").cast("int")),
        "pipe": F.avg(c.contains("|").cast("int")), "dash": F.avg(c.contains("-").cast("int")), "underscore": F.avg(c.contains("_").cast("int")),
    }
    one = lambda df, p: df.where(~missing(F.col(f"`{column}`"))).agg(*(m.alias(f"{p}_{n}") for n, m in measures.items()))
    both = one(old, "old").join(F.broadcast(one(new, "new")))
    return both.select(*((F.col(f"new_{n}") - F.col(f"old_{n}")).alias(f"{n}_change") for n in measures))


def character_changes(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """character, change: characters that only one of the samples has."""
    letters = lambda df: df.select(F.explode(F.split(F.col(f"`{column}`").cast("string"), "")).alias("character")).where("character <> ''").distinct()
    a, b = letters(old), letters(new)
    gone = a.join(b, "character", "left_anti").withColumn("change", F.lit("lost"))
    return b.join(a, "character", "left_anti").withColumn("change", F.lit("new")).unionByName(gone)


def format_findings(column: str, result: DataFrame) -> DataFrame:
    """A drift finding where the similarity is below 0.8."""
    severity = F.when(F.col("stability") == "unstable", F.when(F.col("similarity") < 0.3, "critical").otherwise("high")).when(F.col("stability") == "evolving", "medium").otherwise("low")
    return result.where("similarity < 0.8").select(
        F.lit(column).alias("column"), F.lit("format").alias("kind"), severity.alias("severity"), (1 - F.col("similarity")).alias("metric"), F.lit(0.2).alias("threshold")
    )
