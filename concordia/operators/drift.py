"""Two-sample tests and drift detectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a cumulative distribution is cut into; each is summed by itself, then offset.
RANGES = 64


def cumulative(a: DataFrame, b: DataFrame, value: str, by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """by..., value, m1, m2, c1, c2, n1, n2, next: counts, running counts and totals of two samples.

    Equal values are counted before anything is sorted.  Running sums go by ranges of values
    whose totals are then added up, so no task sorts a whole sample.
    """
    by = by or []
    side = lambda df, x, y: df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("value"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    counts = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy(*by, "value").agg(F.sum("x").alias("m1"), F.sum("y").alias("m2"))
    # Asking for the totals too keeps this plan's shuffle equal to that of the counts, which is then read again.
    cuts = counts.agg(F.percentile_approx("value", [i / ranges for i in range(1, ranges)], 1000).alias("cuts"), F.sum(F.col("m1") + F.col("m2")).alias("all"))
    counts = counts.join(F.broadcast(cuts)).where("m1 + m2 <= all")
    counts = counts.withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts", "all")
    totals = counts.groupBy(*by, "range").agg(F.sum("m1").alias("t1"), F.sum("m2").alias("t2"), F.min("value").alias("lowest"))
    order, whole = Window.partitionBy(*by).orderBy("range"), Window.partitionBy(*by)
    totals = totals.select(
        *by, "range",
        (F.sum("t1").over(order) - F.col("t1")).alias("o1"), (F.sum("t2").over(order) - F.col("t2")).alias("o2"),
        F.sum("t1").over(whole).alias("n1"), F.sum("t2").over(whole).alias("n2"), F.lead("lowest").over(order).alias("following"),
    )
    inside = Window.partitionBy(*by, "range").orderBy("value")
    joined = counts.join(totals, [*by, "range"])
    return joined.select(
        *by, "value", "m1", "m2",
        (F.col("o1") + F.sum("m1").over(inside)).alias("c1"), (F.col("o2") + F.sum("m2").over(inside)).alias("c2"), "n1", "n2",
        F.coalesce(F.lead("value").over(inside), F.col("following")).alias("next"),
    )


def ks_p_value(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic p; 1 for a statistic near 0, where the series does not converge."""
    lam = d * F.sqrt(n1 * n2 / (n1 + n2))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda t, k: t + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * total)))


#: c(alpha) of the two-sample test.
KS_CRITICAL = {0.01: 1.63, 0.05: 1.36, 0.10: 1.22}


def ks_test(a: DataFrame, b: DataFrame, value: str, by: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """by..., statistic, critical_value, p_value, n1, n2 and significant (p below alpha)."""
    by = by or []
    cdf = cumulative(a, b, value, by)
    gap = F.abs(F.col("c1") / F.col("n1") - F.col("c2") / F.col("n2"))
    out = cdf.groupBy(*by).agg(F.max(gap).alias("statistic"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    critical = KS_CRITICAL[alpha] * F.sqrt((F.col("n1") + F.col("n2")) / (F.col("n1") * F.col("n2")))
    out = out.withColumn("critical_value", critical).withColumn("p_value", ks_p_value(F.col("statistic"), F.col("n1"), F.col("n2")))
    return out.withColumn("significant", F.col("p_value") < alpha)


def wasserstein(a: DataFrame, b: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by..., distance: the area between the two cumulative distributions."""
    by = by or []
    gap = F.abs(F.col("c1") / F.col("n1") - F.col("c2") / F.col("n2")) * (F.col("next") - F.col("value"))
    return cumulative(a, b, value, by).groupBy(*by).agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("distance"))


def anderson_darling(a: DataFrame, b: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by..., statistic, significant: the rank form that is compared with 2.5 (not the textbook one)."""
    by = by or []
    cdf = cumulative(a, b, value, by)
    n, m = F.col("n1") + F.col("n2"), F.col("m1") + F.col("m2")
    before = F.col("c1") + F.col("c2") - m
    inner = (F.col("c1") > 0) & (F.col("c1") < F.col("n1")) & (F.col("c2") > 0) & (F.col("c2") < F.col("n2"))
    # A value that occurs m times after `before` others has ranks whose weights add up so.
    term = m * (2 * before + m - n) * (F.ln(F.col("c1") / F.col("n1")) + F.ln(F.col("c2") / F.col("n2")))
    out = cdf.groupBy(*by).agg(F.sum(F.when(inner, term).otherwise(0.0)).alias("s"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    n = F.col("n1") + F.col("n2")
    statistic = (-n - F.col("s") / n) * F.col("n1") * F.col("n2") / (n * n)
    return out.select(*by, statistic.alias("statistic"), (statistic > 2.5).alias("significant"))


#: Bounds of the stability classes, and the share that stands for none.
PSI_LEVELS = ((0.1, "stable"), (0.15, "minor"), (0.25, "moderate"))
PSI_FLOOR = 1e-4


def psi(expected: DataFrame, actual: DataFrame, value: str, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    """by..., psi, level: stability over bins whose edges are order statistics of ``expected``.

    Equal edges are one, so columns with few values have fewer bins.  A value's bin follows
    from how many expected values are smaller, so the distribution is passed once and only the
    bins' sums are put together: what lies up to the first edge goes with the bin after it, what
    lies beyond the last one with the bin before it.
    """
    by = by or []
    cdf = cumulative(expected, actual, value, by)

    def edges_below(smaller: Column) -> Column:
        return sum((F.floor(F.lit(i) * (F.col("n1") - 1) / bins) < smaller).cast("int") for i in range(bins + 1))

    has, smaller = F.col("m1") > 0, F.col("c1") - F.col("m1")
    sums = cdf.withColumn("bin", edges_below(smaller)).groupBy(*by, "bin").agg(
        F.sum("m1").alias("s1"), F.sum("m2").alias("s2"), F.max("n1").alias("n1"), F.max("n2").alias("n2"),
        F.min(F.when(has & (smaller == 0), F.col("c1"))).alias("first"), F.max(F.when(has & (F.col("c1") == F.col("n1")), smaller)).alias("last"),
    )
    whole = Window.partitionBy(*by)
    sums = sums.withColumn("lowest", edges_below(F.max("first").over(whole))).withColumn("highest", edges_below(F.max("last").over(whole)))
    sums = sums.withColumn("bin", F.least(F.greatest("bin", "lowest"), F.col("highest")))
    counts = sums.groupBy(*by, "bin").agg((F.sum("s1") / F.max("n1")).alias("e"), (F.sum("s2") / F.max("n2")).alias("a"))
    e, a = F.greatest("e", F.lit(PSI_FLOOR)), F.greatest("a", F.lit(PSI_FLOOR))
    out = counts.groupBy(*by).agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))
    return out.withColumn("level", psi_level(F.col("psi")))


def psi_level(score: Column) -> Column:
    out = F.lit("severe")
    for bound, name in reversed(PSI_LEVELS):
        out = F.when(score < bound, name).otherwise(out)
    return out


def chi_square(observed: DataFrame, expected: DataFrame, category: str, count: str) -> DataFrame:
    """statistic and degrees of freedom of observed against expected counts per category."""
    e = expected.groupBy(category).agg(F.sum(count).alias("e"))
    o = observed.groupBy(category).agg(F.sum(count).alias("o"))
    joined = e.join(o, category, "left").where("e > 0").select(F.coalesce("o", F.lit(0)).cast("double").alias("o"), F.col("e").cast("double").alias("e"))
    return joined.agg(F.sum(F.pow(F.col("o") - F.col("e"), 2) / F.col("e")).alias("statistic"), (F.count("*") - 1).alias("df"))


def chi_square_p(statistic: float, df: int) -> float:
    """Upper tail of the chi-square distribution, by the regularised incomplete gamma function."""
    a, x = df / 2, statistic / 2
    if df <= 0 or x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


# --- detectors over fingerprints --------------------------------------------

#: Thresholds of the detectors.
THRESHOLDS = {"ks": 0.05, "psi": 0.1, "similarity": 0.8, "scale": 5.0, "uniqueness": 0.05, "confidence": 0.1}
#: Weights of kinds of drift and penalties of severities for the confidence.
KIND_WEIGHT = {"distribution": 0.2, "format": 0.3, "unit": 0.3, "joinability": 0.2}
SEVERITY_PENALTY = {"low": 0.05, "medium": 0.10, "high": 0.20, "critical": 0.35}
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
#: What a finding takes from the detector's confidence.
FINDING_PENALTY = {"low": 0.05, "medium": 0.1, "high": 0.2, "critical": 0.3}


def _tiers(x: Column, critical: float, high: float, medium: float) -> Column:
    return F.when(x > critical, "critical").when(x > high, "high").when(x > medium, "medium").otherwise("low")


def _case(values: dict, key: Column, default: float = 0.0) -> Column:
    out = F.lit(default)
    for name, v in values.items():
        out = F.when(key == name, float(v)).otherwise(out)
    return out


def scale_drift(pairs: DataFrame) -> DataFrame:
    """Findings where the range grew or shrank over 5 times; pairs has column, old_/new_ min_num and max_num."""
    old, new = F.col("old_max_num") - F.col("old_min_num"), F.col("new_max_num") - F.col("new_min_num")
    factor = new / old
    away = F.greatest(factor, 1 / factor)
    found = pairs.where((old > 0) & (new > 0)).where(away > THRESHOLDS["scale"])
    return found.select("column", F.lit("unit").alias("kind"), _tiers(away, 100, 50, 10).alias("severity"), factor.alias("metric"), F.lit(THRESHOLDS["scale"]).alias("threshold"))


def joinability_drift(pairs: DataFrame) -> DataFrame:
    """Findings where the unique ratio moved by more than 0.05."""
    moved = F.abs(F.col("old_unique_ratio") - F.col("new_unique_ratio"))
    found = pairs.where(moved > THRESHOLDS["uniqueness"])
    return found.select("column", F.lit("joinability").alias("kind"), _tiers(moved, 0.5, 0.25, 0.1).alias("severity"), moved.alias("metric"), F.lit(THRESHOLDS["uniqueness"]).alias("threshold"))


def distribution_drift(a: DataFrame, b: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Findings of KS or PSI; with 12,000 values or more PSI alone decides, with a baseline under 50 the mean."""
    stats = ks_test(a, b, value, by).join(psi(a, b, value, by), by)
    means = lambda df, n: df.groupBy(*by).agg(F.avg(F.col(value).cast("double")).alias(n))
    stats = stats.join(means(a, "mean1"), by).join(means(b, "mean2"), by)
    shift = F.abs(F.col("mean2") - F.col("mean1")) / F.greatest(F.lit(1.0), F.abs("mean1"))
    few, many = F.col("n1") < 50, F.col("n1") + F.col("n2") >= 12_000
    ks, ps = F.col("p_value") < THRESHOLDS["ks"], F.col("psi") > THRESHOLDS["psi"]
    severity = (
        F.when((F.col("psi") > 0.25) | (F.col("p_value") < 0.001), "critical").when((F.col("psi") > 0.15) | (F.col("p_value") < 0.01), "high").otherwise("medium")
    )
    hit = F.when(few, shift > 0.2).when(many, ps).otherwise(ks | ps)
    return stats.where(hit).select(
        F.col(by[0]).alias("column"),
        F.lit("distribution").alias("kind"),
        F.when(few, F.when(shift > 1, "high").otherwise("medium")).otherwise(severity).alias("severity"),
        F.when(few, shift).otherwise(F.greatest(F.col("psi"), 1 - F.col("p_value"))).alias("metric"),
        F.when(few, 0.2).otherwise(min(THRESHOLDS["psi"], THRESHOLDS["ks"])).alias("threshold"),
    )


def confidence_drift(findings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Findings where the other findings take more than 0.1 from an anchor's confidence (column, confidence)."""
    loss = findings.groupBy("column").agg(F.sum(_case(KIND_WEIGHT, F.col("kind")) * _case(SEVERITY_PENALTY, F.col("severity"))).alias("loss"))
    change = F.col("confidence") - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") * (1 - F.col("loss"))))
    found = loss.join(anchors, "column").where(F.col("confidence").isNotNull()).withColumn("change", change).where(F.col("change") > THRESHOLDS["confidence"])
    return found.select("column", F.lit("confidence").alias("kind"), _tiers(F.col("change"), 0.4, 0.25, 0.15).alias("severity"), F.col("change").alias("metric"), F.lit(THRESHOLDS["confidence"]).alias("threshold"))


def drift_report(findings: DataFrame) -> DataFrame:
    """column, findings, severity, confidence and kinds: one row per column that has findings."""
    rank = _case(SEVERITY_RANK, F.col("severity"))
    out = findings.groupBy("column").agg(
        F.count("*").alias("findings"),
        F.max(rank).alias("worst"),
        F.avg(rank).alias("mean"),
        F.sum(_case(FINDING_PENALTY, F.col("severity"))).alias("penalty"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
    )
    severity = (
        F.when((F.col("worst") >= 4) | (F.col("mean") >= 3.5), "critical")
        .when((F.col("worst") >= 3) | (F.col("mean") >= 2.5), "high")
        .when((F.col("worst") >= 2) | (F.col("mean") >= 1.5), "medium")
        .otherwise("low")
    )
    sure = F.greatest(F.lit(0.1), F.least(F.lit(1.0), 0.5 + F.least(F.col("findings") / 3, F.lit(1.0)) - F.col("penalty")))
    return out.select("column", "findings", severity.alias("severity"), F.round(sure, 6).alias("confidence"), F.array_join("kinds", ",").alias("kinds"))


# --- alerts -----------------------------------------------------------------

#: What each kind of drift touches and what to do about it.
IMPACT = {
    "distribution": ("Averages, models and reports", "Ask what changed where these values come from"),
    "format": ("Parsers and checks", "Compare old and new spellings and adapt the parser"),
    "unit": ("Sums and comparisons", "Find out the unit that each source writes"),
    "joinability": ("Joins on this column", "Count repeated and missing keys on either side"),
    "confidence": ("Matching by meaning", "Infer the column's type again"),
}


def alerts(findings: DataFrame, rows_affected: int = 0) -> DataFrame:
    """An alert per finding: id, thresholds of 0.7 and 1.5 times, impact score, action, escalation."""
    text = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in IMPACT.items() for x in (k, v[i]))), F.col("kind"))
    scale = 2.0 if rows_affected > 1_000_000 else 1.5 if rows_affected > 100_000 else 1.0
    escalation = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "high", 2).otherwise(1)
    return findings.select(
        F.concat(F.lit("alert_"), F.substring(F.sha2(F.concat_ws("|", "column", "kind", "severity"), 256), 1, 16)).alias("alert_id"),
        "column", "kind", "severity", "metric",
        (F.col("threshold") * 0.7).alias("warning_at"), (F.col("threshold") * 1.5).alias("critical_at"),
        (_case(SEVERITY_RANK, F.col("severity")) * scale).alias("impact"), text(0).alias("touches"), text(1).alias("action"), escalation.alias("escalation_level"),
    )


def by_priority(found: DataFrame) -> DataFrame:
    """Worst first: severity, impact, then column and kind."""
    return found.orderBy(_case(SEVERITY_RANK, F.col("severity")).desc(), F.col("impact").desc(), "column", "kind")


def alert_summary(found: DataFrame) -> DataFrame:
    """severity, kind, n over a cube of both (null: all)."""
    return found.cube("severity", "kind").agg(F.count("*").alias("n"))


def health(found: DataFrame) -> DataFrame:
    """health: 100 less the mean severity as a share of the worst."""
    return found.agg((100 - F.coalesce(F.sum(_case(SEVERITY_RANK, F.col("severity"))) / (F.count("*") * 4) * 100, F.lit(0.0))).alias("health"))


# --- cheap checks first, and how well detectors do -----------------------------


def quick_findings(pairs: DataFrame) -> DataFrame:
    """column, reason where fingerprints alone tell: another type, ten times the cardinality, nulls moved by half.

    pairs has column and old_/new_ dtype, cardinality and null_ratio.  Only the columns left over
    need the tests that read values.
    """
    x, y = F.col("old_cardinality"), F.col("new_cardinality")
    reason = (
        F.when(F.col("old_dtype") != F.col("new_dtype"), "dtype")
        .when(F.greatest(x, y) > 10 * F.greatest(F.least(x, y), F.lit(1)), "cardinality")
        .when(F.abs(F.col("old_null_ratio") - F.col("new_null_ratio")) > 0.5, "nulls")
    )
    return pairs.select("column", reason.alias("reason")).where("reason is not null")


def detection_rates(results: DataFrame) -> DataFrame:
    """true_positive_rate and false_positive_rate of (drifted boolean, found boolean)."""
    rate = lambda hit, of: F.try_divide(F.count_if(hit).cast("double"), F.count_if(of))
    d, f = F.col("drifted"), F.col("found")
    return results.agg(rate(d & f, d).alias("true_positive_rate"), rate(~d & f, ~d).alias("false_positive_rate"))


# --- all detectors at once --------------------------------------------------


def column_drift(old: DataFrame, new: DataFrame, columns: list[str] | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """Findings of all detectors for the columns that both frames have.

    Distributions of numeric columns are compared by one frame of (column, value) pairs a side,
    formats of texts by their shapes, ranges and uniqueness by the columns' figures; with
    ``anchors`` (column, confidence) the loss of confidence that follows is a finding too.
    """
    from concordia.operators import anchors as columns_of
    from concordia.operators import patterns

    columns = columns or [c for c in old.columns if c in new.columns]
    figures = ("min_num", "max_num", "unique_ratio", "null_ratio", "cardinality")
    side = lambda df, p: columns_of.fingerprints(df, columns).select("column", *(F.col(c).alias(f"{p}_{c}") for c in figures))
    pairs = side(old, "old").join(side(new, "new"), "column")
    found = scale_drift(pairs).unionByName(joinability_drift(pairs))
    numeric = ("int", "bigint", "smallint", "tinyint", "float", "double")
    kinds = {c: (old.schema[c].dataType.simpleString(), new.schema[c].dataType.simpleString()) for c in columns}
    is_number = lambda k: k in numeric or k.startswith("decimal")
    numbers = [c for c, (x, y) in kinds.items() if is_number(x) and is_number(y)]
    if numbers:
        long = lambda df: df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in numbers))))
        found = found.unionByName(distribution_drift(long(old), long(new), "value", ["column"]))
    for c in (c for c, k in kinds.items() if k == ("string", "string")):
        shapes = patterns.pattern_changes(patterns.shape_frequencies(old, c), patterns.shape_frequencies(new, c))
        found = found.unionByName(patterns.format_findings(c, patterns.similarity(shapes)))
    if anchors is not None:
        found = found.unionByName(confidence_drift(found, anchors))
    return found
