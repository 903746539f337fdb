"""Fingerprints over time: trajectories, velocity, volatility, trends, anomalies, summaries.

A history has column, ts, cardinality, null_ratio and unique_ratio per point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(history: DataFrame, start, end) -> DataFrame:
    """Points of a date range."""
    return history.where(F.col("ts").between(F.lit(start), F.lit(end)))


def trajectory(history: DataFrame) -> DataFrame:
    """column, ts, drift, kind, critical, moved between each point and the one before.

    Drift is the mean of the relative change of cardinality and the changes of both ratios;
    kind names the largest part, ``moved`` is 'spike' or 'drop' where drift passes 0.3.
    """
    order = Window.partitionBy("column").orderBy("ts")
    before = {c: F.lag(c).over(order) for c in ("cardinality", "null_ratio", "unique_ratio")}
    rows = history.select("*", *(v.alias(f"old_{c}") for c, v in before.items())).where(F.col("old_null_ratio").isNotNull())
    parts = {
        "cardinality": F.coalesce(F.try_divide(F.abs(F.col("cardinality") - F.col("old_cardinality")), F.col("old_cardinality")), F.lit(0.0)),
        "null_ratio": F.abs(F.col("null_ratio") - F.col("old_null_ratio")),
        "unique_ratio": F.abs(F.col("unique_ratio") - F.col("old_unique_ratio")),
    }
    most = F.greatest(*parts.values())
    kind = F.when(most == 0, "none")
    for name, part in parts.items():
        kind = kind.when(part == most, name)
    drift = sum(parts.values(), F.lit(0.0)) / len(parts)
    moved = F.when(drift > 0.3, F.when(F.col("cardinality") >= F.col("old_cardinality"), "spike").otherwise("drop"))
    return rows.select("column", "ts", drift.alias("drift"), kind.alias("kind"), (drift > 0.5).alias("critical"), moved.alias("moved"))


def velocity(path: DataFrame) -> DataFrame:
    """column, mean, p50, p90 and max of the drift per day between points."""
    order = Window.partitionBy("column").orderBy("ts")
    days = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(order))) / 86400e6
    rows = path.select("column", (F.col("drift") / days).alias("v")).where("v is not null")
    return rows.groupBy("column").agg(F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("p50"), F.percentile("v", 0.9).alias("p90"), F.max("v").alias("max"))


def volatility(path: DataFrame) -> DataFrame:
    """column, volatility (deviation of the drift), level, predictability (1 less the coefficient of variation)."""
    sd, mean = F.stddev_pop("drift"), F.avg("drift")
    level = F.when(F.col("volatility") < 0.05, "low").when(F.col("volatility") < 0.2, "medium").otherwise("high")
    out = path.groupBy("column").agg(sd.alias("volatility"), F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(sd, mean), F.lit(0.0))).alias("predictability"))
    return out.withColumn("level", level)


def trend(history: DataFrame) -> DataFrame:
    """column, first_mean, last_mean, trend: the cardinality of the first against the last third, beyond a tenth."""
    order = Window.partitionBy("column").orderBy("ts")
    n = F.count("*").over(Window.partitionBy("column"))
    rows = history.select("column", "cardinality", F.row_number().over(order).alias("i"), F.floor(n / 3).alias("k"), n.alias("n")).where("n >= 3")
    means = rows.groupBy("column").agg(
        F.avg(F.when(F.col("i") <= F.col("k"), F.col("cardinality"))).alias("first_mean"),
        F.avg(F.when(F.col("i") > F.col("n") - F.col("k"), F.col("cardinality"))).alias("last_mean"),
    )
    kind = F.when(F.col("last_mean") > F.col("first_mean") * 1.1, "increasing").when(F.col("last_mean") < F.col("first_mean") * 0.9, "decreasing").otherwise("stable")
    return means.withColumn("trend", kind)


def anomalies(history: DataFrame, measure: str = "cardinality", bound: float = 2.5) -> DataFrame:
    """column, ts, value, z: points with |z| above the bound (population deviation)."""
    stats = history.groupBy("column").agg(F.avg(measure).alias("m"), F.stddev_pop(measure).alias("s"))
    z = F.try_divide(F.col(measure) - F.col("m"), F.col("s"))
    return history.join(stats, "column").select("column", "ts", F.col(measure).cast("double").alias("value"), z.alias("z")).where(F.abs("z") > bound)


def index_percentile(df: DataFrame, value: str, percents: list[int], by: list[str] | None = None) -> DataFrame:
    """by..., p5, p50...: the element at place floor(p / 100 * n) of the sorted values, never interpolated.

    Found from counts per distinct value, so repeated values cost nothing.
    """
    from concordia.operators.drift import cumulative

    by = by or []
    cdf = cumulative(df, df.limit(0), value, by)
    places = {p: F.least(F.floor(F.lit(p) * F.col("n1") / 100), F.col("n1") - 1) for p in percents}
    pick = lambda k: F.max(F.when((F.col("c1") > k) & (F.col("c1") - F.col("m1") <= k), F.col("value")))
    return cdf.groupBy(*by).agg(*(pick(k).alias(f"p{p}") for p, k in places.items()))


def summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by..., n, mean, std_dev, min, max and p25, p50, p75, p90, p95, p99 by place."""
    by = by or []
    v = F.col(value).cast("double")
    basic = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_dev"), F.min(v).alias("min"), F.max(v).alias("max"))
    places = index_percentile(df, value, [25, 50, 75, 90, 95, 99], by)
    return basic.join(places, by) if by else basic.join(F.broadcast(places))


def regression(history: DataFrame, measure: str = "cardinality") -> DataFrame:
    """column, slope per day, intercept, r2: the straight line through the points."""
    x, y = F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6, F.col(measure).cast("double")
    return history.groupBy("column").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def forecast(history: DataFrame, days: float, measure: str = "cardinality") -> DataFrame:
    """column, forecast: the line's value so many days after the last point."""
    last = history.groupBy("column").agg(F.max("ts").alias("last"))
    line = regression(history, measure).join(last, "column")
    return line.select("column", (F.col("slope") * (F.unix_micros(F.col("last").cast("timestamp")) / 86400e6 + days) + F.col("intercept")).alias("forecast"))


def autocorrelation(history: DataFrame, lags: list[int], measure: str = "cardinality") -> DataFrame:
    """column, lag, correlation of each measure with the one ``lag`` points before: a sign of cycles."""
    order = Window.partitionBy("column").orderBy("ts")
    shifted = F.array(*(F.struct(F.lit(k).alias("lag"), F.lag(measure, k).over(order).cast("double").alias("old")) for k in lags))
    rows = history.select("column", F.col(measure).cast("double").alias("now"), F.explode(shifted).alias("x"))
    return rows.groupBy("column", "x.lag").agg(F.corr("now", "x.old").alias("correlation"))


def breakpoints(history: DataFrame, measure: str = "cardinality", width: int = 5, bound: float = 0.5) -> DataFrame:
    """column, ts, change: points where the mean of the next ``width`` differs from that of the last by more than the bound."""
    order = Window.partitionBy("column").orderBy("ts")
    old, new = F.avg(measure).over(order.rowsBetween(-width, -1)), F.avg(measure).over(order.rowsBetween(0, width - 1))
    change = F.try_divide(new - old, F.abs(old))
    return history.select("column", "ts", change.alias("change")).where(F.abs("change") > bound)
