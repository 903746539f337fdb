"""Time series: grains, gaps, grids, alignment and time zones."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Grains in milliseconds; months, quarters and years are 30, 90 and 365 days.
GRAINS = {
    "millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000, "month": 2_592_000_000,
    "quarter": 7_776_000_000, "year": 31_536_000_000,
}


def adjust(ts: Column, grain: str, mode: str = "floor") -> Column:
    """floor, ceil or round to multiples of the grain since 1970, or calendar: the start of the calendar unit."""
    if mode == "calendar":
        return F.date_trunc(grain, ts)
    g, ms = GRAINS[grain], F.unix_millis(ts.cast("timestamp"))
    step = {"floor": F.floor(ms / g), "ceil": F.ceil(ms / g), "round": F.floor(ms / g + 0.5)}[mode]
    return F.timestamp_millis((step * g).cast("long"))


def _intervals(df: DataFrame, ts: str, by: list[str], bucket: str = "day") -> DataFrame:
    """by..., ms: positive intervals between consecutive times.

    Sorted within calendar buckets, whose ends are then chained: no key's whole series
    has to be in one task.
    """
    rows = df.where(F.col(ts).isNotNull()).select(*by, F.unix_millis(F.col(ts).cast("timestamp")).alias("t"), F.date_trunc(bucket, F.col(ts)).alias("b"))
    within = Window.partitionBy(*by, "b").orderBy("t")
    inside = rows.select(*by, (F.col("t") - F.lag("t").over(within)).alias("ms"))
    edges = rows.groupBy(*by, "b").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    across = edges.select(*by, (F.col("lo") - F.lag("hi").over(Window.partitionBy(*by).orderBy("b"))).alias("ms"))
    return inside.unionByName(across).where("ms > 0")


def nearest_grain(ms: Column) -> Column:
    """The first grain within a tenth of the interval, else the nearest."""
    out = F.lit(None).cast("string")
    for name, g in reversed(GRAINS.items()):
        out = F.when(F.abs(ms - g) <= g * 0.1, name).otherwise(out)
    nearest = F.array_min(F.array(*(F.struct(F.abs(ms - g).cast("double").alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, g) in enumerate(GRAINS.items()))))["n"]
    return F.coalesce(out, nearest)


def grain_statistics(df: DataFrame, ts: str, by: list[str] | None = None) -> DataFrame:
    """by..., mode_ms, grain, intervals, mean_ms, var_ms, confidence, regularity.

    The most frequent interval (the smallest of equally frequent ones) names the grain;
    confidence is the share of intervals within a tenth of it, regularity 1 less the coefficient of variation.
    """
    by = by or []
    gaps = _intervals(df, ts, by)
    counts = gaps.groupBy(*by, "ms").agg(F.count("*").alias("n"))
    mode = counts.groupBy(*by).agg(F.max(F.struct("n", (-F.col("ms")).alias("minus"))).alias("top")).select(*by, (-F.col("top.minus")).alias("mode_ms"))
    joined = counts.join(F.broadcast(mode), by) if by else counts.join(F.broadcast(mode))
    n, ms = F.col("n").cast("double"), F.col("ms").cast("double")
    near = F.when(F.abs(ms - F.col("mode_ms")) <= F.col("mode_ms") * 0.1, n).otherwise(0.0)
    out = joined.groupBy(*by).agg(
        F.max("mode_ms").alias("mode_ms"), F.sum("n").alias("intervals"), (F.sum(n * ms) / F.sum(n)).alias("mean_ms"),
        (F.sum(n * ms * ms) / F.sum(n)).alias("square"), (F.sum(near) / F.sum(n)).alias("confidence"),
    )
    variance = F.greatest(F.lit(0.0), F.col("square") - F.col("mean_ms") * F.col("mean_ms"))
    return out.select(
        *by, "mode_ms", nearest_grain(F.col("mode_ms")).alias("grain"), "intervals", "mean_ms", variance.alias("var_ms"), "confidence",
        F.greatest(F.lit(0.0), 1 - F.sqrt(variance) / F.col("mean_ms")).alias("regularity"),
    )


def gap_count(df: DataFrame, ts: str, grain: str, by: list[str] | None = None) -> DataFrame:
    """by..., gaps: grid points between the first and the last time that have no row."""
    by = by or []
    missing = F.greatest(F.round(F.col("ms") / GRAINS[grain]) - 1, F.lit(0.0)).cast("long")
    return _intervals(df, ts, by).groupBy(*by).agg(F.coalesce(F.sum(missing), F.lit(0)).alias("gaps"))


def keeps_order(df: DataFrame, before: str, after: str) -> DataFrame:
    """ordered: whether no two rows change their order from one column to the other.

    Per time of the first column the least and greatest of the second are compared with
    those of the times before; days are chained by their extremes.
    """
    rows = df.groupBy(F.col(before).alias("x")).agg(F.min(after).alias("lo"), F.max(after).alias("hi")).withColumn("b", F.date_trunc("day", "x"))
    prior = Window.partitionBy("b").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select((F.coalesce(F.max("hi").over(prior) <= F.col("lo"), F.lit(True))).alias("ok"))
    days = rows.groupBy("b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    earlier = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    across = days.select(F.coalesce(F.max("hi").over(earlier) <= F.col("lo"), F.lit(True)).alias("ok"))
    return inside.unionByName(across).agg(F.bool_and("ok").alias("ordered"))


def grid(bounds: DataFrame, start: str, end: str, grain: str, by: list[str] | None = None, name: str = "timestamp") -> DataFrame:
    """by..., timestamp: all multiples of the grain from floor(start) to end."""
    step = F.make_dt_interval(secs=F.lit(GRAINS[grain] / 1000).cast("decimal(18,6)"))
    return bounds.select(*(by or []), F.explode(F.sequence(adjust(F.col(start), grain), F.col(end).cast("timestamp"), step)).alias(name))


FILLS = ("forward", "backward", "interpolate", "zero", "drop")


def align(df: DataFrame, ts: str, value: str, grain: str, fill: str = "forward", by: list[str] | None = None, mode: str = "floor", common_grid: bool = False) -> DataFrame:
    """by..., timestamp, value, filled: one point per grid time.

    Points that fall on one grid time are averaged; times without a point are filled
    forward, backward, with the midpoint of the value before and the next one (for each in a
    run, so the k-th of a run lies 1 - 0.5^k of the way), with zero, or left out.
    ``common_grid`` stretches all series over the whole range.
    """
    if fill not in FILLS:
        raise ValueError(f"fill is one of {FILLS}")
    by = by or []
    points = df.where(F.col(ts).isNotNull()).groupBy(*by, adjust(F.col(ts), grain, mode).alias("timestamp")).agg(F.avg(value).alias("value"))
    if fill == "drop":
        return points.select(*by, "timestamp", "value", F.lit(False).alias("filled"))
    if common_grid:
        span = points.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
        bounds = points.select(*by).distinct().join(F.broadcast(span)) if by else span
    else:
        bounds = points.groupBy(*by).agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    whole = grid(bounds, "lo", "hi", grain, by).join(points, [*by, "timestamp"], "left")
    order = Window.partitionBy(*by).orderBy("timestamp")
    last = F.last("value", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first("value", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    if fill == "interpolate":
        seen = F.count("value").over(order.rowsBetween(Window.unboundedPreceding, 0))
        whole = whole.select("*", last.alias("before"), nxt.alias("after"), seen.alias("run"))
        k = F.row_number().over(Window.partitionBy(*by, "run").orderBy("timestamp")) - 1
        between = F.col("after") - (F.col("after") - F.col("before")) * F.pow(F.lit(0.5), k)
        made = F.coalesce("value", between, "before", "after")
    else:
        made = {"forward": F.coalesce("value", last), "backward": F.coalesce("value", nxt), "zero": F.coalesce("value", F.lit(0.0))}[fill]
    return whole.select(*by, "timestamp", made.alias("value"), F.col("value").isNull().alias("filled"))


def advise_grain(stats: dict, span_ms: int, target: int | None = None) -> tuple[str, str]:
    """(grain, reason): the grain found if it is regular, else a coarser one; or the one that gives about ``target`` points."""
    names = list(GRAINS)
    if target is None:
        if stats["regularity"] > 0.8 and stats["confidence"] > 0.8:
            return stats["grain"], "the series is regular"
        return names[min(names.index(stats["grain"]) + 1, len(names) - 1)], "the series is irregular"
    for name in names:
        points = span_ms // GRAINS[name] + 1
        if 0.8 * target <= points <= 1.2 * target:
            return name, f"about {points} points"
    return stats["grain"], "no grain gives that many points"


# --- time zones -------------------------------------------------------------

#: Usual zones with their abbreviations and standard offsets in minutes.
ZONES = {
    "UTC": ("UTC", 0), "America/New_York": ("EST/EDT", -300), "America/Chicago": ("CST/CDT", -360), "America/Denver": ("MST/MDT", -420),
    "America/Los_Angeles": ("PST/PDT", -480), "Europe/London": ("GMT/BST", 0), "Europe/Paris": ("CET/CEST", 60),
    "Europe/Berlin": ("CET/CEST", 60), "Asia/Tokyo": ("JST", 540), "Asia/Shanghai": ("CST", 480), "Australia/Sydney": ("AEST/AEDT", 600),
}


def convert_zone(ts: Column, source: str, target: str) -> Column:
    """The wall clock of ``target`` at the moment that ``source``'s wall clock shows ts."""
    return F.from_utc_timestamp(F.to_utc_timestamp(ts, source), target)


def to_utc(ts: Column, source: str) -> Column:
    return F.to_utc_timestamp(ts, source)


def is_dst(ts: Column, zone: str) -> Column:
    """Whether the zone's offset at ts (UTC) is above its least offset of that year."""
    offset = lambda t: F.unix_micros(F.from_utc_timestamp(t, zone).cast("timestamp")) - F.unix_micros(t.cast("timestamp"))
    january = F.make_timestamp(F.year(ts), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    july = F.make_timestamp(F.year(ts), F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return offset(ts) > F.least(offset(january), offset(july))


def valid_zone(name: str) -> bool:
    try:
        zoneinfo.ZoneInfo(name)
    except (ValueError, zoneinfo.ZoneInfoNotFoundError, OSError):
        return False
    return True


def closest_zone(offset_minutes: int) -> str:
    """The usual zone with the nearest standard offset."""
    return min(ZONES, key=lambda z: abs(ZONES[z][1] - offset_minutes))


def format_zone(ts: Column, zone: str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(ts, zone), pattern), F.lit(f" {ZONES.get(zone, (zone, 0))[0]}"))
