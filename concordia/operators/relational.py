"""Joins beyond equality: ranges, bands and the latest row before a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, ranges: DataFrame, at: Column, low: str, high: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Rows of points within [low, high] of ranges, by an equi-join on bins of ``width``.

    Each range is repeated for the bins that it touches; the exact bounds are checked after.
    """
    by = by or []
    bins = F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))
    spread = ranges.where(F.col(low) <= F.col(high)).withColumn("__bin", F.explode(bins))
    joined = points.withColumn("__at", at).withColumn("__bin", F.floor(F.col("__at") / width).cast("long")).join(spread, [*by, "__bin"])
    return joined.where(F.col("__at").between(F.col(low), F.col(high))).drop("__bin", "__at")


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, band: float, by: list[str] | None = None) -> DataFrame:
    """Pairs whose values differ by at most ``band``."""
    ranges = right.withColumn("__low", F.col(right_value) - band).withColumn("__high", F.col(right_value) + band)
    return range_join(left, ranges, F.col(left_value), "__low", "__high", max(band, 1e-9) * 2, by).drop("__low", "__high")


def as_of_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, by: list[str], columns: list[str], bucket: str = "day") -> DataFrame:
    """left with ``columns`` of the latest right row of the same keys at or before its time; one shuffle.

    Both sides are unioned and the last right row carried forward.  Keys are cut by time bucket,
    and each bucket starts with the last right row of those before it, so a busy key is
    not one task.
    """
    held = F.struct(F.col(right_ts).alias("__rts"), *columns)
    r = right.select(*by, F.col(right_ts).alias("__ts"), F.date_trunc(bucket, right_ts).alias("__b"), held.alias("__r"))
    names = [c for c in left.columns if c not in by]
    row = F.struct(*(F.col(f"`{c}`") for c in names))
    both = left.select(*by, F.col(left_ts).alias("__ts"), F.date_trunc(bucket, left_ts).alias("__b"), row.alias("__l")).unionByName(r, allowMissingColumns=True)
    order = Window.partitionBy(*by, "__b").orderBy("__ts", F.col("__l").isNotNull())
    inside = both.withColumn("__r", F.last("__r", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("__l").isNotNull())
    ends = both.groupBy(*by, "__b").agg(F.max(F.struct(F.col("__r.__rts"), *(F.col(f"__r.{c}") for c in columns))).alias("__e"))
    earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "__b", F.last(F.when(F.col("__e.__rts").isNotNull(), F.col("__e")), True).over(earlier).alias("__c"))
    joined = inside.join(carried, [*by, "__b"], "left")
    found = F.coalesce("__r", "__c")
    return joined.select(*by, *(F.col(f"__l.`{c}`").alias(c) for c in names), *(found[c].alias(c if c not in left.columns else f"{c}_right") for c in columns))
