"""Column profiles: one aggregate over the table for any number of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
MISSING = ("",)


def missing(c: Column) -> Column:
    """Null or empty."""
    return c.isNull() | (c.cast("string") == "")


def unpivoted(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value): one row per cell, values as strings; a narrow transformation."""
    columns = columns or df.columns
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    return df.select(F.explode(cells).alias("cell")).select("cell.column", "cell.value")


def _tall(df: DataFrame, columns: list[str], made: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate row turned into one row per column."""
    names = list(next(iter(made.values())))
    wide = df.agg(*(x.alias(f"{i}:{n}") for i, c in enumerate(columns) for n, x in made[c].items()))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"`{i}:{n}`").alias(n) for n in names)) for i, c in enumerate(columns)))
    return wide.select(F.explode(cells).alias("p")).select("p.*")


def column_metrics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, total, null_count, unique_count, null_percent, unique_percent, min/max/avg_length.

    Empty strings count as missing, and lengths are those of the values as text.
    """
    columns = columns or df.columns
    made = {}
    for name in columns:
        c = F.col(f"`{name}`")
        there = F.when(~missing(c), c)
        n, text = F.count(F.lit(1)), F.length(there.cast("string"))
        made[name] = {
            "total": n,
            "null_count": n - F.count(there),
            "unique_count": F.count_distinct(there),
            "null_percent": F.try_divide((n - F.count(there)) * 100.0, n),
            "unique_percent": F.try_divide(F.count_distinct(there) * 100.0, F.count(there)),
            "min_length": F.min(text).cast("long"),
            "max_length": F.max(text).cast("long"),
            "avg_length": F.avg(text),
        }
    return _tall(df, columns, made)


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, min, max, mean, median, std_dev (population), is_integer, negatives, zeros, positives."""
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]
    made = {}
    for name in columns:
        c = F.col(f"`{name}`").cast("double")
        made[name] = {
            "min": F.min(c), "max": F.max(c), "mean": F.avg(c), "median": F.percentile(c, 0.5), "std_dev": F.stddev_pop(c),
            "is_integer": F.bool_and(c == F.floor(c)), "negatives": F.count_if(c < 0), "zeros": F.count_if(c == 0), "positives": F.count_if(c > 0),
        }
    return _tall(df, columns, made)


def string_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, avg/min/max/var_length, upper/lower/title shares, has_digits, has_specials."""
    made = {}
    for name in columns:
        c = F.col(f"`{name}`")
        c = F.when(~missing(c), c.cast("string"))
        made[name] = {
            "avg_length": F.avg(F.length(c)), "min_length": F.min(F.length(c)).cast("long"), "max_length": F.max(F.length(c)).cast("long"),
            "var_length": F.var_pop(F.length(c)),
            "upper_share": F.avg((c == F.upper(c)).cast("int")), "lower_share": F.avg((c == F.lower(c)).cast("int")),
            "has_digits": F.bool_or(c.rlike("[0-9]")), "has_specials": F.bool_or(c.rlike("[^A-Za-z0-9 ]")),
        }
    return _tall(df, columns, made)


def affixes(df: DataFrame, column: str, width: int = 3, least_share: float = 0.1) -> DataFrame:
    """kind ('prefix' or 'suffix'), affix, n, share: those with more than ``least_share`` of the values."""
    c = F.col(f"`{column}`").cast("string")
    values = df.where(~missing(F.col(f"`{column}`")) & (F.length(c) >= width)).select(c.alias("v"))
    both = F.array(
        F.struct(F.lit("prefix").alias("kind"), F.substring("v", 1, width).alias("affix")),
        F.struct(F.lit("suffix").alias("kind"), F.expr(f"right(v, {width})").alias("affix")),
    )
    counts = values.select(F.explode(both).alias("a")).groupBy("a.kind", "a.affix").agg(F.count("*").alias("n"))
    total = df.agg(F.count_if(~missing(F.col(f"`{column}`"))).alias("total"))
    return counts.join(F.broadcast(total)).where(F.col("n") > F.col("total") * least_share).select("kind", "affix", "n", (F.col("n") / F.col("total")).alias("share"))


def temporal_stats(df: DataFrame, column: str, bucket: str = "day") -> DataFrame:
    """min, max, range_days, mean and variance of the seconds between consecutive values, sequential.

    Consecutive values are taken within calendar buckets that are then chained by their
    first and last values, so no task sorts the whole column.
    """
    c = F.col(f"`{column}`").cast("timestamp")
    from pyspark.sql import Window

    rows = df.where(c.isNotNull()).select(F.unix_micros(c).alias("t"), F.date_trunc(bucket, c).alias("b"))
    within = Window.partitionBy("b").orderBy("t")
    gaps = rows.select("b", ((F.col("t") - F.lag("t").over(within)) / 1e6).alias("gap")).where(F.col("gap").isNotNull())
    edges = rows.groupBy("b").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    joined = edges.select(((F.col("first") - F.lag("last").over(Window.orderBy("b"))) / 1e6).alias("gap")).where(F.col("gap").isNotNull())
    stats = gaps.select("gap").union(joined).agg(F.avg("gap").alias("avg_gap"), F.var_pop("gap").alias("var_gap"))
    span = rows.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return span.join(F.broadcast(stats)).select(
        F.timestamp_micros("lo").alias("min"),
        F.timestamp_micros("hi").alias("max"),
        ((F.col("hi") - F.col("lo")) / 86400e6).alias("range_days"),
        "avg_gap",
        "var_gap",
        (F.col("var_gap") < F.col("avg_gap") * 0.1).alias("sequential"),
    )


def frame_quality(df: DataFrame, email_columns: list[str] | None = None) -> DataFrame:
    """One row: rows, duplicate_rows and a score of 1 less penalties.

    0.3 for each column with over half missing, 0.1 for over a fifth; 0.2 if over a tenth of the
    rows repeat; 0.1 for each unusual column name and for each e-mail column with invalid values.
    """
    email_columns = email_columns or [c for c in df.columns if "email" in c.lower()]
    n = F.count(F.lit(1))
    shares = [F.try_divide(F.count_if(missing(F.col(f"`{c}`"))), n) for c in df.columns]
    bad_mail = [F.count_if(~missing(F.col(f"`{c}`")) & ~F.col(f"`{c}`").rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")) for c in email_columns]
    odd_names = sum(1 for c in df.columns if not c.strip() or c != c.strip())
    counts = df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.count("*").alias("__n")).agg(F.sum("__n").alias("rows"), F.sum(F.col("__n") - 1).alias("duplicate_rows"))
    made = df.agg(
        sum((F.when(s > 0.5, 0.3).when(s > 0.2, 0.1).otherwise(0.0) for s in shares), F.lit(0.1 * odd_names)).alias("gaps"),
        sum((F.when(b > 0, 0.1).otherwise(0.0) for b in bad_mail), F.lit(0.0)).alias("mail"),
    )
    rows = F.coalesce("rows", F.lit(0))
    repeated = F.when(F.col("duplicate_rows") > rows * 0.1, 0.2).otherwise(0.0)
    return counts.join(F.broadcast(made)).select(
        rows.alias("rows"),
        F.coalesce("duplicate_rows", F.lit(0)).alias("duplicate_rows"),
        F.greatest(F.lit(0.0), 1 - F.col("gaps") - F.col("mail") - repeated).alias("score"),
    )


def schema_overlap(left: DataFrame, right: DataFrame) -> dict:
    """Common and one-sided columns, type mismatches, and the share of common columns."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    common = [c for c in left.columns if c in b]
    return {
        "common": common,
        "only_left": [c for c in left.columns if c not in b],
        "only_right": [c for c in right.columns if c not in a],
        "mismatched": [(c, a[c], b[c]) for c in common if a[c] != b[c]],
        "score": len(common) / max(len(a), len(b), 1),
    }


def validation_scores(issues: DataFrame) -> DataFrame:
    """file, errors, warnings, score: 100 less 20 an error and 5 a warning (file, level)."""
    errors, warnings = F.count_if(F.col("level") == "error"), F.count_if(F.col("level") == "warning")
    rows = issues.groupBy("file").agg(errors.alias("errors"), warnings.alias("warnings"))
    return rows.withColumn("score", F.greatest(F.lit(0), 100 - 20 * F.col("errors") - 5 * F.col("warnings")))


def coverage(files: DataFrame, analyzed: DataFrame) -> DataFrame:
    """files, analyzed, percent, status: 'pass' from 80 percent, 'warn' from 50 (path on both sides)."""
    marked = files.select("path").distinct().join(analyzed.select("path").distinct().withColumn("seen", F.lit(1)), "path", "left")
    out = marked.agg(F.count("*").alias("files"), F.count("seen").alias("analyzed")).withColumn("percent", F.try_divide(F.col("analyzed") * 100.0, F.col("files")))
    return out.withColumn("status", F.when(F.col("percent") >= 80, "pass").when(F.col("percent") >= 50, "warn").otherwise("fail"))


def top_types(log: DataFrame, n: int = 10) -> DataFrame:
    """semantic_type, runs: the n most frequent types of a log."""
    return log.groupBy("semantic_type").agg(F.count("*").alias("runs")).orderBy(F.col("runs").desc(), "semantic_type").limit(n)
