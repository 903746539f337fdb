"""Writers: the evidence log, the anchor store, reports and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_evidence(events: DataFrame, path: str) -> None:
    """Append events as JSON lines; those without an id get one from their contents."""
    made = F.sha2(F.concat_ws("|", "anchor_id", "type", "source", F.col("timestamp").cast("string")), 256)
    data = F.struct(*(c for c in ("anchor_id", "column_name", "dataset", "confidence_score", "details") if c in events.columns))
    out = events.select(F.coalesce("id", F.concat(F.lit("ev_"), F.substring(made, 1, 16))).alias("id"), "timestamp", "type", "source", data.alias("data"))
    out.write.mode("append").json(path)


def write_anchors(store: DataFrame, path: str) -> None:
    """The anchor store as Parquet by dataset; only the datasets that are given are replaced."""
    store.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    store.write.mode("overwrite").partitionBy("dataset").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A small report as JSON lines in one file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def run_metrics(log: DataFrame) -> DataFrame:
    """day, runs, mean_seconds, types: a summary of a log of runs (ts, seconds, semantic_type)."""
    return log.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("runs"), F.avg("seconds").alias("mean_seconds"), F.approx_count_distinct("semantic_type").alias("types"))
