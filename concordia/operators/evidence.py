"""The evidence log: events about anchors, their confidence, recommendation, state and replay.

Events have id, timestamp, type, source and anchor_id.  Ages count from ``as_of``, so results
do not depend on the clock.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = (
    "id string, timestamp timestamp, type string, source string, anchor_id string, column_name string, dataset string, "
    "confidence_score double, details map<string,string>"
)
#: Weights of the types of evidence.
TYPE_WEIGHTS = {
    "human_approval": 0.8, "human_rejection": -0.9, "statistical_match": 0.4, "schema_consistency": 0.3, "temporal_stability": 0.2,
    "cross_validation": 0.5, "anchor_creation": 0.1, "anchor_deprecation": -0.3,
}
#: How far each source is trusted.
SOURCE_WEIGHTS = {
    "human_feedback": 1.0, "automated_analysis": 0.7, "cross_reference": 0.8, "statistical_model": 0.6, "system_validation": 0.5,
}
DECAY = 0.95
POSITIVE = ("human_approval", "statistical_match", "schema_consistency", "temporal_stability", "cross_validation")
NEGATIVE = ("human_rejection", "anchor_deprecation")


def _map(values: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key), F.lit(default))


def query(events: DataFrame, anchor_id: str | None = None, type: str | None = None, source: str | None = None, start=None, end=None, limit: int | None = None) -> DataFrame:  # noqa: A002
    """The events that meet all conditions, by time."""
    for name, value in (("anchor_id", anchor_id), ("type", type), ("source", source)):
        if value is not None:
            events = events.where(F.col(name) == value)
    if start is not None:
        events = events.where(F.col("timestamp") >= F.lit(start))
    if end is not None:
        events = events.where(F.col("timestamp") <= F.lit(end))
    events = events.orderBy("timestamp", "id")
    return events.limit(limit) if limit is not None else events


def statistics(events: DataFrame) -> DataFrame:
    """type, source, n, oldest, newest over a cube of both (null: all)."""
    return events.cube("type", "source").agg(F.count("*").alias("n"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


def weighed(events: DataFrame, as_of: datetime) -> DataFrame:
    """events with type_weight, reliability, decay and weight."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp"))) / 86400e6
    out = events.withColumns(
        {
            "type_weight": _map(TYPE_WEIGHTS, F.col("type"), 0.1),
            "reliability": _map(SOURCE_WEIGHTS, F.col("source"), 0.5),
            "decay": F.pow(F.lit(DECAY), age),
        }
    )
    return out.withColumn("weight", F.abs("type_weight") * F.col("reliability") * F.col("decay"))


def consistency(n: Column, positive: Column, negative: Column) -> Column:
    total = positive + negative
    return (
        F.when((n <= 1) | (total == 0), 0.5).when(positive >= total * 0.6, 0.8).when(negative >= total * 0.6, 0.2).otherwise(0.5)
    )


def final_confidence(positive: Column, negative: Column, decay: Column, reliability: Column, agreement: Column) -> Column:
    score = ((0.5 + (positive - negative) * 0.3) * decay * reliability + agreement) / 2
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def confidence(events: DataFrame, as_of: datetime) -> DataFrame:
    """anchor_id, evidence, positive, negative, decay, reliability, consistency, confidence."""
    up, down = F.col("type_weight") > 0, F.col("type_weight") <= 0
    rows = weighed(events, as_of).groupBy("anchor_id").agg(
        F.count("*").alias("evidence"),
        F.coalesce(F.sum(F.when(up, F.col("weight"))), F.lit(0.0)).alias("positive"),
        F.coalesce(F.sum(F.when(down, F.col("weight"))), F.lit(0.0)).alias("negative"),
        F.avg("decay").alias("decay"),
        F.coalesce(F.try_divide(F.sum(F.col("reliability") * F.col("weight")), F.sum("weight")), F.lit(0.5)).alias("reliability"),
        consistency(F.count("*"), F.count_if(F.col("type").isin(*POSITIVE)), F.count_if(F.col("type").isin(*NEGATIVE))).alias("consistency"),
    )
    return rows.withColumn("confidence", final_confidence(*(F.col(c) for c in ("positive", "negative", "decay", "reliability", "consistency"))))


def aggregate(events: DataFrame, as_of: datetime) -> DataFrame:
    """confidence() with counts by kind of source, indicators and a recommendation."""
    has = lambda t: F.coalesce(F.bool_or(F.col("type") == t), F.lit(False))
    day = F.col("timestamp") >= F.lit(as_of) - F.expr("interval 24 hours")
    recent = lambda types: F.coalesce(F.bool_or(day & F.col("type").isin(*types)), F.lit(False))
    summary = events.groupBy("anchor_id").agg(
        F.count_if(F.col("timestamp") >= F.lit(as_of) - F.expr("interval 7 days")).alias("recent"),
        F.count_if(F.col("source") == "human_feedback").alias("human"),
        F.count_if(F.col("source").isin("automated_analysis", "statistical_model", "system_validation")).alias("automated"),
        has("schema_consistency").alias("schema_stable"),
        has("temporal_stability").alias("temporal_consistent"),
        has("cross_validation").alias("cross_validated"),
        has("human_approval").alias("human_approved"),
        (recent(POSITIVE) & recent(NEGATIVE)).alias("conflicting"),
    )
    rows = confidence(events, as_of).join(summary, "anchor_id")
    return rows.withColumn("recommendation", recommendation())


def recommendation() -> Column:
    c, human, conflict = F.col("confidence"), F.col("human"), F.col("conflicting")
    return (
        F.when(conflict & (human == 0), "review")
        .when((c >= 0.9) & F.col("human_approved"), "accept")
        .when((c >= 0.8) & (F.col("cross_validated") | F.col("temporal_consistent")), "accept")
        .when((c <= 0.2) | (conflict & (human > 0)), "reject")
        .when((c <= 0.3) & (F.col("evidence") > 10), "deprecate")
        .when((c >= 0.4) & (c <= 0.7), "monitor")
        .otherwise("review")
    )


def aggregate_recent(events: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """aggregate() of the anchors with an event in the last hours."""
    touched = events.where(F.col("timestamp") >= F.lit(as_of) - F.expr(f"interval {hours} hours")).select("anchor_id").distinct()
    return aggregate(events.join(touched, "anchor_id", "left_semi"), as_of)


def explain(rows: DataFrame) -> DataFrame:
    """anchor_id and a sentence about its confidence."""
    return rows.select(
        "anchor_id",
        F.format_string("%d events, confidence %.3f (%.3f for, %.3f against): %s", "evidence", "confidence", "positive", "negative", "recommendation").alias("report"),
    )


def replay(events: DataFrame, as_of: datetime) -> DataFrame:
    """id, anchor_id, step, confidence after each event and its change from the one before (0.5 at first)."""
    order = Window.partitionBy("anchor_id").orderBy("timestamp", "id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    w = weighed(events, as_of)
    total = lambda c: F.sum(c).over(so_far)
    n = F.count(F.lit(1)).over(so_far)
    up = F.coalesce(total(F.when(F.col("type_weight") > 0, F.col("weight")).otherwise(0.0)), F.lit(0.0))
    down = F.coalesce(total(F.when(F.col("type_weight") <= 0, F.col("weight")).otherwise(0.0)), F.lit(0.0))
    agree = consistency(n, total(F.col("type").isin(*POSITIVE).cast("int")), total(F.col("type").isin(*NEGATIVE).cast("int")))
    trust = F.coalesce(F.try_divide(total(F.col("reliability") * F.col("weight")), total(F.col("weight"))), F.lit(0.5))
    out = w.select("id", "anchor_id", "timestamp", n.alias("step"), final_confidence(up, down, F.avg("decay").over(so_far), trust, agree).alias("confidence"))
    return out.withColumn("change", F.col("confidence") - F.lag("confidence", 1, 0.5).over(order)).drop("timestamp")


def slices(events: DataFrame, hours: int) -> DataFrame:
    """anchor_id, slice, events, first_id, last_id in tumbling slices from the earliest event of all."""
    start = events.agg(F.min("timestamp").alias("start"))
    number = F.floor((F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / (hours * 3600e6)).alias("slice")
    at = F.struct("timestamp", "id")
    return events.join(F.broadcast(start)).groupBy("anchor_id", number).agg(F.count("*").alias("events"), F.min_by("id", at).alias("first_id"), F.max_by("id", at).alias("last_id"))


# --- states of anchors ------------------------------------------------------

#: Thresholds of the transitions, and days until a state is due for review.
RULES = {"accept": 0.8, "reject": 0.2, "monitoring_days": 30}
REVIEW_DAYS = {"proposed": 7, "monitoring": 30, "accepted": 60}


def next_state(state: str, days_in_state: float, type: str, score: float, advice: str) -> tuple[str, str] | None:  # noqa: A002
    """(state, trigger) that an event leads to, or None."""
    human = {"human_approval": "accepted", "human_rejection": "rejected"}.get(type)
    if state in ("proposed", "monitoring"):
        if human:
            return human, type
        if score >= RULES["accept"]:
            return "accepted", "confidence_threshold"
        if score <= RULES["reject"]:
            return "rejected", "confidence_threshold"
        if state == "proposed":
            return ("monitoring", "evidence_accumulation") if advice == "monitor" else None
        if days_in_state >= RULES["monitoring_days"]:
            return ("deprecated", "temporal_decay") if score < 0.5 else ("accepted", "evidence_accumulation")
        return None
    if state == "accepted":
        if type == "human_rejection":
            return "deprecated", type
        if score <= RULES["reject"]:
            return "deprecated", "confidence_threshold"
        return ("deprecated", "evidence_accumulation") if advice == "deprecate" else None
    return ("monitoring", "manual_override") if type == "human_approval" and score > 0.5 else None


def scored_steps(events: DataFrame, as_of: datetime) -> DataFrame:
    """id, anchor_id, timestamp, type, confidence and advice at each step, for the state machine."""
    steps = replay(events, as_of).join(events.select("id", "timestamp", "type"), "id")
    advice = F.when((F.col("confidence") >= 0.4) & (F.col("confidence") <= 0.7), "monitor").when((F.col("confidence") <= 0.3) & (F.col("step") > 10), "deprecate").otherwise("review")
    return steps.select("id", "anchor_id", "timestamp", "type", "confidence", advice.alias("advice"))


TRANSITION = "anchor_id string, id string, from_state string, to_state string, trigger string, at timestamp"


def fold(state: tuple[str, pd.Timestamp] | None, rows: pd.DataFrame) -> tuple[tuple[str, pd.Timestamp], list[tuple]]:
    """Run ordered steps of one anchor through next_state()."""
    made = []
    for r in rows.itertuples():
        name, since = state or ("proposed", r.timestamp)
        step = next_state(name, (r.timestamp - since).total_seconds() / 86400, r.type, r.confidence, r.advice)
        state = (step[0], r.timestamp) if step else (name, since)
        if step:
            made.append((r.anchor_id, r.id, name, *step, r.timestamp))
    return state, made


def transitions(steps: DataFrame) -> DataFrame:
    """The transitions of every anchor: a fold over its steps in order.

    The fold reads an anchor's sorted rows in batches and keeps only its state, so a
    busy anchor does not have to fit in memory.
    """
    columns = [c.split()[0] for c in TRANSITION.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for rows in batches:
            made = []
            for anchor, part in rows.groupby("anchor_id", sort=False):
                if anchor != current:
                    current, state = anchor, None
                state, new = fold(state, part)
                made += new
            yield pd.DataFrame(made, columns=columns)

    ordered = steps.repartition("anchor_id").sortWithinPartitions("anchor_id", "timestamp", "id")
    return ordered.mapInPandas(run, TRANSITION)


def current_states(moves: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor_id, state, since, review_due of all anchors (anchor_id, created)."""
    last = moves.groupBy("anchor_id").agg(F.max_by("to_state", F.struct("at", "id")).alias("state"), F.max("at").alias("since"))
    joined = anchors.join(last, "anchor_id", "left").select("anchor_id", F.coalesce("state", F.lit("proposed")).alias("state"), F.coalesce("since", "created").alias("since"))
    days = F.try_element_at(F.create_map(*(F.lit(x) for kv in REVIEW_DAYS.items() for x in kv)), F.col("state"))
    return joined.withColumn("review_due", F.timestamp_micros(F.unix_micros(F.col("since").cast("timestamp")) + days * 86400000000))


def due_for_review(states: DataFrame, as_of: datetime) -> DataFrame:
    return states.where(F.col("review_due") <= F.lit(as_of))
