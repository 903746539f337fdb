"""Continuous forms: windowed profiles, sessions, drift of micro-batches, states of anchors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from concordia.operators import drift, evidence


def window_profile(events: DataFrame, ts: str, value: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """by..., start, end, n, mean, min, max, distinct values (approximate) in tumbling windows; later events are dropped."""
    w = F.window(ts, width)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.approx_count_distinct(value).alias("distinct")
    )
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "min", "max", "distinct")


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """key, start, end, n: runs of events with no longer gap."""
    w = F.session_window(ts, gap)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def drift_sink(baseline: DataFrame, value: str, emit: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: KS and PSI of each micro-batch against the baseline, passed to ``emit``."""

    def run(batch: DataFrame, number: int) -> None:
        stats = drift.ks_test(baseline, batch, value).join(F.broadcast(drift.psi(baseline, batch, value)), how="cross")
        emit(stats.withColumn("batch", F.lit(number)), number)

    return run


STATE = "anchor_id string, state string, since timestamp, positive double, negative double, events int"


def anchor_states(events: DataFrame, as_of: datetime) -> DataFrame:
    """anchor_id, state, since, positive, negative, events, updated with every micro-batch.

    Only running sums are kept per anchor; a micro-batch's events of an anchor are folded
    in order of time.
    """
    rows = evidence.weighed(events, as_of).select("anchor_id", "id", "timestamp", "type", "type_weight", "reliability", "decay", "weight")
    kept = "state string, since timestamp, up double, down double, decay double, trust double, weight double, pos int, neg int, n int"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, since, up, down, decay, trust, weight, pos, neg, n = state.get if state.exists else ("proposed", None, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0, 0)
        for r in pd.concat(batches).sort_values(["timestamp", "id"]).itertuples():
            since = since if since is not None else r.timestamp
            up, down = (up + r.weight, down) if r.type_weight > 0 else (up, down + r.weight)
            decay, trust, weight, n = decay + r.decay, trust + r.reliability * r.weight, weight + r.weight, n + 1
            pos, neg = pos + (r.type in evidence.POSITIVE), neg + (r.type in evidence.NEGATIVE)
            agree = _agreement(n, pos, neg)
            score = max(0.0, min(1.0, ((0.5 + (up - down) * 0.3) * decay / n * (trust / weight if weight else 0.5) + agree) / 2))
            advice = "monitor" if 0.4 <= score <= 0.7 else "deprecate" if score <= 0.3 and n > 10 else "review"
            step = evidence.next_state(name, (r.timestamp - since).total_seconds() / 86400, r.type, score, advice)
            if step:
                name, since = step[0], r.timestamp
        state.update((name, since, up, down, decay, trust, weight, pos, neg, n))
        yield pd.DataFrame([(key[0], name, since, up, down, n)], columns=["anchor_id", "state", "since", "positive", "negative", "events"])

    return rows.groupBy("anchor_id").applyInPandasWithState(run, STATE, kept, "update", GroupStateTimeout.NoTimeout)


def _agreement(n: int, positive: int, negative: int) -> float:
    total = positive + negative
    if n <= 1 or not total:
        return 0.5
    return 0.8 if positive >= total * 0.6 else 0.2 if negative >= total * 0.6 else 0.5


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", **options: Any) -> None:
    """Process what is there and stop; results go to Parquet."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).options(**options).start()
    query.awaitTermination()
