"""Streaming forms of the stateful operators. Watermarks bound the state; late rows beyond them are dropped; output is append."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "10 minutes"


def metric_windows(stream: DataFrame, time: str, value: Column, width: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """(bucket, value, samples): tumbling means, given once the watermark has passed their end."""
    rows = stream.withColumn("_t", F.col(time).cast("timestamp")).withColumn("_v", value).withWatermark("_t", watermark)
    out = rows.groupBy(F.window("_t", width).alias("w")).agg(F.avg("_v").alias("value"), F.count("_v").alias("samples"))
    return out.select(F.col("w.start").alias("bucket"), "value", "samples")


def gap_sessions(stream: DataFrame, entity: str, time: str, gap: str = "10 minutes", watermark: str = WATERMARK) -> DataFrame:
    """(entity, started, ended, events): sessions split by gaps; a session is given once it can't grow any more."""
    rows = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", watermark)
    out = rows.groupBy(entity, F.session_window("_t", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.max("_t").alias("ended"))
    return out.select(entity, F.col("w.start").alias("started"), "ended", "events")


def debounced(stream: DataFrame, path: str, time: str, quiet: str = "1 second", watermark: str = "5 seconds") -> DataFrame:
    """(path, at, changes): one row for each burst of changes of a path."""
    return gap_sessions(stream, path, time, quiet, watermark).select(path, F.col("ended").alias("at"), F.col("events").alias("changes"))


def sliding_count(stream: DataFrame, time: str, flag: Column, width: str = "10 minutes", step: str = "1 minute", least: int = 5, watermark: str = WATERMARK) -> DataFrame:
    """(bucket, n): sliding windows that hold ``least`` flagged rows or more."""
    rows = stream.withColumn("_t", F.col(time).cast("timestamp")).where(flag).withWatermark("_t", watermark)
    out = rows.groupBy(F.window("_t", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= least).select(F.col("w.start").alias("bucket"), "n")


def _closing(timeout_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            started, last, events, failed, pending = state.get
            state.remove()
            outcome = "abandoned" if pending else "failure" if failed * 2 > events else "success"
            yield pd.DataFrame([(key[0], pd.Timestamp(started, unit="us"), pd.Timestamp(last, unit="us"), events, failed, outcome)], columns=["entity", "started", "ended", "events", "failed", "outcome"])
            return
        started, last, events, failed, pending = state.getOption or (None, 0, 0, 0, 0)
        for f in frames:
            us = f["us"].to_numpy()
            started = int(us.min()) if started is None else min(started, int(us.min()))
            last, events, failed = max(last, int(us.max())), events + len(f), failed + int(f["bad"].sum())
            pending = pending + int((f["phase"] == "start").sum()) - int((f["phase"] == "end").sum())
        state.update((started, last, events, failed, pending))
        state.setTimeoutTimestamp(max(last // 1000 + timeout_ms, state.getCurrentWatermarkMs() + 1))

    return run


def tool_sessions(stream: DataFrame, entity: str, time: str, failed: Column, phase: Column, timeout_minutes: int = 60, watermark: str = WATERMARK) -> DataFrame:
    """(entity, started, ended, events, failed, outcome): an entity's events until it was silent for ``timeout_minutes`` of event time.

    A session with tools begun and not ended is abandoned; else one of more failures than successes a failure.
    State holds five numbers for each open entity.
    """
    t = F.col(time).cast("timestamp")
    rows = stream.select(F.col(entity).cast("string").alias("entity"), t.alias("_t"), F.unix_micros(t).alias("us"), failed.cast("int").alias("bad"), phase.alias("phase")).withWatermark("_t", watermark)
    return rows.groupBy("entity").applyInPandasWithState(
        _closing(timeout_minutes * 60_000), "entity string, started timestamp, ended timestamp, events long, failed long, outcome string",
        "started long, last long, events long, failed long, pending long", "append", GroupStateTimeout.EventTimeTimeout,
    )


def _limiting(per_window: int, ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, used = state.getOption or (0, 0)
        for f in frames:
            f = f.sort_values(["us", "id"], kind="stable")
            allowed = []
            for us in f["us"]:
                if us - opened >= ms * 1000 or used == 0:
                    opened, used = us, 0
                used += 1
                allowed.append(used <= per_window)
            yield pd.DataFrame({"entity": key[0], "id": f["id"].to_numpy(), "allowed": allowed})
        state.update((int(opened), int(used)))

    return run


def rate_limited(stream: DataFrame, entity: str, time: str, key: str, per_window: int = 100, seconds: int = 60) -> DataFrame:
    """(entity, id, allowed): a fixed window opens with the first event after the last one closed."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    rows = stream.select(F.col(entity).cast("string").alias("entity"), t.alias("us"), F.col(key).cast("long").alias("id"))
    return rows.groupBy("entity").applyInPandasWithState(_limiting(per_window, seconds * 1000), "entity string, id long, allowed boolean", "opened long, used long", "append", GroupStateTimeout.NoTimeout)


def _weighing(gamma: float):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits, misses = state.getOption or (0.0, 0.0)
        for f in frames:
            for hit in f.sort_values(["us", "id"], kind="stable")["hit"]:
                hits, misses = hits * gamma + hit, misses * gamma + 1 - hit
        state.update((float(hits), float(misses)))
        yield pd.DataFrame([(key[0], 1 + hits, 1 + misses)], columns=["arm", "alpha", "beta"])

    return run


def online_bandit(stream: DataFrame, arm: str, time: str, key: str, hit: Column, gamma: float = 0.99) -> DataFrame:
    """(arm, alpha, beta) after each batch: discounted Beta counts, two numbers of state for each arm. Output mode update."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    rows = stream.select(F.col(arm).alias("arm"), t.alias("us"), F.col(key).cast("long").alias("id"), hit.cast("int").alias("hit"))
    return rows.groupBy("arm").applyInPandasWithState(_weighing(gamma), "arm string, alpha double, beta double", "hits double, misses double", "update", GroupStateTimeout.NoTimeout)


def cooled_down(stream: DataFrame, entity: str, time: str, hours: int = 24) -> DataFrame:
    """(entity, id, allowed) of rows (entity, time, id): one is let through, then none for ``hours``."""
    return rate_limited(stream, entity, time, "id", 1, hours * 3600)


def into_table(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, every: str = "1 minute"):
    """Starts a query that hands each batch to ``merge`` once: the keyed merges of operators.incremental, with a checkpointed offset.

    One instance runs at a time, as a checkpoint has one owner; a batch that is replayed carries the same number.
    """
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
