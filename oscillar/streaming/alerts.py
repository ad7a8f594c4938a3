"""Stateful alerting: k-of-n votes, cooldown and hysteresis for each key, in batch and in Structured Streaming by one rule."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "key string, ts timestamp, emitted boolean, active boolean, reason string"
# Reasons.
EMITTED, MERGED, CLEARING, CLEARED, WAITING, COOLING = (
    "persistent_non_normal_event",
    "active_event_merged",
    "waiting_for_clear_hysteresis",
    "cleared_after_generated_normal_outputs",
    "waiting_for_generated_output_persistence",
    "popup_cooldown",
)


class AlertState(NamedTuple):
    """The last flags as bits, the normal windows in a row of an event that is under way (-1: none is), the time of the last alert."""

    votes: int = 0
    calm: int = -1
    last: float = float("-inf")


class AlertRule(NamedTuple):
    """An alert needs k abnormal ones among the last n windows and a cooldown; m normal windows in a row end it."""

    n: int = 5
    k: int = 3
    m: int = 3
    cooldown: float = 30.0

    def after(self, state: AlertState, at: float, abnormal: bool) -> tuple[AlertState, str]:
        votes = (state.votes * 2 + abnormal) % (1 << self.n)
        if state.calm < 0:
            if votes.bit_count() < self.k:
                return AlertState(votes, -1, state.last), WAITING
            if at - state.last < self.cooldown:
                return AlertState(votes, -1, state.last), COOLING
            return AlertState(votes, 0, at), EMITTED
        calm = 0 if abnormal else state.calm + 1
        if calm >= self.m:
            return AlertState(0, -1, state.last), CLEARED
        return AlertState(votes, calm, state.last), MERGED if abnormal else CLEARING


def _steps(rule: AlertRule, state: AlertState, rows: pd.DataFrame) -> tuple[AlertState, pd.DataFrame]:
    out = []
    for ts, abnormal in zip(rows["ts"], rows["abnormal"], strict=True):
        state, reason = rule.after(state, ts.timestamp(), bool(abnormal))
        out.append((reason == EMITTED, state.calm >= 0, reason))
    return state, rows[["key", "ts"]].reset_index(drop=True).join(pd.DataFrame(out, columns=["emitted", "active", "reason"]))


def alerts_batch(windows: DataFrame, **limits) -> DataFrame:
    """key, ts, abnormal → SCHEMA rows. Windows pass in the order of keys and times, and a key's state goes on from batch to batch, so no key's history is held at once."""
    rule = AlertRule(**limits)

    def run(batches):
        key, state = None, AlertState()
        for b in batches:
            done = []
            for own, rows in b.groupby("key", sort=False, dropna=False):
                if own != key:
                    key, state = own, AlertState()
                state, out = _steps(rule, state, rows)
                done.append(out)
            if done:
                yield pd.concat(done)

    rows = windows.select("key", "ts", "abnormal").filter("key IS NOT NULL")
    return rows.repartition("key").sortWithinPartitions("key", "ts").mapInPandas(run, SCHEMA)


def alerts_stream(windows: DataFrame, **limits) -> DataFrame:
    """The same on a stream whose windows arrive in order for each key; state is three numbers."""
    rule = AlertRule(**limits)

    def run(key, batches, state: GroupState):
        rows = pd.concat(list(batches)).sort_values("ts")
        now, out = _steps(rule, AlertState(*state.get) if state.exists else AlertState(), rows)
        state.update(tuple(now))
        yield out

    return windows.select("key", "ts", "abnormal").groupBy("key").applyInPandasWithState(run, SCHEMA, "votes long, calm long, last double", "append", GroupStateTimeout.NoTimeout)


def aligned_windows(samples: DataFrame, seconds: int = 10, late: str = "30 seconds", stride: int | None = None) -> DataFrame:
    """Event-time windows over all sensors, late data dropped after the watermark: start, sensors, n, rms; with a stride they slide."""
    stride = stride or seconds
    w = samples.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds", f"{stride} seconds"))
    agg = w.agg(F.approx_count_distinct("sensor").alias("sensors"), F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    return agg.select(F.col("window.start").alias("start"), "sensors", "n", "rms")


def ready_windows(samples: DataFrame, sensors: int, least: int, seconds: int = 10, stride: int = 2, late: str = "30 seconds") -> DataFrame:
    """start, n of the sliding windows in which every one of the sensors has at least so many samples; each window comes once, when the watermark has passed it."""
    w = F.window("ts", f"{seconds} seconds", f"{stride} seconds")
    per = samples.withWatermark("ts", late).groupBy(w, "sensor").agg(F.count(F.lit(1)).alias("k"))
    full = per.filter(F.col("k") >= least).groupBy("window").agg(F.count(F.lit(1)).alias("ready"), F.sum("k").alias("n"))
    return full.filter(F.col("ready") >= sensors).select(F.col("window.start").alias("start"), "n")


def new_samples(samples: DataFrame, late: str = "30 seconds") -> DataFrame:
    """Appended chunks without the overlap with what has been seen: one row per sensor and time."""
    return samples.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sensor", "ts"])


#: parts of a store, by a hash of the key.
STORE_PARTS = 64


def stored(events: DataFrame, path: str, key: str, checkpoint: str):
    """Starts a query that appends events to a Parquet store, a key once: what the store or the batch itself has is left out.

    The store lies in parts by a hash of the key (column part_), and a batch reads the parts that its keys fall in. A batch
    that is run again after a failure finds what it has already written.
    """

    def insert(batch: DataFrame, _: int) -> None:
        from pyspark.errors import AnalysisException

        fresh = batch.dropDuplicates([key]).withColumn("part_", F.pmod(F.xxhash64(key), F.lit(STORE_PARTS)).cast("int"))
        touched = [r[0] for r in fresh.select("part_").distinct().collect()]  # STORE_PARTS at most
        try:
            there = batch.sparkSession.read.schema(fresh.schema).parquet(path).filter(F.col("part_").isin(touched))
            fresh = fresh.join(there.select(key, "part_"), [key, "part_"], "left_anti")
        except AnalysisException:  # the store has no file yet
            pass
        fresh.repartition("part_").write.mode("append").partitionBy("part_").parquet(path)

    return events.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
