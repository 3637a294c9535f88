"""Token-bucket admission and other event-driven behaviour, as batch jobs and as streams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..operators.folds import folded
from ..operators.ranges import segments

DECISIONS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.StringType()), T.StructField("action", T.StringType()),
    T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.IntegerType()),
])


def admit(tokens: float, last_ms: float, now_ms: float, limit: int, interval_ms: int = rules.RATE_INTERVAL_MS) -> tuple[float, bool, int]:
    """(tokens left, allowed, seconds to wait) of one request."""
    rate = limit / interval_ms
    tokens = min(limit, tokens + (now_ms - last_ms) * rate)
    if tokens >= 1:
        return tokens - 1, True, 0
    return tokens, False, max(1, math.ceil((1 - tokens) / rate / 1000))


def next_state(state: tuple[float, float] | None, now: float, limit: int | None) -> tuple[tuple[float, float], bool, int]:
    """A bucket after a request, and its decision; actions without a limit are always allowed."""
    if limit is None:
        return (0.0, now), True, 0
    tokens, last = state or (float(limit), now)
    tokens, ok, seconds = admit(tokens, last, now, limit)
    return (tokens, now), ok, seconds


class Bucket:
    """Decisions on the requests of one user and action, one after the other."""

    def __init__(self, key: object):
        self.held = None

    def row(self, key, event_id, user_id, action, at_us) -> list[tuple]:
        self.held, ok, seconds = next_state(self.held, at_us / 1000, rules.RATE_LIMITS.get(action))
        return [(event_id, user_id, action, ok, seconds)]

    def end(self) -> list[tuple]:
        return []


def full_again(before: Column, now: Column) -> Column:
    """Whether a bucket has filled up since the request before (a millisecond over the interval, so that rounding can't tell it from a new one)."""
    return now["at_us"] - before["at_us"] >= (rules.RATE_INTERVAL_MS + 1) * 1000


def admissions(requests: DataFrame) -> DataFrame:
    """Every request with its decision; each user and action has a bucket of its own.

    A bucket is full, as a new one is, after 15 idle minutes, so the requests between two such pauses are decided by themselves: a user's work
    is dealt to as many tasks as there are pauses.
    """
    rows = requests.select(F.concat_ws("\x1f", "action", "user_id").alias("key"), "event_id", "user_id", "action", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    rows = segments(rows, "key", ["at_us", "event_id"], full_again)
    rows = rows.select(F.concat_ws("\x1f", "key", "segment").alias("key"), "event_id", "user_id", "action", "at_us")
    return folded(rows, "key", ["at_us", "event_id"], Bucket, "event_id long, user_id string, action string, allowed boolean, retry_after int")


def admission_stream(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The same over a stream; a key's bucket is forgotten when it must be full again by the time of the events, however long a batch waits.

    Requests of a batch are decided in order of time, and batches as they come: a request from before the last one of its key finds
    the bucket as that one left it. Those older than the watermark (``delay`` behind the latest request) are not decided.
    """
    rows = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        limit, held = rules.RATE_LIMITS.get(key[0]), state.get if state.exists else None
        out = []
        for now in (pdf["ts"].astype("datetime64[us]").astype("int64") / 1000).tolist():
            held, *said = next_state(held, max(now, held[1]) if held else now, limit)
            out.append(said)
        state.update((float(held[0]), float(held[1])))
        full = int(held[1]) + rules.RATE_INTERVAL_MS + 1
        # a timer must lie behind the watermark
        state.setTimeoutTimestamp(max(full, state.getCurrentWatermarkMs() + 1))
        yield pdf[["event_id", "user_id", "action"]].assign(allowed=[ok for ok, _ in out], retry_after=pd.Series([w for _, w in out], pdf.index, "int32"))

    state = T.StructType([T.StructField("tokens", T.DoubleType()), T.StructField("last_ms", T.DoubleType())])
    return rows.groupBy("action", "user_id").applyInPandasWithState(run, DECISIONS, state, "append", "EventTimeTimeout")


def latest_status(events: DataFrame) -> DataFrame:
    """The last status of each document; over a stream, in update mode."""
    last = F.max_by("status", F.struct("ts", "id"))
    return events.groupBy("document_id").agg(last.alias("status"), F.count(F.lit(1)).alias("n_events"))
