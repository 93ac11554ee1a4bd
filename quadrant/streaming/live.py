"""Structured Streaming forms of the stateful operators.

The steps are those of the batch operators; here a key's state lives in the state store and expires by processing time, so keys
that fall silent cost nothing. Exactly-once output comes from the query's checkpoint, which belongs in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limit(events: DataFrame, key: str, at_ms: str, order: str, window_ms: int, most: int, expire: bool = True) -> DataFrame:
    """(order, allowed, remaining) of a stream: windows open at a key's first event after the last one ended. Within a micro-batch events are taken in order of time.

    ``expire`` drops the state of keys that fall silent for two windows of processing time. A stream with such timeouts runs
    batches for ever, so a run over what is there (availableNow) has to do without.
    """

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until, count = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(frames)).sort_values([at_ms, order])
        out = []
        for now, number in zip(rows[at_ms], rows[order], strict=True):
            if until <= now:
                until, count = int(now) + window_ms, 0
            count += 1
            out.append((int(number), count <= most, max(0, most - count)))
        state.update((int(until), count))
        if expire:
            state.setTimeoutDuration(2 * window_ms)
        yield pd.DataFrame(out, columns=[order, "allowed", "remaining"])

    rows = events.select(key, at_ms, order).filter(f"{key} is not null and {at_ms} is not null")
    return rows.groupBy(key).applyInPandasWithState(run, f"{order} long, allowed boolean, remaining long", "until long, count long", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def decayed_visits(events: DataFrame, key: str, at_ms: str, half_life_ms: float) -> DataFrame:
    """(key, weight, at): each key's decayed number of visits after every micro-batch. Late visits count what they are worth by then."""

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weight, at = state.get if state.exists else (0.0, 0)
        for frame in frames:
            times = frame[at_ms].to_numpy()
            last = max(int(times.max()), at)
            weight = weight * 0.5 ** ((last - at) / half_life_ms) + float((0.5 ** ((last - times) / half_life_ms)).sum())
            at = last
        state.update((weight, at))
        yield pd.DataFrame([(name[0], weight, at)], columns=[key, "weight", "at"])

    rows = events.select(key, at_ms).filter(f"{key} is not null and {at_ms} is not null")
    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, weight double, at long", "weight double, at long", "update", GroupStateTimeout.NoTimeout)


def progress(fixes: DataFrame, key: str, at_ms: str, along: str, stops: list[float], reach: float) -> DataFrame:
    """(key, at_ms, step) of a stream of positions along a line: the step never goes back."""
    edges = list(stops)

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (step,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames)).sort_values(at_ms)
        out = []
        for now, metres in zip(rows[at_ms], rows[along], strict=True):
            step = max(step, min(len(edges) - 1, sum(e < metres + reach for e in edges)))
            out.append((name[0], int(now), step))
        state.update((int(step),))
        yield pd.DataFrame(out, columns=[key, at_ms, "step"])

    rows = fixes.select(key, at_ms, along).filter(f"{key} is not null and {at_ms} is not null and {along} is not null")
    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {at_ms} long, step long", "step long", "append", GroupStateTimeout.NoTimeout)


def latest_by_key(events: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """(key, the values of the latest row): a running maximum, so the state holds one row a key."""
    return events.groupBy(key).agg(F.max(F.struct(time, *values)).alias("l")).select(key, f"l.{time}", *[f"l.{v}" for v in values])


def windowed_counts(events: DataFrame, time: str, every: str, late: str, *keys: str) -> DataFrame:
    """Counts per window and keys, final once the watermark has passed the window."""
    return events.withWatermark(time, late).groupBy(F.window(time, every), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
