"""Operators over keyed, ordered events whose state cannot be written as a window frame.

Each runs one pass over rows sorted by key and time inside partitions: a key's rows stream through as Arrow batches, only its small
state is held, so a key with a third of all rows costs time, not memory.

Defined results: rows with a null key or time are left out; equal times keep the order of their ids; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_ordered(frame: DataFrame, key: str, order: list[str], values: list[str], start: Callable, step: Callable, result: str) -> DataFrame:
    """Rows that ``step(state, row) -> list of result rows`` gives for each input row, in order, from ``start()`` at each key.

    ``row`` is (key, *order, *values); ``result`` is the schema of what step returns.
    """
    columns = [key, *order, *values]
    rows = frame.select(*columns).filter(" and ".join(f"{c} is not null" for c in [key, order[0]]))
    names = [part.split()[0] for part in result.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
    types = [kinds[part.split()[1]] for part in result.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != current:
                    current, state = row[0], start()
                out += step(state, row)
            cells = list(zip(*out, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=names)

    return rows.repartition(F.col(key)).sortWithinPartitions(*columns[: 1 + len(order)]).mapInArrow(run, result)


def rate_limit(events: DataFrame, key: str, at_ms: str, order: str, window_ms: int, most: int) -> DataFrame:
    """(order, allowed, remaining, retry_after): a window opens at a key's first event after the last one ended; refused events count as well.

    ``retry_after`` is the whole seconds until the window ends, one at least, for allowed events too.
    """

    def start() -> dict:
        return {"until": None, "count": 0}

    def step(state: dict, row: tuple) -> list[tuple]:
        now = row[1]
        if state["until"] is None or state["until"] <= now:
            state["until"], state["count"] = now + window_ms, 0
        state["count"] += 1
        allowed = state["count"] <= most
        return [(row[2], allowed, max(0, most - state["count"]), max(1, -(-(state["until"] - now) // 1000)))]

    return scan_ordered(events, key, [at_ms, order], [], start, step, f"{order} long, allowed boolean, remaining long, retry_after long")


def tumbling_flush(events: DataFrame, key: str, at_ms: str, order: str, value: str, every_ms: int, least: int = 2) -> DataFrame:
    """(key, at_ms, samples, mean, upper_median, most): the buffer is given out and cleared at the first sample that comes ``every_ms`` or
    more after the last time, if it holds ``least``."""

    def start() -> dict:
        return {"last": None, "held": []}

    def step(state: dict, row: tuple) -> list[tuple]:
        now = row[1]
        if state["last"] is None:
            state["last"] = now
        if row[3] is not None:
            state["held"].append(row[3])
        if now - state["last"] < every_ms or len(state["held"]) < least:
            return []
        held = sorted(state["held"])
        state["last"], state["held"] = now, []
        return [(row[0], now, len(held), sum(held) / len(held), held[len(held) // 2], held[-1])]

    return scan_ordered(events, key, [at_ms, order], [value], start, step, f"{key} long, {at_ms} long, samples long, mean double, upper_median double, most double")


def latched_status(events: DataFrame, key: str, at_ms: str, order: str, action: str) -> DataFrame:
    """(order, shown, depth): 'error' stays shown until a 'set'; 'busy' and 'rest' count a depth that never falls below 0."""

    def start() -> dict:
        return {"shown": "rest", "depth": 0, "latched": False}

    def step(state: dict, row: tuple) -> list[tuple]:
        act = row[3]
        if act == "error":
            state["shown"], state["latched"] = "error", True
        elif act == "set":
            state["shown"], state["latched"] = "set", False
        elif act == "busy":
            state["depth"] += 1
        elif act == "rest":
            state["depth"] = max(0, state["depth"] - 1)
        if not state["latched"] and act in ("busy", "rest"):
            state["shown"] = "busy" if state["depth"] else "rest"
        return [(row[2], state["shown"], state["depth"])]

    return scan_ordered(events, key, [at_ms, order], [action], start, step, f"{order} long, shown string, depth long")


def capped_visits(events: DataFrame, key: str, at_ms: str, order: str, name: str, half_life_ms: float, keep: int) -> DataFrame:
    """(key, name, weight, at): weights after all visits, when only the ``keep`` heaviest names are kept at every visit; each brought forward to its last visit."""

    def start() -> dict:
        return {}

    def step(state: dict, row: tuple) -> list[tuple]:
        now, visited = row[1], row[3]
        weight, at = state.get(visited, (0.0, now))
        state[visited] = (weight * 0.5 ** ((now - at) / half_life_ms) + 1, now)
        if len(state) > keep:
            lightest = min(state, key=lambda n: (state[n][0] * 0.5 ** ((now - state[n][1]) / half_life_ms), n))
            del state[lightest]
        return [(row[0], row[2], visited, state.get(visited, (0.0, now))[0], now)]

    return scan_ordered(events, key, [at_ms, order], [name], start, step, f"{key} long, {order} long, name string, weight double, at long")


def reused_until(events: DataFrame, key: str, at_ms: str, order: str, lifetime_ms: str, slack_ms: int) -> DataFrame:
    """(order, minted, expires): a kept thing is used again while it has more than ``slack_ms`` to live, else a new one is made, which lives for the row's
    ``lifetime_ms``; a null lifetime is a failure, after which nothing is kept."""

    def start() -> dict:
        return {"expires": None}

    def step(state: dict, row: tuple) -> list[tuple]:
        minted = state["expires"] is None or state["expires"] <= row[1] + slack_ms
        if minted:
            state["expires"] = None if row[3] is None else row[1] + row[3]
        return [(row[2], minted, state["expires"])]

    return scan_ordered(events, key, [at_ms, order], [lifetime_ms], start, step, f"{order} long, minted boolean, expires long")
