"""The two per-client rules of request logs as stateful streams in event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from offerloom.operators.traffic import is_crawler

MICROS = 1_000_000


def _in_order(log: DataFrame, delay: str, start: tuple, state: str, output: str, fold: Callable, ends: Callable) -> DataFrame:
    """Rows (event_id, client_key, output) of a log whose requests are folded in order of time, client by client.

    A request waits in its client's state until the watermark, `delay` behind the latest time, has passed it;
    then no earlier one can come. So results depend neither on micro-batches nor on the clock. Spark
    drops requests that are late: not after the watermark. Waiting requests are 16 bytes each.
    fold(held, times) gives the new state and a flag for each time; ends(held) the time in micros
    from which the state tells nothing any more (None: never). Event ids are whole numbers.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        *now, waiting = held.get if held.exists else (*start, b"")
        rows = [np.frombuffer(waiting, np.int64).reshape(-1, 2)]
        if not held.hasTimedOut:
            rows += [f[["at", "event_id"]].to_numpy(np.int64) for f in frames]
        rows = np.concatenate(rows)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        mark = held.getCurrentWatermarkMs()
        n = int(np.searchsorted(rows[:, 0], mark * 1000, "right"))
        now, flags = fold(tuple(now), rows[:n, 0])
        rest = rows[n:]
        end = ends(now)
        wake = int(rest[0, 0]) if len(rest) else end
        if len(rest) or end is None or end > mark * 1000:
            held.update((*now, rest.tobytes()))
            if wake is not None:
                held.setTimeoutTimestamp(max(mark, wake // 1000) + 1)
        elif held.exists:
            held.remove()
        yield pd.DataFrame({"event_id": rows[:n, 1], "client_key": key[0], output: np.array(flags, bool)})

    time = F.col("ts").cast("timestamp")
    keyed = log.select("event_id", "client_key", time.alias("ts"), F.unix_micros(time).alias("at")).withWatermark("ts", delay)
    return keyed.groupBy("client_key").applyInPandasWithState(step, f"event_id long, client_key string, {output} boolean", f"{state}, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


def return_visits(log: DataFrame, minutes: int = 30, keep_days: int | None = None, delay: str = "10 minutes") -> DataFrame:
    """(event_id, client_key, is_return): whether the client's previous request is at least `minutes` back.

    With keep_days, a previous request that is as far back as that tells nothing, and its state goes.
    """
    keep = None if keep_days is None else keep_days * 86_400 * MICROS

    def fold(held: tuple, times: np.ndarray):
        before = np.r_[np.int64(-1 if held[0] is None else held[0]), times[:-1]][: len(times)]
        gap = times - before
        flags = gap >= minutes * 60 * MICROS
        if keep is not None:
            flags &= gap < keep
        if len(times) and held[0] is None:
            flags[0] = False
        return ((int(times[-1]) if len(times) else held[0]),), flags

    return _in_order(log, delay, (None,), "last long", "is_return", fold, lambda held: None if keep is None or held[0] is None else held[0] + keep)


def rate_limit(log: DataFrame, seconds: int = 60, most: int = 60, delay: str = "10 seconds") -> DataFrame:
    """(event_id, client_key, blocked) of requests that are no crawler's and have a client key; a window's state goes when the watermark has passed its end."""
    span = seconds * MICROS

    def fold(held: tuple, times: np.ndarray):
        start, n = held
        flags = np.zeros(len(times), bool)
        i = 0
        while i < len(times):
            if n == 0 or times[i] - start >= span:
                start, n = int(times[i]), 0
            # the requests up to the window's end
            to = int(np.searchsorted(times, start + span, "left"))
            flags[i:to] = n + 1 + np.arange(to - i) > most
            n, i = n + to - i, to
        return (start, n), flags

    rows = log.where(~is_crawler(F.col("user_agent")) & F.col("client_key").isNotNull())
    return _in_order(rows, delay, (0, 0), "start long, n long", "blocked", fold, lambda held: held[0] + span)
