"""Folds over ordered rows of a key that are split over tasks, however many rows the key has."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import written


def ranged(rows: DataFrame, keys: list[str], order: list[str], keep: bool = True) -> DataFrame:
    """rows with _range and _m: dealt by ranges of keys and order, a large key over many; _m ascends with the order in each range. Ends in a checkpoint, unless they are read only once."""
    at = [*keys, *order]
    spread = rows.repartitionByRange(*at).sortWithinPartitions(*at).withColumn("_m", F.monotonically_increasing_id())
    spread = spread.withColumn("_range", F.shiftright("_m", 33))
    return spread.checkpoint() if keep else spread


def before(placed: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Ranged rows with the sum of value over the earlier rows of their key: the sums of whole ranges before, then those in the range."""
    placed = placed.withColumn("_v", value)
    sums = placed.groupBy(*keys, "_range").agg(F.sum("_v").alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_s").over(earlier), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*keys, "_range").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(sums, [*keys, "_range"]).withColumn(name, F.col("_ahead") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_v", "_ahead")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """The columns of each run of rows that are equal in the first `keys` columns, from batches that are sorted by them."""
    held: list[list] | None = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        at = list(zip(*columns[:keys]))
        cuts = [i for i in range(1, len(at)) if at[i] != at[i - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(at)]):
            if held is not None and a == 0 and b and at[0] == tuple(c[0] for c in held[:keys]):
                for old, new in zip(held, columns):
                    old += new[:b]
            elif b:
                if held is not None:
                    yield held
                held = [c[a:b] for c in columns]
    if held is not None:
        yield held


def _told(rows: Iterator[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of rows."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)


def _mapped(rows: DataFrame, keys: int, step, schema: str) -> DataFrame:
    """Rows (tuples) that step makes of the runs of sorted rows."""
    kinds = {"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64(), "long": pa.int64(), "int": pa.int32()}
    fields = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))])
    return rows.mapInArrow(lambda batches: _told(step(_runs(batches, keys)), fields), schema)


# --- windows that open with the first request after the last one's end ---------------------


def windows(placed: DataFrame, span: int) -> DataFrame:
    """(event_id, client_key, opened, nth) of ranged requests (client_key, at in micros, event_id).

    A window opens with a client's first request, and with each first one `span` or more after the last
    opening; nth is a request's number in its window. Each range tabulates, for the requests with which it
    could be entered, the last window that opens in it: entries soon lead to the same one, so the table
    is short. A fold over a client's ranges then finds where each is really entered.
    """

    def tables(runs):
        for client, place, t in runs:
            t = np.array(t, np.int64)
            n = len(t)
            after = np.searchsorted(t, t + span, "left").tolist()
            last = list(range(n))
            for i in range(n - 1, -1, -1):
                if after[i] < n:
                    last[i] = last[after[i]]
            begins = [i for i in range(n) if not i or last[i] != last[i - 1]]
            # a line holds for the requests up to the one before the next line's
            for i, to in zip(begins, [*begins[1:], n]):
                yield client[0], place[0], int(t[to - 1]), i, last[i], int(t[last[i]]), n, int(t[-1])

    def fold(runs):
        client, opened, rank, ahead = None, None, 0, 0
        for name, place, upto, _, last, last_at, n, end_at in runs:
            if name[0] != client:
                client, opened, rank, ahead = name[0], None, 0, 0
            yield client, place[0], opened, rank, ahead
            if opened is None or opened + span <= end_at[0]:
                k = 0 if opened is None else bisect_left(upto, opened + span)
                opened, rank = last_at[k], ahead + last[k]
            ahead += n[0]

    def number(runs):
        for client, _, at, event, opened, rank, ahead in runs:
            start, first, i, n = opened[0], rank[0] - ahead[0], 0, len(at)
            while i < n:
                if start is None or at[i] - start >= span:
                    start, first = at[i], i
                yield event[i], client[0], at[i], start, i - first + 1
                i += 1

    keys = ["client_key", "_range"]
    kind = placed.schema["event_id"].dataType.simpleString()
    made = _mapped(placed.select(*keys, "at"), 2, tables, "client_key string, _range long, upto long, i long, last long, last_at long, n long, end_at long")
    made = made.repartition("client_key").sortWithinPartitions("client_key", "_range", "i")
    entered = _mapped(made, 2, fold, "client_key string, _range long, opened long, rank long, ahead long")
    rows = placed.join(entered, keys).repartition(*keys).sortWithinPartitions(*keys, "_m").select(*keys, "at", "event_id", "opened", "rank", "ahead")
    return _mapped(rows, 2, number, f"event_id {kind}, client_key string, at long, opened long, nth long")


# --- the richer of rows that are met in order ----------------------------------------------


class _Records:
    """For each score, the lengths of the rows from here on that are longer than all before them, from the nearest."""

    def __init__(self):
        self.length: dict[int, list[int]] = {}  # with a minus, ascending: the nearest is last
        self.place: dict[int, list[int]] = {}

    def push(self, i: int, s: int, n: int) -> None:
        length, place = self.length.setdefault(s, []), self.place.setdefault(s, [])
        while length and -length[-1] <= n:
            length.pop()
            place.pop()
        length.append(-n)
        place.append(i)

    def beats(self, s: int, n: int) -> int | None:
        """The nearest row that a winner with score s and length n loses to."""
        found = [p[-1] for c, p in self.place.items() if c >= s + 2]
        for c, low in ((s + 1, n), (s, n + 1)):
            k = bisect_right(self.length.get(c, []), -low)  # those at least as long as low stand first
            if k:
                found.append(self.place[c][k - 1])
        return min(found, default=None)


def winners(placed: DataFrame) -> DataFrame:
    """(id, place) of the winner of each group of ranged rows (g, seq, id, s, n), with the first row's seq.

    In order, a row takes over if its score s, and one more for being longer, exceeds the winner's. From a row on it
    is settled who wins within its range. Only the first and the last group of a range can reach into others: of the
    rest the winner is known at once. A range is entered with a winner from before, who
    loses to a row that is longer than all before it of its score: only these rows, with who wins after
    them, go into the fold over a group's ranges. What a range finds is written once.
    """

    def wins_of(s, n):
        right, wins = _Records(), list(range(len(s)))
        for i in range(len(s) - 1, -1, -1):
            after = right.beats(s[i], n[i])
            wins[i] = i if after is None else wins[after]
            if i:
                right.push(i, s[i], n[i])
        return wins

    def lines(g, place, seq, name, s, n):
        longest: dict[int, int] = {}
        for i, w in enumerate(wins_of(s, n)):
            if n[i] > longest.get(s[i], -1):
                longest[s[i]] = n[i]
                yield g[0], place[0], i, s[i], n[i], name[w], s[w], n[w], seq[0]

    def tables(runs):
        last, inside = None, False
        for run in runs:
            if last is not None:
                if inside:
                    _, _, seq, name, s, n = last
                    yield None, None, None, None, None, name[wins_of(s, n)[0] if len(s) > 1 else 0], None, None, seq[0]
                else:
                    yield from lines(*last)
                    inside = True
            last = run
        if last is not None:
            yield from lines(*last)

    def fold(runs):
        group, first, won = None, None, None
        for g, _, _, s, n, name, won_s, won_n, seq in runs:
            if g[0] != group:
                if won is not None:
                    yield won[0], first
                group, first, won = g[0], seq[0], None
            hit = next((r for r in zip(s, n, name, won_s, won_n) if won is None or r[0] + (r[1] > won[2]) > won[1] + (won[2] > r[1])), None)
            won = won if hit is None else hit[2:]
        if won is not None:
            yield won[0], first

    made = _mapped(placed.select("g", "_range", "seq", "id", "s", "n"), 2, tables, "g binary, _range long, i long, s int, n int, won string, won_s int, won_n int, first long")
    made = written(made)
    across = made.where("g is not null").repartition("g").sortWithinPartitions("g", "_range", "i")
    return made.where("g is null").select(F.col("won").alias("id"), F.col("first").alias("place")).unionByName(_mapped(across, 2, fold, "id string, place long"))
