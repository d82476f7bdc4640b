"""Shared pieces: scratch tables, word scanning over Arrow buffers, connected components."""

from __future__ import annotations

import ctypes
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, free: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends at replicated files.

    Shuffle files of a finished job go once the driver has collected its plan. With `free`, a step that
    shuffled much, the listeners first get time to let go of the plan.
    """
    path = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for _ in range(2 if free else 1):
        if free:
            time.sleep(0.5)
        df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that written() made and that no later step reads."""
    path = df._scratch_path
    jvm = df.sparkSession.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


# --- memory of Python workers ------------------------------------------------------------

#: Tables that a worker keeps from task to task, by operator.
_tables: dict[str, dict] = {}


def worker_table(operator: str) -> dict:
    return _tables.setdefault(operator, {})


def forget(operator: str) -> None:
    """Empty the tables of all other operators."""
    for name, table in _tables.items():
        if name != operator:
            table.clear()


def give_back() -> None:
    """Return memory that Arrow and the C library hold but do not use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run, operator: str = ""):
    """run, for mapInArrow, in a worker that many steps share: it drops other operators' tables first and keeps no freed memory."""

    def whole(batches):
        def fed():
            for batch in batches:
                yield batch
                batch = None
                give_back()

        forget(operator)
        try:
            yield from run(fed())
        finally:
            give_back()

    return whole


# --- words over Arrow buffers ------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 22:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges of about `most` bytes each, so that temporary arrays stay small."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(data: np.ndarray, offsets: np.ndarray, fold: bool):
    """(row of each word, its first byte, its end, 64-bit hash) for the rows of one piece."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = ~space
    first[1:] &= space[:-1] | edge[1:n]
    last = ~space
    last[:-1] &= space[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_FOLD[data] if fold else data] * _power(_BASE, n, "p"), out=total[1:])
    code = mix((total[end] - total[start]) * _power(_INV, n, "i")[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start, end, code


def shingles(code: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each place; the caller masks places near a text's end."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + code[j : j + n]
    return mix(out)


# --- connected components ----------------------------------------------------------------


def _forest(batches):
    """Spanning forest of each partition's edges, bounded by the number of its nodes."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def drain():
        pairs = [(x, find(x)) for x in list(parent)]
        pairs = [(a, b) for a, b in pairs if a != b]
        parent.clear()
        if pairs:
            a, b = zip(*pairs)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 500_000:
            yield from drain()
    yield from drain()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id): the smallest id that each endpoint of the edges (a, b) reaches.

    Each partition first shrinks its edges to a spanning forest. Then rounds of large-star and
    small-star rewire neighbours to the smallest of them until nothing changes; every round is
    a written table. Empty edges give an empty table.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now = written(edges.mapInArrow(lean(_forest), "a long, b long").selectExpr("greatest(a,b) a", "least(a,b) b").distinct())
    before = None
    while True:
        # large-star: every neighbour above a node goes to the smallest neighbour (or the node)
        both = now.union(now.selectExpr("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").selectExpr("b as a", "m as b").distinct()
        # small-star: every neighbour below a node, and the node, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a")
        small = star.where("b <> m").selectExpr("b as a", "m as b").union(low.select("a", "m"))
        nxt = written(small.where("a <> b").distinct())
        mark = nxt.selectExpr("count(*) n", "sum(cast(xxhash64(a, b) as decimal(38,0))) h").first()
        discard(now)
        now = nxt
        if mark == before:
            break
        before = mark
    return now.selectExpr("a as id", "b as component_id").union(now.selectExpr("b", "b").distinct())
