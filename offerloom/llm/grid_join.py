"""Embedding near-dedup by an epsilon grid order join."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm import common

#: Leading axes that order the points, axes of the boxes, points of a block and of an interval that is not halved further.
CELL_DIMS, BOX_DIMS, BLOCK, LEAF = 8, 16, 8192, 256


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Columns: the sample's leading principal directions. Any orthonormal axes give right results; good ones skip more."""
    values, vectors = np.linalg.eigh(sample.T @ sample)
    return vectors[:, np.argsort(-values)][:, :BOX_DIMS]


def _near(box_a, box_b, eps: float) -> bool:
    """Whether boxes (lo, hi) can hold points within eps."""
    gap = np.maximum(0, np.maximum(box_a[0] - box_b[1], box_b[0] - box_a[1]))
    return float(gap @ gap) <= eps * eps


def _labels(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each row and column of a link matrix reaches inside it."""
    top = np.iinfo(np.int64).max
    while True:
        na = np.minimum(a, np.where(mask, b[None, :], top).min(1))
        nb = np.minimum(b, np.where(mask, na[:, None], top).min(0))
        if (na == a).all() and (nb == b).all():
            return a, b
        a, b = na, nb


def sequence_join(a, b, eps: float, least: float, same: bool, out: list) -> None:
    """Join two sequence intervals (vectors, norms, coordinates, ids, sizes): skip them if their boxes are distant, else halve the longer.

    Appends (ids, links counted by group size) and (ids, smallest id linked) arrays to out.
    """
    if not _near((a[2].min(0), a[2].max(0)), (b[2].min(0), b[2].max(0)), eps):
        return
    na, nb = len(a[3]), len(b[3])
    if max(na, nb) > LEAF:
        half = lambda x, n: (tuple(v[: n // 2] for v in x), tuple(v[n // 2 :] for v in x))
        if same:
            lo, hi = half(a, na)
            sequence_join(lo, lo, eps, least, True, out)
            sequence_join(hi, hi, eps, least, True, out)
            sequence_join(lo, hi, eps, least, False, out)
        elif na >= nb:
            for part in half(a, na):
                sequence_join(part, b, eps, least, False, out)
        else:
            for part in half(b, nb):
                sequence_join(a, part, eps, least, False, out)
        return
    mask = (a[0] @ b[0].T) / (a[1][:, None] * b[1][None, :]) >= least
    if same:
        np.fill_diagonal(mask, False)
    if mask.any():
        out.append((a[3], mask @ b[4], *([_labels(mask, a[3], b[3])[0]])))
        if not same:
            out.append((b[3], mask.T @ a[4], _labels(mask, a[3], b[3])[1]))


def near_vectors(vectors: DataFrame, least: float = 0.95, sample: int = 10000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: links of cosine >= least, in double precision.

    Equal vectors are one point first. Points are projected on leading principal axes (of a
    sample of at most `sample` points; coordinate axes for lengths that it lacks) and ordered by
    length and by grid cells of the side eps that the cosine allows between unit vectors. Runs of
    at most BLOCK points in this order are blocks with bounding boxes; a block meets the blocks
    whose first cells reach into its own or the next, unless their boxes are more than eps apart. A
    pair of blocks is joined recursively, skipping distant intervals; it gives link counts and
    each point's smallest linked id, never its pairs. A block moves once for each block it meets:
    where no axis tells points apart, that is N / BLOCK times.

    Vectors that are null, zero or hold null or non-finite components, and rows without an id,
    link with nothing. Vectors of different lengths do not link. Repeated rows count as vectors.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    x = F.transform(vec_col, lambda v: v.cast("double"))
    good = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(good, F.transform(x, lambda v: v + 0.0)).alias("x"))
    points = common.written(rows.where("x is not null").groupBy("x").agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("size")))
    found = common.written(_joined(points, eps, least, sample))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = common.components(found.select(F.col("id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("id", "cid")
    groups = points.join(links, "id", "left").join(parts, F.col("id") == F.col("cid"), "left").select("x", "id", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component_id", "id").alias("component"))
    joined = rows.join(groups.withColumnRenamed("x", "gx"), F.col("x") == F.col("gx"), "left")
    component = F.coalesce("component", F.col("vec_id").cast("long"))
    return joined.select("vec_id", F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").cast("long").eqNullSafe(component).alias("kept"))


def _joined(points: DataFrame, eps: float, least: float, sample: int) -> DataFrame:
    """(id, links, low) for each pair of blocks and point with links in it."""
    by_length: dict[int, list] = {}
    for r in points.orderBy(F.xxhash64("x"), "id").limit(sample).select("x").collect():
        by_length.setdefault(len(r[0]), []).append(r[0])
    axes = {}
    for length, found in by_length.items():
        v = np.array(found, float)
        axes[length] = principal_axes(v / np.linalg.norm(v, axis=1, keepdims=True))

    def place(batches):
        for batch in batches:
            lists = batch.column(0)
            length = np.asarray(pc.list_value_length(lists))
            for d in np.unique(length).tolist():
                at = pa.array(np.flatnonzero(length == d))
                x = lists.take(at)
                v = np.array(x.flatten()).reshape(-1, d)
                y = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ axes.get(d, np.eye(d)[:, :BOX_DIMS])
                cell = np.floor(y[:, :CELL_DIMS] / eps).astype(np.int32)
                rows = lambda m, t: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(m).ravel(), t))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d, np.int32)), rows(cell, pa.int32()), batch.column(1).take(at), batch.column(2).take(at), x, rows(y, pa.float64())], ["length", "cell", "id", "size", "x", "y"])

    placed = points.select("x", "id", "size").mapInArrow(place, "length int, cell array<int>, id long, size long, x array<double>, y array<double>")
    # neighbouring ranges go together, so that blocks are full however many ranges there are
    tasks = max(1, points.count() // (4 * BLOCK))
    ordered = placed.repartitionByRange("length", "cell", "id").sortWithinPartitions("length", "cell", "id").coalesce(tasks)

    def pack(batches):
        held: list = []

        def flush():
            y, x = np.array([h[5] for h in held]), np.array([h[4] for h in held])
            ids, sizes = np.array([h[2] for h in held], np.int64), np.array([h[3] for h in held], np.int64)
            row = [int(ids[0]), held[0][0], held[0][1][0], held[-1][1][0], y.min(0).tolist(), y.max(0).tolist(), ids.tobytes(), sizes.tobytes(), x.tobytes(), y.tobytes()]
            types = [pa.int64(), *[pa.int32()] * 3, *[pa.list_(pa.float64())] * 2, *[pa.binary()] * 4]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["block", "length", "first", "last", "lo", "hi", "ids", "sizes", "x", "y"])

        for batch in batches:
            for r in zip(*(col.to_pylist() for col in batch.columns)):
                if held and (len(held) >= BLOCK or held[0][0] != r[0]):
                    yield flush()
                held.append(r)
        if held:
            yield flush()

    blocks = common.written(ordered.mapInArrow(pack, "block long, length int, first int, last int, lo array<double>, hi array<double>, ids binary, sizes binary, x binary, y binary"))
    # a block's points lie in the cells first..last of the leading axis
    left = blocks.select("length", F.col("block").alias("ablock"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("cell"))
    right = blocks.select("length", F.col("block").alias("bblock"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.explode(F.sequence("first", "last")).alias("cell"))
    gap = F.aggregate(F.zip_with(F.arrays_zip("alo", "ahi"), F.arrays_zip("blo", "bhi"), lambda p, q: F.greatest(F.lit(0.0), p["alo"] - q["bhi"], q["blo"] - p["ahi"])), F.lit(0.0), lambda acc, g: acc + g * g)
    pairs = left.join(right, ["length", "cell"]).where("ablock <= bblock").where(gap <= eps * eps).select("ablock", "bblock").distinct()
    full = lambda p: blocks.select(F.col("block").alias(f"{p}block"), *[F.col(n).alias(p + n) for n in ("ids", "sizes", "x", "y")])
    met = pairs.join(full("a"), "ablock").join(full("b"), "bblock").select("ablock", "bblock", *[p + n for p in "ab" for n in ("x", "y", "ids", "sizes")])

    def side(r, at):
        ids, sizes = (np.frombuffer(r[at + k].as_py(), np.int64) for k in (2, 3))
        x = np.frombuffer(r[at].as_py()).reshape(len(ids), -1)
        return x, np.linalg.norm(x, axis=1), np.frombuffer(r[at + 1].as_py()).reshape(len(ids), -1), ids, sizes

    def join(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = [col[i] for col in batch.columns]
                same, out = r[0].as_py() == r[1].as_py(), []
                a = side(r, 2)
                sequence_join(a, a if same else side(r, 6), eps, least, same, out)
                if out:
                    ids, links, low = (np.concatenate(v) for v in zip(*out))
                    hit = links > 0
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(low[hit])], ["id", "links", "low"])

    return met.mapInArrow(join, "id long, links long, low long")
