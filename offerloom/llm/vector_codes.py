"""Codes of vectors: a codebook for each part, fitted by exact integer Lloyd rounds over active entries."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm import common

#: Integers of this size and more would let a squared distance leave 64 bits.
LARGEST = 1 << 27
#: Label sums are broadcast up to this many (some 20 bytes each); beyond, the join is shuffled.
MOST_BROADCAST = 1_000_000


def assign(x: np.ndarray, book: np.ndarray, entry: np.ndarray | None = None, dist: np.ndarray | None = None, moved: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part of x (n, parts, width) in book (parts, entries, width); ties to the lower index.

    With the result of the last round and a mask (parts, entries) of the entries that moved since:
    a part whose entry stayed where it was meets the moved entries only, against its stored distance,
    which is still exact and beats every entry that did not move. Other parts meet all entries.
    """
    n, parts, _ = x.shape
    new, near = (np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64)) if entry is None else (entry.copy(), dist.copy())
    for p in range(parts):
        again = np.arange(n) if entry is None else np.flatnonzero(moved[p][entry[:, p]])
        for a in range(0, len(again), 4096):
            rows = again[a : a + 4096]
            d = ((x[rows, p, None, :] - book[p][None]) ** 2).sum(-1)
            new[rows, p] = d.argmin(1)
            near[rows, p] = d.min(1)
        if entry is None or not moved[p].any():
            continue
        fixed, some = np.flatnonzero(~moved[p][entry[:, p]]), np.flatnonzero(moved[p])
        for a in range(0, len(fixed), 4096):
            rows = fixed[a : a + 4096]
            d = ((x[rows, p, None, :] - book[p][some][None]) ** 2).sum(-1)
            at, least = some[d.argmin(1)], d.min(1)
            better = (least < near[rows, p]) | ((least == near[rows, p]) & (at < new[rows, p]))
            new[rows[better], p], near[rows[better], p] = at[better], least[better]
    return new, near


def sums(x: np.ndarray, entry: np.ndarray, entries: int) -> np.ndarray:
    """(parts, entries, width + 1): component sums of each entry's parts, and their count."""
    out = np.zeros((x.shape[1], entries, x.shape[2] + 1), np.int64)
    for p in range(x.shape[1]):
        np.add.at(out[p, :, :-1], entry[:, p], x[:, p])
        out[p, :, -1] = np.bincount(entry[:, p], minlength=entries)
    return out


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    finite = F.forall(vector_col, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.where(F.col(vector_col).isNotNull()).where(finite).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))


def whole(x: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """Integers (n, parts, width) of vectors (n, length); a length that parts do not divide is filled up with zeros."""
    y = np.floor(x * scale)
    if y.size and np.abs(y).max() >= LARGEST:
        raise ValueError(f"a component times {scale} is not below {LARGEST}: squared distances would not fit into a long")
    width = -(-y.shape[1] // parts)
    out = np.zeros((len(y), parts * width), np.int64)
    out[:, : y.shape[1]] = y
    return out.reshape(len(y), parts, width)


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256; one row per kept vector.

    Components become floor(scale * x). Codebooks start as the parts of the vectors with the smallest
    ids; each round assigns all parts and replaces each entry by the floored mean of its parts; a last
    assignment gives the codes. Vectors lie in packs, a row for each Arrow batch; a round is one pass
    that writes each pack with its entries, exact distances and the sums of its parts, and one small
    aggregate of the sums, so the driver holds codebooks only. Nothing is shuffled but sums.

    Vectors that are null or hold null or non-finite components are dropped. Null ids are above all
    others; of equal ids the smaller vector counts as the smaller. With fewer vectors than entries the
    codebook has as many entries as there are vectors. Each length of vectors has its own codebooks
    (an empty vector has codes of zeros). Components of 32768 and more are an error, as distances would
    not fit a long. Null labels are one label. Other columns are ignored. An empty table gives no rows.
    """
    rows = _kept(vectors, id_col, vector_col, label_col)
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    books = {}
    # lengths of vectors: a few
    for (length,) in rows.select(F.size("x")).distinct().collect():
        first = rows.where(F.size("x") == length).orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
        books[length] = whole(np.array([r["x"] for r in first], float).reshape(len(first), length), parts, scale).transpose(1, 0, 2)
    fields = f"size int, ids array<{id_type}>, labels array<{label_type}>, x binary, entry binary, dist binary, sums binary"
    names = [f.split()[0] for f in fields.split(", ")]

    def pack(batches):
        for batch in batches:
            values = batch.column("x")
            length = np.diff(np.asarray(values.offsets))
            for size in np.unique(length).tolist():
                part = batch.filter(pa.array(length == size))
                x = whole(np.array(part.column("x").flatten(), float).reshape(part.num_rows, size), parts, scale)
                entry, dist = assign(x, books[size])
                yield row(size, part.column("vec_id"), part.column("label"), x, entry, dist)

    def row(size, ids, labels, x, entry, dist):
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        blob = lambda v: pa.array([v.tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), one(ids), one(labels), blob(x.astype(np.int32)), blob(entry), blob(dist), blob(sums(x, entry, books[size].shape[1]))], names)

    def unpacked(batch, i):
        size = batch.column("size")[i].as_py()
        part = lambda c, t: np.frombuffer(batch.column(c)[i].as_py(), t)
        n = len(batch.column("ids")[i].values)
        return size, batch.column("ids")[i].values, batch.column("labels")[i].values, part("x", np.int32).astype(np.int64).reshape(n, parts, -(-size // parts)), part("entry", np.uint8).reshape(n, parts), part("dist", np.int64).reshape(n, parts)

    def step(books, moved):
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    size, ids, labels, x, entry, dist = unpacked(batch, i)
                    yield row(size, ids, labels, x, *assign(x, books[size], entry, dist, moved[size]))

        return run

    def summed(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, raw in zip(*(batch.column(c).to_pylist() for c in ("size", "sums"))):
                held[size] = held.get(size, 0) + np.frombuffer(raw, np.int64)
        for size, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), size, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["size", "at", "v"])

    state = common.written(rows.mapInArrow(pack, fields))
    for _ in range(rounds):
        total = {size: np.zeros(b.shape[0] * b.shape[1] * (b.shape[2] + 1), object) for size, b in books.items()}
        # a row for each component of each entry
        for r in state.select("size", "sums").mapInArrow(summed, "size int, at int, v long").groupBy("size", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
            total[r["size"]][r["at"]] = int(r["v"])
        after, moved = {}, {}
        for size, b in books.items():
            t = total[size].reshape(b.shape[0], b.shape[1], b.shape[2] + 1)
            used = t[:, :, -1] > 0
            after[size] = np.where(used[:, :, None], t[:, :, :-1] // np.where(used, t[:, :, -1], 1)[:, :, None], b).astype(np.int64)
            moved[size] = (after[size] != b).any(2)
        books = after
        last, state = state, common.written(state.mapInArrow(step(books, moved), fields))
        common.discard(last)
    digest = {size: hashlib.sha256(",".join(map(str, b.ravel().tolist())).encode()).hexdigest() for size, b in books.items()}

    def coded(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                size, ids, labels, _, entry, dist = unpacked(batch, i)
                text = entry.tobytes().hex()
                codes = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(dist.sum(1)), pa.array([digest[size]] * len(codes))], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    out = state.mapInArrow(coded, f"vec_id {id_type}, label {label_type}, code string, error long, codebooks_sha256 string")
    by_label = common.written(out.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    by_label = F.broadcast(by_label) if by_label.count() <= MOST_BROADCAST else by_label
    return out.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
