"""Exact dedup through recipes of content-defined chunks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm import common

WINDOW, MASK, LONGEST = 24, np.uint64(2047), 65536


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a piece's rows.

    A chunk ends where the hash of the WINDOW bytes before it meets MASK, so that an edit moves
    only the ends near it; at each row's end; and LONGEST bytes after the last end at most.
    Ends fall on characters.
    """
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(common._BYTE[data] * common._power(common._BASE, n, "p"), out=total[1:])
    ends = offsets[1:][np.diff(offsets) > 0]
    if n >= WINDOW:
        code = common.mix((total[WINDOW:] - total[:-WINDOW]) * common._power(common._INV, n, "i")[: n - WINDOW + 1])
        hit = np.flatnonzero((code & MASK) == 0) + WINDOW
        row = np.searchsorted(offsets, hit, "left") - 1
        hit = hit[hit - WINDOW >= offsets[row]]
        hit = hit[hit < n]
        hit = hit[(data[hit] & 0xC0) != 0x80]
        ends = np.union1d(ends, hit)
    begin = np.r_[0, ends[:-1]]
    more = []
    for k in np.flatnonzero(ends - begin > LONGEST):
        at = begin[k] + LONGEST
        while at < ends[k]:
            cut = at
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
            more.append(cut)
            at = cut + LONGEST
    return np.union1d(ends, np.array(more, np.int64)) if more else ends


def _cut(batch: pa.RecordBatch, column: int):
    data, offsets = common.utf8(batch.column(column))
    for a, b in common.pieces(offsets):
        lo, hi = offsets[a], offsets[b]
        part, off = data[lo:hi], offsets[a : b + 1] - lo
        ends = chunk_ends(part, off) if len(part) else np.zeros(0, np.int64)
        yield a, b, part, off, ends, np.r_[0, ends[:-1]] if len(ends) else ends


def _digest(piece: bytes, attempt: int, size: int) -> bytes:
    return hashlib.blake2b(piece, digest_size=size, salt=attempt.to_bytes(2, "big")).digest()


def recipes(rows: DataFrame, attempt: int, size: int) -> DataFrame:
    """(doc_id, text_sha256, recipe: ids of the text's chunks in order) for rows (doc_id, text)."""
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b, part, off, ends, begin in _cut(batch, 1):
                raw, first = part.tobytes(), np.searchsorted(ends, off)
                ids = [_digest(raw[i:j], attempt, size) for i, j in zip(begin.tolist(), ends.tolist())]
                per_row = np.diff(np.searchsorted(ends, off, "right")).astype(np.int32)
                at = np.r_[0, np.cumsum(per_row)].astype(np.int32)
                sha = [hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
                assert at[-1] == len(ids) and len(first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sha), pa.ListArray.from_arrays(pa.array(at), pa.array(ids, pa.binary()))], ["doc_id", "text_sha256", "recipe"])

    return rows.mapInArrow(common.lean(run), f"doc_id {id_type}, text_sha256 string, recipe array<binary>")


def chunks(rows: DataFrame, attempt: int, size: int) -> DataFrame:
    """(id, chunk) of every chunk of rows (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for _, _, part, _, ends, begin in _cut(batch, 1):
                if len(ends):
                    raw = part.tobytes()
                    text = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(raw))
                    ids = [_digest(raw[i:j], attempt, size) for i, j in zip(begin.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), text.cast(pa.string())], ["id", "chunk"])

    return rows.mapInArrow(common.lean(run), "id binary, chunk string")


def exact_dedup(docs: DataFrame, digest_size: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks; one row per row of docs.

    Texts are equal when they are so after lower-casing A-Z. Each text becomes a recipe, the ids
    of its content-defined chunks in order. The chunk dictionary, one row for each distinct
    chunk, proves that an id stands for one chunk only; if it ever does not, ids are made anew
    with another salt and more bytes. Then whole recipes are compared, a few dozen bytes for each
    document, so a long text is read but moves only as chunks that no other row has sent.

    A null text counts as empty (an empty recipe). The row with the largest id stays; null ids
    are below all others. Rows that repeat both id and text all carry kept = true if that id
    stays, and count in group_size. Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), common.ascii_lower(F.coalesce(text_col, F.lit(""))).alias("text"))
    attempt, size = 0, digest_size
    while True:
        dictionary = chunks(rows, attempt, size).groupBy("id", "chunk").agg(F.count("*").alias("n"))
        contested = dictionary.groupBy("id").agg(F.count("*").alias("v")).where("v > 1")
        if contested.isEmpty():
            break
        attempt, size = attempt + 1, min(64, size * 2)
    listed = recipes(rows, attempt, size)
    groups = listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return listed.join(groups, "recipe").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"))
