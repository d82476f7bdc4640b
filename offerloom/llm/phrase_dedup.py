"""Substring dedup with automata of repeated phrases."""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm import common

#: Bytes of text in a pack, windows in a shard, windows of one owner and shard in a part, words of phrases in an automaton.
PACK, PER_SHARD, PER_PART, PER_AUTOMATON = 4 << 20, 1 << 21, 1 << 15, 160_000


def windows_of(raw: np.ndarray, off: np.ndarray, window: int):
    """(first byte of each word, its end, places where a window begins, their hashes); no window crosses a text's end."""
    row, start, end, code = common.words(raw, off, False)
    if len(code) < window:
        return start, end, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :])
    return start, end, place, common.shingles(code, window)[place]


def _unpack(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("z")[i].as_py()), np.uint8)
    return raw, np.r_[0, np.cumsum(np.array(batch.column("lengths")[i].values, np.int64))].astype(np.int64)


def _packs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(batch, ids, lengths, z): the texts in order of id in packs of about PACK bytes, batch numbers in the same order."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64(text_col).alias("h"), F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, off = common.utf8(batch.column("text"))
            packed = [z.compress(data[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("h"), batch.column("id"), pa.array(packed, pa.binary())], ["doc", "h", "id", "z"])

    def pack(batches):
        z, d = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        task, made, size = TaskContext.get().partitionId() << 32, 0, 0
        texts: list[bytes] = []
        ids: list[pa.Array] = []

        def flush():
            every = pa.concat_arrays(ids)
            row = [pa.array([task + made]), pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([z.compress(b"".join(texts))], pa.binary())]
            texts.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays(row, ["batch", "ids", "lengths", "z"])

        for batch in batches:
            for i, packed in enumerate(batch.column("z").to_pylist()):
                texts.append(d.decompress(packed))
                ids.append(batch.column("id").slice(i, 1))
                size += len(texts[-1])
                if size >= PACK:
                    yield flush()
                    made, size = made + 1, 0
        if texts:
            yield flush()

    moved = rows.mapInArrow(squeeze, f"doc long, h long, id {id_type}, z binary")
    ordered = moved.repartitionByRange("doc", "h").sortWithinPartitions("doc", "h").select("id", "z")
    return common.written(ordered.mapInArrow(pack, f"batch long, ids array<{id_type}>, lengths array<int>, z binary"), free=True)


def _split(packs: DataFrame) -> int:
    """Leading bits of a window's hash that name its shard; further bits name the window in 7 bytes."""
    total = int(packs.agg(F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]) // 6
    return max(3, (total // PER_SHARD).bit_length())


def _cut(found: np.ndarray, split: int) -> np.ndarray:
    """The bits of hashes that shard and 7 bytes hold: all 64 from 256 shards on."""
    low = np.uint64(max(0, 8 - split))
    return (found >> low) << low


def _wanted(packs: DataFrame, window: int, split: int) -> DataFrame:
    """(owner, bits, part, askers, windows): confirmed windows of packs, the askers, that an earlier pack, the owner, has first.

    A row holds what a shard knows of an owner; of much asked ones, what it knows for a part of the askers.
    """

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = np.unique(_cut(windows_of(*_unpack(batch, i), window)[3], split))
                if not len(found):
                    continue
                shard = (found >> np.uint64(64 - split)).astype(np.int32)
                cuts = np.flatnonzero(np.r_[True, np.diff(shard) > 0])
                short = np.ascontiguousarray(((found << np.uint64(split)) >> np.uint64(8)).view(np.uint8).reshape(-1, 8)[:, :7])
                blobs = [short[a:b].tobytes() for a, b in zip(cuts.tolist(), np.r_[cuts[1:], len(found)].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard[cuts]), pa.array(np.full(len(cuts), batch.column("batch")[i].as_py())), pa.array(blobs, pa.binary())], ["shard", "batch", "windows"])

    def answer(batches):
        held: list = []

        def flush():
            raw = np.frombuffer(b"".join(h[2] for h in held), np.uint8).reshape(-1, 7)
            key = np.zeros((len(raw), 8), np.uint8)
            key[:, :7] = raw
            key = key.view(np.uint64).ravel()
            own = np.repeat(np.array([h[1] for h in held]), [len(h[2]) // 7 for h in held])
            # packs come in order, so the first row of a window is its earliest pack
            _, first, at = np.unique(key, return_index=True, return_inverse=True)
            owner = own[first][at]
            later = np.flatnonzero(owner != own)
            owner, own = owner[later], own[later]
            full = (key[later] << np.uint64(8)) >> np.uint64(split) | (np.uint64(held[0][0]) << np.uint64(64 - split))
            # what very many ask of one owner is dealt over parts by asker
            _, which, many = np.unique(owner, return_inverse=True, return_counts=True)
            bits = np.ceil(np.log2(np.maximum(1, many / PER_PART))).astype(np.int64)[which] if len(owner) else owner
            part = (common.mix(own.view(np.uint64)) >> np.uint64(32) & ((np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            order = np.lexsort((own, part, owner))
            owner, bits, part, own, full = owner[order], bits[order], part[order], own[order], full[order]
            cuts = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(part) != 0)]) if len(own) else later
            ends = np.r_[cuts[1:], len(own)]
            for a in range(0, len(cuts), 1000):
                c, e = cuts[a : a + 1000], ends[a : a + 1000]
                blobs = [pa.array([v[x:y].tobytes() for x, y in zip(c.tolist(), e.tolist())], pa.binary()) for v in (own, full)]
                yield pa.RecordBatch.from_arrays([pa.array(owner[c]), pa.array(bits[c].astype(np.int32)), pa.array(part[c]), *blobs], ["owner", "bits", "part", "askers", "windows"])
            held.clear()

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("shard", "batch", "windows"))):
                if held and held[0][0] != r[0]:
                    yield from flush()
                held.append(r)
        if held:
            yield from flush()

    asked = packs.select("batch", "lengths", "z").mapInArrow(ask, "shard int, batch long, windows binary")
    return asked.repartition("shard").sortWithinPartitions("shard", "batch").mapInArrow(answer, "owner long, bits int, part long, askers binary, windows binary")


def _passages(packs: DataFrame, wanted: DataFrame, window: int, split: int) -> DataFrame:
    """(batch, passages): for each pack that asks, the passages that hold its windows as they stand in an earlier pack."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw, off = _unpack(batch, i)
                start, end, place, found = windows_of(raw, off, window)
                found = _cut(found, split)
                order = np.argsort(found, kind="stable")
                found, place, text = found[order], place[order], raw.tobytes()
                rows = batch.column("asked")[i].as_py()
                asker, want = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("askers", np.int64), ("windows", np.uint64)))
                order = np.argsort(asker, kind="stable")
                asker, want = asker[order], want[order]
                begin = np.flatnonzero(np.r_[True, np.diff(asker) != 0])
                out = []
                for x, y in zip(begin.tolist(), np.r_[begin[1:], len(asker)].tolist()):
                    here = np.sort(place[np.searchsorted(found, want[x:y])])
                    cut = np.flatnonzero(np.r_[True, np.diff(here) > 1])
                    out.append(list({text[start[here[a]] : end[here[b - 1] + window - 1]] for a, b in zip(cut.tolist(), np.r_[cut[1:], len(here)].tolist())}))
                yield pa.RecordBatch.from_arrays([pa.array(asker[begin]), pa.array(out, pa.list_(pa.binary()))], ["batch", "passages"])

    asked = wanted.groupBy("owner", "bits", "part").agg(F.collect_list(F.struct("askers", "windows")).alias("asked"))
    return packs.select("batch", "lengths", "z").join(asked.select(F.col("owner").alias("batch"), "asked"), "batch").mapInArrow(run, "batch long, passages array<binary>")


def _shared(passages: list[bytes], place: np.ndarray, found: np.ndarray, window: int, split: int) -> list[list[bytes]]:
    """What passages and a pack share: for each run of the pack's windows that also stand in a row in a passage, the passage's words there."""
    off = np.r_[0, np.cumsum([len(p) for p in passages])].astype(np.int64)
    _, _, at, have = windows_of(np.frombuffer(b"".join(passages), np.uint8), off, window)
    words = [w for p in passages for w in p.split()]
    have = _cut(have, split)
    order = np.argsort(have, kind="stable")
    have, at = have[order], at[order]
    k = np.minimum(np.searchsorted(have, found), len(have) - 1)
    hit = have[k] == found
    here, there = place[hit], at[k][hit]
    cut = np.flatnonzero(np.r_[True, (np.diff(here) != 1) | (np.diff(there) != 1)]) if len(here) else here
    return [list(p) for p in {tuple(words[there[a] : there[b - 1] + window]) for a, b in zip(cut.tolist(), np.r_[cut[1:], len(here)].tolist())}] if len(here) else []


def occurrences(words: list[bytes], breaks: np.ndarray, phrases: list[list[bytes]], window: int):
    """Yields (places, length) of each phrase in the words; none goes across a break. Automata hold PER_AUTOMATON words of phrases at most."""
    parts = []
    for p in phrases:
        step = PER_AUTOMATON // 2 - window
        parts += [p[i : i + step + window - 1] for i in range(0, max(1, len(p) - window + 1), step)]
    a = 0
    while a < len(parts):
        b, size = a, 0
        while b < len(parts) and (b == a or size + len(parts[b]) <= PER_AUTOMATON):
            size, b = size + len(parts[b]), b + 1
        letter: dict[bytes, int] = {}
        for p in parts[a:b]:
            for w in p:
                letter.setdefault(w, len(letter) + 2)

        def coded(some, gaps=None):
            code = np.array([letter.get(w, 1) for w in some], np.uint32)
            code[code >= 0xD800] += 0x800  # surrogates are no characters
            return (code if gaps is None else np.insert(code, gaps, 0)).tobytes().decode("utf-32-le")

        automaton = ahocorasick.Automaton()
        for k, p in enumerate(parts[a:b]):
            automaton.add_word(coded(p), k)
        automaton.make_automaton()
        hits = np.array(list(automaton.iter(coded(words, breaks))), np.int64).reshape(-1, 2)
        # a zero stands before each break's word; take these out of the places
        end = hits[:, 0] - np.searchsorted(breaks + np.arange(len(breaks)), hits[:, 0], "right")
        order = np.lexsort((end, hits[:, 1]))
        which, end = hits[order, 1], end[order]
        cuts = np.flatnonzero(np.r_[True, np.diff(which) > 0]) if len(which) else which
        for c, d in zip(cuts.tolist(), np.r_[cuts[1:], len(which)].tolist()):
            n = len(parts[a + int(which[c])])
            yield end[c:d] - n + 1, n
        a = b


def _located(packs: DataFrame, passages: DataFrame, window: int, split: int, id_type: str, keep_text: bool) -> DataFrame:
    """Every text of a pack streams through automata of the phrases that it shares with earlier packs, then of those that it repeats itself."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw, off = _unpack(batch, i)
                texts = [raw[a:b].tobytes().split() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                words = [w for t in texts for w in t]
                at = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
                breaks = np.unique(at[1:-1])
                mark = np.zeros(len(words) + 1, np.int64)
                _, _, place, found = windows_of(raw, off, window)
                if batch.column("passages")[i].is_valid:
                    earlier = _shared(batch.column("passages")[i].values.to_pylist(), place, _cut(found, split), window, split)
                    for where, n in occurrences(words, breaks, earlier, window):
                        np.add.at(mark, where, 1)
                        np.add.at(mark, where + n, -1)
                gone = np.cumsum(mark)[:-1] > 0
                order = np.argsort(found, kind="stable")
                lead = np.maximum.accumulate(np.where(np.r_[True, np.diff(found[order]) > 0], np.arange(len(order)), 0)) if len(order) else order
                first = np.empty_like(place)
                first[order] = place[order[lead]]
                left = np.r_[0, np.cumsum(~gone)]
                again = np.flatnonzero((first != place) & (left[place + window] > left[place]))
                if len(again):
                    p, f = place[again], first[again]
                    cut = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (np.diff(f) != 1)])
                    own = {tuple(words[p[a] : p[b - 1] + window]) for a, b in zip(cut.tolist(), np.r_[cut[1:], len(p)].tolist())}
                    for where, n in occurrences(words, breaks, [list(p) for p in own], window):
                        np.add.at(mark, where[1:], 1)
                        np.add.at(mark, where[1:] + n, -1)
                    gone = np.cumsum(mark)[:-1] > 0
                lost = np.r_[0, np.cumsum(gone)]
                removed = lost[at[1:]] - lost[at[:-1]]
                sha, kept = [], []
                for k, t in enumerate(texts):
                    if removed[k]:
                        t = [w for w, g in zip(t, gone[at[k] : at[k + 1]].tolist()) if not g]
                    text = b" ".join(t)
                    sha.append(hashlib.sha256(text).hexdigest())
                    if keep_text:
                        kept.append(text.decode())
                ids = batch.column("ids")[i].values
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), pa.array(removed), pa.array(sha, pa.string()), *([pa.array(kept, pa.string())] if keep_text else [])], ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else [])])

    return packs.join(passages, "batch", "left").select("ids", "lengths", "z", "passages").mapInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string{', kept string' if keep_text else ''}")


def repeated_passages(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, if asked for); one row per row of docs.

    A word goes if a window of `window` words covers it whose words also start earlier: in a row
    of a smaller id, or earlier in the row. Texts are packed in order of id. Each pack sends the
    hash of each of its windows once to the hash's shard; the shard confirms which recur and tells
    the first pack that has a window which later ones do. That pack sends them the passages, as they
    stand in its texts. What a pack shares with these are the phrases of its automata, of bounded
    size, and all texts of the pack stream through these, which locate every occurrence by its
    words. Windows that recur inside a pack get automata likewise; of their occurrences the first stays.

    A null text has no words. Rows of one id are ordered by a hash of their texts; of rows that
    repeat both, one is first. Null ids come last, in order of that hash. Other columns are ignored.
    An empty table gives none. Two different windows with one 64-bit hash can hide a repeat; nothing
    is removed unless its words repeat.
    """
    packs = _packs(docs, id_col, text_col)
    split = _split(packs)
    wanted = common.written(_wanted(packs, window, split), free=True)
    passages = common.written(_passages(packs, wanted, window, split), free=True)
    common.discard(wanted)
    lists = passages.groupBy("batch").agg(F.flatten(F.collect_list("passages")).alias("passages"))
    return _located(packs, lists, window, split, docs.schema[id_col].dataType.simpleString(), keep_text)
