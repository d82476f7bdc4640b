"""Jaccard self-join of documents' shingle sets through token-combination prefixes."""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm import common

#: A token of more sets than this is of the frequent class.
FREQUENT = 3
#: Bytes of text in a pack, tokens in a shard, candidate pairs of one set that meet it in one task, sets in a tile.
PACK, PER_SHARD, PER_SALT, TILE = 4 << 20, 1 << 21, 2000, 4096


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct k-word shingles of each row; with fewer words, of all its words as one."""
    row, _, _, code = common.words(data, offsets, True)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    at = np.r_[0, np.cumsum(count)]
    gram = common.shingles(code, k)
    out = []
    for i in range(n):
        a, b = at[i], at[i + 1]
        if b - a >= k:
            out.append(np.unique(gram[a : b - k + 1]))
        elif b > a:
            out.append(common.shingles(code[a:b], b - a) + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingles_of(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    """The set itself, of words."""
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def name_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def length_class(n: int, num: int, den: int) -> int:
    """Sets that can link are in one class or in neighbouring ones."""
    return int(math.log(n) / math.log(den / num) + 1e-9)


def shared_at_least(m: int, num: int, den: int) -> int:
    """k of a length class: sets meeting there that link share more tokens than this."""
    return max(1, int(0.3 * (den / num) ** m))


def signatures(tokens: np.ndarray, levels: np.ndarray, num: int, den: int) -> np.ndarray | None:
    """Index keys of a set whose tokens have the given frequency levels (0 in one set only, 1 rare, 2 and up frequent); None if it can link with no other.

    A set that links with this one lacks at most `slack` of its tokens. Tokens of no other set
    are lacking for sure. Of the rare ones, slack + 1 are keys of their own, the prefix of that
    class. A set that shares none of them lacks at most slack - |rare| of the frequent tokens, so in
    the prefix of slack - |rare| + k of these, the most seldom first, it shares k. Dealt over k - 1
    groups, two of the k fall into one group: the keys are the pairs of frequent tokens in a group.
    k belongs to a length class; a set meets others in its class and in the one above.
    """
    n = len(tokens)
    slack = n - -(-n * num // den) - int((levels == 0).sum())
    if slack < 0:
        return None
    rare = tokens[levels == 1]
    out = [common.mix(rare[: slack + 1])]
    slack -= len(rare)
    if slack >= 0:
        often = levels > 1
        frequent = tokens[often][np.lexsort((tokens[often], levels[often]))]
        c = length_class(n, num, den)
        for m in (c, c + 1):
            k = shared_at_least(m, num, den)
            part = frequent[: slack + k]
            if k == 1:
                out.append(common.mix(part + np.uint64(m + 1)))
                continue
            group = (common.mix(part + np.uint64(7)) % np.uint64(k - 1)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            ends = np.flatnonzero(np.r_[np.diff(group[order]) > 0, True]) + 1
            a, pairs = 0, []
            for b in ends.tolist():
                pairs += combinations(order[a:b].tolist(), 2)
                a = b
            if pairs:
                i, j = np.array(pairs).T
                lo, hi = np.minimum(part[i], part[j]), np.maximum(part[i], part[j])
                out.append(common.mix(common.mix(lo) + hi * np.uint64(3) + np.uint64(m + 1)))
    return np.unique(np.concatenate(out))


def sketch(tokens: np.ndarray) -> bytes:
    """A bitmap of at least four bits a token; sets differ in at least as many tokens as their bitmaps in bits."""
    bits = 1 << max(6, (4 * len(tokens) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(tokens % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def jaccard_components(docs: DataFrame, shingle: int = 5, num: int = 3, den: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id; sets link when den * |intersection| >= num * |union|.

    Rows with equal sets are one node, named by 128 bits of its tokens. Texts are packed, and a
    pack sends each token once, with a count, to the token's shard; the shards sum the counts and
    answer each pack with a frequency level a token. So every set knows which of its tokens are
    rare, and only sets that can link at all are indexed: rare tokens singly, frequent ones in
    combinations (see signatures). The members of an index block meet its pivot, the member with the
    fewest tokens of its own. Blocks whose other members still belong to several components then form
    clusters; these members meet in tiles of bounded size, and bitmaps leave only pairs that may link.
    Every candidate is verified on hashes and then on words. Tiles inside one component never meet, nor
    do texts that only share tokens with their neighbours in a chain, whose blocks have two members.

    Words are runs of other characters than ASCII white space, A-Z lower-cased. A null text or
    one without words has an empty set and no links; with fewer words than a shingle, all words
    are one. Rows of one id are one document; rows with a null id link with nothing and have a
    null component. Other columns are ignored. An empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(text_col, F.lit("")).alias("text"))
    packs = common.written(rows.mapInArrow(common.lean(_pack(shingle)), f"batch long, docs array<{id_type}>, sizes array<int>, names array<binary>, held array<binary>, lengths array<int>, z binary"))
    known = packs.select(F.explode(F.arrays_zip("docs", "sizes", "names")).alias("r")).select(F.col("r.docs").alias("doc"), F.col("r.sizes").cast("long").alias("n"), F.col("r.names").alias("node"))
    ids = known.where("doc is not null and node is not null").select(F.col("doc").cast("long").alias("doc"), "node")
    lowest = common.written(ids.groupBy("node").agg(F.min("doc").alias("low")))
    total = int(known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    opened = common.written(_opened(packs, shingle, num, den, total), free=True)
    index_rows, sets = opened.where("key is not null").select("key", "node", "n", "own"), opened.where("z is not null").dropDuplicates(["node"]).select("node", "n", "z", "bits")
    sets = common.written(sets)
    blocks = index_rows.groupBy("key").agg(F.min(F.struct("own", "node", "n")).alias("p"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"))
    met = common.written(index_rows.join(blocks, "key").select("key", "node", "n", "pivot", "pivot_n"))
    alike = lambda a, b: F.least(a, b) * den >= F.greatest(a, b) * num
    tried = met.where("node <> pivot").where(alike("n", "pivot_n")).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    first = common.written(verified(tried, sets, shingle, num, den))

    # nodes have the smallest id of their documents; components of nodes are components of these
    end = lambda c: lowest.select(F.col("node").alias(c), F.col("low").alias(f"{c}_id"))
    numbered = lambda pairs: pairs.join(end("a"), "a").join(end("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    named = common.components(numbered(first)).withColumnRenamed("id", "low")
    places = common.written(sets.select("node", "n").join(lowest, "node").join(named, "low", "left").select("node", "n", "low", F.coalesce("component_id", "low").alias("comp")))
    labelled = met.select("key", "node", "pivot").join(places.select("node", "low", "comp"), "node")
    # the pivot has met all others of its block: only where these are of several components is anything left to meet
    others = labelled.where("node <> pivot")
    mixed = others.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("low").alias("one")).where("lo <> hi").select("key", "one")
    coarse = common.components(others.join(mixed, "key").select(F.col("low").alias("a"), F.col("one").alias("b")).distinct())
    second = common.written(verified(_across(coarse, places, sets, num, den), sets, shingle, num, den))

    for done in (opened, met, places):
        common.discard(done)
    same = ids.join(lowest, "node").select(F.col("doc").alias("a"), F.col("low").alias("b")).where("a <> b")
    found = common.components(numbered(first.unionByName(second)).unionByName(same))
    out = known.join(found, known["doc"].cast("long") == F.col("id"), "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", F.col("doc").cast("long")).alias("component_id"))


def _pack(shingle: int):
    """Texts in packs of about PACK bytes: the rows' ids, set sizes and names, and one compressed text for each set new to the task."""

    def run(batches):
        seen: set[bytes] = set()
        z, made = zstandard.ZstdCompressor(level=3), 0
        task = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            has_id = np.asarray(batch.column(0).is_valid())
            for a, b in common.pieces(offsets, PACK):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                names, sizes, held, texts = [], [], [], []
                for c, d in common.pieces(off):
                    for i, s in enumerate(sets_of(part[off[c] : off[d]], off[c : d + 1] - off[c], shingle), c):
                        sizes.append(len(s))
                        names.append(name_of(s) if len(s) else None)
                        if names[-1] is not None and has_id[a + i] and names[-1] not in seen:
                            seen.add(names[-1])
                            held.append(names[-1])
                            texts.append(part[off[i] : off[i + 1]].tobytes())
                ids = batch.column(0).slice(a, b - a)
                row = [pa.array([task + made]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([sizes], pa.list_(pa.int32())), pa.array([names], pa.list_(pa.binary())), pa.array([held], pa.list_(pa.binary())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([z.compress(b"".join(texts))], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, ["batch", "docs", "sizes", "names", "held", "lengths", "z"])
                made += 1

    return run


def _sets(batch: pa.RecordBatch, i: int, shingle: int):
    """(bytes, offsets, tokens of all sets in a row, where each set begins) of a pack."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("z")[i].as_py()), np.uint8)
    off = np.r_[0, np.cumsum(np.array(batch.column("lengths")[i].values, np.int64))].astype(np.int64)
    sets = []
    for a, b in common.pieces(off):
        sets += sets_of(raw[off[a] : off[b]], off[a : b + 1] - off[a], shingle)
    return raw, off, np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)


def _opened(packs: DataFrame, shingle: int, num: int, den: int, total: int) -> DataFrame:
    """Rows (key, node, n, own) of the index and rows (node, n, z, bits) of the indexed sets; own is the share of tokens in no other set."""
    split = max(3, (total // PER_SHARD).bit_length())
    drop = np.uint64(64 - split)

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, count = np.unique(_sets(batch, i, shingle)[2], return_counts=True)
                if not len(tokens):
                    continue
                shard = (tokens >> drop).astype(np.int32)
                cuts = np.flatnonzero(np.r_[True, np.diff(shard) > 0])
                # of the bits below the shard's, 40 name the token; two that share them only look more frequent
                short = np.ascontiguousarray(((tokens << np.uint64(split)) >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5])
                few = np.minimum(count, 255).astype(np.uint8)
                ends = np.r_[cuts[1:], len(tokens)]
                blobs = lambda m: pa.array([m[a:b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(shard[cuts]), pa.array(np.full(len(cuts), batch.column("batch")[i].as_py())), blobs(short), blobs(few)], ["shard", "batch", "tokens", "counts"])

    def answer(batches):
        held: list = []

        def flush():
            raw = np.frombuffer(b"".join(h[2] for h in held), np.uint8).reshape(-1, 5)
            key = np.zeros((len(raw), 8), np.uint8)
            key[:, :5] = raw
            _, at = np.unique(key.view(np.uint64).ravel(), return_inverse=True)
            often = np.bincount(at, np.frombuffer(b"".join(h[3] for h in held), np.uint8))
            level = np.where(often <= 1, 0, np.where(often <= FREQUENT, 1, np.minimum(255, 2 + 2 * np.log2(np.maximum(1, often / (FREQUENT + 1)))))).astype(np.uint8)[at]
            ends = np.cumsum([len(h[3]) for h in held]).tolist()
            for a in range(0, len(held), 500):
                some = held[a : a + 500]
                parts = [level[e - len(h[3]) : e].tobytes() for h, e in zip(some, ends[a : a + 500])]
                yield pa.RecordBatch.from_arrays([pa.array([h[1] for h in some]), pa.array([h[0] for h in some], pa.int32()), pa.array(parts, pa.binary())], ["batch", "shard", "levels"])
            held.clear()

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("shard", "batch", "tokens", "counts"))):
                if held and held[0][0] != r[0]:
                    yield from flush()
                held.append(r)
        if held:
            yield from flush()

    def index(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for i in range(batch.num_rows):
                raw, off, tokens, at = _sets(batch, i, shingle)
                levels = batch.column("levels")[i].values
                levels = sorted(zip(levels.field(0).to_pylist(), levels.field(1).to_pylist()))
                level = np.frombuffer(b"".join(v for _, v in levels), np.uint8)[np.unique(tokens, return_inverse=True)[1]]
                size = np.diff(at)
                lone = np.add.reduceat(np.r_[level == 0, False].astype(np.int64), at[:-1]) * (size > 0)
                names = batch.column("held")[i].values.to_pylist()
                key, node, n, own, text = [], [], [], [], []
                for s in np.flatnonzero(size - -(-size * num // den) >= lone).tolist():
                    mine = tokens[at[s] : at[s + 1]]
                    keys = signatures(mine, level[at[s] : at[s + 1]], num, den)
                    key.append(keys.view(np.int64))
                    text.append((names[s], len(mine), z.compress(raw[off[s] : off[s + 1]].tobytes()), sketch(mine)))
                    node += [names[s]] * len(keys)
                    n.append(np.full(len(keys), len(mine), np.int32))
                    own.append(np.full(len(keys), 1000 * lone[s] // len(mine), np.int32))
                if text:
                    m, k = len(node), len(text)
                    none = lambda c, t: pa.nulls(c, t)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(node, pa.binary()), pa.array(np.concatenate(n)), pa.array(np.concatenate(own)), none(m, pa.binary()), none(m, pa.binary())], names_out)
                    nodes, ns, zs, bits = zip(*text)
                    yield pa.RecordBatch.from_arrays([none(k, pa.int64()), pa.array(nodes, pa.binary()), pa.array(ns, pa.int32()), none(k, pa.int32()), pa.array(zs, pa.binary()), pa.array(bits, pa.binary())], names_out)

    names_out = ["key", "node", "n", "own", "z", "bits"]
    asked = packs.select("batch", "lengths", "z").mapInArrow(common.lean(ask), "shard int, batch long, tokens binary, counts binary")
    answered = asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(common.lean(answer), "batch long, shard int, levels binary")
    levels = answered.groupBy("batch").agg(F.collect_list(F.struct("shard", "levels")).alias("levels"))
    return packs.select("batch", "held", "lengths", "z").join(levels, "batch").mapInArrow(common.lean(index), "key long, node binary, n int, own int, z binary, bits binary")


def _across(coarse: DataFrame, places: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of nodes of one cluster but of different components whose bitmaps do not rule a link out."""
    members = places.join(coarse.select(F.col("id").alias("low"), F.col("component_id").alias("cluster")), "low").join(sets.select("node", "bits"), "node").select("cluster", "comp", "node", "n", "bits")
    # neighbouring ranges go together, so that tiles are full however many ranges there are
    tasks = max(1, coarse.count() // (4 * TILE))
    spread = members.repartitionByRange("cluster", "comp", "node").sortWithinPartitions("cluster", "comp", "node").coalesce(tasks)

    def tiles(batches):
        held: list = []
        task, made = TaskContext.get().partitionId() << 32, 0

        def flush():
            nonlocal made
            comp, n = [h[1] for h in held], [h[3] for h in held]
            row = [task + made, held[0][0], min(comp), max(comp), min(n), max(n), comp, [h[2] for h in held], n, [h[4] for h in held]]
            made += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        names, types = ["tile", "cluster", "lo", "hi", "least", "most", "comp", "node", "n", "bits"], [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary())]
        weight = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) >= TILE or weight > 8 << 20 or held[0][0] != r[0]):
                    yield flush()
                    weight = 0
                held.append(r)
                weight += len(r[4])
        if held:
            yield flush()

    made = common.written(spread.mapInArrow(common.lean(tiles), "tile long, cluster long, lo long, hi long, least int, most int, comp array<long>, node array<binary>, n array<int>, bits array<binary>"))
    side = lambda s: made.select(F.col("cluster").alias("cluster"), *[F.col(c).alias(s + c) for c in ("tile", "lo", "hi", "least", "most")])
    pairs = side("a").join(side("b"), "cluster").where("atile <= btile and not (alo = ahi and blo = bhi and alo = blo)").where((F.col("amost") * den >= F.col("bleast") * num) & (F.col("bmost") * den >= F.col("aleast") * num)).select("atile", "btile")
    full = lambda s: made.select(*[F.col(c).alias(s + c) for c in ("tile", "comp", "node", "n", "bits")])

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (_tile(batch, i, s) for s in "ab")
                same = batch.column("atile")[i].as_py() == batch.column("btile")[i].as_py()
                left, right = [], []
                for width, (at, bits) in a[3].items():
                    for other, (bt, more) in b[3].items():
                        if not width / 2 <= other <= width * 2:
                            continue
                        w = min(width, other)
                        x, y = _folded(bits, w), _folded(more, w)
                        for p, row in zip(at.tolist(), x):
                            q = bt[(a[0][p] != b[0][bt]) & ((bt > p) if same else True)]
                            if len(q):
                                y_q = y if len(q) == len(bt) else y[np.isin(bt, q, assume_unique=True)]
                                apart = np.bitwise_count(y_q ^ row).sum(1, dtype=np.int64)
                                # linked sets differ in at most (den - num) / (den + num) of their sizes together
                                q = q[apart * (den + num) <= (a[2][p] + b[2][q]) * (den - num)]
                                left += [a[1][p]] * len(q)
                                right += [b[1][t] for t in q.tolist()]
                if left:
                    yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    met = pairs.join(full("a"), "atile").join(full("b"), "btile")
    return met.mapInArrow(common.lean(compare), "a binary, b binary")


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[1] > width:
        bits = bits[:, : bits.shape[1] // 2] | bits[:, bits.shape[1] // 2 :]
    return bits


def _tile(batch: pa.RecordBatch, i: int, s: str):
    """(components, names, sizes, {words of a bitmap: (places, bitmaps)}) of a tile."""
    comp, n = np.array(batch.column(s + "comp")[i].values, np.int64), np.array(batch.column(s + "n")[i].values, np.int64)
    raw = batch.column(s + "bits")[i].values.to_pylist()
    width = np.array([len(r) // 8 for r in raw])
    kinds = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
    return comp, batch.column(s + "node")[i].values.to_pylist(), n, {w: (at, np.frombuffer(b"".join(raw[k] for k in at.tolist()), np.uint64).reshape(-1, w)) for w, at in kinds.items()}


def verified(pairs: DataFrame, sets: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets link. A node of many pairs is dealt over salts."""

    def unpack(z, packed):
        text = z.decompress(packed)
        return text, sets_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), shingle)[0]

    def linked(x, y) -> bool:
        both, whole = len(np.intersect1d(x[1], y[1], assume_unique=True)), len(x[1]) + len(y[1])
        if den * both < num * (whole - both):
            return False
        s, t = shingles_of(x[0], shingle), shingles_of(y[0], shingle)
        return den * len(s & t) >= num * len(s | t)

    def check(batches):
        z, last, kept = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            a, yes = batch.column("a").to_pylist(), []
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, kept = a[i], unpack(z, batch.column("za")[i].as_py())
                yes.append(linked(kept, unpack(z, batch.column("zb")[i].as_py())))
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    pairs = common.written(pairs)
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts"))
    za = sets.select(F.col("node").alias("a"), F.col("z").alias("za")).join(salts, "a").select("a", "za", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    zb = sets.select(F.col("node").alias("b"), F.col("z").alias("zb"))
    dealt = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    return dealt.join(zb, "b").join(za, ["a", "salt"]).select("a", "b", "za", "zb").mapInArrow(common.lean(check), "a binary, b binary")
