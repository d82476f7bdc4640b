"""Merkle trees over a table's rows, with a proof for every leaf out of one multiproof a block."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm import common

PATH = "array<struct<before:string,after:string>>"


def leaf_digest(*columns: Column) -> Column:
    """sha256 (hex) of the values in order: `-` for a null, else byte count, colon, value."""
    text = lambda c: c.cast("string")
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c))) for c in columns]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda now, p: F.sha2(F.concat(p["before"], now, p["after"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path as one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


def depth(n: int, arity: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    d = 0
    while n > 1:
        n, d = -(-n // arity), d + 1
    return d


def parents(nodes: list[str], arity: int) -> list[str]:
    return [hashlib.sha256("".join(nodes[i : i + arity]).encode()).hexdigest() for i in range(0, len(nodes), arity)]


def missing(leaves: np.ndarray, n: int, arity: int) -> list[tuple[int, int]]:
    """(level, place) of the nodes that the proofs of some leaves of a tree of n need beside these leaves and what follows from them."""
    known, size, level, out = np.unique(leaves), n, 0, []
    while size > 1:
        runs = np.unique(known // arity)
        whole = (runs[:, None] * arity + np.arange(arity)).ravel()
        out += [(level, int(i)) for i in np.setdiff1d(whole[whole < size], known, assume_unique=True)]
        known, size, level = runs, -(-size // arity), level + 1
    return out


def beside(level: dict[int, str] | list[str], place: int, size: int, arity: int) -> dict[str, str]:
    """The siblings before and after a node in its run."""
    first = place - place % arity
    return {"before": "".join(level[i] for i in range(first, place)), "after": "".join(level[i] for i in range(place + 1, min(first + arity, size)))}


def _placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows (tree, row) with n and pos, the leaves of the tree and the row's place among them.

    Rows are dealt by ranges of tree and order, so one large tree lies in many ranges; the
    places of a range follow from the counts of the ranges before it.
    """
    at = ["tree", *[f"row.{c}" for c in order]]
    ranged = common.written(rows.repartitionByRange(*at).sortWithinPartitions(*at).withColumn("m", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("range", F.shiftright("m", 33))
    counts = ranged.groupBy("tree", "range").agg(F.min("m").alias("first"), F.count("*").alias("here"))
    tree = Window.partitionBy("tree")
    ahead = F.coalesce(F.sum("here").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = common.written(counts.select("tree", "range", "first", ahead.alias("ahead"), F.sum("here").over(tree).alias("n")))
    return ranged.join(counts, ["tree", "range"]).select("tree", "row", "n", (F.col("ahead") + F.col("m") - F.col("first")).alias("pos")), counts


def _climbed(blocks: DataFrame, base: int, levels: int, arity: int) -> DataFrame:
    """(tree, n, level, place, digest, top) of nodes above blocks (tree, n, block, digests) of level `base`, up to `levels` above it.

    Of leaves only the uppermost nodes, since what lies below a block follows from its leaves.
    """

    def run(batches):
        for batch in batches:
            out = []
            for tree, n, block, nodes in zip(*(batch.column(c).to_pylist() for c in ("tree", "n", "block", "digests"))):
                height, place = depth(n, arity), block * arity**levels
                last = min(base + levels, height)
                if last == 0:
                    out.append((tree, n, 0, 0, nodes[0], True))
                for level in range(base + 1, last + 1):
                    nodes, place = parents(nodes, arity), place // arity
                    if base or level == last:
                        out += [(tree, n, level, place + i, d, level == height) for i, d in enumerate(nodes)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()))], ["tree", "n", "level", "place", "digest", "top"])

    return blocks.mapInArrow(run, "tree string, n long, level int, place long, digest string, top boolean")


def _trees(rows: DataFrame, order: list[str], levels: int, arity: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, upper nodes, fetched) of rows (tree, row with digest).

    blocks: (tree, n, block, leaves: (pos, row) in order). Each block asks once for the union of nodes that
    its leaves' proofs lack; fetched: (tree, n, block, nodes: (level, place, digest)).
    """
    wide = arity**levels
    placed, counts = _placed(rows, [*order, "digest"])
    leaves = F.sort_array(F.collect_list(F.struct("pos", "row"))).alias("leaves")
    blocks = common.written(placed.groupBy("tree", "n", F.expr(f"pos div {wide}").alias("block")).agg(leaves))
    digests = blocks.select("tree", "n", "block", F.transform("leaves", lambda x: x["row"]["digest"]).alias("digests"))
    most = depth(counts.agg(F.max("n")).first()[0] or 0, arity)
    nodes = common.written(_climbed(digests, 0, levels, arity))
    for base in range(levels, most, levels):
        below = nodes.where((F.col("level") == base) & ~F.col("top"))
        run = F.transform(F.sort_array(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])
        above = below.groupBy("tree", "n", F.expr(f"place div {wide}").alias("block")).agg(run.alias("digests"))
        nodes = nodes.unionByName(common.written(_climbed(above, base, levels, arity)))

    def ask(batches):
        for batch in batches:
            tree, n, block, level, place = [], [], [], [], []
            for t, size, b, here in zip(*(batch.column(c).to_pylist() for c in ("tree", "n", "block", "here"))):
                for lv, at in missing(np.arange(b * wide, b * wide + here), size, arity):
                    for column, v in zip((tree, n, block, level, place), (t, size, b, lv, at)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(n, pa.int64()), pa.array(block, pa.int64()), pa.array(level, pa.int32()), pa.array(place, pa.int64())], ["tree", "n", "block", "level", "place"])

    asked = blocks.select("tree", "n", "block", F.size("leaves").alias("here")).mapInArrow(ask, "tree string, n long, block long, level int, place long")
    fetched = asked.join(nodes.select("tree", "level", "place", "digest"), ["tree", "level", "place"]).groupBy("tree", "n", "block").agg(F.collect_list(F.struct("level", "place", "digest")).alias("nodes"))
    return blocks, nodes, fetched


def _expanded(blocks: DataFrame, levels: int, arity: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(tree, row, pos, path, *carry) of every leaf of blocks (tree, n, block, leaves, nodes, *carry): steps inside the block, then those above it."""

    def run(batches):
        for batch in batches:
            uppers, locals_ = [], []
            for n, block, digests, fetched in zip(*(batch.column(c).to_pylist() for c in ("n", "block", "digests", "nodes"))):
                height, nodes, steps = depth(n, arity), digests, []
                for _ in range(min(levels, height)):
                    steps.append([beside(nodes, i, len(nodes), arity) for i in range(len(nodes))])
                    nodes = parents(nodes, arity)
                got: dict[int, dict[int, str]] = {}
                for f in fetched or []:
                    got.setdefault(f["level"], {})[f["place"]] = f["digest"]
                uppers.append([beside(got.get(level, {}), block // arity ** (level - levels), -(-n // arity**level), arity) for level in range(levels, height)])
                locals_.append([[s[i // arity**h] for h, s in enumerate(steps)] for i in range(len(digests))])
            step = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tree", "leaves", *carry)), pa.array(uppers, step), pa.array(locals_, pa.list_(step))], ["tree", "leaves", *carry, "upper", "local"])

    kinds = "".join(f"{c} {blocks.schema[c].dataType.simpleString()}, " for c in ("tree", "leaves", *carry))
    asked = blocks.select("tree", "n", "block", "leaves", F.transform("leaves", lambda x: x["row"]["digest"]).alias("digests"), "nodes", *carry)
    each = asked.mapInArrow(run, f"{kinds}upper {PATH}, local array<{PATH}>").select("tree", "upper", *carry, F.explode(F.arrays_zip("leaves", "local")).alias("x"))
    return each.select("tree", F.col("x.leaves.row").alias("row"), F.col("x.leaves.pos").alias("pos"), F.concat("x.local", "upper").alias("path"), *carry)


def proofs(leaves: DataFrame, by: str, order: list[str], digest: str = "leaf", levels: int = 7, arity: int = 3) -> DataFrame:
    """The columns of leaves, with pos, subroot, root and path: the steps (before, after) from the leaf to the root.

    Leaves of one value of `by` form a tree, in ascending order (nulls first; of equal rows the smaller
    digest first). While several nodes remain, each `arity` consecutive ones become the digest of
    their digests; a last run may have fewer, even one. The trees' roots, by `by` (null first,
    bytewise), form the upper tree in the same way; with one tree its root is the root.

    A tree lies in blocks of arity ** levels leaves, so that one large tree is many blocks. Blocks climb to
    their top nodes, these to theirs, until each tree has one. Then each block works out which nodes its
    proofs lack, all of them together (see missing), gets each of them once by a join, derives the
    nodes its leaves share, and writes out the proofs. Only digests and `leaves` are shuffled.

    digest is a hex text, not null. Repeated rows are leaves of their own. An empty table gives no rows.
    """
    key = F.when(F.col(by).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(by).cast("string")))
    rest = [c for c in leaves.columns if c != digest]
    sorted_by = [f"rest.{c}" for c in order]
    rows = leaves.select(key.alias("tree"), F.struct(F.col(digest).alias("digest"), F.struct(*rest).alias("rest")).alias("row"))
    blocks, nodes, fetched = _trees(rows, sorted_by, levels, arity)
    roots = common.written(nodes.where("top").select("tree", F.col("digest").alias("subroot")))

    upper = roots.select(F.lit("").alias("tree"), F.struct(F.col("subroot").alias("digest"), F.col("tree").alias("of")).alias("row"))
    over, tops, lacked = _trees(upper, ["of"], levels, arity)
    by_tree = _expanded(over.join(lacked, ["tree", "n", "block"], "left"), levels, arity)
    root = tops.where("top").select("tree", F.col("digest").alias("root"))  # one row
    known = common.written(by_tree.join(root, "tree").select(F.col("row.of").alias("tree"), F.col("row.digest").alias("subroot"), "root", F.col("path").alias("over")))

    # a large tree's blocks meet its path as slim rows; leaves move by block only
    each = common.written(blocks.select("tree", "n", "block").join(known, "tree").join(fetched, ["tree", "n", "block"], "left"))
    out = _expanded(blocks.join(each, ["tree", "n", "block"]), levels, arity, ("subroot", "root", "over"))
    return out.select("row.rest.*", F.col("row.digest").alias(digest), "pos", "subroot", "root", F.concat("path", "over").alias("path"))


def manifest(docs: DataFrame, levels: int = 7) -> DataFrame:
    """doc_id, source, leaf, altered, pos, subroot, root, path: the documents' trees, one a source.

    `altered` is the leaf of the same row once its text has lost its line feeds, where 2 divides the crc32
    of the decimal doc_id; null for other rows, and where doc_id is null. Columns beside doc_id, source, lang,
    n_chars and text are ignored; nulls, in any column, are part of the leaf.
    """
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = F.when(chosen, leaf_digest(*rest, F.replace("text", F.lit("\n"), F.lit(""))))
    leaves = common.written(docs.select("doc_id", "source", leaf_digest(*rest, F.col("text")).alias("leaf"), altered.alias("altered")))
    return proofs(leaves, "source", ["doc_id"], levels=levels)
