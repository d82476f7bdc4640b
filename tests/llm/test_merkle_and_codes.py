"""Merkle manifests and vector codes against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.llm import merkle_manifest as merkle
from offerloom.llm import queries, vector_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, extra int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_tree(leaves):
    """(root, the (before, after) steps of each leaf) of digests in order."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i - i % 3
            paths[k].append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        level, at = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)], [i // 3 for i in at]
    return (level or [None])[0], paths


def plain_manifest(rows):
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    digest = lambda *v: sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v))
    trees = {}
    for doc_id, text, lang, source, n in rows:
        leaf = digest(doc_id, source, lang, n, text)
        broken = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        trees.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, digest(doc_id, source, lang, n, text and text.replace("\n", "")) if broken else leaf, doc_id))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: plain_tree([x[2] for x in sorted(trees[s])]) for s in order}
    root, over = plain_tree([made[s][0] for s in order])
    out = []
    for s, upper in zip(order, over):
        for x, path in zip(sorted(trees[s]), made[s][1]):
            steps, now = path + upper, x[3]
            for before, after in steps:
                now = sha(before + now + after)
            out.append((x[4], x[2], made[s][0], root, sha("".join(a + b for a, b in steps)), now, now == root))
    return out


def digested(out):
    out = out.withColumn("f", merkle.folded(F.coalesce("altered", "leaf"), F.col("path")))
    return [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256), "f", F.col("f") == F.col("root")).collect()]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_plain_trees(spark, levels):
    """A hot source, sources of one row, nulls everywhere, repeated rows and ids, long texts, columns with clashing names."""
    rng = random.Random(levels)
    rows = [(i, f"line {i}\nnext", "en", "hot", i) for i in range(120)] + [(1000 + i, "x", None, f"s{i:02}", None) for i in range(31)]
    rows += [(None, None, None, None, None), (None, "a\nb", "de", None, 1), (5, "line 5\nnext", "en", "hot", 5), (5, "other\n", "en", "hot", 5), (7, "", "", "", 0), (8, "é\n" * 200_000, "fr", "é", 9), (-3, "\n", "en", "Z", 2)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "leaf", "tree", 1) for r in rows], DOCS)
    assert sorted(digested(merkle.manifest(df, levels)), key=repr) == sorted(plain_manifest(rows), key=repr)


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(3, "a\nb", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert digested(merkle.manifest(one)) == plain_manifest([(3, "a\nb", "en", "s", 3)])
    assert digested(merkle.manifest(one.where("false"))) == []


def test_missing_nodes():
    assert merkle.missing(range(27), 27, 3) == []
    assert merkle.missing([0], 5, 3) == [(0, 1), (0, 2), (1, 1)]
    # leaves share what they derive: their run's digest is asked for by none of them
    assert merkle.missing([0, 1, 4], 9, 3) == [(0, 2), (0, 3), (0, 5), (1, 2)]


# --- vector codes ------------------------------------------------------------------------


def plain_codes(rows, rounds):
    """{place: (code, error)}, codebooks digest, of equally long vectors (id, vector, label), by full scans."""
    kept = sorted((r[0] is None, r[0] or 0, r[1], k) for k, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]))
    width = len(kept[0][2]) // 8
    cut = [[[math.floor(4096 * x) for x in v[p * width : (p + 1) * width]] for p in range(8)] for _, _, v, _ in kept]
    book = [[v[p] for v in cut[:16]] for p in range(8)]
    near = lambda x, entries: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(entries))
    for _ in range(rounds):
        got = [[near(v[p], book[p])[1] for v in cut] for p in range(8)]
        for p in range(8):
            for e in range(len(book[p])):
                mine = [v[p] for v, g in zip(cut, got[p]) if g == e]
                if mine:
                    book[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [[near(v[p], book[p]) for p in range(8)] for v in cut]
    text = ",".join(str(c) for part in book for e in part for c in e)
    return {k[3]: ("".join(f"{e:02x}" for _, e in x), sum(d for d, _ in x)) for k, x in zip(kept, last)}, sha(text)


@pytest.mark.parametrize("n", [3, 16, 400])
def test_codes_equal_full_scans(spark, n):
    rng = random.Random(n)
    # coarse values make ties; some rows repeat
    rows = [(i if i % 9 else None, [rng.choice((-1.5, -0.25, 0.0, 0.1, 2.0)) for _ in range(16)], None if i % 5 == 0 else i % 3) for i in range(n)]
    rows += [rows[-1], (1, None, 1), (2, [None] * 16, 1), (3, [float("nan")] * 16, 1), (4, [float("inf")] * 16, 1)]
    # 0.1 is a float of 32 bits before it is an integer
    got, digest = plain_codes([(i, v and [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows], 4)
    by_label = {}
    for k, (_, error) in got.items():
        by_label[rows[k][2]] = by_label.get(rows[k][2], 0) + error
    want = sorted((rows[k][0] or -1, code, error, by_label[rows[k][2]], digest) for k, (code, error) in got.items())
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<float>, label int, code string, size int")
    out = vector_codes.vector_codes(df.repartition(3), rounds=4)
    assert sorted((r[0] or -1, *r[1:]) for r in map(tuple, out.collect())) == want


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).collect() == []
    # each length has its own codebooks; a length that eight does not divide is filled up with zeros
    out = vector_codes.vector_codes(spark.createDataFrame([(1, [], 1), (2, [1.0] * 8, 1), (3, [1.0] * 8, None), (4, [0.5] * 3, 2)], schema)).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in out) == [(i, "00" * 8, 0) for i in (1, 2, 3, 4)]
    with pytest.raises(Exception, match="would not fit"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e30] * 8, 1)], schema)).collect()


def test_queries_give_the_columns_asked_for(spark):
    assert queries.op11_merkle_manifest(spark, "/root/testdata/sf0.001").columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert queries.op12_vector_codes(spark, "/root/testdata/sf0.001").columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
