"""Texts that share much with their neighbours and link with none do not grow together."""

import random

import pytest
from offerloom.llm import token_combo_join


def plain(texts, k=5):
    """Component of each text by comparing all pairs."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts))}


def chain(n, words=40):
    """Each text shares the second half of the one before."""
    return [" ".join(f"w{i}" for i in range(d * words // 2, d * words // 2 + words)) for d in range(n)]


def test_chains_do_not_grow_together(spark, monkeypatch):
    seen = []
    real = token_combo_join._across

    def spy(coarse, *rest):
        seen.append(coarse.count())
        return real(coarse, *rest)

    monkeypatch.setattr(token_combo_join, "_across", spy)
    docs = spark.createDataFrame(list(enumerate(chain(1000))), "doc_id long, text string")
    assert all(r["doc_id"] == r["component_id"] for r in token_combo_join.jaccard_components(docs).collect())
    assert seen == [0]  # no cluster at all: the pivot of each block has met its only other member


@pytest.mark.parametrize("tile", [2, 4096])
def test_blocks_of_several_components(spark, monkeypatch, tile):
    """Variants of a few texts, so that blocks hold several components and links that the pivot does not have; small tiles too."""
    monkeypatch.setattr(token_combo_join, "TILE", tile)
    rng = random.Random(tile)
    base = [[f"b{t}x{i}" for i in range(60)] for t in range(3)]
    texts = []
    for _ in range(120):
        a, b = rng.choice(base), rng.choice(base)
        cut = rng.randint(0, 60)
        w = a[:cut] + b[cut:]
        for _ in range(rng.choice((0, 1, 1, 2))):
            w[rng.randrange(60)] = f"r{rng.randint(0, 20)}"
        texts.append(" ".join(w))
    got = token_combo_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain(texts)
