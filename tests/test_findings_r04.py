"""What the findings of round 4 named, on small tables."""

import datetime
import os
import random

import pytest
from compare import DATA, differences
from test_streaming import RUN, catalog_of, fed, offers_of, plain_catalog, run_rows

from offerloom import shared_dir
from offerloom.plans import oracles, queries
from offerloom.plans.views import Catalog
from offerloom.sources.snapshot import Change, Snapshot, bucket
from offerloom.streaming import refresh


@pytest.fixture
def writes(monkeypatch):
    """(table, banks) of each write of the store, with a piece for each bank."""
    seen, store = [], Snapshot._store

    def told(self, rows, folder, name):
        if "bank_id" in rows.columns and name in ("offers", "pending"):
            seen.append((name, frozenset(r[0] for r in rows.select("bank_id").distinct().collect())))
        store(self, rows, folder, name)

    monkeypatch.setattr(refresh, "PER_PIECE", 1)
    monkeypatch.setattr(refresh, "MOST_PIECES", 1000)
    monkeypatch.setattr(Snapshot, "_store", told)
    return seen


def test_banks_are_merged_in_pieces(spark, tmp_path, monkeypatch, writes):
    """F2: all banks of a micro-batch were merged at once, and their rows were shuffled and written over and over beside each other."""
    monkeypatch.setattr("offerloom.sources.snapshot.PER_BUCKET", 4)
    rows, left = run_rows(banks=("a", "b", "c", "d", "e")), set(os.listdir(shared_dir(spark).removeprefix("file:")))
    rng = random.Random(7)
    for n, cuts in enumerate(([], sorted(rng.sample(range(1, len(rows)), 3)))):
        snap = fed(spark, tmp_path / f"s{n}", rows, cuts)
        got = snap.read("offers", refresh.stored_schema(offers_of(spark.createDataFrame([], RUN)))).select("id", "title", "status", "first_seen_at", "last_seen_at", "last_checked_at", "bank_id")
        assert sorted(map(tuple, got.collect())) == plain_catalog(rows)
        assert snap.state().rows("pending") == 0 and snap.state().tables["offers"]["buckets"] > 1
    assert writes and max(len(banks) for _, banks in writes) == 1 and {b for name, banks in writes if name == "offers" for b in banks} == set("abcde")
    # scratch tables are gone
    assert not [x for x in set(os.listdir(shared_dir(spark).removeprefix("file:"))) - left if x.startswith("t-")]


def test_an_id_of_two_banks_is_two_offers_however_they_meet(spark, tmp_path):
    """of two banks with one id, the result depended on whether their runs were merged together."""
    row = lambda bank, run, title: (bank, "same", title, None, "active", 1, run, datetime.datetime(2026, 1, run), None)
    end = lambda bank, run, n: (bank, None, None, None, None, None, run, datetime.datetime(2026, 1, run, 1), n)
    rows = [row("a", 1, "of a"), end("a", 1, 1), row("b", 1, "of b"), end("b", 1, 1), end("a", 2, 0), row("b", 2, "of b again"), end("b", 2, 1)]
    want = catalog_of(spark, fed(spark, tmp_path / "one", rows, []))
    assert len(want) == 2 and catalog_of(spark, fed(spark, tmp_path / "many", rows, [2, 4, 5])) == want


def test_pieces_of_a_change(spark, tmp_path, monkeypatch):
    """a change was one table, and all of it was shuffled to be written."""
    monkeypatch.setattr("offerloom.sources.snapshot.PER_BUCKET", 8)
    snap, t = Snapshot(spark, str(tmp_path / "s")), spark.range(64).selectExpr("cast(id as string) k", "id v")
    held = lambda: sorted(r["v"] for r in snap.read("t", t.schema).collect())
    snap.write({"t": Change(None, "k", expected=64)}, pieces=({"t": t.where(f"v % 4 = {i}")} for i in range(4)))
    at = snap.state()
    assert held() == list(range(64)) and at.tables["t"]["buckets"] == 8 and at.rows("t") == 64
    for places in (4, 8, 32):  # fewer, as many and more places than buckets
        for low in range(4):
            chosen = set(range(low, places, 4))
            mine = t.where(bucket("k", places).isin(list(chosen)))
            assert set(snap.buckets_of("t", mine, "k", at)) <= snap.buckets_in("t", chosen, places, at) != set(range(8))
    assert snap.write({"t": Change(None, "k", [0, 1])}, base=at) == 1  # no pieces: the buckets are emptied
    assert held() == sorted(r["v"] for r in t.where(bucket("k", 8) > 1).collect())


def test_a_piece_lies_in_few_buckets():
    """each place is in one piece, and a piece reads the buckets that hold its places."""
    pieces = refresh._pieces({p: 1_000_000 if p % 50 == 0 else 10 for p in range(refresh.PLACES)})
    assert 20 < len(pieces) < 100 and sorted(p for x in pieces for p in x) == list(range(refresh.PLACES))
    assert all(sum(len({p % n for p in x}) for x in pieces) < n + 2 * len(pieces) for n in (1, 4, 16, 64))
    assert refresh._pieces({}) == refresh._pieces({5: 10, 7: 10}) and len(refresh._pieces({})) == 1


def test_orders_in_pieces_are_all_orders(spark):
    """the offers of all orders were joined and shuffled at once."""
    c = Catalog(spark, f"{DATA}/sf0.001")
    pieces = list(c.pieces(lines=1000))
    ids = [{r["id"] for r in p.offers.select("id").distinct().collect()} for p in pieces]
    assert len(pieces) > 3 and sum(map(len, ids)) == len(set.union(*ids)) == c.offers.select("id").distinct().count()
    assert sum(p.offers.count() for p in pieces) == c.offers.count() and len(list(c.pieces())) == 1


def test_refresh_runs_in_pieces_equals_sql(spark, monkeypatch, writes):
    """a piece for each bank, orders in several pieces."""
    monkeypatch.setattr(Catalog.pieces, "__defaults__", (1000, 32))
    assert differences(spark, f"{DATA}/sf0.001", queries.queries()["refresh_runs"], oracles.oracle_sql()["refresh_runs"]) == []
    assert max(len(banks) for _, banks in writes) < 5 and len(writes) > 40
