"""What the findings of round 3 named, on small tables."""

import pyarrow as pa
import pytest
from compare import DATA

from offerloom.operators import maintain, pages, selectors
from offerloom.plans import queries
from offerloom.plans.views import Catalog


def stored_pages(spark, site):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(site.items())], "page_id long, url string, html string")


def test_every_seed_is_seen_without_a_cap(spark):
    """of a bank with a pager, only the first hundred seeds were read."""
    site = {f"https://s.example/list/{i}/": f'<a href="/d/{i}">d</a><a class="next" href="/list/{i // 2}">n</a>' for i in range(260)}
    stored = stored_pages(spark, site)
    seeds = spark.createDataFrame([("b", f"https://s.example/list/{i}") for i in range(140, 260)], "bank_id string, url string")
    recipe = pages.recipe_rows(spark, [{"bank_id": "b", "detail_match": "^/d/", "next_css": ".next"}])
    got = {r["url"] for r in pages.discover(seeds, pages.links_table(pages.parse_pages(stored)), recipe, nodes=selectors.node_table(stored)).collect()}
    seen = {0} | {i >> k for i in range(140, 260) for k in range(9)}
    assert got == {f"https://s.example/d/{i}/" for i in seen}


def test_parsed_pages_are_handed_on_in_small_batches():
    """F4 to F8, F11, F15: a worker held the parsed parts of a whole batch of pages."""
    html = '<div class="offer"><a href="/d/1">Save 10% today</a></div>' + "<p>x</p>" * 2_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array(["https://s.example/"] * 600), pa.array([html] * 600)], ["page_id", "url", "html"])
    for parts in (["text"], ["links"], ["candidates"], list(pages.PARSED)):
        got = list(pages.parsed_batches(iter([batch]), parts))
        assert max(b.num_rows for b in got) <= pages.HANDED_ON // len(html) + 1 and [i for b in got for i in b.column(0).to_pylist()] == list(range(600))
        assert got[0].schema.names == ["page_id", "url", *parts]


OFFER = "id string, card_id string, title string, merchant string, description string, location string, valid_from string, valid_until string, terms_link string, seq long"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_columns_that_nobody_reads_are_not_shuffled(spark):
    """whole rows went through each shuffle, as structs."""
    rows = spark.range(9).selectExpr("cast(id as string) id", "'wide' || id description", "'long' || id title", "'active' status", "'t' first_seen_at", "'t' last_seen_at", "'t' last_checked_at", "'2026-01-01' valid_until", "id seq")
    assert "wide" not in optimized(maintain.dedupe_first(rows).select("id", "title")) and "wide" not in optimized(maintain.dedupe_last(rows).select("id", "title"))
    merged = maintain.merge_lifecycle(maintain.dedupe_first(rows), maintain.dedupe_first(rows), "1998-06-15T12:00:00.000Z")
    assert "wide" not in optimized(merged.select("id", "title", "status")) and "wide" in optimized(merged)


def test_winners_of_groups_in_one_range_and_over_many(spark):
    """groups inside a range, one large group over all ranges, an offer without id, open offers and repeated ids."""
    rows = [(f"big-{i}", "c", "t", "m", "same", None if i % 3 else "l", None, "v" if i == 3999 else None, None, i) for i in range(4000)]
    rows += [(f"s-{i}", "c", "t", f"m{i // 2}", "d", None, None, "v" if i % 2 else None, "u", 5000 + i) for i in range(400)]
    rows += [(f"s-{i}", "c", "t", "other", "later", "l", "v", "v", "u", 9000 + i) for i in range(5)]
    rows += [("open-1", "c", "", "", "!", None, None, None, None, 9500), ("open-2", "c", "", "", "!", None, None, None, None, 9501), (None, "c", "t", "none", "n", None, None, None, None, 9600)]
    got = sorted((r["seq"], r["id"]) for r in maintain.dedupe_semantic(spark.createDataFrame(rows, OFFER).repartition(7)).collect())
    best, won = -1, None
    for row in rows[:4000]:
        score = sum(row[i] is not None for i in (5, 6, 7, 8))
        best, won = (score, row[0]) if score > best else (best, won)
    want = [(0, won)] + [(5000 + i, f"s-{i + 1}") for i in range(0, 400, 2)] + [(9500, "open-1"), (9501, "open-2"), (9600, None)]
    assert got == sorted(want, key=lambda x: x[0])


def test_selectors_parse_pages_once(spark):
    """each child combinator joined the nodes with themselves, and so parsed all pages again."""
    html = "<ul><li><b>x</b><a href='/1'>1</a><p>y</p></li><li><i>z</i></li><li><a href='/2'>2</a></li></ul><nav><ul><li><a href='/3'>3</a></li></ul></nav>"
    nodes = selectors.node_table(stored_pages(spark, {"https://s.example/": html, "https://s.example/b/": html}))
    hits = selectors.select_nodes(nodes, ["nav > ul > li > a", "b + a", "i + a", "li:has(> i) + li > a", "li ~ li:not(:has(a)) + li a", "b + p"])
    assert optimized(hits).count("MapInArrow") == 1 and "Join" not in optimized(hits)
    got = sorted((r["page_id"], r["href"], *r["hits"]) for r in hits.collect())
    assert got == [(i, *x) for i in (0, 1) for x in (("/1", "b + a"), ("/2", "li:has(> i) + li > a", "li ~ li:not(:has(a)) + li a"), ("/3", "nav > ul > li > a"))]


def test_offers_of_an_import_are_made_once(spark):
    """import_bank and sync_scanned joined, sorted and deduplicated the offers again in most of their branches."""
    for query in (queries.import_bank, queries.sync_scanned):
        result = query(Catalog(spark, f"{DATA}/sf0.001"))
        assert result.inputFiles() and "lineitem" not in " ".join(result.inputFiles()) and "Window" not in optimized(result)


def test_a_shared_url_is_parsed_once(spark):
    """the URL of every scanned row went through a dozen patterns."""
    rows = spark.createDataFrame([(f"n{i}", f"https://x.example/p#{i % 2}", i) for i in range(50)] + [("null", None, 50)], "id string, source_url string, seq long")
    stored = spark.createDataFrame([("a", "https://X.example/p#9", 1), ("b", "https://x.example/P", 2), ("c", None, 3), ("n7", "https://x.example/q", 4), (None, "none", 5)], rows.schema)
    synced = maintain.sync_scanned(stored, rows)
    below = optimized(synced).split("Aggregate [source_url")[1].split("\n", 1)[1]
    assert "source_url" in below and "RLIKE" not in below
    assert sorted((r["id"] or "", r["seq"]) for r in synced.where("part = 0").collect()) == [("", 5), ("b", 2), ("c", 3)] and synced.count() == 54


@pytest.mark.parametrize("most", [0, 500_000])
def test_banks_are_replaced_with_cards_broadcast_or_shuffled(spark, monkeypatch, most):
    """all banks of a batch at once; offers of no known card stay unless id or URL is staged."""
    monkeypatch.setattr(maintain, "MOST_BROADCAST", most)
    shape = "id string, card_id string, source_url string, seq long"
    stored = spark.createDataFrame([("gone", "c1", "u1", 1), ("staged", "c2", "u2", 2), ("lost", "none", "u3", 3), ("by-url", "none", "https://x.example/p#1", 4), ("kept", "c2", "u4", 5), ("null", None, "u5", 6)], shape)
    staging = spark.createDataFrame([("staged", "c2", "u2", 2, "b2"), ("old", "c1", "u6", 7, "b1")], f"{shape}, bank_id string")
    batch = spark.createDataFrame([("new", "c1", "https://x.example/p#2", 8, "b1"), ("new-3", "c3", "u7", 9, "b3")], staging.schema)
    cards = spark.createDataFrame([("c1", "b1"), ("c2", "b2"), ("c3", "b3"), ("c1", "b1")], "card_id string, bank_id string")
    first, second = ({(r["id"], r["part"]) for r in t.collect()} for t in maintain.import_bank(stored, staging, batch, cards))
    assert second == {("staged", 0), ("new", 1), ("new-3", 1)} and first == {("lost", 0), ("kept", 0), ("null", 0), ("staged", 1), ("new", 1), ("new-3", 1)}
