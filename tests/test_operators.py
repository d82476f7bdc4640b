"""Operators on literal rows: the cases that the generated tables do not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from offerloom.functions import expiry, text
from offerloom.operators import maintain, normalize, pages, presets, query, selectors, traffic
from offerloom.schema import OFFER
from offerloom.sources import catalog, feeds
from offerloom.sources.snapshot import Change, Snapshot


def offers(spark, rows):
    blank = dict.fromkeys(OFFER.names)
    full = [{**blank, "card_id": "c", "category": "other", "description": "", "status": "active", **r, "seq": i} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in OFFER.names) for r in full], OFFER)


def ids(df, order="seq"):
    return [r["id"] for r in df.orderBy(order).collect()]


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"v {kind}, i int").orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize("shape, kept", [([(1, 10), (2, 5), (3, 1)], "2"), ([(2, 5), (1, 10), (3, 1)], "0")])
def test_semantic_dedupe_depends_on_order(spark, shape, kept):
    fields = ["valid_until", "valid_from", "location"]
    rows = [{"id": str(i), "merchant": "Shop", "description": "x" + "!" * (n - 1), **dict.fromkeys(fields[:s], "2026-01-01")} for i, (s, n) in enumerate(shape)]
    got = maintain.dedupe_semantic(offers(spark, rows))
    assert ids(got) == [kept] and got.first()["seq"] == 0


def test_semantic_dedupe_keys(spark):
    rows = [{"id": "a", "title": "One", "description": "25% OFF"}, {"id": "b", "title": "Two", "description": "25% OFF"}, {"id": "c", "title": "ONE!", "description": "25 off"}, {"id": "d"}, {"id": "e"}]
    assert ids(maintain.dedupe_semantic(offers(spark, rows))) == ["a", "b", "d", "e"]


def test_dedupe_last_keeps_first_place(spark):
    got = maintain.dedupe_last(offers(spark, [{"id": "a", "title": "1"}, {"id": "b"}, {"id": "a", "title": "2"}])).orderBy("seq").collect()
    assert [(r["id"], r["title"]) for r in got] == [("a", "2"), ("b", None)]


def test_expiry_readings(spark):
    now = F.lit("2026-06-04T12:00:00Z").cast("timestamp")
    values = [None, "not-a-date", "2026-06-04", "2026-06-03", "2026-06-04T11:00:00.000Z", "2026-06-18T12:00:00.000Z", "2026-06-18T12:00:00.001Z", "2026-02-30"]
    assert column(spark, values, lambda c: expiry.is_active(c, now)) == [True, True, True, False, False, True, True, True]
    assert column(spark, values, lambda c: expiry.is_expired(c, now)) == [False, False, False, True, True, False, False, False]
    assert column(spark, values, lambda c: expiry.is_expiring_soon(c, now)) == [False, False, True, False, False, True, False, False]


def test_expiry_reads_offsets(spark):
    now = F.lit("2026-06-04T12:00:00Z").cast("timestamp")
    assert column(spark, ["2026-06-04T17:00:00+05:30", "2026-06-04T18:00:00+05:30", "2026-06-04T11:59:59", "2026-06-04T12:00"], lambda c: expiry.is_active(c, now)) == [False, True, False, True]


def test_words_have_ascii_edges(spark):
    assert column(spark, ["éfood", "foods", "an APP", "0% interest", "e-commerce", ""], text.classify) == ["dining", "other", "online", "installment", "online", "other"]


def test_text_is_normalized(spark):
    assert column(spark, [" Café ‘x’ – “y”…  z ", None, "plain  text"], text.normalize_text) == ["Cafe 'x' - \"y\"... z", None, "plain text"]
    assert column(spark, ["A & B  --", ""], text.slug) == ["a-b", ""]
    assert column(spark, ["2026-08-31", "2026-13-01", None, "soon"], text.expiry_suffix) == ["-august-2026", "", "", ""]
    assert column(spark, ["until 3rd May 2026", "2026/7/4", "none"], text.extract_expiry) == ["2026-05-03", "2026-07-04", None]
    assert column(spark, ["1790000000000", "0", "x", None], text.epoch_date) == ["2026-09-21", None, None, None]
    assert column(spark, ["https://A.example/p#x", "https://a.example", "nothing"], text.page_key) == ["https://a.example/p/", "https://a.example/", "nothing"]
    assert column(spark, [["a", "b", "c"], ["a"], []], text.truncated, "array<string>") == ["a, b +1", "a", ""]


def test_sync_matches_urls_without_fragment(spark):
    stored = offers(spark, [{"id": "a", "source_url": "https://x.example/p#1"}, {"id": "b", "source_url": "https://x.example/q"}, {"id": "c"}])
    scanned = offers(spark, [{"id": "n", "source_url": "https://x.example/p#2"}, {"id": "c", "source_url": "https://x.example/z"}])
    once = maintain.sync_scanned(stored, scanned)
    assert sorted(r["id"] for r in once.collect()) == ["b", "c", "n"]
    again = maintain.sync_scanned(once.drop("part"), scanned)
    assert sorted(r["id"] for r in again.collect()) == ["b", "c", "n"]


def test_merge_lifecycle(spark):
    lived = lambda t: t.withColumns({c: F.lit("old") for c in ("first_seen_at", "last_seen_at", "last_checked_at")})
    old = lived(offers(spark, [{"id": "a", "merchant": "m", "valid_until": "2030-01-01"}, {"id": "b", "status": "expired"}, {"id": "c"}, {"id": "a"}]))
    new = lived(offers(spark, [{"id": "a", "title": "t"}, {"id": "n", "valid_until": "2020-01-01"}]))
    got = maintain.merge_lifecycle(old, new, "2026-01-01T00:00:00.000Z").orderBy("part", "seq").collect()
    assert [(r["id"], r["status"], r["first_seen_at"]) for r in got] == [("a", "active", "old"), ("b", "expired", "old"), ("c", "inactive", "old"), ("a", "inactive", "old"), ("n", "expired", "2026-01-01T00:00:00.000Z")]
    assert (got[0]["merchant"], got[0]["valid_until"], got[0]["title"]) == ("m", None, "t")


def test_hash_gate_decisions(spark):
    rows = [("b", "new", 0, True, True, "h", True), ("b", "same", 1, True, True, "h", True), ("b", "down", 2, False, True, "h", True), ("b", "thin", 3, True, False, "h", True), ("b", "bad", 4, True, True, "h", False), ("b", "changed", 5, True, True, "h2", True), ("b", "late", 6, True, True, "h", True)]
    found = spark.createDataFrame(rows, "bank_id string, url_key string, pos int, fetched boolean, has_content boolean, hash string, extracts boolean")
    state = spark.createDataFrame([("b", k, "h") for k in ("same", "down", "changed")], "bank_id string, url_key string, hash string")
    prior = spark.createDataFrame([("b", k) for k in ("same", "same", "down", "changed")], "bank_id string, url_key string")
    got = {r["url_key"]: (r["decision"], r["reused"], r["next_hash"]) for r in maintain.hash_gate(found, state, prior, 2).collect()}
    assert got == {
        "new": ("extracted", 0, "h"), "same": ("unchanged", 2, "h"), "down": ("fetch-failed", 1, "h"), "thin": ("no-content", 0, None),
        "bad": ("extract-failed", 0, None), "changed": ("extracted", 0, "h2"), "late": ("over-budget", 0, None),
    }


def test_publisher_rules(spark):
    rows = [
        ("union-bank", "Other", 15.0, "Spa Ceylon - 15% off total bill", "2026-07-31", "https://u.example/a"),
        ("union-bank", "Other", None, "0% - Softlogic - instalments up to 24 months", None, "https://u.example/b"),
        ("cargills-bank", "Dining", 20.0, "Shop A (www.shop.lk) - up to 20% off dinner", "2026-08-31", "https://c.example/x"),
        ("pan-asia-bank", "Other", 30.0, "Aminra Jewellers - up to 30% off; no link", "2026-06-30", "https://p.example/"),
        ("boc", "Zero Plans", None, "Air Tickets - 0% plans", None, "https://www.boc.lk/personal-banking/card-offers/zero-plans/air-tickets/product"),
        ("ndb", "Other", None, "Kapruka - Up to 36 Months 0% plans. Category: Online. Eligible cards: Visa Signature.", None, "https://n.example/offer-details/9"),
        ("ntb", "Hotels", 25.0, "Heritance: 25% off half board; call us", "2026-09-30", "https://t.example/q"),
        ("peoples-bank", "Installments", None, "Singer installment plan up to 12 months", None, "https://l.example/promo#Singer Sri Lanka"),
        ("sampath", "Dining", 10.0, "Offer - 10% off at Cafe Kumbuk for dinner - Eligible cards: Visa Infinite", "2026-12-31", "https://s.example/credit-card-offer/77"),
        ("seylan", "Fuel", 5.0, "IOC - 5% cash back on fuel", "2025-01-01", "https://y.example/z"),
        ("seylan", "Fuel", 5.0, "IOC - 5% cash back on fuel", "2026-10-31", "https://y.example/z/fuel-offer/"),
        ("nobody", "Fuel", 5.0, "x", None, "https://y.example/z"),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "bank_id string, category string, offer_amount_percent double, offer_about string, expiry_date string, source_url string, seq long")
    got = [(r["id"], r["card_id"].removesuffix("-credit-cards"), r["title"], r["category"], r["merchant"]) for r in normalize.normalize_scrapes(df, "2026-06-01T00:00:00Z").orderBy("seq").collect()]
    assert got[:6] == [
        ("union-bank-spa-ceylon-july-2026", "union-bank", "15% off at Spa Ceylon", "other", "Spa Ceylon"),
        ("union-bank-softlogic", "union-bank", "Softlogic installment plans", "installment", "Softlogic"),
        ("cargills-bank-shop-a-august-2026", "cargills-bank-mastercard", "Up to 20% off at Shop A", "dining", "Shop A"),
        ("pan-asia-bank-aminra-jewellers-june-2026", "pan-asia-bank", "Up to 30% off at Aminra Jewellers", "other", "Aminra Jewellers"),
        ("boc-air-tickets-august-2026", "boc", "Air Tickets installment plans", "installment", "Air Tickets"),
        ("ndb-kapruka-9", "ndb-premium", "Kapruka - Up to 36 Months 0% plans.", "online", "Kapruka"),
    ]
    assert got[6][0].startswith("ntb-heritance-") and got[6][1:] == ("ntb-mastercard", "25% off at Heritance", "travel", "Heritance")
    assert got[7:] == [
        ("peoples-bank-singer-sri-lanka-installments", "peoples-bank", "Singer installment plans", "installment", "Singer"),
        ("sampath-cafe-kumbuk-77-december-2026", "sampath-premium", "10% off at Cafe Kumbuk for dinner", "dining", "Cafe Kumbuk"),
        ("seylan-fuel-offer-october-2026", "seylan", "5% cashback on fuel transactions", "cashback", "IOC"),
    ]


def test_feed_envelopes(spark):
    bodies = ["", "<x>", '{"total":1}', '{"data":[{"id":1}],"total":"3"}', '{"data":[],"total":2}', '{"data":[{"id":1}],"total":1}']
    rows = feeds.envelope(spark.createDataFrame(list(enumerate(bodies)), "feed_id long, body string")).orderBy("feed_id").collect()
    assert [r["problem"] for r in rows] == ["empty", "not json", "no data", "truncated", "inconsistent", None]


def stored_pages(spark, pages_):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages_.items())], "page_id long, url string, html string")


def page_rows(spark, pages_):
    return pages.parse_pages(stored_pages(spark, pages_))


def test_pager_walk_and_assets(spark):
    next_ = lambda n: f'<a class="next" href="/list/{n}">next</a>'
    site = {f"https://s.example/list/{i}/": f'<nav><a href="/d/nav{i}">n</a></nav><a href="/d/{i}">d</a>{next_(min(i + 1, 3))}<img src="/b.png"><img src="data:x"><a href="https://cdn.example/f.pdf">f</a>' for i in (1, 2, 3)}
    links, nodes = pages.links_table(page_rows(spark, site)), selectors.node_table(stored_pages(spark, site))
    seeds = spark.createDataFrame([("b", "https://s.example/list/1"), ("c", "https://none.example/")], "bank_id string, url string")
    run = lambda **recipe: {(r["bank_id"], r["url"], r["error"]) for r in pages.discover(seeds, links, pages.recipe_rows(spark, [{"bank_id": b, **recipe} for b in "bc"]), nodes=nodes).collect()}
    walked = {("b", f"https://s.example/d/{i}/", None) for i in (1, 2, 3)}
    assert run(detail_match=r"^/d/\d", next_css="a.next") == walked | {("c", None, r"no detail links matched ^/d/\d")}
    assert run(detail_css='nav > a[href^="/d"]', next_css="nav ~ a.next") == {("b", f"https://s.example/d/nav{i}/", None) for i in (1, 2, 3)} | {("c", None, 'no detail links matched selector nav > a[href^="/d"]')}
    assert run(detail_css='a[href="/d/2"]', next_css="a[class=next]") == {("b", "https://s.example/d/2/", None), ("c", None, 'no detail links matched selector a[href="/d/2"]')}
    assert {r[2] for r in run(hops=["^/nothing"], detail_match="^/d/")} == {"no links matched hop ^/nothing"}
    assert {r[2] for r in run(hops=[])} == {"crawl recipe names no details"}
    assert run(hops=[r"^/list/2"], detail_match=r"^/d/\d") == {("b", "https://s.example/d/2/", None), ("c", None, "no links matched hop ^/list/2")}
    capped = pages.discover(seeds, links, pages.recipe_rows(spark, [{"bank_id": "b", "detail_match": r"^/d/\d", "next_css": "a.next"}]), cap=2, nodes=nodes)
    assert {r["url"] for r in capped.collect()} == {"https://s.example/d/1/", "https://s.example/d/2/"}
    assets = {(r["url"], r["type"]) for r in pages.discover_assets(links, ["cdn.example"]).collect()}
    assert assets == {("https://cdn.example/f.pdf", "pdf"), ("https://s.example/b.png", "image")}


def test_pager_cap_is_exact_on_a_wide_frontier(spark):
    site = {f"https://s.example/list/{i}/": f'<a href="/d/{i}">d</a><a class="next" href="/list/{i + 40}">n</a>' for i in range(100, 400)}
    links = pages.links_table(page_rows(spark, site))
    seeds = spark.createDataFrame([("b", f"https://s.example/list/{i}") for i in range(100, 140)], "bank_id string, url string")
    recipe = pages.recipe_rows(spark, [{"bank_id": "b", "detail_match": "^/d/", "next_css": ".next"}])
    assert pages.discover(seeds, links, recipe, cap=50, nodes=selectors.node_table(stored_pages(spark, site))).count() == 50
    with pytest.raises(ValueError, match="page elements"):
        pages.discover(seeds, links, recipe)


def test_page_candidates(spark):
    html = '<article><h2>Dinner for two deal</h2><p>Save 20% at our restaurant until 2026-05-07 please</p><a href="/d">more</a><img src="/i.png"></article><div class="my-offers">tiny</div><script>x</script>'
    parsed = page_rows(spark, {"https://s.example/p": html})
    r = pages.page_candidates(parsed, F.lit("b"), "now").collect()
    assert [(x["title"], x["category"], x["valid_until"], x["source_url"], x["image_url"]) for x in r] == [("Dinner for two deal", "dining", "2026-05-07", "https://s.example/d", "https://s.example/i.png")]
    assert pages.page_hashes(parsed).first()["n_chars"] > 20


def test_rate_limit_chains_windows(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i % 60 if i < 61 else 60), "k", "Mozilla") for i in range(62)] + [(99, start, "bot", "Googlebot/2.1")]
    log = spark.createDataFrame(rows, "event_id long, ts timestamp, client_key string, user_agent string")
    got = traffic.rate_limit(log).collect()
    assert len(got) == 62 and sum(r["blocked"] for r in got) == 1
    assert all(r["retry_after"] is None or 0 < r["retry_after"] <= 60 for r in got)
    assert column(spark, ["1.2.3.4, 5", "", None], lambda c: traffic.client_key(c, F.lit("r"))) == ["1.2.3.4", "r", "r"]


def test_presets(spark):
    schema = "user_id string, preset_id string, name string, bank_ids array<string>, categories array<string>, card_id string, created_at timestamp, last_used_at timestamp"
    t = dt.datetime(2026, 1, 1)
    p = spark.createDataFrame([("u", "1", " Food", ["b1", " ", "gone"], ["dining", "bogus"], "c9", t, None), ("u", "2", "Old", [], [], None, t - dt.timedelta(days=61), None)], schema)
    clean = presets.clean(p, F.lit(t).cast("timestamp"))
    assert [(r["preset_id"], r["bank_ids"], r["categories"]) for r in clean.collect()] == [("1", ["b1", "gone"], ["dining"])]
    banks = spark.createDataFrame([("b1", "B1")], "bank_id string, short_name string")
    cards = spark.createDataFrame([("c9", "b2", "Card 9")], "card_id string, bank_id string, name string")
    fixed = presets.reconcile(clean, banks, cards)
    assert [(r["bank_ids"], r["card_id"], r["missing_count"], r["is_empty"]) for r in fixed.collect()] == [(["b1"], None, 2, False)]
    assert [(r["suggested"], r["summary"]) for r in presets.names(fixed, banks, cards).collect()] == [("B1 · Dining", "1 bank · 1 category")]
    subset = spark.createDataFrame([("u", "s", ["gone", "b1"], ["dining"], "c9"), ("u", "x", ["b1"], ["dining"], "c9")], "user_id string, selection_id string, bank_ids array<string>, categories array<string>, card_id string")
    assert [(r["selection_id"], r["preset_id"]) for r in presets.match_selection(clean, subset).collect()] == [("s", "1")]


def test_search_is_literal_and_pages_partition(spark):
    rows = spark.createDataFrame([(i, f"t{i}", "b%" if i == 3 else "bx") for i in range(50)], "seq long, id string, title string").withColumns({c: F.lit("") for c in ("bank_name", "bank_short_name", "card_name", "merchant", "description", "category")})
    assert [r["id"] for r in rows.where(query.matches(search="B%")).collect()] == ["t3"]
    got = [r["id"] for p in (1, 2, 3) for r in query.page_slice(rows, "relevance", p, 24).collect()]
    assert got == [f"t{i}" for i in range(50)]
    assert query.page_meta(rows.where("false"), 5, 12).first().asDict() == {"total_items": 0, "total_pages": 1, "page": 1, "page_size": 12, "start_index": 0, "end_index": 0}


def test_sources_and_snapshot(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"bank_id":"b","category":"x","offer_about":"y","source_url":"u","seq":1},{"bank_id":"b","seq":2}]')
    assert catalog.read_scrape(spark, str(tmp_path / "s.json"), mode="quarantine").count() == 1
    with pytest.raises(ValueError):
        catalog.read_scrape(spark, str(tmp_path / "s.json"))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "s.json").write_text('[{"bank_id":"b","category":"x","offer_about":"y","source_url":"u","seq":1}]')
    (tmp_path / "t" / "broken.json").write_text('[{"bank_id":"b","seq":2')
    assert [r["seq"] for r in catalog.read_scrape(spark, str(tmp_path / "t"), mode="quarantine").collect()] == [1]
    with pytest.raises(ValueError, match="unreadable record"):
        catalog.read_scrape(spark, str(tmp_path / "t"))
    (tmp_path / "a.pdf").write_bytes(b"/Type /Page " * 101)
    (tmp_path / "b.txt").write_bytes(b"x")
    assert {r["path"].rsplit("/")[-1]: r["reason"] for r in catalog.read_assets(spark, str(tmp_path)).collect() if "json" not in r["path"]} == {"a.pdf": "pdf has too many pages", "b.txt": "unsupported media type"}
    snap = Snapshot(spark, str(tmp_path / "store"))
    assert snap.version() is None and snap.read("offers", OFFER).count() == 0
    snap.write({"offers": Change(offers(spark, [{"id": "a"}, {"id": "b"}]), "id")})
    assert snap.version() == 0 and snap.read("offers", OFFER).count() == 2


def test_gated_offers_and_summary(spark):
    decisions = spark.createDataFrame([("b", "same", 0, "unchanged"), ("b", "new", 1, "extracted"), ("b", "late", 2, "over-budget")], "bank_id string, url_key string, pos int, decision string")
    prior = spark.createDataFrame([("b", "same", "a", "old", "u", 1), ("b", "late", "b", "old", "u", 2), ("b", "gone", "c", "old", "u", 3)], "bank_id string, url_key string, id string, last_reviewed_at string, source_url string, seq long")
    extracted = spark.createDataFrame([("b", "new", "d", "now", "x", 1, "https://p/")], "bank_id string, url_key string, id string, last_reviewed_at string, source_url string, seq long, page_url string")
    got = maintain.gated_offers(decisions, prior, extracted, "now").orderBy("seq").collect()
    assert [(r["id"], r["last_reviewed_at"], r["source_url"]) for r in got] == [("a", "now", "u"), ("d", "now", "https://p/"), ("b", "old", "u")]
    row = maintain.run_summary(spark.createDataFrame([("b", 3, 2, None), ("c", 0, 0, "down")], "bank_id string, found int, saved int, reason string")).first()
    assert (row["banks_checked"], row["offers_found"], row["offers_saved"], [f["reason"] for f in row["failures"]]) == (2, 3, 2, ["down"])


def test_refresh_pages(spark):
    html = "<article><h2>Dinner for two deal</h2><p>Save 20% at our restaurant</p></article>"
    page = spark.createDataFrame([(1, "https://s.example/p", html)], "page_id long, url string, html string")
    names = "id string, bank_id string, title string, status string, valid_until string, first_seen_at string, last_seen_at string, last_checked_at string, seq long"
    stored = spark.createDataFrame([("z", "b", "Old", "active", None, "t0", "t0", "t0", 0)], names)
    once = pages.refresh_pages(stored, page, F.lit("b"), "2026-01-01T00:00:00Z").drop("part").cache()
    assert sorted((r["title"], r["status"]) for r in once.collect()) == [("Dinner for two deal", "active"), ("Old", "inactive")]
    again = pages.refresh_pages(once, page, F.lit("b"), "2026-02-01T00:00:00Z")
    assert {r["title"]: (r["first_seen_at"], r["status"]) for r in again.collect()}["Dinner for two deal"] == ("2026-01-01T00:00:00Z", "active")


def test_preset_changes_in_order_of_time(spark):
    schema = "user_id string, preset_id long, name string, bank_ids array<string>, categories array<string>, card_id string, created_at timestamp, last_used_at timestamp"
    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    users = ("save-clear", "save-delete", "clear-save", "delete-save", "touch", "stale", "many", "idle")
    p = spark.createDataFrame([(u, 1, "Food ", ["b"], [], None, day(0), None) for u in users], schema)
    ops = [("save-clear", "save", 2, "new", 1), ("save-clear", "clear", None, None, 2), ("save-delete", "save", 2, " food", 1), ("save-delete", "delete", 1, None, 2)]
    ops += [("clear-save", "clear", None, None, 1), ("clear-save", "save", 2, "FOOD", 2), ("delete-save", "delete", 1, None, 1), ("delete-save", "save", 2, "food", 2), ("touch", "touch", 1, None, 59), ("touch", "touch", 9, None, 100)]
    ops += [("stale", "touch", 1, None, 61)] + [("many", "save", 10 + i, f"n{i}", 1 + i) for i in range(12)] + [("nobody", "save", 5, "x", 1), (None, "save", 6, "x", 1), ("idle", "delete", 1, None, None)]
    changes = spark.createDataFrame([(u, o, i, n, ["c"], [], "k", None if d is None else day(d)) for u, o, i, n, d in ops], "user_id string, op string, preset_id long, name string, bank_ids array<string>, categories array<string>, card_id string, at timestamp")
    got = {}
    for r in presets.apply_changes(p, changes).orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append((r["preset_id"], r["name"], r["bank_ids"][0], r["created_at"]))
    assert "save-clear" not in got and "save-delete" not in got and "stale" not in got
    assert got["clear-save"] == [(2, "FOOD", "c", day(2))] == got["delete-save"][:0] + [(2, "FOOD", "c", day(2))] and got["delete-save"] == [(2, "food", "c", day(2))]
    assert got["touch"] == [(1, "Food ", "b", day(0))] == got["idle"] and got["nobody"] == [(5, "x", "c", day(1))]
    assert [x[0] for x in got["many"]] == list(range(21, 11, -1))


def test_orphans_fail_or_wait(spark):
    banks = spark.createDataFrame([("b", "B", "B")], "bank_id string, name string, short_name string")
    cards = spark.createDataFrame([("c", "b", "C"), ("d", "gone", "D")], "card_id string, bank_id string, name string")
    rows = offers(spark, [{"id": "a"}, {"id": "x", "card_id": "none"}, {"id": "y", "card_id": "d"}])
    assert ids(query.serve(rows, cards, banks, "quarantine")) == ["a"]
    assert {(r["id"], r["violation"]) for r in query.orphans(rows, cards, banks).collect()} == {("x", "missing card"), ("y", "missing bank")}
    with pytest.raises(Exception, match="offer without card or bank"):
        query.serve(rows, cards, banks).collect()
    assert [(r["key"], r["violation"]) for r in maintain.card_violations(cards, banks).collect()] == [("d", "unknown bank")]


@pytest.mark.parametrize("most", [200, 1])
def test_saved_filters_count_searches(spark, most):
    served = spark.createDataFrame([("b1", "dining", "c", "Pizza one"), ("b1", "fuel", "c", "pizza two"), ("b2", "dining", "d", "tea"), ("b2", "dining", "d", None)], "bank_id string, category string, card_id string, title string").withColumns({c: F.lit("") for c in ("bank_name", "bank_short_name", "card_name", "merchant", "description")})
    filters = spark.createDataFrame([(1, ["b1"], [], None, "PIZZA"), (2, [], ["dining"], None, ""), (3, [], [], "D", "te"), (4, ["b1", "b2"], ["dining"], None, "nothing"), (5, None, None, None, None)], "filter_id long, bank_ids array<string>, categories array<string>, card_id string, search string")
    got = {r["filter_id"]: r["offers"] for r in query.match_saved(served, filters, most_searches=most).collect()}
    assert got == {1: 2, 2: 3, 3: 1, 4: 0, 5: 4}


def test_sorts_order_their_rows(spark):
    rows = spark.createDataFrame([(1, "2026-01-02", "t1", "t0"), (2, None, "t2", "t0"), (3, "2026-01-01T00:00:00.000Z", "t2", "t1"), (4, "soon", "t1", "t0")], "seq long, valid_until string, last_seen_at string, first_seen_at string")
    order = lambda key: [r["seq"] for r in rows.orderBy(*query.order(key)).collect()]
    assert order("relevance") == [1, 2, 3, 4] and order("newest") == [3, 2, 1, 4] and order("expiring-soon") == [3, 1, 2, 4]
