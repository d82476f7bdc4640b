"""Catalog upkeep: checks, dedupe, merges, batch replacement, pruning and gates."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.functions import expiry
from offerloom.functions.text import dedupe_key, url_without_fragment
from offerloom.llm.common import written
from offerloom.operators import ordered
from offerloom.schema import CATEGORIES

BASELINE, FLOOR = 10, 3
#: Cards are broadcast up to this many (some 100 bytes each); beyond, the joins are shuffled.
MOST_BROADCAST = 500_000


def small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def offer_violations(offers: DataFrame) -> DataFrame:
    """(seq, violation) of rows that break the declared shape of an offer."""
    required = ["id", "card_id", "title", "category", "description", "terms_link", "source_url", "last_reviewed_at", "status"]
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]), lambda x: x.isNotNull())
    bad = F.when(~F.col("category").isin(list(CATEGORIES)), F.array(F.lit("unknown category"))).otherwise(F.array().cast("array<string>"))
    return offers.select("seq", F.explode(F.concat(missing, bad)).alias("violation"))


def scrape_violations(rows: DataFrame) -> DataFrame:
    required = ["bank_id", "category", "offer_about", "source_url"]
    return rows.select("seq", F.explode(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]), lambda x: x.isNotNull())).alias("violation"))


def _shape(rows: DataFrame, key: str, required: list[str]) -> DataFrame:
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]), lambda x: x.isNotNull())
    return rows.select(F.col(key).alias("key"), F.explode(missing).alias("violation"))


def bank_violations(banks: DataFrame) -> DataFrame:
    """(key, violation) of bank entries that lack a declared field, or share an id."""
    twice = banks.groupBy("bank_id").count().where("count > 1").select(F.col("bank_id").alias("key"), F.lit("repeated bank_id").alias("violation"))
    return _shape(banks, "bank_id", ["bank_id", "name", "short_name", "website_url"]).unionByName(twice)


def card_violations(cards: DataFrame, banks: DataFrame) -> DataFrame:
    """The same for card entries, and cards whose bank is unknown."""
    twice = cards.groupBy("card_id").count().where("count > 1").select(F.col("card_id").alias("key"), F.lit("repeated card_id").alias("violation"))
    lost = cards.join(banks.select("bank_id"), "bank_id", "left_anti").select(F.col("card_id").alias("key"), F.lit("unknown bank").alias("violation"))
    return _shape(cards, "card_id", ["card_id", "bank_id", "name"]).unionByName(twice).unionByName(lost)


def scan_violations(scanned: DataFrame, cards: DataFrame, banks: DataFrame) -> DataFrame:
    """(id, seq, violation): missing bank, missing card, or a card of another bank."""
    b = banks.select(F.col("bank_id"), F.lit(True).alias("has_bank"))
    c = cards.select("card_id", F.col("bank_id").alias("card_bank"), F.lit(True).alias("has_card"))
    what = F.when(F.col("has_bank").isNull(), "missing bank").when(F.col("has_card").isNull(), "missing card").when(F.col("card_bank") != F.col("bank_id"), "bank and card differ")
    return scanned.join(b, "bank_id", "left").join(c, "card_id", "left").select("id", "seq", what.alias("violation")).where("violation is not null")


def dedupe_first(rows: DataFrame, key: str = "id") -> DataFrame:
    """The first row of each id. Rows that cannot be first go before the shuffle, and so do columns that nobody reads later."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last("seq")))
    return rows.withColumn("_first", place).where("_first = 1").drop("_first")


def dedupe_last(rows: DataFrame, key: str = "id") -> DataFrame:
    """The last values of each id at the place of its first row."""
    rest = [c for c in rows.columns if c != "seq"]
    # a column each, so that those that nobody reads are left out
    last = [F.max_by(c, "seq").alias(c) for c in rest if c != key]
    return rows.groupBy(key).agg(*last, F.min("seq").alias("seq")).select(*rest, "seq")


def dedupe_semantic(rows: DataFrame) -> DataFrame:
    """First by id, then of rows with one card, anchor (merchant, else title) and description the richer.

    Rows meet in order: a later one wins if it has more of four optional fields, a longer
    description counting one more. That is no total order, so it is a fold over each group in
    order of `seq` (and id, where a seq repeats). It needs only score and length, and splits a large group over
    tasks (see ordered.winners): these few numbers are shuffled and sorted, and the winner's row is joined back by id.
    """
    anchor = F.coalesce(F.nullif(dedupe_key(F.col("merchant")), F.lit("")), dedupe_key(F.col("title")))
    keyed = rows.withColumns({"_a": anchor, "_d": dedupe_key(F.col("description"))})
    score = sum((F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0) for c in ("valid_until", "valid_from", "location", "terms_link")), F.lit(0))
    open_ = (F.col("_a") == "") & (F.col("_d") == "")
    # the first 128 bits of a digest
    group = F.substring(F.unhex(F.sha2(F.concat_ws("|", F.coalesce("card_id", F.lit("?")), "_a", "_d"), 256)), 1, 16)
    marked = keyed.select(F.when(~open_, group).alias("g"), F.col("seq").cast("long").alias("seq"), "id", score.alias("s"), F.length(F.coalesce("description", F.lit(""))).alias("n"))
    won = ordered.winners(ordered.ranged(dedupe_first(marked).where("g is not null"), ["g"], ["seq", "id"], keep=False)).withColumnRenamed("id", "_id")
    first = dedupe_first(keyed.withColumn("_open", open_)).drop("_a", "_d")
    rest = [c for c in rows.columns if c != "seq"]
    # a plain equality, so that the rows, which are dealt by id, are not dealt again
    every = first.join(won.where("_id is not null"), F.col("id") == F.col("_id"), "left").where("_open or _id is not null").select(*rest, F.when(F.col("_open"), F.col("seq")).otherwise(F.col("place")).alias("seq"))
    unnamed = won.where("_id is null")
    if not unnamed.isEmpty():
        every = every.unionByName(first.where("id is null and not _open").crossJoin(unnamed).select(*rest, F.col("place").alias("seq")))
    return every


def sync_scanned(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """Stored offers whose id and URL are not scanned, then the scanned ones."""
    ids = scanned.select("id").distinct()
    # many offers share a URL, which is parsed once; a plain distinct would be merged with the outer one, and all rows parsed
    urls = scanned.groupBy("source_url").count().select(F.when(F.col("count") > 0, url_without_fragment(F.col("source_url"))).alias("_u")).distinct()
    kept = stored.join(ids, "id", "left_anti").withColumn("_u", url_without_fragment(F.col("source_url"))).join(urls, "_u", "left_anti").drop("_u")
    return kept.withColumn("part", F.lit(0)).unionByName(scanned.select(*stored.columns, F.lit(1).alias("part")))


def merge_lifecycle(existing: DataFrame, incoming: DataFrame, now: str | None = None, now_col: str | None = None) -> DataFrame:
    """Stored offers after a batch: matched ones updated, missing ones inactive, new ones added.

    A matched offer keeps first_seen_at; validity and image take the fresh value even if it is
    null, other optional fields only where the fresh row has one. Expired stays expired. Of
    incoming rows with one id the last counts, at the first one's place. A second stored row of
    a matched id goes inactive. Order: (part, seq). With now_col, both tables carry the batch's time
    in a column of that name, which may differ between rows without a common id; it is left out of the result.
    """
    # plain columns: those of a struct would all go through the join
    of = lambda side, c: F.col(f"_{side}_{c}")
    now = F.lit(now) if now_col is None else F.coalesce(of("new", now_col), of("old", now_col))
    at = now.cast("timestamp")
    fresh = dedupe_last(incoming).select(*[F.col(c).alias(f"_new_{c}") for c in incoming.columns], F.col("id").alias("nid"))
    old = existing.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).select(*[F.col(c).alias(f"_old_{c}") for c in existing.columns], F.col("id").alias("oid"), "_k")
    both = old.join(fresh, (F.col("oid") == F.col("nid")) & (F.col("_k") == 1), "full_outer")
    hit, new = F.col("oid").isNotNull() & F.col("nid").isNotNull(), F.col("oid").isNull()
    status = F.when(F.col("nid").isNull(), F.when(of("old", "status") == "expired", "expired").otherwise("inactive")).otherwise(F.when(expiry.is_expired(of("new", "valid_until"), at), "expired").otherwise("active"))
    value = lambda c: F.when(new, of("new", c)).when(~hit, of("old", c))
    own = {"valid_until": of("new", "valid_until"), "first_seen_at": of("old", "first_seen_at"), "seq": of("old", "seq")}
    cols = []
    for c in [c for c in existing.columns if c != now_col]:
        if c == "status":
            cols.append(status.alias(c))
        elif c in ("last_seen_at", "last_checked_at"):
            cols.append(F.when(F.col("nid").isNotNull() | F.lit(c == "last_checked_at"), now).otherwise(of("old", c)).alias(c))
        elif c == "first_seen_at":
            cols.append(F.when(new, now).otherwise(of("old", "first_seen_at")).alias(c))
        else:
            cols.append(value(c).otherwise(own.get(c, F.coalesce(of("new", c), of("old", c)))).alias(c))
    return both.select(*cols, F.when(new, 1).otherwise(0).alias("part"))


def import_bank(stored: DataFrame, staging: DataFrame, batch: DataFrame, registry_cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored, staging) after replacing the offers of every bank in the batch, for all banks at once.

    registry_cards (card_id, bank_id): stored offers of these banks' cards go, then staging is synced.
    The batch is read for its banks once; stored offers are shuffled by card only where the cards are too many for a broadcast.
    """
    banks = written(batch.select("bank_id").distinct())
    staged = staging.join(banks, "bank_id", "left_anti").withColumn("part", F.lit(0)).unionByName(batch.select(*staging.columns, F.lit(1).alias("part")))
    cards = small(registry_cards.join(banks, "bank_id", "left_semi").select("card_id").distinct())
    return sync_scanned(stored.join(cards, "card_id", "left_anti"), staged.drop("part")), staged


def append_missing(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """rows, then those of more whose key they lack."""
    return rows.unionByName(more.join(rows.select(key).distinct(), key, "left_anti").select(*rows.columns))


def remove_banks(stored: DataFrame, staging: DataFrame, banks: DataFrame, cards: DataFrame, retired: DataFrame) -> dict[str, DataFrame]:
    """All four tables without the retired banks, their cards and their offers."""
    gone = cards.join(retired, "bank_id", "left_semi").select("card_id").distinct()
    return {"stored": stored.join(gone, "card_id", "left_anti"), "staging": staging.join(retired, "bank_id", "left_anti"), "banks": banks.join(retired, "bank_id", "left_anti"), "cards": cards.join(retired, "bank_id", "left_anti")}


def expire_lapsed(stored: DataFrame, staging: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables without lapsed offers, and one row of counts."""
    ok = expiry.is_active(F.col("valid_until"), as_of)
    count = lambda t, name: t.agg(F.count_if(~ok).alias(f"{name}_dropped"), F.count_if(ok).alias(f"{name}_kept"))
    return stored.where(ok), staging.where(ok), count(stored, "stored").join(count(staging, "staging"))


def reconcile_orphans(stored: DataFrame, cards: DataFrame, valid: DataFrame) -> DataFrame:
    """Stored offers of valid banks; those of unknown cards stay."""
    gone = cards.join(valid, "bank_id", "left_anti").select("card_id").distinct()
    return stored.join(gone, "card_id", "left_anti")


def bank_offer_count(stored: DataFrame, cards: DataFrame, registry_cards: DataFrame) -> DataFrame:
    """(bank_id, offers): stored offers over a bank's registry cards and stored cards together."""
    every = cards.select("bank_id", "card_id").unionByName(registry_cards.select("bank_id", "card_id")).distinct()
    n = stored.groupBy("card_id").agg(F.count("*").alias("n"))
    return every.join(n, "card_id", "left").groupBy("bank_id").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("offers"))


def collapse_gate(stored_counts: DataFrame, batch: DataFrame, override: list[str]) -> DataFrame:
    """(bank_id, stored, fresh, rejected): an established bank whose fresh set shrank to almost nothing."""
    fresh = dedupe_semantic(batch).groupBy("bank_id").agg(F.count("*").alias("fresh"))
    joined = stored_counts.withColumnRenamed("offers", "stored").join(fresh, "bank_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    return joined.withColumn("rejected", (F.col("stored") >= BASELINE) & (F.col("fresh") <= FLOOR) & ~F.col("bank_id").isin(override))


def content_hash(sources: DataFrame, assets: DataFrame) -> DataFrame:
    """(bank_id, hash) of source hashes in their order (ord), then asset URLs in theirs, joined by bars.

    A bank's texts stream in order through one task that holds the digest so far; a digest of one
    sequence has no parts that could be made apart. Banks without sources have none.
    """
    texts = sources.select("bank_id", F.lit(0).alias("part"), F.col("ord").cast("long").alias("ord"), F.coalesce("hash", F.lit("")).alias("text"))
    texts = texts.unionByName(assets.select("bank_id", F.lit(1).alias("part"), F.lit(None).cast("long").alias("ord"), F.col("url").alias("text")))

    def digest(batches):
        bank, so_far, told = None, None, False

        def done():
            return pa.RecordBatch.from_arrays([pa.array([bank], pa.string()), pa.array([so_far.hexdigest()])], ["bank_id", "hash"])

        for batch in batches:
            for b, part, text in zip(*(c.to_pylist() for c in batch.columns)):
                if so_far is None or b != bank:
                    if told:
                        yield done()
                    bank, so_far, told = b, hashlib.sha1(), part == 0
                    so_far.update(text.encode())
                else:
                    so_far.update(b"|" + text.encode())
        if told:
            yield done()

    ordered_ = texts.where("text is not null").repartition("bank_id").sortWithinPartitions("bank_id", "part", "ord", "text")
    return ordered_.select("bank_id", "part", "text").mapInArrow(digest, "bank_id string, hash string")


def hash_gate(discovered: DataFrame, state: DataFrame, prior: DataFrame, budget: int) -> DataFrame:
    """A decision for each discovered URL of each bank.

    discovered (bank_id, url_key, pos, fetched, has_content, hash, extracts): what the page gave and
    whether extraction would succeed. state (bank_id, url_key, hash); prior (bank_id, url_key).
    Changed pages are tried in order while fewer than `budget` before them have succeeded; how many
    that are is summed over ranges of a bank's places first, so that a large bank is many tasks.
    """
    held = prior.groupBy("bank_id", "url_key").agg(F.count("*").alias("prior"))
    rows = discovered.join(state.withColumnRenamed("hash", "old_hash"), ["bank_id", "url_key"], "left").join(held, ["bank_id", "url_key"], "left").withColumn("prior", F.coalesce("prior", F.lit(0)))
    same = (F.col("old_hash") == F.col("hash")) & (F.col("prior") > 0)
    rows = rows.withColumn("gate", F.when(~F.col("fetched"), "fetch-failed").when(~F.col("has_content"), "no-content").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed"))
    tried = (F.col("gate") == "changed").cast("int") * F.col("extracts").cast("int")
    rows = ordered.before(ordered.ranged(rows, ["bank_id"], ["pos"]), ["bank_id"], tried, "before")
    decision = F.when(F.col("gate") != "changed", F.col("gate")).when(F.col("before") >= budget, "over-budget").when(F.col("extracts"), "extracted").otherwise("extract-failed")
    rows = rows.withColumn("decision", decision)
    keeps = ~F.col("decision").isin("unchanged", "extracted")
    next_hash = F.when(keeps, F.when(F.col("prior") > 0, F.col("old_hash"))).otherwise(F.col("hash"))
    reused = F.when(F.col("decision") == "extracted", 0).otherwise(F.col("prior"))
    return rows.select("bank_id", "url_key", "pos", "decision", reused.alias("reused"), next_hash.alias("next_hash"))


def bank_status(rows: DataFrame) -> DataFrame:
    """(bank_id, status): the first rule that holds, over one row of facts per bank."""
    f = F.col
    crawl = (
        F.when(~f("has_extractor"), "deferred").when(~f("discovered"), "fetch-failed").when(f("active_offers") == 0, "extract-failed")
        .when(f("rejected"), "sanity-rejected").otherwise("updated")
    )
    listing = (
        F.when(f("fetched_sources") == 0, "fetch-failed").when(f("thin_sources") > 0, "skipped-empty").when(f("same_hash"), "unchanged")
        .when(~f("has_mapper") & (~f("has_extractor") | f("over_budget")), "deferred").when(f("active_offers") == 0, "extract-failed")
        .when(f("rejected"), "sanity-rejected").otherwise("updated")
    )
    return rows.select("bank_id", F.when(~f("enabled"), "disabled").when(f("crawl"), crawl).otherwise(listing).alias("status"))


def refresh_summary(report: DataFrame) -> DataFrame:
    """(status, banks, failed, tokens_in, tokens_out, written) of a run's report rows."""
    failed = F.col("status").isin("fetch-failed", "extract-failed", "sanity-rejected")
    return report.groupBy("status").agg(F.count("*").alias("banks"), F.count_if(failed).alias("failed"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.coalesce(F.sum("offers_written"), F.lit(0)).alias("written"))


def refresh_sweep(stored: DataFrame, cards: DataFrame, valid: DataFrame, as_of: Column) -> DataFrame:
    """End of a run: orphans pruned, then lapsed offers dropped."""
    return reconcile_orphans(stored, cards, valid).where(expiry.is_active(F.col("valid_until"), as_of))


def gated_offers(decisions: DataFrame, prior: DataFrame, extracted: DataFrame, reviewed: str) -> DataFrame:
    """Offers of a hash-gated run: kept and reused rows of prior, and the extracted ones.

    prior has (bank_id, url_key) beside its offer columns, extracted the same plus page_url, which
    becomes the source. Reused rows of unchanged pages take the review date. URLs without a
    decision drop out. The last row of an id counts, at the first one's place.
    """
    key = ["bank_id", "url_key"]
    kept = prior.join(decisions.where("decision <> 'extracted'").select(*key, "decision", "pos"), key)
    kept = kept.withColumn("last_reviewed_at", F.when(F.col("decision") == "unchanged", reviewed).otherwise(F.col("last_reviewed_at")))
    fresh = extracted.join(decisions.where("decision = 'extracted'").select(*key, "decision", "pos"), key).withColumn("source_url", F.col("page_url")).drop("page_url")
    rows = kept.unionByName(fresh).withColumn("seq", F.struct("pos", "seq"))
    return dedupe_last(rows.drop("decision", "pos", "url_key"))


def run_summary(banks: DataFrame) -> DataFrame:
    """One row of a run over banks (bank_id, found, saved, reason): totals and the failures."""
    failure = F.when(F.col("reason").isNotNull(), F.struct("bank_id", "reason"))
    return banks.agg(F.count("*").alias("banks_checked"), F.sum("found").alias("offers_found"), F.sum("saved").alias("offers_saved"), F.array_sort(F.collect_list(failure)).alias("failures"))
