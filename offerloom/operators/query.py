"""Serving side of a catalog: projection, filters, search, order, pages and counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions import expiry
from offerloom.functions.text import category_label
from offerloom.schema import CATEGORIES


def serve(offers: DataFrame, cards: DataFrame, banks: DataFrame, missing: str = "fail") -> DataFrame:
    """Stored offers joined to card and bank. Dimensions have a row per card and bank; the optimizer sees their size.

    An offer without card or bank is an error of the catalog. fail: reading its bank raises it.
    quarantine: it is left out, and orphans() returns it.
    """
    c = cards.select(F.col("card_id"), F.col("bank_id"), F.col("name").alias("card_name"))
    b = banks.select(F.col("bank_id"), F.col("name").alias("bank_name"), F.col("short_name").alias("bank_short_name"), F.lit(True).alias("_bank"))
    seen, how = F.col("last_reviewed_at"), "left" if missing == "fail" else "inner"
    bank_id = F.col("bank_id")
    if missing == "fail":
        bank_id = F.when(F.col("_bank"), bank_id).otherwise(F.raise_error(F.concat(F.lit("offer without card or bank: "), F.coalesce("id", F.lit("null")))))
    return offers.drop("bank_id").join(c, "card_id", how).join(b, "bank_id", how).select(
        "id", bank_id.alias("bank_id"), "bank_name", "bank_short_name", "card_id", "card_name", "title", "category", "description", "merchant", "location", "valid_from", "valid_until",
        F.col("terms_link").alias("terms"), "source_url", seen.alias("first_seen_at"), seen.alias("last_seen_at"), seen.alias("last_checked_at"), "status",
        F.sha1(F.concat_ws("|", "id", seen)).alias("raw_source_hash"), "seq",
    )


def orphans(offers: DataFrame, cards: DataFrame, banks: DataFrame) -> DataFrame:
    """(id, card_id, seq, violation) of the offers that serve() cannot join."""
    c = cards.select("card_id", "bank_id", F.lit(True).alias("_card")).join(banks.select("bank_id", F.lit(True).alias("_bank")), "bank_id", "left").drop("bank_id")
    rows = offers.select("id", "card_id", "seq").join(c, "card_id", "left")
    what = F.when(F.col("_card").isNull(), "missing card").when(F.col("_bank").isNull(), "missing bank")
    return rows.select("id", "card_id", "seq", what.alias("violation")).where("violation is not null")


def active(served: DataFrame, as_of: Column) -> DataFrame:
    return served.where((F.col("status") == "active") & expiry.is_active(F.col("valid_until"), as_of))


def searchable() -> Column:
    """Lower-cased text that a search looks in; empty parts leave no space."""
    parts = ["title", "bank_name", "bank_short_name", "card_name", "merchant", "description", "category"]
    return F.lower(F.concat_ws(" ", *[F.nullif(F.col(p), F.lit("")) for p in parts], category_label(F.col("category"))))


def needle(value: str | None) -> str:
    return (value or "").strip().lower()


def matches(bank_ids: Sequence[str] | None = None, categories: Sequence[str] | None = None, bank_id: str | None = None, category: str | None = None, card_id: str | None = None, search: str | None = None) -> Column:
    """One condition of a filter: cheap column tests first, the substring search last.

    Sets are alternatives and beat single values; dimensions are all required; blanks filter nothing.
    """
    tests: list[Column] = []
    if bank_ids:
        tests.append(F.col("bank_id").isin([needle(b) for b in bank_ids]))
    elif needle(bank_id):
        tests.append(F.col("bank_id") == needle(bank_id))
    if categories:
        tests.append(F.col("category").isin(list(categories)))
    elif category:
        tests.append(F.col("category") == category)
    if needle(card_id):
        tests.append(F.col("card_id") == needle(card_id))
    if needle(search):
        tests.append(searchable().contains(needle(search)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def locked(filters: dict, **dimension: str) -> dict:
    """A page's own bank or category over the request's."""
    out = dict(filters)
    if "bank_id" in dimension:
        out["bank_ids"] = [dimension["bank_id"]]
    if "category" in dimension:
        out["categories"] = [dimension["category"]]
    return out


def order(key: str) -> list[Column]:
    """Sort columns of a sort key; input order (`seq`) breaks ties."""
    if key == "newest":
        return [F.desc("last_seen_at"), F.desc("first_seen_at"), F.asc("seq")]
    if key == "expiring-soon":
        return [F.asc_nulls_last(expiry.instant(F.col("valid_until"))), F.asc("seq")]
    return [F.asc("seq")]


def page_meta(rows: DataFrame, page: int, size: int) -> DataFrame:
    """One row: clamped page, totals and the indexes of its first and last row."""
    total = F.col("total_items")
    pages = F.greatest(F.lit(1), F.ceil(total / size)).cast("int")
    at = F.when(total == 0, 1).otherwise(F.least(F.greatest(F.lit(page), F.lit(1)), F.col("total_pages")))
    start = (F.col("page") - 1) * size
    return (
        rows.agg(F.count("*").alias("total_items")).withColumn("total_pages", pages).withColumn("page", at).withColumn("page_size", F.lit(size))
        .withColumn("start_index", F.when(total == 0, 0).otherwise(start + 1).cast("long"))
        .withColumn("end_index", F.least(total, start + size).cast("long"))
    )


def page_slice(rows: DataFrame, key: str, page: int, size: int, top: int = 10_000) -> DataFrame:
    """The rows of a clamped page.

    A page among the first `top` rows is a bounded top-k. For a later one, rows are dealt by ranges of the
    sort key in one pass; the sizes of the ranges tell the last page and which ranges hold the one asked for,
    and only these are sorted.
    """
    if max(1, page) * size <= top:
        first = rows.orderBy(*order(key)).offset((max(1, page) - 1) * size).limit(size).checkpoint()
        if page <= 1 or not first.isEmpty():
            return first
    spread = rows.repartitionByRange(*order(key)).withColumn("_range", F.spark_partition_id()).checkpoint()
    # a line for each range
    sizes = sorted((r["_range"], r["count"]) for r in spread.groupBy("_range").count().collect())
    total = sum(n for _, n in sizes)
    at = min(max(page, 1), max(1, -(-total // size)))
    skip, ahead, wanted, inside = (at - 1) * size, 0, [], None
    for place, n in sizes:
        if ahead < skip + size and ahead + n > skip:
            wanted.append(place)
            inside = skip - ahead if inside is None else inside
        ahead += n
    return spread.where(F.col("_range").isin(wanted)).drop("_range").orderBy(*order(key)).offset(inside or 0).limit(size)


def page_after(rows: DataFrame, key: str, last: dict, size: int) -> DataFrame:
    """The `size` rows after the row `last` (its columns last_seen_at, first_seen_at, valid_until and seq as far as the order uses them): a bounded top-k, however far on."""
    seq = F.col("seq") > last["seq"]
    if key == "newest":
        a, b = (F.lit(last[c]) for c in ("last_seen_at", "first_seen_at"))
        here = lambda c, v: F.col(c).eqNullSafe(v)
        lower = lambda c, v: F.coalesce(F.col(c) < v, F.col(c).isNull() & v.isNotNull())
        rest = lower("last_seen_at", a) | here("last_seen_at", a) & (lower("first_seen_at", b) | here("first_seen_at", b) & seq)
    elif key == "expiring-soon":
        own, v = expiry.instant(F.col("valid_until")), expiry.instant(F.lit(last["valid_until"]).cast("string"))
        rest = F.coalesce(own > v, own.isNull() & v.isNotNull()) | own.eqNullSafe(v) & seq
    else:
        rest = seq
    return rows.where(rest).orderBy(*order(key)).limit(size)


def count_by(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Offers for every value of a dimension, zeros included."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    return dimension.select(key).join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("offers"))


def category_dimension(spark) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CATEGORIES], "category string")


def totals(rows: DataFrame, condition: Column) -> DataFrame:
    """Matching and all offers, and all rounded down to hundreds, in one pass."""
    return rows.agg(F.count_if(condition).alias("matching"), F.count("*").alias("total")).withColumn("rounded", (F.floor(F.col("total") / 100) * 100).cast("long"))


def listing_json(served: DataFrame) -> DataFrame:
    """Each offer as nested JSON; null and blank fields are left out."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    seller = F.when(some("merchant").isNotNull(), F.struct(F.lit("Organization").alias("@type"), F.col("merchant").alias("name")))
    body = F.struct(
        F.lit("Offer").alias("@type"), some("title").alias("name"), some("description").alias("description"), category_label(F.col("category")).alias("category"),
        F.struct(F.lit("BankOrCreditUnion").alias("@type"), F.col("bank_name").alias("name")).alias("offeredBy"),
        some("valid_from").alias("validFrom"), some("valid_until").alias("validThrough"), seller.alias("seller"), some("last_checked_at").alias("dateModified"),
    )
    return served.select("id", F.to_json(body).alias("json"))


def url_feed(served: DataFrame, banks: DataFrame, site: str) -> DataFrame:
    """URLs of home, category index, banks, categories and offers of active status, expired or not."""
    spark = served.sparkSession
    fixed = spark.createDataFrame([(site, "daily", 1.0, None), (f"{site}/categories", "weekly", 0.8, None)], "url string, change_frequency string, priority double, last_modified string")
    none = F.lit(None).cast("string").alias("last_modified")
    row = lambda url, how, p, when=none: (url.alias("url"), F.lit(how).alias("change_frequency"), F.lit(p).alias("priority"), when)
    by_bank = banks.select(*row(F.concat(F.lit(f"{site}/banks/"), "bank_id"), "daily", 0.8))
    by_category = category_dimension(spark).select(*row(F.concat(F.lit(f"{site}/categories/"), "category"), "daily", 0.7))
    offers = served.where("status = 'active'").select(*row(F.concat(F.lit(f"{site}/offers/"), "id"), "weekly", 0.6, F.col("last_checked_at").alias("last_modified")))
    return fixed.unionByName(by_bank).unionByName(by_category).unionByName(offers)


#: Searches and their letters are broadcast up to this many; beyond, the joins are shuffled.
MOST_BROADCAST = 1_000_000


def match_saved(served: DataFrame, filters: DataFrame, most_searches: int = 200) -> DataFrame:
    """(filter_id, offers): how many offers each saved filter (bank_ids, categories, card_id, search) hits.

    Distinct selections are evaluated once. Each offer's text is tested once for each distinct
    search; these come to the offers as one list where there are at most `most_searches`, else
    through a join by each search's rarest three letters. Offers are counted by bank, category, card and search before anything
    else, and selections meet these counts through equal keys, sets exploded.
    """
    any_ = "*"
    keyed = filters.withColumn("sel", F.struct(F.array_sort(F.array_distinct("bank_ids")).alias("bank_ids"), F.array_sort(F.array_distinct("categories")).alias("categories"), F.nullif(F.lower(F.trim("card_id")), F.lit("")).alias("card_id"), F.nullif(F.lower(F.trim("search")), F.lit("")).alias("search")))
    selections = keyed.select("sel").distinct()
    one = lambda c: F.explode(F.when(F.size(f"sel.{c}") > 0, F.col(f"sel.{c}")).otherwise(F.array(F.lit(any_))))
    wide = selections.select("sel", one("bank_ids").alias("b")).select("sel", "b", one("categories").alias("c")).select("sel", "b", "c", F.coalesce("sel.card_id", F.lit(any_)).alias("k"), F.coalesce("sel.search", F.lit("")).alias("s"))
    searches = filters.select(F.nullif(F.lower(F.trim("search")), F.lit("")).alias("s")).where("s is not null").distinct()
    known = [r["s"] for r in searches.limit(most_searches + 1).collect()]
    offers = served.select("bank_id", "category", "card_id", searchable().alias("text"))
    if len(known) <= most_searches:
        hits = F.filter(F.array(*map(F.lit, known)).cast("array<string>"), lambda s: F.col("text").contains(s))
        found = offers.select("bank_id", "category", "card_id", F.explode(F.concat(F.array(F.lit("")), hits)).alias("s"))
    else:
        # a search stands only where its rarest three letters do, so offers with these meet it; one of two letters or
        # fewer stands where they do
        pieces = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.col(c).substr(i, F.lit(n))))
        asked = searches.select("s", F.explode(F.when(F.length("s") < 3, F.array("s")).otherwise(pieces("s", 3))).alias("g"))
        grams = offers.select("*", F.explode(F.array_distinct(F.concat(*[pieces("text", n) for n in (1, 2, 3)]))).alias("g"))
        small = lambda t: F.broadcast(t) if t.count() <= MOST_BROADCAST else t
        common = grams.drop("text").join(small(asked.select("g").distinct()), "g", "left_semi").groupBy("g").agg(F.count("*").alias("n"))
        rarest = asked.join(common, "g", "left").groupBy("s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).where("r.n > 0").select("s", F.col("r.g").alias("g")).checkpoint()
        at = grams.join(small(rarest), "g").where(F.expr("contains(text, s)"))
        found = offers.select("bank_id", "category", "card_id", F.lit("").alias("s")).unionByName(at.select("bank_id", "category", "card_id", "s"))
    # the eight ways to leave a dimension open
    open_ = lambda name: F.explode(F.array(F.col(name), F.lit(any_)))
    cube = found.groupBy("bank_id", "category", "card_id", "s").agg(F.count("*").alias("n"))
    cube = cube.select(open_("bank_id").alias("b"), "category", "card_id", "s", "n").select("b", open_("category").alias("c"), "card_id", "s", "n").select("b", "c", open_("card_id").alias("k"), "s", "n")
    cube = cube.groupBy("b", "c", "k", "s").agg(F.sum("n").alias("n"))
    counted = wide.join(cube, ["b", "c", "k", "s"]).groupBy("sel").agg(F.sum("n").alias("n"))
    return keyed.join(counted, "sel", "left").select("filter_id", F.coalesce("n", F.lit(0)).cast("long").alias("offers"))
