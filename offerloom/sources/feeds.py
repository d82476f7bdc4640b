"""JSON promotion feeds and extracted offers as tables of response texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom import schema
from offerloom.functions.text import classify, epoch_date, normalize_text, stable_id
from offerloom.operators.maintain import dedupe_last

# Feed B's category tabs that have a category of ours.
FEED_B_CATEGORIES = {"dining": "dining", "hotels": "travel", "travel_and_leisure": "travel", "super_markets": "supermarket", "online": "online", "fuel": "fuel"}


def envelope(feeds: DataFrame) -> DataFrame:
    """(feed_id, rows, total, problem) of response texts (feed_id, body)."""
    parsed = F.from_json("body", "data string, total string")
    good = F.from_json("body", "data array<string>, total string")
    rows, total = F.size("good.data"), F.col("p.total").try_cast("double")
    body = F.coalesce(F.trim("body"), F.lit(""))
    problem = (
        F.when(body == "", "empty").when(F.expr("try_parse_json(body) is null"), "not json").when(F.col("good.data").isNull(), "no data")
        .when((rows == 0) & (total > 0), "inconsistent").when(total > rows, "truncated")
    )
    return feeds.withColumns({"p": parsed, "good": good}).select("feed_id", F.when(F.col("good.data").isNotNull(), rows).alias("rows"), total.alias("total"), problem.alias("problem"))


def _rows(feeds: DataFrame, kind: str) -> DataFrame:
    return feeds.select("feed_id", F.posexplode(F.from_json("body", kind)["data"]).alias("pos", "r")).select(F.struct("feed_id", "pos").alias("seq"), "r.*")


def _text(c: str) -> Column:
    return normalize_text(F.coalesce(c, F.lit("")))


def _plain(c: str) -> Column:
    """Text of an HTML fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "(?s)<(script|style)[^>]*>.*?</\\1>", ""), "<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return normalize_text(bare)


def map_feed_a(feeds: DataFrame, bank: str, card: str, debit_card: str, reviewed: str, site: str) -> DataFrame:
    """Offers of feed A: rows with an id and a title; debit promotions go to the debit card."""
    rows = _rows(feeds, schema.FEED_A).where(F.trim("id") != "").withColumn("t", _text("title")).where("t <> ''")
    url = F.concat(F.lit(f"{site}/search/"), "id")
    out = rows.select(
        F.concat(F.lit(f"{bank}-"), "id").alias("id"), F.lit(bank).alias("bank_id"), F.when(F.lower(F.trim("cardType")) == "debit", debit_card).otherwise(card).alias("card_id"),
        F.col("t").alias("title"), classify(F.col("t")).alias("category"), F.col("t").alias("description"), F.nullif(_text("merchant"), F.lit("")).alias("merchant"),
        F.nullif(F.regexp_extract(F.coalesce("valid", F.lit("")), r"Valid From (\d{4}-\d{2}-\d{2})", 1), F.lit("")).alias("valid_from"),
        F.when(F.col("to").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("to")).alias("valid_until"), url.alias("terms_link"), url.alias("source_url"), F.lit(reviewed).alias("last_reviewed_at"), F.lit("active").alias("status"), "seq",
    )
    return dedupe_last(out)


def map_feed_b(feeds: DataFrame, bank: str, card: str, reviewed: str, page: str) -> DataFrame:
    """Offers of feed B: enabled rows with an id; category from the discount's words, else the tab."""
    rows = _rows(feeds, schema.FEED_B).where(F.coalesce("enable", F.lit(True)) & ~F.coalesce("delete_status", F.lit(False)) & F.col("id").isNotNull())
    rows = rows.withColumns({"m": _text("company_name"), "d": _text("short_discount")})
    rows = rows.withColumn("text", F.coalesce(F.nullif(_plain("description"), F.lit("")), F.nullif(_plain("short_description"), F.lit("")), F.col("d")))
    title = F.when((F.col("d") != "") & (F.col("m") != ""), F.concat("d", F.lit(" at "), "m")).otherwise(F.coalesce(F.nullif(F.col("m"), F.lit("")), F.nullif(F.col("d"), F.lit("")), F.substring("text", 1, 80)))
    tabs = F.create_map(*[F.lit(x) for kv in FEED_B_CATEGORIES.items() for x in kv])
    category = (
        F.when(F.col("d").rlike(r"(?i)instal+ment|0%\s*(interest|p\.?\s?a)"), "installment").when(F.col("d").rlike(r"(?i)cash\s?back"), "cashback")
        .otherwise(F.coalesce(F.try_element_at(tabs, F.lower(F.trim(F.coalesce("category", F.lit(""))))), F.lit("other")))
    )
    out = rows.withColumn("t", title).where("t <> ''").select(
        F.concat(F.lit(f"{bank}-"), "id").alias("id"), F.lit(bank).alias("bank_id"), F.lit(card).alias("card_id"), F.col("t").alias("title"), category.alias("category"), F.col("text").alias("description"),
        F.nullif(F.col("m"), F.lit("")).alias("merchant"), F.nullif(_text("city"), F.lit("")).alias("location"), epoch_date(F.col("display_on")).alias("valid_from"), epoch_date(F.col("expire_on")).alias("valid_until"),
        F.lit(page).alias("terms_link"), F.coalesce(F.concat(F.lit(f"{page}?firstTab="), "category"), F.lit(page)).alias("source_url"), F.lit(reviewed).alias("last_reviewed_at"), F.lit("active").alias("status"), "seq",
    )
    return dedupe_last(out)


def map_feeds(feeds: DataFrame, mappers: dict[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(offers, unmapped) of response texts (bank_id, feed_id, body): the registry's mapper of each bank, and the feeds of other banks, for an extractor."""
    offers = None
    for bank, mapper in mappers.items():
        found = mapper(feeds.where(F.col("bank_id") == bank).select("feed_id", "body"))
        offers = found if offers is None else offers.unionByName(found, allowMissingColumns=True)
    return offers, feeds.where(~F.coalesce(F.col("bank_id").isin(list(mappers)), F.lit(False)))


def conform_extracted(responses: DataFrame, reviewed: str) -> DataFrame:
    """Offers of extracted JSON (seq, bank_id, card_id, source_url, body): titled rows, known categories, blanks as null."""
    rows = responses.select("bank_id", "card_id", F.col("source_url").alias("page"), "seq", F.posexplode(F.from_json("body", f"offers {schema.EXTRACTED}")["offers"]).alias("pos", "r"))
    some = lambda c: F.nullif(normalize_text(F.col(f"r.{c}")), F.lit(""))
    rows = rows.withColumns({"title": normalize_text(F.coalesce("r.title", F.lit(""))), "link": F.coalesce(some("sourceUrl"), "page")}).where("title <> ''")
    out = rows.select(
        stable_id(F.col("bank_id"), F.col("title"), F.col("link")).alias("id"), "bank_id", "card_id", "title",
        F.when(F.col("r.category").isin(list(schema.CATEGORIES)), F.col("r.category")).otherwise("other").alias("category"), normalize_text(F.coalesce("r.description", F.lit(""))).alias("description"),
        some("merchant").alias("merchant"), some("validFrom").alias("valid_from"), some("validUntil").alias("valid_until"), F.coalesce(some("termsLink"), "link").alias("terms_link"), F.col("link").alias("source_url"),
        F.lit(reviewed).alias("last_reviewed_at"), F.lit("active").alias("status"), F.struct(F.col("seq").alias("feed_id"), "pos").alias("seq"),
    )
    return dedupe_last(out)
