"""Raw scrape rows of every publisher to staged offers, in one select."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.text import classify, expiry_suffix, normalize_text, slug, squeeze
from offerloom.operators import publishers as P


def _ci(pattern: str) -> str:
    """Case-blind, with ASCII word edges for the JVM."""
    return "(?i)" + pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def _blank(c: Column) -> Column:
    return F.nullif(squeeze(c), F.lit(""))


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, _ci(pattern), group), F.lit(""))


def _before(c: Column, mark: str) -> Column:
    """What stands before the first mark; null without one."""
    return F.when(F.instr(c, mark) > 0, F.substring_index(c, mark, 1))


def _by_bank(cases: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for bank, value in cases.items():
        out = F.when(F.col("bank_id") == bank, value).otherwise(out)
    return out


def _mapped(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def _merchant(text: Column, summary: Column) -> Column:
    parts = lambda i: F.coalesce(F.get(F.split(text, " - "), F.lit(i)), F.lit(""))
    starts = lambda c: squeeze(c).rlike("(?i)^(?:" + P.PERCENT + r"|0%\s+interest|Equal Monthly Instalment plan|transfer outstanding balances|Cargills Bank Mastercard Credit Cardholders|golf privileges)")
    lead = F.when((F.size(F.split(text, " - ")) >= 3) & ~starts(parts(1)) & starts(parts(2)), F.concat(squeeze(parts(0)), F.lit(" - "), squeeze(parts(1)))).otherwise(parts(0))
    cut = lambda bank, c: F.regexp_extract(c, _ci("^(.*?)(?:" + "|".join(P.BOUNDARY[bank]) + "|$)"), 1)
    domain = _first(summary, r"\b(?:at|on)\s+((?:www\.)?[a-z0-9-]+\.[a-z]{2,})\b")
    explicit = _first(summary, r"^(.+?)\s+-\s+(?:Offer(?:\s+\d+)?:|Up to\b|\d|Enjoy\b)")
    explicit = _blank(F.regexp_replace(F.when(~explicit.rlike("(?i)^offer$"), explicit), r"[;|]+$", ""))
    at = _first(summary, r"\bat\s+([a-z0-9&'.(),/ -]+?)(?:\s+(?:exclusively|when|for|with|during)\b|;|\s+-\s+|$)")
    at = _blank(F.regexp_replace(at, r"(?i)\s+and$", ""))
    ndb = cut("ndb", summary)
    zero = F.substring_index(F.expr("substr(_text, 6)"), " - ", 1)
    return _by_bank({
        "boc": _blank(_before(text, " - ")), "dfcc": _blank(_before(text, " - ")), "pan-asia-bank": _blank(_before(summary, " - ")),
        "cargills-bank": _blank(F.regexp_replace(lead, r"(?i)\s*\((?:https?://|www\.)[^)]+\)", "")),
        "ndb": F.when(ndb != summary, _blank(ndb)).otherwise(_blank(_before(summary, " - "))),
        "ntb": _blank(_before(text, ":")),
        "peoples-bank": F.when(F.col("category") == "Installments", _blank(_first(text, r"^(.+?) installment plan\b"))).otherwise(_blank(cut("peoples-bank", text))),
        "sampath": F.when(summary.rlike(_ci(r"^(?:exclusive offers?|exlusice offers?)\b")), domain).otherwise(F.coalesce(explicit, domain, at)),
        "seylan": _blank(F.coalesce(_before(text, " - "), text)),
        "union-bank": F.when(text.startswith("0% - "), _blank(zero)).otherwise(_blank(cut("union-bank", text))),
    })


def _category(text: Column, merchant: Column) -> Column:
    asked = classify(text)
    asked = F.when((F.col("bank_id") == "boc") & merchant.rlike(_ci(r"\bbeach\b")), "travel").otherwise(asked)
    table = _by_bank({bank: _mapped(F.col("category"), rules) for bank, rules in P.CATEGORY.items()})
    out = F.coalesce(table, asked)
    for bank, raw, pattern, category in reversed(P.CATEGORY_TEXT):
        hit = (F.col("bank_id") == bank) & text.rlike(_ci(pattern))
        out = F.when(hit & F.col("category").isin(raw) if raw else hit, category).otherwise(out)
    return out


def _segments(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1), "/"), lambda s: s != "")


def normalize_scrapes(rows: DataFrame, review_date: str) -> DataFrame:
    """Staged offers (id, bank_id, card_id, title, ..., seq) of the rows that have not lapsed by review_date.

    rows (bank_id, category, offer_amount_percent, offer_about, expiry_date, source_url, seq).
    Lapsed and skipped rows go before any text work. Publishers without rules give no offers.
    """
    if not re.match(r"\d{4}-\d{2}-\d{2}T", review_date):
        raise ValueError(f"review date must be an ISO timestamp: {review_date}")
    day = review_date[:10]
    rows = rows.where(F.col("bank_id").isin(list(P.CARD)) & (F.col("expiry_date").isNull() | (F.col("expiry_date") >= day)) & ~F.col("source_url").isin(P.SKIPPED_URLS))
    rows = rows.withColumn("_text", normalize_text(F.col("offer_about")))
    text, url, bank = F.col("_text"), F.col("source_url"), F.col("bank_id")
    summary = F.coalesce(_by_bank({
        "ndb": squeeze(F.regexp_replace(F.substring_index(text, "Category:", 1), r"\.*$", "")),
        "ntb": squeeze(F.substring_index(text, ";", 1)), "pan-asia-bank": squeeze(F.substring_index(text, ";", 1)),
        "sampath": squeeze(F.regexp_replace(F.substring_index(text, " - Eligible cards:", 1), r"[;|]+$", "")),
    }), text)
    rows = rows.withColumn("_summary", summary)
    rows = rows.withColumn("_merchant", _merchant(text, F.col("_summary")))
    summary, merchant = F.col("_summary"), F.col("_merchant")
    rows = rows.withColumn("_category", _category(text, merchant))

    eligible = F.coalesce(_first(text, r"Eligible cards:\s*([^.]*)\."), text)
    cards = F.lower(squeeze(F.coalesce(_first(text, r"Eligible cards:\s*(.+?)(?:\s+-\s+Validity text:|$)"), F.lit(""))))
    premium = (
        F.when(bank == "ndb", eligible.rlike(_ci(P.NDB_PREMIUM))).when(bank == "ntb", (url == P.NTB_PRIVATE_URL) | F.col("offer_about").rlike("(?i)private banking"))
        .when(bank == "sampath", cards.rlike(P.SAMPATH_PREMIUM) & ~cards.rlike(P.SAMPATH_STANDARD)).otherwise(False)
    )
    card = F.when(premium, _mapped(bank, P.PREMIUM)).otherwise(_mapped(bank, P.CARD))

    suffix, seg = expiry_suffix(F.col("expiry_date")), _segments(url)
    last = F.coalesce(F.try_element_at(seg, F.lit(-1)), F.lit("offer"))
    boc = F.coalesce(F.try_element_at(seg, F.lit(-2)), F.lit("offer"))
    fragment = F.regexp_extract(url, "#(.*)$", 1)
    cleaned = last
    for pattern, to in ((r"(?i)-(?:credit|debit)$", ""), ("(?i)^www-", ""), ("(?i)-(?:com|lk)-", "-"), ("(?i)-(?:com|lk)$", ""), ("-{2,}", "-"), ("^-+|-+$", "")):
        cleaned = F.regexp_replace(cleaned, pattern, to)
    peoples = F.when(squeeze(fragment) != "", F.concat(slug(fragment), F.lit("-installments"))).otherwise(cleaned)
    number = lambda path: F.coalesce(F.concat(F.lit("-"), _first(url, path + r"/(\d+)/?$")), F.lit(""))
    short = lambda c: F.coalesce(F.nullif(F.substring(slug(c), 1, 48), F.lit("")), F.lit("offer"))
    offered = F.regexp_replace(F.regexp_replace(summary, r"(?i)^offer\s+-\s*", ""), r"(?i)^exclusive offers?\s+for\s+[^-]+-\s*", "")
    url_tail = F.coalesce(F.try_element_at(F.filter(F.split(url, "/"), lambda s: s != ""), F.lit(-1)), url)
    ntb = F.concat(F.when(premium, "ntb-private-banking").otherwise("ntb"), F.lit("-"), short(F.coalesce(merchant, summary)), F.lit("-"), F.substring(F.sha1(F.concat_ws("|", url, summary, F.coalesce("expiry_date", F.lit("open")))), 1, 8))
    named = F.coalesce(merchant, url)
    subject = _by_bank({
        "boc": boc, "dfcc": last, "cargills-bank": slug(named), "union-bank": slug(named), "pan-asia-bank": slug(F.coalesce(merchant, summary)),
        "seylan": slug(url_tail), "peoples-bank": peoples,
        "ndb": F.concat(short(F.coalesce(merchant, summary)), number("/offer-details")), "sampath": F.concat(short(F.coalesce(merchant, offered)), number("/credit-card-offer")),
    })
    legacy = _mapped(F.when(bank == "ntb", F.concat(url, F.lit("|"), F.coalesce(merchant, summary))).otherwise(url), P.LEGACY_ID)
    legacy = F.when(bank.isin("boc", "ndb", "ntb", "peoples-bank"), legacy)
    rows = rows.withColumn("_id", F.coalesce(legacy, F.when(bank == "ntb", ntb), F.concat(bank, F.lit("-"), subject, suffix)))

    percent = F.regexp_replace(F.col("offer_amount_percent").cast("string"), r"\.0$", "")
    up_to = lambda c: F.when(c.rlike(_ci(r"\bup to\b")), "Up to ").otherwise("")
    about = F.col("offer_about")
    off = lambda c, between=" ": F.when(merchant.isNotNull() & percent.isNotNull(), F.concat(up_to(c), percent, F.lit(f"% off{between}at "), merchant))
    plans = lambda other: F.when(F.col("_category") == "installment", F.concat(F.coalesce(merchant, other), F.lit(" installment plans")))
    spaced = lambda c: squeeze(F.replace(c, F.lit("-"), F.lit(" ")))
    cash = lambda other: F.when((F.col("_category") == "cashback") & percent.isNotNull(), F.when(text.rlike(_ci(r"\bfuel\b")), F.concat(percent, F.lit("% cashback on fuel transactions"))).otherwise(F.concat(percent, F.lit("% cashback with "), F.coalesce(merchant, F.lit(other)))))
    when = lambda pattern, c, value: F.when(merchant.isNotNull() & c.rlike(_ci(pattern)), value)
    title = F.coalesce(_mapped(F.when(bank.isin("ndb", "ntb"), F.col("_id")), P.LEGACY_TITLE), _by_bank({
        "boc": F.coalesce(plans(spaced(boc)), off(about), when(r"\bbonus month\b", about, F.concat(merchant, F.lit(" bonus month offer"))), merchant, spaced(boc)),
        "cargills-bank": F.coalesce(plans(F.lit("Cargills Bank")), F.when(text.rlike(_ci(r"\b(?:0%\s*)?instal(?:l)?ment|emi plan\b")), off(text, " and installment plans ")), off(text), merchant, text),
        "dfcc": F.coalesce(plans(spaced(last)), off(about), merchant, spaced(last)),
        "ndb": summary,
        "ntb": F.coalesce(off(summary), when("companion dining offer", summary, F.concat(F.lit("Companion dining offer at "), merchant)), when("installment", summary, F.concat(F.lit("Installment plans at "), merchant)), summary),
        "pan-asia-bank": F.coalesce(off(summary), when(r"\binstallment|instalment\b", summary, F.concat(merchant, F.lit(" installment plans"))), merchant, summary),
        "peoples-bank": F.when(F.col("category") == "Installments", F.concat(F.coalesce(merchant, F.lit("Installment")), F.lit(" installment plans"))).otherwise(F.coalesce(off(about), merchant, spaced(peoples))),
        "sampath": squeeze(F.regexp_replace(summary, r"(?i)^Offer\s+-\s*", "")),
        "seylan": F.coalesce(plans(F.lit("Seylan Bank")), cash("Seylan Credit Cards"), off(text), merchant, text),
        "union-bank": F.coalesce(plans(F.lit("Union Bank")), cash("Union Bank Credit Cards"), off(text), merchant, text),
    }))
    none = F.lit(None).cast("string")
    return rows.select(
        F.col("_id").alias("id"), "bank_id", card.alias("card_id"), title.alias("title"), F.col("_category").alias("category"), text.alias("description"), merchant.alias("merchant"),
        none.alias("location"), none.alias("valid_from"), F.col("expiry_date").alias("valid_until"), url.alias("terms_link"), "source_url", F.lit(review_date).alias("last_reviewed_at"), F.lit("active").alias("status"), "seq",
    )
