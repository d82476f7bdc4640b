"""Declared schemas of the catalog's tables and the fixed value sets they use."""

from pyspark.sql import types as T

# Category ids in display order, with labels.
CATEGORY_LABELS = {
    "dining": "Dining", "fuel": "Fuel", "supermarket": "Supermarket", "travel": "Travel", "online": "Online",
    "installment": "Installment", "cashback": "Cashback", "bogo": "BOGO", "other": "Other",
}
CATEGORIES = tuple(CATEGORY_LABELS)
SORT_KEYS = ("relevance", "newest", "expiring-soon")
PAGE_SIZES = (12, 24, 48)
STATUSES = ("active", "inactive", "expired", "needs_review")


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


BANK = T.StructType(_strings("bank_id", "name", "short_name", "website_url") + [T.StructField("seq", T.LongType())])
CARD = T.StructType(_strings("card_id", "bank_id", "name", "network", "tier") + [T.StructField("seq", T.LongType())])
OFFER = T.StructType(
    _strings("id", "card_id", "title", "category", "description", "merchant", "location", "valid_from", "valid_until", "terms_link", "source_url", "last_reviewed_at", "status")
    + [T.StructField("seq", T.LongType())]
)
SCANNED_OFFER = T.StructType(OFFER.fields + _strings("bank_id"))
SCRAPE = T.StructType(
    [*_strings("bank_id", "category"), T.StructField("offer_amount_percent", T.DoubleType()), *_strings("offer_about", "expiry_date", "source_url"), T.StructField("seq", T.LongType())]
)
PRESET = T.StructType(
    [*_strings("user_id", "preset_id", "name"), T.StructField("bank_ids", T.ArrayType(T.StringType())), T.StructField("categories", T.ArrayType(T.StringType())), *_strings("card_id", "created_at", "last_used_at")]
)
EXTRACTED = "array<struct<title:string,category:string,description:string,merchant:string,location:string,validFrom:string,validUntil:string,termsLink:string,sourceUrl:string>>"
FEED_A = "struct<data:array<struct<id:string,title:string,thumb:string,merchant:string,cardType:string,to:string,valid:string>>,total:string>"
FEED_B = "struct<data:array<struct<id:string,company_name:string,short_discount:string,short_description:string,description:string,category:string,city:string,expire_on:string,display_on:string,enable:boolean,delete_status:boolean>>,total:string>"
