"""Text, id, URL and date expressions of catalog jobs; Spark built-ins but for Unicode decomposition."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom.schema import CATEGORY_LABELS

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

# Ordered keyword rules, the first that hits names the category.
CATEGORY_RULES = (
    ("travel", "travel|airline|airlines|flight|flights|airport|tour|tours|holiday|holidays|vacation|vacations|hotel|hotels|resort|resorts|stay|stays|accommodation|lodging"),
    ("installment", "installment|installments|instalment|instalments|easy payment|easy pay|0% interest|monthly plan|pay later"),
    ("cashback", "cashback|cash back|rebate|money back"),
    ("bogo", "bogo|buy one get one|buy 1 get 1|two for one|2 for 1"),
    ("supermarket", "supermarket|supermarkets|grocery|groceries|grocery store|hypermarket"),
    ("dining", "dining|restaurant|restaurants|cafe|cafes|eatery|food|meal|meals|cuisine"),
    ("fuel", "fuel|petrol|gasoline|gas station|diesel|pump"),
    ("online", "online|internet|web|website|e-commerce|ecommerce|digital|app|apps|mobile"),
)


def words(pattern: str) -> str:
    """A case-blind pattern between ASCII word edges; the JVM's own word edge knows letters of all scripts."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def squeeze(c: Column) -> Column:
    """White space runs, no-break spaces included, as one space, ends trimmed."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


@F.pandas_udf(T.StringType())
def _decompose(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v))


def normalize_text(c: Column) -> Column:
    """Decomposed, unaccented, plain dashes and quotes, single spaces. ASCII texts never meet Python."""
    plain = F.regexp_replace(_decompose(F.when(c.rlike(r"[^\x00-\x7F]"), c)), r"[̀-ͯ]", "")
    plain = F.regexp_replace(plain, r"[‐-―]", "-")
    plain = F.translate(plain, "‘’“”", "''\"\"")
    plain = F.regexp_replace(plain, "…", "...")
    return squeeze(F.coalesce(plain, c))


def classify(text: Column) -> Column:
    """Category by the first keyword rule that hits, else other."""
    out = F.lit("other")
    for category, pattern in reversed(CATEGORY_RULES):
        out = F.when(text.rlike(words(pattern)), category).otherwise(out)
    return out


def dedupe_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def expiry_suffix(date: Column) -> Column:
    """-month-year of a date string; empty without a valid month."""
    year, month = F.split_part(date, F.lit("-"), F.lit(1)), F.expr("cast(null as int)")
    month = F.try_to_number(F.nullif(F.regexp_extract(date, "^[^-]*-([0-9]{1,2})(?:-|$)", 1), F.lit("")), F.lit("99")).cast("int")
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.when(month.between(1, 12), month).otherwise(1))
    return F.when(date.isNotNull() & (year != "") & month.between(1, 12), F.concat(F.lit("-"), name, F.lit("-"), year)).otherwise("")


def stable_id(bank: Column, title: Column, url: Column) -> Column:
    return F.concat(bank, F.lit("-"), F.substring(F.sha1(F.concat_ws("|", bank, title, url)), 1, 12))


def extract_expiry(text: Column) -> Column:
    """First date in a text: year-month-day, else day, month name and year."""
    iso, dmy = r"\b(20\d{2})[-/](0?[1-9]|1[0-2])[-/](0?[1-9]|[12]\d|3[01])\b", r"(?i)\b(0?[1-9]|[12]\d|3[01])(?:st|nd|rd|th)?\s+(" + "|".join(MONTHS) + r")\s+(20\d{2})\b"
    part = lambda p, i: F.regexp_extract(text, p, i)
    two = lambda c: F.lpad(c, 2, "0")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(dmy, 2))).cast("string")
    return F.when(part(iso, 1) != "", F.concat_ws("-", part(iso, 1), two(part(iso, 2)), two(part(iso, 3)))).when(part(dmy, 3) != "", F.concat_ws("-", part(dmy, 3), two(month), two(part(dmy, 1))))


def epoch_date(c: Column) -> Column:
    """Date string of epoch milliseconds; null for text, zero or less."""
    ms = c.try_cast("double")
    return F.when((ms > 0) & (ms <= 8.64e15), F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd"))


# --- URLs ----------------------------------------------------------------------------------

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def _url(c: Column, i: int) -> Column:
    return F.regexp_extract(c, _URL, i)


def url_without_fragment(c: Column) -> Column:
    """Key of staged offers: the URL less its fragment; other strings unchanged."""
    whole = F.substring_index(c, "#", 1)
    site = F.regexp_extract(whole, "^[^/]+//[^/?]+", 0)
    rest = F.substring(whole, F.length(site) + 1, F.length(whole))
    return F.when(c.rlike(_URL), F.concat(F.lower(site), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))).otherwise(c)


def page_key(c: Column) -> Column:
    """Key of pages: lower-case host, no fragment, a path that ends with a slash."""
    path = F.when(_url(c, 3).endswith("/"), _url(c, 3)).otherwise(F.concat(_url(c, 3), F.lit("/")))
    return F.when(c.rlike(_URL), F.concat(F.lower(_url(c, 1)), F.lit("://"), F.lower(_url(c, 2)), path, _url(c, 4))).otherwise(c)


def host_of(c: Column) -> Column:
    return F.lower(_url(c, 2))


def path_query(c: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(_url(c, 3), F.lit("")), F.lit("/")), _url(c, 4))


# --- display -------------------------------------------------------------------------------


def category_label(c: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in CATEGORY_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(labels, c), F.lit("Other"))


def display_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c.try_cast("date"), "MMM d, yyyy"), F.lit("Not specified"))


def truncated(labels: Column, most: int = 2) -> Column:
    """Up to two labels, then how many more."""
    head = F.array_join(F.slice(labels, 1, most), ", ")
    return F.when(F.size(labels) > most, F.concat(head, F.lit(" +"), (F.size(labels) - most).cast("string"))).otherwise(head)
