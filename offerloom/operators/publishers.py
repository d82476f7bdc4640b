"""Rules of the ten scraped publishers, as data. Texts here are fixed values."""

PERCENT = r"(?:up to\s+)?\d+(?:\.\d+)?%"

#: Per publisher: raw category -> category ("?" asks the keyword rules), and what an unlisted one gives.
CATEGORY = {
    "boc": {"Dining": "dining", "Supermarkets": "supermarket", "Travel and Leisure": "travel", "Zero Plans": "installment"},
    "cargills-bank": {"Dining": "dining", "Supermarket": "supermarket", "Travel": "travel", "Online": "online", "Entertainment": "other", "Other": "other"},
    "dfcc": {"Dining": "dining", "Supermarket": "supermarket", "Travel": "travel", "Online": "online", "Automobile": "other", "Education": "other", "Home & Living": "other", "Insurance": "other", "Jewellery": "other"},
    "ndb": {"Dining": "dining", "Supermarket": "supermarket", "Online": "online", "Travel": "travel"},
    "ntb": {"Dining": "dining", "Hotels": "travel", "Travel": "travel", "Installment Plans": "installment", "Online": "online", "Supermarket": "supermarket"},
    "pan-asia-bank": {"Supermarket": "supermarket", "Jewellery": "other"},
    "peoples-bank": {"Dining": "dining", "Installments": "installment", "Online": "online", "Supermarket": "supermarket", "Travel": "travel"},
    "sampath": {"Dining": "dining", "Online": "online", "Supermarket": "supermarket", "Travel": "travel", "Electronics & Furniture": "other"},
    "seylan": {"Dining": "dining", "Supermarket": "supermarket", "Travel": "travel", "Installment": "installment", "Fuel": "fuel"},
    "union-bank": {"Dining": "dining", "Supermarket": "supermarket", "Travel": "travel", "Other": "other"},
}

#: (publisher, raw categories or none for all, pattern over the text, category); these come before CATEGORY.
CATEGORY_TEXT = [
    ("boc", ["VISA Offers"], r"\b(?:taste|dining|food|restaurant)\b", "dining"),
    ("boc", ["VISA Offers"], r"\b(?:singapore|korea|thailand|destination|attractions)\b", "travel"),
    ("cargills-bank", ["Other"], r"\b(?:0%\s*)?instal(?:l)?ment|emi plan\b", "installment"),
    ("dfcc", ["Automobile", "Education", "Health & Beauty", "Insurance"], "0% Easy Payment", "installment"),
    ("dfcc", ["Home & Living"], "Easy Payment", "installment"),
    ("sampath", ["Electronics & Furniture"], r"\b(?:installment|installments|instalment|instalments|0% interest|easy payment|pay later)\b", "installment"),
    ("seylan", None, r"\binstal(?:l)?ments?\b", "installment"),
    ("seylan", None, r"\bcash\s*back\b", "cashback"),
    ("union-bank", None, r"\binstal(?:l)?ments?\b", "installment"),
    ("union-bank", None, r"\bcashback\b", "cashback"),
]

#: Where the merchant's name ends; the leftmost hit of any alternative counts, no hit means the whole text.
BOUNDARY = {
    "ndb": [r"\s+-\s+(?:Flat\s+)?(?:Up to|Upto|\d+(?:\.\d+)?%|0%)", r"\s+-\s+\d+\s*Months?\b"],
    "peoples-bank": [r"\s+-\s+(?:Up to\s+)?\d+(?:\.\d+)?%"] + [rf"\s+-\s+{w}\b" for w in ("Maximum", r"Max\.?", "Minimum", "The maximum", "Valid", "For", "Stay", "Booking", "Travel", "On Base Fare", "Not Applicable", "Food only", "o", "Excluding", "Applicable", "Orders", "One", "Blackout", "View Promotion Details")] + [r"\s+View Promotion Details\b", r"\s+Promo Code\b"],
    "union-bank": [r"\s+-\s+(?:Up to\s+)?\d+(?:\.\d+)?%", r"\s+-\s+Father'?s Day\b", r"\s+-\s+convert\b", r"\s+-\s+'"],
}

CARD = {
    "boc": "boc-credit-cards", "cargills-bank": "cargills-bank-mastercard-credit-cards", "dfcc": "dfcc-credit-cards", "ndb": "ndb-credit-cards", "ntb": "ntb-mastercard-credit-cards",
    "pan-asia-bank": "pan-asia-bank-credit-cards", "peoples-bank": "peoples-bank-credit-cards", "sampath": "sampath-credit-cards", "seylan": "seylan-credit-cards", "union-bank": "union-bank-credit-cards",
}
PREMIUM = {"ndb": "ndb-premium-credit-cards", "ntb": "ntb-private-banking-mastercard-credit-cards", "sampath": "sampath-premium-credit-cards"}
NDB_PREMIUM = r"\b(?:platinum|signature|infinite|privilege banking)\b"
SAMPATH_PREMIUM = "visa infinite|visa signature|mastercard world|platinum ultramiles|american express"
SAMPATH_STANDARD = r"visa credit|visa debit|visa cards|mastercard(?!\s*world)|credit\s*&\s*debit|credit\/debit|all sampath visa|all sampath mastercard|sampath mastercard\s*&\s*visa|sampath mastercard,\s*visa"
NTB_PRIVATE_URL = "https://www.nationstrust.com/promotions/enjoy-exclusive-savings-with-private-banking-mastercard-credit-cards"

#: Source URL (and subject, for ntb) -> id kept from earlier catalogs; and titles of some of them.
LEGACY_ID = {
    "https://www.boc.lk/personal-banking/card-offers/supermarkets/keells/product": "boc-keells-june-2026",
    "https://www.boc.lk/personal-banking/card-offers/zero-plans/air-tickets/product": "boc-air-tickets-august-2026",
    "https://www.ndbbank.com/cards/card-offers/offer-details/247": "ndb-findmyfare-june-2026",
    "https://www.ndbbank.com/cards/card-offers/offer-details/316": "ndb-education-ipp-june-2026",
    "https://www.nationstrust.com/promotions/enjoy-exclusive-savings-on-dining|Butlers": "ntb-butlers-june-2026",
    "https://www.nationstrust.com/promotions/enjoy-exclusive-savings-when-you-shop-online-with-nations-trust-bank-mastercard-cards|Cargills Online": "ntb-cargills-online-july-2026",
    "https://www.nationstrust.com/promotions/enjoy-installment-plans-at-a-range-of-merchant-partners|Up to 12 Month 0% Extended Settlement Plans at anywhere": "ntb-installments-june-2026",
    "https://www.peoplesbank.lk/promotion/keells-25-off-credit/": "peoples-bank-keells-june-2026",
    "https://www.peoplesbank.lk/promotion/plates-at-cinnamon-grand-colombo-30-off-credit/": "peoples-bank-plates-june-2026",
}
LEGACY_TITLE = {
    "ndb-findmyfare-june-2026": "Flat 20% savings at findmyfare.com with 0% installment plans",
    "ndb-education-ipp-june-2026": "Up to 36 months 0% installment plans on education payments",
    "ntb-butlers-june-2026": "20% off at Butlers",
    "ntb-cargills-online-july-2026": "15% off online at Cargills Online",
    "ntb-installments-june-2026": "Up to 12-month 0% extended settlement plans",
}
SKIPPED_URLS = ["https://www.cargillsbank.com/wp-content/uploads/2018/04/Araliya-Hotels-Offer-Terms-Conditions.pdf"]
