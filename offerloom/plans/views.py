"""The catalog's relations as views of the benchmark tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-06-15 12:00:00"
TABLES = ("nation", "supplier", "lineitem", "orders", "part", "events", "documents", "pages")

VIEWS = {
    "bank": """
        select lower(n_name) as bank_id, n_name || ' Bank' as name, n_name as short_name, 'https://www.' || lower(n_name) || '.example' as website_url, cast(n_nationkey as bigint) as seq from nation""",
    "card": """
        select 's' || cast(s_suppkey as string) as card_id, 'nation_' || cast(s_nationkey as string) as bank_id, s_name as name,
               case s_suppkey % 3 when 0 then 'Visa' when 1 then 'Mastercard' end as network, case when s_suppkey % 5 = 0 then 'Premium' end as tier, cast(s_suppkey as bigint) as seq
        from supplier""",
    "offer_raw": """
        select 'o' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) as id, 's' || cast(l_suppkey as string) as card_id, p_name || ' ' || p_brand as title,
               case l_partkey % 9 when 0 then 'dining' when 1 then 'fuel' when 2 then 'supermarket' when 3 then 'travel' when 4 then 'online' when 5 then 'installment' when 6 then 'cashback' when 7 then 'bogo' else 'other' end as category,
               p_type || case when l_linenumber % 2 = 0 then '  ' else ' ' end || p_name as description,
               case when l_linenumber = 7 then null when l_linenumber % 2 = 0 then upper(p_brand) else p_brand end as merchant,
               case when l_returnflag = 'A' then 'Sri Lanka' end as location,
               case when l_quantity < 25 then cast(cast(l_shipdate as date) as string) end as valid_from,
               case l_linenumber when 1 then null when 2 then 'not-a-date' when 3 then cast(cast(l_shipdate as date) as string) || 'T00:00:00.000Z' else cast(cast(l_shipdate as date) as string) end as valid_until,
               'https://www.nation.example/p/' || cast(l_partkey as string) || case when l_linenumber % 2 = 0 then '#x' else '' end as source_url,
               cast(cast(o_orderdate as date) as string) || 'T00:00:00.000Z' as last_reviewed_at,
               case o_orderstatus when 'F' then 'inactive' when 'O' then 'active' else 'needs_review' end as status,
               cast(((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey as bigint) as seq
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "request_log": """
        select event_id, ts, 'u' || cast(user_id as string) as client_key,
               'https://catalog.example/' || case event_type when 'view' then '?search=%20' when 'click' then '?bank=nation_1&category=dining' when 'signup' then '?search=keells' when 'purchase' then '?card=s1&page=2' else '' end as url,
               case when event_id % 10 = 0 then 'Mozilla/5.0 (compatible; Googlebot/2.1)' else 'Mozilla/5.0' end as user_agent
        from events""",
    "scrape_raw": """
        select doc_id as seq, 'nation_' || cast(doc_id % 25 as string) as bank_id,
               case doc_id % 4 when 0 then 'Dining' when 1 then 'Travel' when 2 then 'Other' else 'Unmapped' end as category,
               case when doc_id % 3 = 0 then null else cast(doc_id % 50 as double) end as offer_amount_percent,
               'Merchant ' || cast(doc_id % 40 as string) || ' - ' || case doc_id % 7 when 0 then 'up to 20% off at our restaurant' when 1 then '0% interest installment plan' when 2 then 'hotel stay discount'
                 when 3 then 'cash back on fuel' when 4 then 'buy 1 get 1 meals' when 5 then 'grocery savings online' else 'special benefits' end || ' ' || lang as offer_about,
               case when doc_id % 5 = 0 then null else '2026-' || lpad(cast(1 + doc_id % 12 as string), 2, '0') || '-28' end as expiry_date,
               'https://www.nation.example/offers/' || source || '/' || cast(doc_id as string) || '/product' as source_url
        from documents""",
    "preset": """
        select 'u' || cast(o_custkey as string) as user_id, cast(o_orderkey as bigint) as preset_id, ' ' || o_orderpriority as name, array_bank as bank_ids, cat as categories,
               case when o_orderkey % 4 = 0 then 's' || cast(o_orderkey % 20 as string) end as card_id, o_orderdate as created_at, case when o_orderkey % 2 = 0 then o_orderdate + interval 30 day end as last_used_at
        from (select *, split('nation_' || cast(o_orderkey % 30 as string) || ',nation_' || cast(o_custkey % 25 as string), ',') as array_bank,
                     split('dining,' || case when o_orderkey % 3 = 0 then 'bogus' else 'fuel' end, ',') as cat from orders) t""",
}


class Catalog:
    """The mapped relations of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if f" {t}" in VIEWS[name]}
        sql = VIEWS[name]
        for t in used:
            sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
        return self.spark.sql(sql, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)

    @property
    def offers(self) -> DataFrame:
        """offer_raw with the link to its terms."""
        return self.view("offer_raw").selectExpr("*", "source_url as terms_link")

    @property
    def banks(self) -> DataFrame:
        return self.view("bank")

    @property
    def cards(self) -> DataFrame:
        return self.view("card")

    def pieces(self, lines: int = 1_000_000, most: int = 32) -> Iterator[Catalog]:
        """Catalogs of some orders each, together of all orders, in pieces of about `lines` offers, `most` pieces at most. Offers with one id are in one piece."""
        rows = self.table("lineitem").select(F.col("l_orderkey").cast("double"))
        n = min(most, max(1, -(-rows.count() // lines)))
        cuts = sorted({int(x) for x in rows.approxQuantile("l_orderkey", [i / n for i in range(1, n)], 0.25 / n)}) if n > 1 else []
        for low, high in zip([None, *cuts], [*cuts, None]):
            yield _Orders(self.spark, self.dir, low, high)


class _Orders(Catalog):
    """The relations of the orders whose key is from low to below high; None is open."""

    def __init__(self, spark: SparkSession, sf_dir: str, low: int | None, high: int | None):
        super().__init__(spark, sf_dir)
        self.low, self.high = low, high

    def table(self, name: str) -> DataFrame:
        rows, key = super().table(name), {"lineitem": "l_orderkey", "orders": "o_orderkey"}.get(name)
        if key and self.low is not None:
            rows = rows.where(F.col(key) >= self.low)
        if key and self.high is not None:
            rows = rows.where(F.col(key) < self.high)
        return rows
