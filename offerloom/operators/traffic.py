"""Request logs: filters in URLs, return visits, page-path classes and request limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.operators import ordered
from offerloom.schema import CATEGORIES, PAGE_SIZES, SORT_KEYS

# Crawlers that are never limited.
CRAWLERS = ("googlebot", "bingbot", "slurp", "duckduckbot", "baiduspider", "yandex", "applebot", "gptbot", "claudebot", "perplexitybot", "google-extended", "oai-searchbot", "chatgpt-user")


def query_values(url: Column, key: str) -> Column:
    """All values of a query key, decoded, in order."""
    pairs = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    hits = F.filter(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1)) == key)
    return F.transform(hits, lambda p: F.coalesce(F.try_url_decode(F.regexp_replace(p, "^[^=]*=?", "")), F.regexp_replace(p, "^[^=]*=?", "")))


def first_value(url: Column, key: str) -> Column:
    return F.coalesce(F.get(query_values(url, key), F.lit(0)), F.lit(""))


def log_filters(log: DataFrame) -> DataFrame:
    """The filter, order and page that each request asks for; unknown categories and keys fall away."""
    url = F.col("url")
    many = lambda k: F.filter(F.transform(query_values(url, k), lambda v: F.trim(v)), lambda v: v != "")
    some = lambda k: F.nullif(F.trim(first_value(url, k)), F.lit(""))
    whole = lambda k: F.when(first_value(url, k).rlike("^[1-9][0-9]*$"), first_value(url, k).try_cast("int"))
    return log.select(
        "event_id", many("bank").alias("bank_ids"), F.filter(many("category"), lambda c: c.isin(list(CATEGORIES))).alias("categories"), some("card").alias("card_id"), some("search").alias("search"),
        F.when(first_value(url, "sort").isin(list(SORT_KEYS)), first_value(url, "sort")).otherwise(SORT_KEYS[0]).alias("sort"),
        F.coalesce(whole("page"), F.lit(1)).alias("page"), F.when(whole("pageSize").isin(list(PAGE_SIZES)), whole("pageSize")).otherwise(PAGE_SIZES[0]).alias("page_size"),
    )


def return_visits(log: DataFrame, minutes: int = 30, keep_days: int | None = None) -> DataFrame:
    """(event_id, is_return): whether the client's previous request is at least `minutes` back, and less than keep_days if they are given."""
    before = F.lag("ts").over(Window.partitionBy("client_key").orderBy("ts", "event_id"))
    back = F.col("ts") >= before + F.expr(f"interval {minutes} minutes")
    if keep_days is not None:
        back &= F.col("ts") < before + F.expr(f"interval {keep_days} days")
    return log.select("event_id", "client_key", "url", F.coalesce(back, F.lit(False)).alias("is_return"))


def visit_path(url: Column, is_return: Column) -> Column:
    """Class of a page view; null if there is nothing to tell."""
    has = lambda k: F.trim(first_value(url, k)) != ""
    search, chosen = has("search"), has("bank") | has("card") | has("category")
    path = F.concat(F.lit("/__analytics"), F.when(is_return, "/return-visit").otherwise(""), F.when(search, "/search").when(chosen, "/filter").otherwise(""))
    return F.when(search | chosen | is_return, path)


def visit_paths(log: DataFrame) -> DataFrame:
    rows = return_visits(log)
    return rows.groupBy(F.coalesce(visit_path(F.col("url"), F.col("is_return")), F.lit("untouched")).alias("path")).agg(F.count("*").alias("visits"))


def client_key(forwarded: Column, real: Column) -> Column:
    return F.coalesce(F.trim(F.split_part(F.nullif(forwarded, F.lit("")), F.lit(","), F.lit(1))), real, F.lit("unknown"))


def is_crawler(agent: Column) -> Column:
    text = F.lower(F.coalesce(agent, F.lit("")))
    out = F.lit(False)
    for bot in CRAWLERS:
        out = out | text.contains(bot)
    return out


#: Busy clients are broadcast up to this many; beyond, the joins are shuffled.
MOST_BROADCAST = 1_000_000


def rate_limit(log: DataFrame, seconds: int = 60, most: int = 60) -> DataFrame:
    """(event_id, client_key, blocked, retry_after) of requests that are no crawler's.

    A window opens with a client's first request and closes `seconds` later; the next request
    opens the next one. A client that never has more than `most` requests in two neighbouring
    spans of the clock is never blocked, which counts tell. Of the others windows chain; a busy client's
    requests lie in ranges of time that are numbered apart (see ordered.windows). Requests without a
    client key are not limited.
    """

    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = log.where(~is_crawler(F.col("user_agent"))).select("event_id", "client_key", micros.alias("at"))
    span = F.expr(f"at div {seconds * 1_000_000}")
    counts = rows.where("client_key is not null").groupBy("client_key", span.alias("span")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("client_key").orderBy("span")
    both = F.col("n") + F.when(F.lag("span").over(before) == F.col("span") - 1, F.lag("n").over(before)).otherwise(0)
    busy = counts.withColumn("both", both).where(F.col("both") > most).select("client_key").distinct().checkpoint()
    busy = F.broadcast(busy) if busy.count() <= MOST_BROADCAST else busy
    calm = rows.join(busy, "client_key", "left_anti").select("event_id", "client_key", F.lit(False).alias("blocked"), F.lit(None).cast("long").alias("retry_after"))
    folded = ordered.windows(ordered.ranged(rows.join(busy, "client_key", "left_semi").select("event_id", "client_key", "at"), ["client_key"], ["at", "event_id"]), seconds * 1_000_000)
    blocked = F.col("nth") > most
    wait = -F.floor((F.col("at") - F.col("opened") - seconds * 1_000_000) / 1_000_000)
    return calm.unionByName(folded.select("event_id", "client_key", blocked.alias("blocked"), F.when(blocked, wait).cast("long").alias("retry_after")))
