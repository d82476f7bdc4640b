"""Catalog, scrape and page sources with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom import schema
from offerloom.operators.maintain import offer_violations, scrape_violations

PDF_BYTES, PDF_PAGES, IMAGE_BYTES = 32 * 1024 * 1024, 100, 5 * 1024 * 1024
IMAGE_TYPES = ("image/jpeg", "image/png", "image/gif", "image/webp")


def checked(rows: DataFrame, violations: DataFrame, mode: str) -> DataFrame:
    """fail: an error if a row breaks the shape. quarantine: only the rows that keep it."""
    if mode == "quarantine":
        return rows.join(violations.select("seq").distinct(), "seq", "left_anti")
    first = violations.first()
    if first is not None:
        raise ValueError(f"row {first['seq']}: {first['violation']}")
    return rows


def read_offers(spark: SparkSession, path: str, fmt: str = "json", mode: str = "fail", staged: bool = False) -> DataFrame:
    rows = spark.read.format(fmt).schema(schema.SCANNED_OFFER if staged else schema.OFFER).option("multiLine", True).load(path)
    return checked(rows, offer_violations(rows), mode)


def read_scrape(spark: SparkSession, path: str, fmt: str = "json", mode: str = "fail") -> DataFrame:
    """Raw scrape rows of every publisher; percent and expiry may be null. A file that is no JSON of that shape breaks the check like a missing field."""
    corrupt = "_corrupt_record"
    reader = spark.read.format(fmt).option("multiLine", True)
    if fmt != "json":
        rows = reader.schema(schema.SCRAPE).load(path)
        return checked(rows, scrape_violations(rows), mode)
    rows = reader.schema(T.StructType([*schema.SCRAPE.fields, T.StructField(corrupt, T.StringType())])).option("columnNameOfCorruptRecord", corrupt).load(path)
    broken = F.col(corrupt).isNotNull()
    if mode == "quarantine":
        good = rows.where(~broken).drop(corrupt)
        return checked(good, scrape_violations(good), mode)
    first = rows.where(broken).select(corrupt, "seq").first()
    if first is not None:
        raise ValueError(f"unreadable record: {first[0][:200]}")
    good = rows.drop(corrupt)
    return checked(good, scrape_violations(good), mode)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages (page_id, url, html); nothing is fetched."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, bytes, pages, reason): binary files with the limit that each breaks, if any; pages of documents that are not empty or too large."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext == "pdf", "application/pdf").when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext.isin("png", "gif", "webp"), F.concat(F.lit("image/"), ext))
    # only documents that their size does not rule out are read
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).where(F.col("length").between(1, PDF_BYTES))
    counted = read.select("path", F.regexp_count(F.decode("content", "ISO-8859-1"), F.lit(r"/Type\s*/Page(?!s)")).alias("pages"))
    rows = rows.join(counted, "path", "left").select("path", kind.alias("kind"), "bytes", "pages")
    pdf = F.col("kind") == "application/pdf"
    reason = F.when(F.col("kind").isNull(), "unsupported media type").when(F.col("bytes") == 0, "empty").when(pdf & (F.col("bytes") > PDF_BYTES), "pdf too large").when(pdf & (F.col("pages") > PDF_PAGES), "pdf has too many pages").when(~pdf & (F.col("bytes") > IMAGE_BYTES), "image too large")
    return rows.withColumn("reason", reason)


def registry_sources(entries: DataFrame) -> DataFrame:
    """(bank_id, url, type) of every source of the enabled banks."""
    return entries.where("enabled").select("bank_id", F.explode("sources").alias("s")).select("bank_id", "s.url", "s.type")
