"""Saved filters of users: validation, ageing, ranking, changes, repair, names and matching."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.functions.text import category_label, truncated
from offerloom.schema import CATEGORIES

MOST, DAYS = 10, 60


def last_touch() -> Column:
    return F.coalesce("last_used_at", "created_at")


def clean(presets: DataFrame, as_of: Column) -> DataFrame:
    """Valid presets with trimmed bank ids and known categories, touched within 60 days."""
    valid = (F.coalesce(F.col("preset_id").cast("string"), F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "") & F.col("bank_ids").isNotNull() & F.col("categories").isNotNull() & F.col("created_at").isNotNull() & ~F.exists("bank_ids", lambda b: b.isNull())
    fresh = F.coalesce(last_touch() >= as_of - F.expr(f"interval {DAYS} days"), F.lit(False))
    rows = presets.where(valid & fresh)
    return rows.withColumns({"bank_ids": F.filter(F.transform("bank_ids", lambda b: F.trim(b)), lambda b: b != ""), "categories": F.filter("categories", lambda c: c.isin(list(CATEGORIES)))})


def recent(presets: DataFrame, most: int = MOST) -> DataFrame:
    """Each user's latest presets; rank 1 is the latest."""
    w = Window.partitionBy("user_id").orderBy(last_touch().desc(), F.asc("preset_id"))
    return presets.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def name_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def apply_changes(presets: DataFrame, changes: DataFrame) -> DataFrame:
    """Presets after a change table (user_id, op, preset_id, name, bank_ids, categories, card_id, at), then the latest ten.

    A user's changes apply one after another, by `at`, then op and id. Each first drops presets not
    touched for 60 days at that time and all but the latest ten. save: the latest preset of that name keeps
    id and creation and takes the selection, else one is added with the change's id. delete and
    touch: by id. clear: all presets of the user. Rows without a user are left out; changes without
    a time do nothing. Users stream in order of time through tasks, and a task holds ten presets.
    """
    fields = ["preset_id", "name", "bank_ids", "categories", "card_id"]
    have = presets.select("user_id", F.lit(0).alias("step"), *fields, F.lit("have").alias("op"), "created_at", "last_used_at", F.lit(None).cast("timestamp").alias("at"))
    then = changes.where("at is not null").select("user_id", F.lit(1).alias("step"), *fields, "op", F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("last_used_at"), F.col("at").cast("timestamp").alias("at"))
    events = have.unionByName(then).where("user_id is not null").withColumn("touched", F.unix_micros(F.coalesce("last_used_at", "created_at").cast("timestamp"))).withColumn("when", F.unix_micros("at")).withColumn("k", name_key(F.col("name")))
    order = ["user_id", "step", "when", F.col("touched").desc_nulls_last(), "op", "preset_id"]
    spread = events.select("user_id", "step", "op", *fields, "k", "touched", "when", F.unix_micros(F.col("created_at").cast("timestamp")).alias("made"), F.unix_micros(F.col("last_used_at").cast("timestamp")).alias("used")).repartition("user_id").sortWithinPartitions(*order)
    id_type = presets.schema["preset_id"].dataType.simpleString()
    schema = f"user_id {presets.schema['user_id'].dataType.simpleString()}, preset_id {id_type}, name string, bank_ids array<string>, categories array<string>, card_id string, made long, used long"
    folded = spread.mapInArrow(_fold, schema)
    moment = lambda c: F.timestamp_micros(c).cast(presets.schema["created_at"].dataType)
    return recent(folded.select("user_id", *fields, moment("made").alias("created_at"), moment("used").alias("last_used_at")))


def _fold(batches):
    """Rows in order of user and time: each user's presets first, the changes after them."""
    names = ["user_id", "preset_id", "name", "bank_ids", "categories", "card_id", "made", "used"]
    limit = DAYS * 86_400_000_000
    user, held, schema = None, [], None

    def settle(now=None):
        # latest first; a tie goes to the smaller id
        held.sort(key=lambda r: (r["used"] is None and r["made"] is None, -touch(r), r["preset_id"]))
        if now is not None:
            held[:] = [r for r in held if now - touch(r) <= limit]
        del held[MOST:]

    def touch(r):
        return r["used"] if r["used"] is not None else r["made"] if r["made"] is not None else -(2**62)

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], schema.field(n).type) for n in names], names)

    done: list[dict] = []
    for batch in batches:
        schema = batch.schema
        for r in batch.to_pylist():
            if r["user_id"] != user:
                done += held
                user, held = r["user_id"], []
            if r["op"] == "have":
                # in order of recency, so the first ten are the ones that count
                if len(held) < MOST:
                    held.append({n: r[n] for n in [*names, "k"]})
                continue
            now = r["when"]
            settle(now)
            if r["op"] == "save":
                hit = next((h for h in held if h["k"] == r["k"]), None)
                if hit is None:
                    hit = {"user_id": user, "preset_id": r["preset_id"], "made": now, "k": r["k"]}
                    held.append(hit)
                hit.update({n: r[n] for n in ("bank_ids", "categories", "card_id")}, name=(r["name"] or "").strip(" "), used=now)
                settle()
            elif r["op"] == "delete":
                held[:] = [h for h in held if h["preset_id"] != r["preset_id"]]
            elif r["op"] == "touch":
                for h in held:
                    if h["preset_id"] == r["preset_id"]:
                        h["used"] = now
            elif r["op"] == "clear":
                held.clear()
        if len(done) > 1000:
            yield out(done)
            done = []
    if schema is not None:
        yield out(done + held)


def reconcile(presets: DataFrame, banks: DataFrame, cards: DataFrame) -> DataFrame:
    """Presets without banks and cards that are gone, with what is missing.

    A card stays if it exists and either no bank was chosen or its bank is among those left.
    """
    key = ["user_id", "preset_id"]
    items = presets.select(*key, F.posexplode("bank_ids").alias("pos", "bank_id")).join(banks.select("bank_id"), "bank_id", "left_semi")
    left = items.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "bank_id"))).alias("b")).select(*key, F.transform("b", lambda x: x["bank_id"]).alias("left_ids"))
    c = cards.select("card_id", F.col("bank_id").alias("card_bank"))
    rows = presets.join(left, key, "left").withColumn("left_ids", F.coalesce("left_ids", F.array().cast("array<string>"))).join(c, "card_id", "left")
    keep = F.col("card_bank").isNotNull() & ((F.size("bank_ids") == 0) | F.array_contains("left_ids", F.col("card_bank")))
    card = F.when(keep, F.col("card_id"))
    lost = (F.coalesce("card_id", F.lit("")) != "") & ~keep
    missing = F.size("bank_ids") - F.size("left_ids") + lost.cast("int")
    return rows.select(*key, F.col("left_ids").alias("bank_ids"), "categories", card.alias("card_id"), missing.alias("missing_count"), ((F.size("left_ids") == 0) & (F.size("categories") == 0) & card.isNull()).alias("is_empty"))


def names(presets: DataFrame, banks: DataFrame, cards: DataFrame) -> DataFrame:
    """(user_id, preset_id, suggested, summary) of reconciled presets."""
    key = ["user_id", "preset_id"]
    items = presets.select(*key, F.posexplode("bank_ids").alias("pos", "bank_id")).join(banks.select("bank_id", "short_name"), "bank_id")
    shorts = items.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "short_name"))).alias("b")).select(*key, F.transform("b", lambda x: x["short_name"]).alias("shorts"))
    rows = presets.join(shorts, key, "left").join(cards.select("card_id", F.col("name").alias("card_name")), "card_id", "left")
    bank = truncated(F.coalesce("shorts", F.array().cast("array<string>")))
    category = truncated(F.transform("categories", lambda c: category_label(c)))
    suggested = F.when((bank != "") & (category != ""), F.concat(bank, F.lit(" · "), category)).when(bank != "", bank).when(category != "", category).otherwise(F.coalesce("card_name", F.lit("My filters")))
    nb, nc = F.size("bank_ids"), F.size("categories")
    parts = F.concat_ws(
        " · ", F.when(nb > 0, F.concat(nb.cast("string"), F.when(nb == 1, " bank").otherwise(" banks"))),
        F.when(nc > 0, F.concat(nc.cast("string"), F.when(nc == 1, " category").otherwise(" categories"))), F.when(F.col("card_id").isNotNull(), F.lit("1 card")),
    )
    return rows.select(*key, suggested.alias("suggested"), F.when(parts == "", "All offers").otherwise(parts).alias("summary"))


def match_selection(presets: DataFrame, selections: DataFrame) -> DataFrame:
    """(user_id, selection_id, preset_id): each selection's first preset of equal sets and card."""
    sets = lambda c: F.array_sort(F.array_distinct(c))
    side = lambda t, i: t.select("user_id", i, sets("bank_ids").alias("b"), sets("categories").alias("c"), F.coalesce("card_id", F.lit("")).alias("k"))
    met = side(selections, "selection_id").join(side(presets, "preset_id"), ["user_id", "b", "c", "k"])
    return met.groupBy("user_id", "selection_id").agg(F.min("preset_id").alias("preset_id"))


def is_empty(c: DataFrame) -> Column:
    return (F.size(c["bank_ids"]) == 0) & (F.size(c["categories"]) == 0) & c["card_id"].isNull()
