"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm import common


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, weigh `weights`, repeating. Each round gives what is
    left of the total to the open sources by weight and clamps those above max_epochs times
    their size; rounds go on until none is above. A round is one small aggregate.
    """
    # a source's place: the ranges before its own, and its place in that
    order = F.col("source").asc_nulls_last()
    ranged = common.written(sizes.repartitionByRange(order).select("source", "source_size", F.spark_partition_id().alias("range")))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", ahead.alias("ahead"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    state = common.written(ranged.join(ranges, "range").select("source", "source_size", w.alias("w"), (F.col("source_size") * float(max_epochs)).alias("cap")))
    total = state.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        # a source is clamped once its share at the last level was above its cap
        done = F.col("cap") < F.col("w") * level
        held, open_w, n = state.agg(F.coalesce(F.sum(F.when(done, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~done, F.col("w"))), F.lit(0.0)), F.count_if(done)).first()
        if n == clamped:
            break
        clamped = n
        level = (total - held) / open_w if open_w else 0.0
    return state.select("source", "source_size", F.when(F.col("cap") < F.col("w") * level, F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, repeats, part; one row per row of docs. With carry, also the row itself.

    A source is taken target / source_size times: each document as often as the whole part says
    (`repeats`), and the fraction once more for documents in the order of a seeded hash until
    the target is met. The document that crosses it gives its first `part` words only, so each
    source's taken words are its target, rounded.

    The order is cut into 4096 ranges of the hash. Only their sums are accumulated; only the
    documents of the one range that crosses the target are ordered among themselves, so no task
    holds a source. Null texts have size 0; null sources are one source; repeated rows count
    apart; a source of size 0 has target 0. Other columns are ignored.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    size = F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(common.WORD)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.substring(key, 1, 16).alias("u"), *([F.struct(*docs.columns).alias("row")] if carry else []))
    rows = rows.withColumn("range", F.substring("u", 1, 3))
    slim = common.written(rows.drop("row"))
    rows = rows if carry else slim
    by_range = slim.groupBy("source", "range").agg(F.sum("size").alias("words"))
    targets = source_targets(by_range.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("repeats", F.floor(ratio).cast("long")).withColumn("extra", F.floor(F.col("target") - F.col("repeats") * F.col("source_size") + 0.5).cast("long"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    named = by_range.withColumn("before", F.coalesce(before, F.lit(0))).withColumnRenamed("source", "s")
    crossing = F.when((F.col("before") < F.col("extra")) & (F.col("before") + F.col("words") > F.col("extra")), F.struct("range", "before"))
    # the range that crosses the target; if none does, everything below `full` is taken whole
    cut = targets.join(named, F.col("source").eqNullSafe(F.col("s"))).groupBy("source", "source_size", "target", "repeats", "extra").agg(F.max(crossing).alias("at"), F.max(F.when(F.col("before") + F.col("words") <= F.col("extra"), F.col("range"))).alias("full"))
    cut = common.written(cut.withColumnRenamed("source", "s"))
    placed = rows.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
    at_cut = F.coalesce(F.col("range") == F.col("at.range"), F.lit(False))
    inside = Window.partitionBy("source", "range").orderBy("u", "doc_id", "size", *(["row"] if carry else []))
    ahead = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    crossed = placed.where(at_cut).withColumn("once", F.greatest(F.lit(0), F.least("size", F.col("extra") - F.col("at.before") - ahead)))
    clear = placed.where(~at_cut).withColumn("once", F.when(F.col("range") <= F.col("full"), F.col("size")).otherwise(F.lit(0)))
    out = clear.unionByName(crossed)
    whole = (F.col("once") == F.col("size")) & (F.col("size") > 0)
    return out.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("repeats") + F.col("once")).cast("long").alias("taken"),
        (F.col("repeats") + whole.cast("long")).alias("repeats"),
        F.when(whole, F.lit(0)).otherwise(F.col("once")).cast("long").alias("part"), *(["row"] if carry else []),
    )


def take(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixed rows: every document `repeats` times, and its first `part` words if it has one.

    A plan that carries its rows needs no join. Any other plan meets docs by id, so its ids must
    be unique and not null; it is an error if they are not.
    """
    if "row" in plan.columns:
        joined = plan.select("row.*", F.col("repeats").alias("_repeats"), F.col("part").alias("_part"))
    else:
        p = plan.select(F.col("doc_id").alias("_id"), F.col("repeats").alias("_repeats"), F.col("part").alias("_part"))
        if not p.groupBy("_id").count().where("_id is null or count > 1").isEmpty():
            raise ValueError("ids are null or repeated: the plan must carry its rows")
        joined = docs.join(p, docs[id_col] == F.col("_id"))
    head = F.expr(f"regexp_substr(`{text_col}`, concat('^[\\\\x20\\\\x09-\\\\x0D]*+(?:[^\\\\x20\\\\x09-\\\\x0D]++[\\\\x20\\\\x09-\\\\x0D]*+){{', _part, '}}+'))")
    copies = F.concat(F.array_repeat(F.lit(False), F.col("_repeats").cast("int")), F.when(F.col("_part") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    each = joined.withColumn("_cut", F.explode(copies))
    return each.withColumn(text_col, F.when(F.col("_cut"), head).otherwise(F.col(text_col))).select(docs.columns)
