"""The pipeline's stages against plain versions of what they keep."""

import random
import re
from collections import Counter

import corpus_pipeline
from compare import DATA
from pyspark.sql import functions as F

import __spark_entry__
from offerloom.llm.chunk_dedup import exact_dedup
from offerloom.llm.ngram_quality import quality
from offerloom.llm.token_combo_join import jaccard_components


def test_names():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages(spark):
    folder = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    good = corpus_pipeline.quality_filter(spark, docs, folder).cache()
    assert good.columns == docs.columns and ids(good) == ids(quality(docs, labels).where("keep"))
    clean = labels.where("quality = 1 and toxic = 0").join(docs, "doc_id")
    assert clean.join(good, "doc_id", "left_anti").count() <= 0.02 * clean.count()
    again = good.unionByName(good.limit(3)).cache()
    once = corpus_pipeline.exact_duplicates(spark, again, folder).cache()
    assert ids(once) == ids(exact_dedup(good).where("kept"))
    near = corpus_pipeline.near_duplicates(spark, once, folder).cache()
    assert ids(near) == ids(jaccard_components(once).where("doc_id = component_id"))
    mixed = corpus_pipeline.mixture(spark, near, folder).cache()
    size = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in df.collect())
    assert mixed.columns == docs.columns and abs(size(mixed) - size(near)) <= near.select(F.col("source")).distinct().count()
    assert corpus_pipeline.token_ids(spark, mixed, folder).count() == mixed.count()


def test_null_and_repeated_ids(spark, tmp_path):
    """Each stage takes rows away, not ids: plain Python over rows with null and repeated ids."""
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("the of and ing er on an re en at".split()) + rng.choice("the of and ing er on an re".split()) for _ in range(n))
    base = prose(300).split()
    near = lambda at: " ".join(base[:at] + ["other"] + base[at + 1 :])
    rows = [(None, prose(40)), (None, "  "), (7, prose(50)), (7, prose(50)), (7, ""), (None, prose(30)), (11, near(5)), (12, near(9)), (12, prose(45)), (13, near(0)), (None, near(2))]
    rows += [(9, rows[2][1]), (None, rows[3][1].upper()), (20, prose(20)), (20, rows[-1][1]), (21, "same Text"), (21, "same text"), (21, "another")]
    rows += [(100 + i, prose(rng.randint(5, 60))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()
    spark.createDataFrame([(100 + i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plain = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    key = lambda i: -1 if i is None else i

    good = plain(corpus_pipeline.quality_filter(spark, docs, str(tmp_path)))
    verdict = Counter((r["lang"], r["keep"]) for r in quality(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect())
    assert sum(good.values()) == verdict[("en", True)] and not good - Counter(rows)
    assert (None, "  ") not in good and (None, rows[0][1]) in good and (7, rows[2][1]) in good

    once = corpus_pipeline.exact_duplicates(spark, docs, str(tmp_path)).cache()
    texts = {}
    for i, t in rows:
        texts.setdefault(t.lower(), []).append(i)
    assert Counter((i, t.lower()) for i, t in plain(once).elements()) == Counter((max(v, key=key), t) for t, v in texts.items())

    left = plain(corpus_pipeline.near_duplicates(spark, once, str(tmp_path)))
    copies = {near(at) for at in (0, 2, 5, 9)}
    assert left == Counter({k: n for k, n in plain(once).items() if k[1] not in copies or k == (11, near(5))})
    mixed = corpus_pipeline.mixture(spark, once, str(tmp_path))
    assert plain(mixed) == plain(once)  # one source is taken once
