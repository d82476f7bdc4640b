"""Python workers outlive a step: what one leaves in them must not stand beside the next."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from compare import DATA

from offerloom.llm import common, piece_codec
from offerloom.llm.token_combo_join import jaccard_components


def test_other_steps_drop_the_encoders_tables(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")

    def count(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(piece_codec._loaded)])], ["n"])

    kept = lambda: sum(r.n for r in spark.range(400).repartition(4).mapInArrow(count, "n long").collect())
    piece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).repartition(4).count()
    spark.range(400).repartition(4).mapInArrow(lambda b: b, "id long").count()
    piece_codec.encode_decode(docs.repartition(4), public_tokenizers.path("piece_bpe_32k.model")).count()
    assert kept() > 0
    # as many tasks as there are workers, each long enough that all get one
    jaccard_components(docs.repartition(8)).count()
    assert kept() == 0


def test_freed_memory_goes_back():
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon")) / 1024

    kept = []

    def run(batches):
        for batch in batches:
            # blocks of the heap, the last of which stays in use
            parts = [np.ones(12_000) for _ in range(2000)]
            kept.append(parts[-1])
            del parts
            yield batch

    before = held()
    for _ in common.lean(run)(iter([pa.RecordBatch.from_arrays([pa.array([1])], ["n"])] * 3)):
        pass
    assert held() - before < 60
