"""Quality classifier: interpolated modified Kneser-Ney model of characters."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm import common

ORDER = 4
START = 2  # code of the character before a text
#: Held-out share of trusted documents, for quantiles of texts that the model has not seen.
HELD_OUT = 5
#: Ids of trusted documents are broadcast up to this many (8 bytes each); beyond, the join is shuffled.
MOST_BROADCAST = 2_000_000


#: Characters that are turned into grams at a time; a longer text goes in segments.
AT_ONCE = 500_000


def segments(texts: list[str]):
    """Lists of (row, characters before, segment) of about AT_ONCE characters, white space runs as one space."""
    held, size = [], 0
    for row, text in enumerate(texts):
        text = " ".join(text.split())
        before = chr(START) * (ORDER - 1)
        for i in range(0, len(text), AT_ONCE):
            part = text[i : i + AT_ONCE]
            held.append((row, before, part))
            before, size = (before + part)[-(ORDER - 1) :], size + len(part)
            if size >= AT_ONCE:
                yield held
                held, size = [], 0
    if held:
        yield held


def characters(parts: list[tuple[int, str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of the segments, each segment after its ORDER - 1 before; place where each gram begins; row of each gram)."""
    size = np.array([len(p[2]) for p in parts], np.int64)
    points = np.frombuffer("".join(b + t for _, b, t in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.arange(int(size.sum())) + np.repeat(np.arange(len(parts)), size) * (ORDER - 1)
    return points, begin, np.repeat(np.array([p[0] for p in parts], np.int64), size)


def signs(points: np.ndarray) -> np.ndarray:
    """The distinct characters, sorted."""
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    return np.flatnonzero(seen).astype(np.uint32)


def places(points: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Each character's place in the sorted alphabet, in the fewest bytes that hold it: 1, 2 or 4."""
    kind = np.uint8 if len(alphabet) <= 1 << 8 else np.uint16 if len(alphabet) <= 1 << 16 else np.uint32
    place = np.zeros(0x110000, kind)
    place[alphabet] = np.arange(len(alphabet), dtype=kind)
    return place[points]


#: A gram's key is the places of its ORDER characters side by side, by bytes of a place.
KEY = {1: np.dtype("u4"), 2: np.dtype("u8"), 4: np.dtype("S16")}


def packed(grams: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The key of each gram, a row of characters."""
    code = np.ascontiguousarray(places(grams, alphabet))
    return code.view(KEY[code.itemsize]).ravel()


def packed_at(points: np.ndarray, begin: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The key of each gram that begins at a place in a run of characters."""
    code = places(points, alphabet)
    return np.ndarray(max(len(code) - ORDER + 1, 0), KEY[code.itemsize], code, strides=(code.itemsize,))[begin]


def tallied(key: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct grams as rows of characters, their counts)."""
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    kind = {v: f"u{k}" for k, v in KEY.items()}[key.dtype]
    return alphabet[key[first].view(kind).reshape(-1, ORDER)], np.diff(first, append=len(key))


def looked_up(sought: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where in the sorted distinct keys each sought one stands: by a table of hashes, the few that it does not settle by bisection."""
    if key.dtype.kind == "S":
        return np.minimum(np.searchsorted(key, sought), len(key) - 1)
    bits = int(4 * len(key)).bit_length()
    slot = lambda k: ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    table = np.zeros(1 << bits, np.int32)
    table[slot(key)] = np.arange(len(key), dtype=np.int32)
    at = table[slot(sought)]
    left = np.flatnonzero(key[at] != sought)
    at[left] = np.minimum(np.searchsorted(key, sought[left]), len(key) - 1)
    return at


def strings(grams: np.ndarray) -> pa.Array:
    """Rows of characters as an Arrow column of texts."""
    size = (1 + (grams >= 0x80).astype(np.int32) + (grams >= 0x800) + (grams >= 0x10000)).sum(1)
    text = np.ascontiguousarray(grams).tobytes().decode("utf-32-le", "surrogatepass").encode()
    return pa.Array.from_buffers(pa.string(), len(grams), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.py_buffer(text)])


def distinct(grams: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(the distinct grams, their counts) of rows of characters."""
    if not len(grams):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    alphabet = signs(grams)
    found, count = tallied(packed(grams, alphabet), alphabet)
    return strings(found), count


def counted(parts: list[tuple[int, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct grams of the segments as rows of characters, their counts)."""
    points, begin, _ = characters(parts)
    if not len(begin):
        return np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)
    alphabet = signs(points)
    return tallied(packed_at(points, begin, alphabet), alphabet)


def _by_lang(langs: list, texts: list[str]):
    groups: dict = {}
    for i, lang in enumerate(langs):
        groups.setdefault(lang, []).append(i)
    return [(lang, at, [texts[i] for i in at]) for lang, at in groups.items()]


def gram_counts(trusted: DataFrame) -> DataFrame:
    """(lang, gram, c) over rows (lang, text): each task counts its batches, then counts are summed."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                found = ((lang, seg) for lang, _, texts in _by_lang(part.column(0).to_pylist(), part.column(1).to_pylist()) for seg in segments(texts))
                for lang, seg in found:
                    grams, count = counted(seg)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(grams)), strings(grams), pa.array(count.astype(np.int64))], ["lang", "gram", "c"])

    return trusted.mapInArrow(common.lean(run), "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


class KneserNey:
    """Interpolated modified Kneser-Ney tables, one set per language.

    level[k] holds (lang, gram, c) of k characters: counts at the top, below that in how many
    different contexts a gram continues. context[k] sums them by the first k - 1 characters, with
    how many follow once, twice and more; discount[k] are the three discounts of a language.
    """

    def __init__(self, counts: DataFrame):
        self.level = {ORDER: common.written(counts)}
        for k in range(ORDER - 1, 0, -1):
            above = self.level[k + 1]
            self.level[k] = common.written(above.groupBy("lang", F.expr(f"substr(gram, 2, {k})").alias("gram")).agg(F.count("*").alias("c")))
        self.context, self.discount = {}, {}
        for k, t in self.level.items():
            n = t.groupBy("lang").agg(*[F.count_if(F.col("c") == j).alias(f"n{j}") for j in (1, 2, 3, 4)])
            y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
            d = [F.least(F.lit(float(j)), F.greatest(F.lit(0.05), F.coalesce(j - (j + 1) * y * F.col(f"n{j + 1}") / F.nullif(f"n{j}", F.lit(0)), F.lit(0.5)))) for j in (1, 2, 3)]
            self.discount[k] = n.select("lang", *[v.alias(f"d{j}") for j, v in zip((1, 2, 3), d)])
            by = ["lang", F.expr(f"substr(gram, 1, {k - 1})").alias("ctx")]
            self.context[k] = t.groupBy(*by).agg(F.sum("c").alias("total"), *[F.count_if(F.col("c") == j).alias(f"f{j}") for j in (1, 2)], F.count_if(F.col("c") >= 3).alias("f3"))
            self.context[k] = self.context[k].join(self.discount[k], "lang").select("lang", "ctx", "total", "d1", "d2", "d3", ((F.col("d1") * F.col("f1") + F.col("d2") * F.col("f2") + F.col("d3") * F.col("f3")) / F.col("total")).alias("back"))
        self.signs = common.written(self.level[1].groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("uniform")))
        # at order 1 a language has one context: a row a language, which joins dealt by context could not spread
        self.context[1] = common.written(self.context[1].drop("ctx"))

    def log_chance(self, grams: DataFrame) -> DataFrame:
        """(lang, gram, logp) of distinct (lang, gram): for each order a join of counts and one of contexts."""
        out = grams.join(self.signs, "lang").withColumnRenamed("uniform", "p")
        for k in range(1, ORDER + 1):
            tail = F.expr(f"substr(gram, {ORDER - k + 1}, {k})")
            out = out.withColumns({"tail": tail, "ctx": F.expr(f"substr(gram, {ORDER - k + 1}, {k - 1})")})
            out = out.join(self.level[k].withColumnRenamed("gram", "tail"), ["lang", "tail"], "left").join(self.context[k], ["lang", "ctx"] if k > 1 else "lang", "left")
            off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
            seen = F.coalesce(F.greatest(F.lit(0.0), F.col("c") - off) / F.col("total"), F.lit(0.0))
            out = out.select("lang", "gram", F.when(F.col("total").isNull(), F.col("p")).otherwise(seen + F.col("back") * F.col("p")).alias("p"))
        return out.select("lang", "gram", F.log("p").alias("logp"))


def scores(docs: DataFrame, model: KneserNey) -> DataFrame:
    """(doc_id, lang, n, logp): characters and summed log chances of rows (doc_id, lang, text), with row_key if they have one.

    A batch of documents, as read from the table, is named by its content. Its distinct grams
    meet the count tables by joins; what comes back meets the batch's compressed texts by name.
    A table reads in equal batches each time; a batch that finds no answer is an error.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = "row_key" in docs.columns

    def parts(batches):
        for batch in batches:
            ids, langs, texts = (batch.column(n).to_pylist() for n in ("doc_id", "lang", "text"))
            keys = batch.column("row_key").to_pylist() if keyed else [None] * len(ids)
            size, a = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > 16_000_000 or i + 1 == len(texts):
                    rows = slice(a, i + 1)
                    name = hashlib.blake2b(repr((ids[rows], [len(t) for t in texts[rows]])).encode(), digest_size=8).digest()
                    yield int.from_bytes(name, "big", signed=True), ids[rows], langs[rows], texts[rows], keys[rows]
                    size, a = 0, i + 1

    def asked(batches):
        for name, _, langs, texts, _ in parts(batches):
            for lang, _, group in _by_lang(langs, texts):
                found, _ = distinct(np.concatenate([np.zeros((0, ORDER), np.uint32), *(counted(seg)[0] for seg in segments(group))]))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name, pa.int64()), len(found)), pa.repeat(pa.scalar(lang, pa.string()), len(found)), found], ["name", "lang", "gram"])

    def carried(batches):
        z = zstandard.ZstdCompressor(level=3)
        for name, ids, langs, texts, keys in parts(batches):
            for lang, at, group in _by_lang(langs, texts):
                blob = z.compress("".join(group).encode())
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([lang], pa.string()), pa.array([[ids[i] for i in at]], pa.list_(batch_type)), pa.array([blob], pa.binary()), pa.array([[len(t) for t in group]], pa.list_(pa.int32())), pa.array([[keys[i] for i in at]], pa.list_(pa.int64()))], ["name", "lang", "ids", "z", "lengths", "keys"])

    batch_type = pa.int64() if id_type in ("bigint", "int") else pa.string()
    some = common.written(docs.mapInArrow(common.lean(asked), "name long, lang string, gram string"))
    chances = model.log_chance(some.select("lang", "gram").distinct())
    answers = some.join(chances, ["lang", "gram"]).groupBy("name", "lang").agg(F.collect_list("gram").alias("grams"), F.collect_list("logp").alias("logps"))
    blobs = docs.mapInArrow(common.lean(carried), f"name long, lang string, ids array<{'bigint' if batch_type == pa.int64() else 'string'}>, z binary, lengths array<int>, keys array<bigint>")
    met = blobs.join(answers, ["name", "lang"], "left").join(model.signs.select("lang", F.lit(True).alias("known")), "lang", "left")

    def score(batches):
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lang = batch.column("ids")[i].values, batch.column("lang")[i].as_py()
                whole, ends = d.decompress(batch.column("z")[i].as_py()).decode(), np.cumsum(batch.column("lengths")[i].as_py()).tolist()
                texts = [whole[a:b] for a, b in zip([0, *ends], ends)]
                n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                if batch.column("grams")[i].is_valid:
                    text = common.utf8(batch.column("grams")[i].values)[0].tobytes().decode()
                    grams = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
                    alphabet = signs(grams)
                    key = packed(grams, alphabet)
                    order = np.argsort(key)
                    key, logp = key[order], np.array(batch.column("logps")[i].values)[order]
                    for seg in segments(texts):
                        points, begin, row = characters(seg)
                        v = packed_at(points, begin, alphabet)
                        at = looked_up(v, key)
                        if not (key[at] == v).all():
                            raise ValueError("a batch met other grams than it asked for")
                        n += np.bincount(row, minlength=len(texts))
                        total += np.bincount(row, logp[at], minlength=len(texts))
                else:
                    n += np.array([len(" ".join(t.split())) for t in texts], np.int64)
                if not batch.column("grams")[i].is_valid and batch.column("known")[i].is_valid and any(t.strip() for t in texts):
                    raise ValueError("a batch found no answer: the documents must be a table that reads alike twice")
                yield pa.RecordBatch.from_arrays([ids, pa.array([lang] * len(texts), pa.string()), pa.array(n), pa.array(total), *([batch.column("keys")[i].values] if keyed else [])], ["doc_id", "lang", "n", "logp", *(["row_key"] if keyed else [])])

    return met.mapInArrow(common.lean(score), f"doc_id {'bigint' if batch_type == pa.int64() else 'string'}, lang string, n long, logp double{', row_key long' if keyed else ''}")


def adjusted(n: Column, logp: Column, centre: Column, prior: int = 60) -> Column:
    """Log perplexity, drawn to the language's centre as if `prior` more characters stood there."""
    return (-logp + prior * centre) / (n + prior)


def quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", key_col: str | None = None) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, keep; one row per row of docs. A long key_col goes along as row_key.

    labels (doc_id, quality, toxic): text of quality 1 that is not toxic is trusted. Four fifths
    of the trusted documents train a model per language on all their text; the language's
    threshold is the `quantile` of log perplexity of the others, or of all the language's
    documents where no other is left. A document above it is rejected.

    Perplexity is of characters and, for the threshold, drawn to the median for short texts.
    Null languages are one language ("none"). Documents of a language without trusted text are
    kept, with null perplexity: nothing tells against them. Null, empty and blank texts are rejected. A
    document with several labels is trusted if each row trusts it. Repeated rows each give a
    row; other columns are ignored. docs must be a table or another plan that reads alike twice.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(lang_col, F.lit("none")).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"), *([F.col(key_col).alias("row_key")] if key_col else []))
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    trusted = common.written(labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).where("good").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).alias("held")))
    training = trusted.where("not held").select("doc_id")
    training = F.broadcast(training) if training.count() <= MOST_BROADCAST else training
    model = KneserNey(gram_counts(rows.join(training, "doc_id", "left_semi").select("lang", "text")))
    scored = common.written(scores(rows, model))
    level = F.when(F.col("n") > 0, -F.col("logp") / F.col("n"))
    has = scored.join(model.signs.select("lang"), "lang", "left_semi")
    held = has.where("n > 0").join(trusted.where("held").select("doc_id"), "doc_id", "left_semi").withColumn("level", level)
    fallback = has.where("n > 0").withColumn("level", level)
    middle = lambda t, name: t.groupBy("lang").agg(F.percentile_approx("level", F.lit(0.5), F.lit(10000)).alias(name))
    centre = middle(fallback, "all").join(middle(held, "own"), "lang", "left").select("lang", F.coalesce("own", "all").alias("centre"))
    centre = common.written(centre)
    top = lambda t, name: t.join(centre, "lang").withColumn("a", adjusted(F.col("n"), F.col("logp"), F.col("centre"))).groupBy("lang").agg(F.percentile_approx("a", F.lit(quantile), F.lit(10000)).alias(name))
    limits = centre.join(top(fallback, "all"), "lang", "left").join(top(held, "own"), "lang", "left")
    limits = common.written(limits.select("lang", "centre", F.coalesce("own", "all").alias("limit")))
    out = scored.join(limits, "lang", "left")
    value = adjusted(F.col("n"), F.col("logp"), F.col("centre"))
    return out.select(
        "doc_id", "lang", F.col("n").alias("n_chars"), F.when(F.col("limit").isNotNull(), F.exp(level)).alias("perplexity"), F.exp("limit").alias("threshold"),
        F.when(F.col("n") == 0, F.lit(False)).when(F.col("limit").isNull(), F.lit(True)).otherwise(value <= F.col("limit")).alias("keep"),
        *(["row_key"] if key_col else []),
    )
