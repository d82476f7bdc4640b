"""Scores of texts by a subword lattice: the likelihood of a text summed over all its segmentations."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm import common

#: Bytes of text in a pack, bytes that are split into words at a time, characters of words whose lattices are summed at a time.
PACK, SPLIT, AT_ONCE = 16 << 20, 4 << 20, 60_000
#: Distinct words that a task holds at a time.
GATHERED = 100_000
#: Characters, with the marker, of a stretch of a word that weights are fitted on; longer words are scored one by one.
STRETCH = 256
#: Languages with piece weights of their own: those with the most distinct training words. The others share the weights of all.
LANGUAGES = 64
#: Statistics of languages are broadcast up to this many (some 100 bytes each); beyond, the joins are shuffled.
MOST_BROADCAST = 10_000
#: Training words that the vocabulary's own scores weigh as much as.
PRIOR = 500.0
#: Of what a language's own words leave, the share of the words of all languages; the pieces have the rest.
TO_ALL = 0.1
MARK = "▁"
_loaded: dict[str, "Pieces"] = {}


class Pieces:
    """Pieces of a sentencepiece vocabulary, found in many words at once.

    A word carries the marker in front. Pieces with the marker start words, others continue them, and any
    character can be spelled in bytes, so every word has a segmentation. `prior` are weights from the
    vocabulary's scores: these are log probabilities, or, in merge vocabularies, ranks, whose weight is 1 / (rank + 2).
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        usual = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        usual = [i for i in usual if sp.id_to_piece(i) and MARK not in sp.id_to_piece(i)[1:]]
        self.text = [sp.id_to_piece(i) for i in usual]
        score = np.array([sp.get_score(i) for i in usual])
        # ranks are whole numbers
        self.prior = 1 / (2 + np.maximum(0, -score)) if (score == np.round(score)).all() else np.exp(np.minimum(score, 0))
        self.starts = np.array([t[0] == MARK for t in self.text])
        if MARK not in self.text:
            raise ValueError("the vocabulary has no piece that is the marker alone")
        self.by_length = {}
        for n in sorted({len(t) for t in self.text}):
            at = np.array([i for i, t in enumerate(self.text) if len(t) == n])
            codes = np.array([[ord(c) for c in self.text[i]] for i in at.tolist()], np.uint32)
            key = np.zeros(len(at), np.uint64)
            for k in range(n):
                key = self.rolled(key, codes[:, k])
            order = np.argsort(key)
            some = np.zeros(1 << 18, bool)  # most strings are no piece: the upper bits of their keys tell
            some[key >> np.uint64(46)] = True
            self.by_length[n] = some, key[order], at[order], codes[order]

    @staticmethod
    def rolled(key: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (key + code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    def found(self, codes: np.ndarray, inner: bool = False) -> dict[int, np.ndarray]:
        """{length: piece at each place of each word (place, word), -1 for none} of words of one length, given as codes (n, length). inner: the codes start inside a word."""
        n, length = codes.shape
        codes = np.ascontiguousarray(codes.T)
        key, out = np.zeros((length, n), np.uint64), {}
        for k in range(1, min(length, max(self.by_length)) + 1):
            key = self.rolled(key[: length - k + 1], codes[k - 1 :])
            if k not in self.by_length:
                continue
            some, keys, at, letters = self.by_length[k]
            place, word = np.nonzero(some[key >> np.uint64(46)])
            mine = key[place, word]
            hit = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            same = keys[hit] == mine
            for j in range(k):
                same &= codes[place + j, word] == letters[hit, j]
            # a piece with the marker begins a word, and a word begins with one
            same &= self.starts[at[hit]] == ((place == 0) & (not inner))
            if same.any():
                out[k] = np.full((length - k + 1, n), -1, np.int64)
                out[k][place[same], word[same]] = at[hit[same]]
        return out


class Weights:
    """Log weights of pieces (starting ones sum to 1; continuing ones, bytes and the word's end sum to 1)."""

    def __init__(self, pieces: Pieces, counts: np.ndarray | None = None):
        """counts: expected uses of each piece, then of bytes, then of ends; none: the vocabulary's own scores."""
        n, s = len(pieces.text), pieces.starts
        prior = np.where(s, pieces.prior / pieces.prior[s].sum(), 0.7 * pieces.prior / max(pieces.prior[~s].sum(), 1e-300))
        every = np.r_[prior, 0.001, 0.299] * PRIOR
        every = every if counts is None else every + counts
        start, inside = every[:n][s].sum(), every[:n][~s].sum() + every[n] + every[n + 1]
        self.piece = np.r_[np.log(every[:n] / np.where(s, start, inside)), -np.inf]  # the last is for no piece
        self.byte, self.end = math.log(every[n] / inside / 256), math.log(every[n + 1] / inside)


def spelled(codes: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each character."""
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


def forward(pieces: Pieces, codes: np.ndarray, w: Weights):
    """(log likelihoods of words of one length, forward values, pieces found): the recursion over end places, in log space."""
    n, length = codes.shape
    found, spell = pieces.found(codes), np.ascontiguousarray(spelled(codes).T) * w.byte
    a = np.full((length + 1, n), -np.inf)
    a[0] = 0
    for t in range(1, length + 1):
        terms = [a[t - 1] + spell[t - 1]] if t > 1 else []
        terms += [a[t - k] + w.piece[ids[t - k]] for k, ids in found.items() if k <= t]
        if len(terms) == 1:
            a[t] = terms[0]
            continue
        top = np.maximum.reduce(terms)
        a[t] = top + np.log(sum(np.exp(x - top) for x in terms))
    return a[length] + w.end, a, found


def expected(pieces: Pieces, codes: np.ndarray, w: Weights) -> np.ndarray:
    """Uses of each piece, of bytes and of ends, over all segmentations of words of one length."""
    n, length = codes.shape
    _, a, found = forward(pieces, codes, w)
    size = np.ascontiguousarray(spelled(codes).T)
    b = np.full((length + 1, n), -np.inf)
    b[length] = 0
    ids_, uses, in_bytes = [], [], 0.0
    for t in range(length - 1, -1, -1):
        if t:
            by_bytes = size[t] * w.byte + b[t + 1]
            in_bytes += float((np.exp(a[t] + by_bytes - a[length]) * size[t]).sum())
            b[t] = by_bytes
        for k, ids in found.items():
            if t + k <= length:
                here = np.flatnonzero(ids[t] >= 0)
                if len(here):
                    piece = ids[t, here]
                    on = w.piece[piece] + b[t + k, here]
                    ids_.append(piece)
                    uses.append(np.exp(a[t, here] + on - a[length, here]))
                    b[t, here] = np.logaddexp(b[t, here], on)
    return np.r_[np.bincount(np.concatenate(ids_), np.concatenate(uses), len(pieces.text)), in_bytes, n]


def long_word(pieces: Pieces, codes: np.ndarray, w: Weights) -> float:
    """The same forward recursion for one long word, a block of places at a time."""
    last, reach = [0.0], max(pieces.by_length)  # forward values of the places before
    for lo in range(0, len(codes), 1 << 16):
        back = max(0, lo - reach + 1)
        part = codes[back : lo + (1 << 16)]
        found = {k: ids[:, 0].tolist() for k, ids in pieces.found(part[None], inner=back > 0).items()}
        spell = (spelled(part) * w.byte).tolist()
        for t in range(lo - back + 1, len(part) + 1):
            terms = [last[-1] + spell[t - 1]] if back + t > 1 else []
            for k, ids in found.items():
                if k <= t and ids[t - k] >= 0:
                    terms.append(last[-k] + w.piece[ids[t - k]])
            top = max(terms)
            last.append(top + math.log(sum(math.exp(x - top) for x in terms)))
            if len(last) > 2 * reach:
                del last[:-reach]
    return last[-1] + w.end


def _same_length(words: list[str], classes: list[int]):
    """(places, class, codes) of words of one length and class."""
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (word, c) in enumerate(zip(words, classes)):
        groups.setdefault((c, len(word)), []).append(i)
    for (c, n), every in groups.items():
        many = 1 if n >= STRETCH else 1 + AT_ONCE // (n + 1)
        for a in range(0, len(every), many):
            at = every[a : a + many]
            codes = np.frombuffer("".join(MARK + words[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield at, c, codes.reshape(len(at), n + 1)


def likelihoods(pieces: Pieces, words: list[str], classes: list[int], weights: dict[int, Weights]) -> np.ndarray:
    """Log likelihood of each word by the weights of its class."""
    out = np.zeros(len(words))
    for at, c, codes in _same_length(words, classes):
        out[at] = [long_word(pieces, codes[0], weights[c])] if codes.shape[1] > STRETCH else forward(pieces, codes, weights[c])[0]
    return out


def _gathered(batches):
    """Tables of some GATHERED rows, so that many words have one length."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= GATHERED:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def words_of(text: bytes):
    """Lists of the words of a text, A-Z lower-cased, a few megabytes at a time."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + SPLIT) if at + SPLIT < len(text) else None
        to = cut.start() if cut else len(text)
        yield text[at:to].lower().split()
        at = to


def _packed(docs: DataFrame) -> DataFrame:
    """Rows (pack, lang, at, word, n) of the distinct words of packs of texts, n in training; and one row (pack, lang, n, ids, held, lengths, tokens) a pack, n its training documents."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["pack", "lang", "at", "word", "n", "ids", "held", "lengths", "tokens"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), None, pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary()]

    def run(batches):
        z, task, made = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32, 0
        open_: dict[str, tuple] = {}

        def flush(id_kind):
            nonlocal made
            for lang, (table, ids, held, parts) in open_.items():
                lengths = np.array([sum(map(len, p)) for p in parts], np.int32)
                tokens = np.concatenate([t for p in parts for t in p] or [np.zeros(0, np.int32)])
                train = np.repeat(~np.array(held), lengths)
                n = np.bincount(tokens[train], minlength=len(table))
                one = lambda v, t: pa.array([v], t)
                head = [task + made, lang, None, None, held.count(False), ids, held, lengths.tolist(), z.compress(tokens.tobytes())]
                yield pa.RecordBatch.from_arrays([one(v, t or pa.list_(id_kind)) for v, t in zip(head, types)], names)
                words = list(table)
                for a in range(0, len(words), 50_000):
                    some = words[a : a + 50_000]
                    k = len(some)
                    row = [np.full(k, task + made), [lang] * k, np.arange(a, a + k, dtype=np.int32), pa.array(some, pa.binary()).cast(pa.string()), n[a : a + k]]
                    yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(row, types)] + [pa.nulls(k, t or pa.list_(id_kind)) for t in types[5:]], names)
                made += 1
            open_.clear()

        size, kind = 0, pa.null()
        for batch in batches:
            kind = batch.column("doc_id").type
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
            for doc_id, out, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("lang").to_pylist(), texts):
                text = text.as_py()
                table, ids, held, parts = open_.setdefault(lang, ({}, [], [], []))
                ids.append(doc_id)
                held.append(out)
                parts.append([np.array([table.setdefault(w, len(table)) for w in words], np.int32) for words in words_of(text)])
                size += len(text) + 64
                if size >= PACK:
                    yield from flush(kind)
                    size = 0
        if open_:
            yield from flush(kind)

    return docs.mapInArrow(run, f"pack long, lang string, at int, word string, n long, ids array<{id_type}>, held array<boolean>, lengths array<int>, tokens binary")


def _discount(n1: Column, n2: Column) -> Column:
    """Absolute discount from how many words come once and twice."""
    return F.least(F.lit(0.9), F.greatest(F.lit(0.1), F.coalesce(n1 / F.nullif(n1 + 2 * n2, F.lit(0)), F.lit(0.5))))


def fitted(lexicon: DataFrame, classes: dict[str, int], path: str, rounds: int) -> dict[int, Weights]:
    """Piece weights of each class by expectation maximisation over its distinct training words; class 0 is fitted on the words of all."""
    pieces, context = _pieces(path), lexicon.sparkSession.sparkContext
    weights = {c: Weights(pieces) for c in [0, *classes.values()]}
    rows = lexicon.where("c > 0").select("lang", "word")
    for _ in range(rounds):
        known = context.broadcast(weights)

        def uses(batches):
            mine, total = _pieces(path), {}
            for some in _gathered(batches):
                words, groups = [], []
                for lang, word in zip(*(c.to_pylist() for c in some.columns)):
                    # a longer word counts as its stretches
                    for a in range(0, len(word), STRETCH - 1):
                        words.append(word[a : a + STRETCH - 1])
                        groups.append(classes.get(lang, 0))
                for _, c, codes in _same_length(words, groups):
                    total[c] = total.get(c, 0) + expected(mine, codes, known.value[c])
            for c, v in total.items():
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at.astype(np.int32)), pa.array(v[at])], ["c", "at", "v"])

        # a row for each piece of each class
        found = rows.mapInArrow(uses, "c int, at int, v double").groupBy("c", "at").agg(F.sum("v").alias("v")).toArrow()
        counts = {c: np.zeros(len(pieces.text) + 2) for c in weights}
        for c in weights:
            part = found.filter(pc.equal(found.column("c"), c))
            counts[c][part.column("at").to_numpy()] = part.column("v").to_numpy()
        counts[0] = sum(counts.values())
        weights = {c: Weights(pieces, v) for c, v in counts.items()}
        known.unpersist()
    return weights


def lattice_scores(docs: DataFrame, path: str, modulus: int = 7, remainder: int = 2, rounds: int = 3, again: float = 0.05, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of docs.

    Documents whose crc32(id) leaves `remainder` are held out; the others train. A text is its words, A-Z
    lower-cased, then an end. base_score sums log10((c + 1) / (N + V + 1)) over these tokens.

    score is log10 of the text's likelihood over all segmentations of its lattice. Edges over a part of a word
    are the pieces of an existing vocabulary (`path`, the file on every machine): the weights start at the vocabulary's
    scores and are refitted, by language, on all distinct training words. Edges over a whole word are
    its discounted count in its language and, with a small share, in all training text; what discounts
    free goes to the pieces. A third edge repeats a word of the text so far, with weight `again` times its share of these
    words. Pieces cannot reach over a marker, so the forward recursion passes every word's end: a word's
    inner lattice is summed once for each language and distinct word, and a text's recursion runs over words.

    Texts are packed. A pack sends each distinct word once; counts and likelihoods of words come back to
    the packs by joins, and only there words stand in order. A pack is bounded by PACK bytes or one text.

    A null text is empty: its only token is the end. A null id trains. Null languages are one language; a
    language that does not train is scored by the words and pieces of all. Without any training text the end
    has half the weight, and words the other half by the vocabulary's scores. Repeated rows each give a row; other columns
    are ignored. An empty table gives no rows.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
    lang = F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit(""))
    id_type = docs.schema[id_col].dataType.simpleString()
    packs = common.written(_packed(docs.select(F.col(id_col).alias("doc_id"), held.alias("held"), lang.alias("lang"), F.col(text_col).alias("text"))))
    heads, asked = packs.where("at is null"), packs.where("at is not null").select("pack", "lang", "at", "word", "n")

    lexicon = common.written(asked.groupBy("lang", "word").agg(F.sum("n").alias("c")))
    every = lexicon.groupBy("word").agg(F.sum("c").alias("c_all"))
    facts = lambda c: [F.coalesce(F.sum(c), F.lit(0)).alias("words"), F.count_if(F.col(c) > 0).alias("v"), F.count_if(F.col(c) == 1).alias("n1"), F.count_if(F.col(c) == 2).alias("n2")]
    ends = heads.groupBy("lang").agg(F.sum("n").alias("ends"))
    stats = common.written(ends.join(lexicon.groupBy("lang").agg(*facts("c")), "lang", "left").na.fill(0))
    words = common.written(lexicon.join(every, "word"))
    whole = every.agg(*facts("c_all"), _discount(F.count_if(F.col("c_all") == 1), F.count_if(F.col("c_all") == 2)).alias("d")).first()
    n_ends = stats.agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0]
    total, distinct, d = whole["words"] + n_ends, whole["v"] + (n_ends > 0), whole["d"]

    # what all leave to the pieces, and the weight of the end in all
    spare = d * distinct / total if total else 0.5
    end_all = max(n_ends - d, 0) / total if total else 0.5
    d_l, n_l = _discount(F.col("n1"), F.col("n2")), F.col("words") + F.col("ends")
    left = F.when(n_l > 0, d_l * (F.col("v") + (F.col("ends") > 0).cast("int")) / n_l).otherwise(1.0)
    to_all = F.when(n_l > 0, left * F.lit(TO_ALL)).otherwise(1.0)
    to_pieces = F.when(n_l > 0, left * F.lit(1 - TO_ALL + TO_ALL * spare)).otherwise(F.lit(spare))
    end = F.when(n_l > 0, F.greatest(F.col("ends") - d_l, F.lit(0.0)) / n_l).otherwise(0.0) + to_all * end_all
    stats = common.written(stats.select("lang", "v", d_l.alias("d"), n_l.alias("n_lang"), to_all.alias("to_all"), to_pieces.alias("to_pieces"), F.log(end).alias("end")))
    classes = {r["lang"]: i + 1 for i, r in enumerate(stats.where("v > 0").orderBy(F.desc("v"), "lang").limit(LANGUAGES).collect())}
    weights = docs.sparkSession.sparkContext.broadcast(fitted(lexicon, classes, path, rounds))
    stats = F.broadcast(stats) if stats.count() <= MOST_BROADCAST else stats

    def inner(batches):
        for some in _gathered(batches):
            groups = [classes.get(x, 0) for x in some.column("lang").to_pylist()]
            value = pa.array(likelihoods(_pieces(path), some.column("word").to_pylist(), groups, weights.value))
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in some.columns), value], ["lang", "word", "c", "c_all", "inner"])

    scored = words.select("lang", "word", "c", "c_all").mapInArrow(inner, "lang string, word string, c long, c_all long, inner double").join(stats, "lang")
    by_all = F.col("to_all") * F.greatest(F.col("c_all") - d, F.lit(0.0)) / max(total, 1)
    by_lang = F.when(F.col("n_lang") > 0, F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("n_lang")).otherwise(0.0)
    # a word of no training text has its inner lattice only, which may be below any double
    weight = F.when(F.col("c_all") > 0, F.log(by_lang + by_all + F.col("to_pieces") * F.exp("inner"))).otherwise(F.log("to_pieces") + F.col("inner"))
    scored = common.written(scored.select("lang", "word", "c_all", weight.alias("w")))
    answers = asked.join(scored, ["lang", "word"]).groupBy("pack").agg(F.collect_list(F.struct("at", "c_all", "w")).alias("answers"))
    met = heads.drop("at", "word", "n").join(stats.select("lang", "end"), "lang").join(answers, "pack", "left")

    def score(batches):
        z, floor = zstandard.ZstdDecompressor(), math.log10(total + distinct + 1)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, out = batch.column("ids")[i].values, batch.column("held")[i].values
                lengths = np.array(batch.column("lengths")[i].values, np.int64)
                tokens = np.frombuffer(z.decompress(batch.column("tokens")[i].as_py()), np.int32)
                got = batch.column("answers")[i]
                at, c, w = (np.array(got.values.field(k)) for k in range(3)) if got.is_valid else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
                if len(tokens) and (len(at) != tokens.max() + 1):
                    raise ValueError("a pack lacks answers to some of its words")
                order = np.argsort(at)
                c, w = c[order], w[order]
                row = np.repeat(np.arange(len(lengths)), lengths)
                base = np.bincount(row, np.log10(c[tokens] + 1) - floor, len(lengths)) + math.log10(n_ends + 1) - floor
                known = np.bincount(row, c[tokens] > 0, len(lengths)).astype(np.int64) + (n_ends > 0)
                value = np.bincount(row, repeated(row, tokens, w, again), len(lengths)) + batch.column("end")[i].as_py() + np.where(lengths > 0, math.log1p(-again), 0)
                yield pa.RecordBatch.from_arrays([ids, out, pa.array(lengths + 1), pa.array(known), pa.array(np.full(len(lengths), total)), pa.array(base), pa.array(value / math.log(10))], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return met.mapInArrow(score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def repeated(row: np.ndarray, tokens: np.ndarray, w: np.ndarray, again: float) -> np.ndarray:
    """Log weight of each token of texts in a row: its word's, and, from the second token on, that of repeating what stands before in the text."""
    n = len(tokens)
    key = row * (int(tokens.max()) + 1 if n else 1) + tokens
    order = np.argsort(key, kind="stable")
    first = np.r_[True, np.diff(key[order]) != 0][:n]
    seen = np.empty(n, np.int64)
    seen[order] = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    begins = np.r_[True, np.diff(row) != 0][:n]
    before = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    own = w[tokens] + np.where(before > 0, math.log1p(-again), 0)
    some = seen > 0
    own[some] = np.logaddexp(own[some], np.log(again * seen[some] / before[some]))
    return own
