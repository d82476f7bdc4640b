"""Lattice scores against a plain recursion over dictionaries."""

import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from offerloom.llm import queries, subword_score

PATH = public_tokenizers.path("piece_bpe_32k.model")
END = object()  # beside pieces, None stands for bytes
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, n int, score int"


def plain_pieces():
    sp = SentencePieceProcessor(model_file=PATH)
    usual = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)) and "▁" not in sp.id_to_piece(i)[1:]]
    return {sp.id_to_piece(i): 1 / (2 + max(0, -sp.get_score(i))) for i in usual}


class PlainWeights:
    def __init__(self, prior, uses=None):
        starts = {p: v for p, v in prior.items() if p[0] == "▁"}
        rest = {p: v for p, v in prior.items() if p[0] != "▁"}
        uses = uses or Counter()
        first, total = sum(starts.values()), sum(rest.values())
        start = {p: 500 * v / first + uses[p] for p, v in starts.items()}
        rest = {p: 500 * 0.7 * v / total + uses[p] for p, v in rest.items()}
        in_bytes, end = 0.5 + uses[None], 149.5 + uses[END]
        inside, first = sum(rest.values()) + in_bytes + end, sum(start.values())
        self.p = {p: v / first for p, v in start.items()} | {p: v / inside for p, v in rest.items()}
        self.byte, self.end = in_bytes / inside / 256, end / inside

    def edges(self, word):
        """(from, to, piece or None, weight) of a marked word."""
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + 30) + 1):
                piece = word[i:j]
                if piece in self.p and (piece[0] == "▁") == (i == 0):
                    yield i, j, piece, self.p[piece]
            if i:
                yield i, i + 1, None, self.byte ** len(word[i].encode())

    def chance(self, word):
        a = [1.0] + [0.0] * len(word)
        for i, j, _, w in sorted(self.edges(word), key=lambda e: e[:2]):
            a[j] += a[i] * w
        return a[-1] * self.end

    def uses(self, word):
        edges = sorted(self.edges(word), key=lambda e: e[:2])
        a, b = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
        for i, j, _, w in edges:
            a[j] += a[i] * w
        for i, j, _, w in reversed(edges):
            b[i] += w * b[j]
        out = Counter({END: 1.0})
        for i, j, piece, w in edges:
            out[piece] += a[i] * w * b[j] / a[-1] * (len(word[i].encode()) if piece is None else 1)
        return out


def discount(counts):
    n1, n2 = (sum(v == k for v in counts) for k in (1, 2))
    return min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))


def plain_scores(rows, rounds=3, again=0.05):
    """[(id, held out, tokens, known, N, base, score)] of rows (id, text, lang)."""
    docs = [(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, [w.decode() for w in (t or "").encode().lower().split()], lang) for i, t, lang in rows]
    by_lang, ends = {}, Counter()
    for _, held, words, lang in docs:
        if not held:
            by_lang.setdefault(lang, Counter()).update(words)
            ends[lang] += 1
    every = sum(by_lang.values(), Counter())
    n_ends = sum(ends.values())
    total, distinct, d = sum(every.values()) + n_ends, len(every) + (n_ends > 0), discount(every.values())
    prior = plain_pieces()
    weights = {lang: PlainWeights(prior) for lang in [*by_lang, "rest"]}
    for _ in range(rounds):
        uses = {lang: sum((weights[lang].uses("▁" + w) for w in c), Counter()) for lang, c in by_lang.items()}
        weights = {lang: PlainWeights(prior, u) for lang, u in (uses | {"rest": sum(uses.values(), Counter())}).items()}
    out = []
    for i, held, words, lang in docs:
        c, own_ends = by_lang.get(lang, Counter()), ends[lang]
        n = sum(c.values()) + own_ends
        dl, w = discount(c.values()), weights[lang if c else "rest"]
        left = dl * (len(c) + (own_ends > 0)) / n if n else 1.0
        spare, to_all = d * distinct / total if total else 0.5, 0.1 if n else 1.0
        score, seen = 0.0, Counter()
        for t, word in enumerate(words):
            p = (max(c[word] - dl, 0) / n if n else 0) + left * (to_all * (max(every[word] - d, 0) / max(total, 1) + spare * w.chance("▁" + word)) + (1 - to_all) * w.chance("▁" + word))
            score += math.log10(p if t == 0 else (1 - again) * p + again * seen[word] / t)
            seen[word] += 1
        end = (max(own_ends - dl, 0) / n if n else 0) + left * to_all * ((n_ends - d) / total if total else 0.5)
        score += math.log10((1 - again if words else 1) * end)
        base = sum(math.log10((x + 1) / (total + distinct + 1)) for x in [*(every[w] for w in words), n_ends])
        out.append((i, held, len(words) + 1, sum(every[w] > 0 for w in words) + (n_ends > 0), total, base, score))
    return out


def told(rows):
    return sorted((tuple(f"{v:.7f}" if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", 1, 1) for i, t, lang in rows], SCHEMA)


TEXTS = ["The offer of the day", "the other offer\nand the rest", "Der Tag und die Nacht und der Tag", "unbekanntes Wort im Tag", "naïve café 漢字 ▁mark a▁b \x00 x", "z" * 700, "", None, " \t ", "one one one one two"]


@pytest.fixture(scope="module")
def rows():
    out = [(i, TEXTS[i % len(TEXTS)], ["en", "de", None][i % 3]) for i in range(40)]
    return out + [(None, "the null id", "en"), (3, TEXTS[0], "en"), (3, TEXTS[0], "en"), (2000, "la langue que personne apprend", "fr")]


def test_scores_equal_plain_recursion(spark, rows):
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2]
    assert held and any(r[1] for r in held)
    short = [r for r in rows if not r[1] or len(r[1]) < 250]
    got = subword_score.lattice_scores(frame(spark, short).repartition(3), PATH)
    assert told(map(tuple, got.collect())) == told(plain_scores(short))


def test_long_words(spark):
    pieces = subword_score.Pieces(PATH)
    w, plain = subword_score.Weights(pieces), PlainWeights(plain_pieces())
    for word in ("hello" * 9, "z" * 40 + "é漢", "a"):
        codes = [ord(c) for c in "▁" + word]
        one = subword_score.long_word(pieces, subword_score.np.array(codes, "uint32"), w)
        assert math.isclose(one, math.log(plain.chance("▁" + word)), rel_tol=1e-9)
    # over the bound of a block, and in one word of a text
    word = "promotion" * 10_000
    one = subword_score.long_word(pieces, subword_score.np.array([ord(c) for c in "▁" + word], "uint32"), w)
    part = subword_score.long_word(pieces, subword_score.np.array([ord(c) for c in "▁" + word[:9_000]], "uint32"), w)
    assert one == pytest.approx(10 * (part - w.end), rel=1e-3)
    out = subword_score.lattice_scores(frame(spark, [(1, word + " x", "en"), (2, "x", "en")]), PATH).collect()
    assert all(math.isfinite(r["score"]) for r in out) and len(out) == 2


def test_pieces_sum_to_one():
    w = subword_score.Weights(subword_score.Pieces(PATH))
    starts = subword_score.Pieces(PATH).starts
    p = subword_score.np.exp(w.piece[:-1])
    assert p[starts].sum() == pytest.approx(1) and p[~starts].sum() + 256 * math.exp(w.byte) + math.exp(w.end) == pytest.approx(1)


def test_untrained_and_empty_tables(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = [(held[0], "only held out", "en"), (held[1], None, None), (held[2], "", "de")]
    got = subword_score.lattice_scores(frame(spark, rows), PATH)
    assert told(map(tuple, got.collect())) == told(plain_scores(rows))
    assert subword_score.lattice_scores(frame(spark, rows).where("false"), PATH).collect() == []


def test_words_of_large_texts(monkeypatch):
    monkeypatch.setattr(subword_score, "SPLIT", 10)
    text = b"The  quick\x0bbrown fox\njumps " + b"x" * 40 + b" over \xc2\xa0it\t"
    assert [w for part in subword_score.words_of(text) for w in part] == re.findall(rb"[^\x20\x09-\x0D]+", text.lower())


def test_held_out_texts_score_above_the_base(spark):
    out = queries.op13_subword_score(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert out["s"] / out["n"] > out["b"] / out["n"]
