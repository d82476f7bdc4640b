"""The numbered operators against brute force, the libraries and held-out truth, on small hard tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from offerloom.llm import chunk_dedup, grid_join, html_text, ngram_quality, personal_data, phrase_dedup, piece_codec, source_mix, token_combo_join, token_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n long, recipe string, rep string"


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, nulls, empties, clashing columns and repeated rows."""
    rng = random.Random(seed)
    words = [rng.choice("ab cd éf gh ij kl Mn op qr st uv wx yz The of".split()) + rng.choice(("", "x", "ing")) for _ in range(60)]
    some = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, base = some(40), some(70)
    texts = [None, "", "  \n", "one", "One", "two words", "a b c d", "A B C D", "x" * 5000, "Und " * 90]
    for _ in range(n):
        kind = rng.random()
        t = base.split()
        if kind < 0.3:
            t[rng.randrange(70)] = some(1)
            texts.append(" ".join(t))
        elif kind < 0.5:
            texts.append(some(rng.randint(1, 30)) + "\n" + passage + " " + some(rng.randint(1, 30)))
        elif kind < 0.6:
            texts.append(base.upper() if rng.random() < 0.5 else base)
        else:
            texts.append(some(rng.randint(1, 120)))
    return [(i, t, rng.choice(("en", "de", None)), rng.choice(("s1", "s2", "é", None)), 1, "r", "p") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_dedup(spark, docs, empty):
    rows = {r["doc_id"]: (r["text"] or "").translate(FOLD) for r in docs.collect()}
    got = by_id(chunk_dedup.exact_dedup(docs, digest_size=1))  # ids of one byte clash and are made anew
    for i, t in rows.items():
        same = [j for j, u in rows.items() if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))
        assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert chunk_dedup.exact_dedup(empty).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "A")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in chunk_dedup.exact_dedup(twice).collect()) == [(0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]


def test_chunks_rebuild_texts():
    rng = np.random.default_rng(3)
    raw = "".join(rng.choice(list("abcé 漢😀\n"), 300_000)).encode()
    data = np.frombuffer(raw, np.uint8)
    ends = chunk_dedup.chunk_ends(data, np.array([0, len(data)]))
    parts = [raw[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends)]
    assert b"".join(parts) == raw and max(map(len, parts)) <= chunk_dedup.LONGEST
    assert all(p.decode() for p in parts)


@pytest.mark.parametrize("frequent", [0, 3])
def test_jaccard_components(docs, empty, frequent, monkeypatch):
    monkeypatch.setattr(token_combo_join, "FREQUENT", frequent)
    sets = {}
    for r in docs.collect():
        w = WORD.findall((r["text"] or "").translate(FOLD))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = by_id(token_combo_join.jaccard_components(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}
    if frequent:
        assert token_combo_join.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("edge, low, large", [(178, 170, range(1, 12, 2)), (421, 332, [0])])
def test_near_copies_of_two_classes_link(spark, edge, low, large):
    """Groups of near copies whose sizes stand on both sides of a class: all shared tokens are frequent."""
    rng = random.Random(edge)
    texts = []
    for group in range(4):
        base = [f"w{group}x{i}" for i in range(edge + 24)]
        for i in range(12):
            t = base[: edge + 8 if i in large else low + 4]
            t[-1] = f"own{i}"
            at = rng.randrange(len(t))
            texts.append(t[:at] + [f"new{i}"] + t[at + 1 :])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    assert {token_combo_join.length_class(len(s), 3, 4) for s in sets} == {token_combo_join.length_class(k, 3, 4) for k in (edge, low)}
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i < j and 100 * len(a & b) >= 75 * len(a | b):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {i: r["component_id"] for i, r in by_id(token_combo_join.jaccard_components(docs)).items()} == dict(enumerate(root))
    assert len(set(root)) < 8


def brute_repeats(rows, window=20):
    """Rows in order; (words, removed, kept words) of each."""
    seen, want = set(), []
    for t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        want.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return want


@pytest.mark.parametrize("pack, automaton", [(4 << 20, 160_000), (1500, 90)])
def test_repeated_passages(docs, empty, pack, automaton, monkeypatch):
    monkeypatch.setattr(phrase_dedup, "PACK", pack)
    monkeypatch.setattr(phrase_dedup, "PER_AUTOMATON", automaton)
    monkeypatch.setattr(phrase_dedup, "PER_PART", 3 if pack == 1500 else 1024)
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    want = dict(zip((r["doc_id"] for r in rows), brute_repeats([r["text"] for r in rows])))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in by_id(phrase_dedup.repeated_passages(docs)).items()} == want
    if pack == 1500:
        assert phrase_dedup.repeated_passages(empty).count() == 0


def test_repeated_passages_of_repeated_rows_and_long_texts(spark, monkeypatch):
    """Null and repeated ids, equal rows, a text of 60,000 words that repeats itself, periodic texts over packs."""
    monkeypatch.setattr(phrase_dedup, "PACK", 20_000)
    rng = random.Random(8)
    some = lambda k: " ".join(rng.choice("a b c d e f".split()) + rng.choice("xyz") for _ in range(k))
    passage = some(300)
    long = some(30_000) + " " + passage + "\x00 " + some(29_000) + " " + passage
    rows = [(1, long), (2, passage), (2, passage), (3, "n " * 500), (4, "n " * 25), (5, some(40) + " " + passage[:200] + " " + some(10)), (None, passage), (None, "z " * 30)]
    got = phrase_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), keep_text=True).collect()
    want = brute_repeats([t for _, t in rows[:6]])
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got if r["doc_id"]) == sorted((i, *w) for (i, _), w in zip(rows, want))
    assert sorted((r["n_words"], r["n_removed"]) for r in got if r["doc_id"] is None) == [(30, 29), (300, 300)]


def test_mix_meets_targets(docs, empty):
    got = source_mix.mix_sources(docs).collect()
    again = source_mix.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["repeats"] + r["part"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target) and all(target[s] <= 3 * size[s] + 1e-6 for s in target)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 or all(target[s] == 3 * size[s] for s in target)
    rows = source_mix.take(docs, source_mix.mix_sources(docs))
    assert rows.columns == docs.columns and sum(len(WORD.findall(r["text"] or "")) for r in rows.collect()) == sum(taken.values())
    assert source_mix.mix_sources(empty).count() == 0


def fuzz(n=400):
    rng = random.Random(5)
    signs = list("ab  \n\t▁'sSİΣσé́ﬁ①　😀\x1c\x00. ") + ["<|endoftext|>", "</s>", "<s>", "  ", "I'll", "aaaaaaaa", "!!!!!", "\r\n"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [None, "x" * 20000, "Überraschung für Κώστας"]


def test_token_counts_equal_library(spark):
    from tokenizers import Tokenizer

    texts, path = fuzz(), public_tokenizers.path("word_bpe_49k.json")
    got = by_id(token_count.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, limit=100))
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [(got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) for i in range(len(texts))] == [(n, len((t or "").encode()), n > 100) for n, t in zip(want, texts)]


def test_pieces_equal_library(spark):
    from sentencepiece import SentencePieceProcessor

    texts, path = fuzz(), public_tokenizers.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    got = by_id(piece_codec.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, keep_ids=True, keep_text=True))
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_eos=True)
        assert (got[i]["ids"], got[i]["decoded"], got[i]["n_tokens"]) == (ids, sp.decode(ids), len(ids))
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def brute_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and (not 12 <= len(d) <= 19 or sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), ("email", "ip", "card", "phone").index(kind), m.end(), kind))
    return sorted(out)


def test_personal_data(spark):
    rng = random.Random(9)
    bits = ["a.b@c.de", "x@y", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "010.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (264) 555-6638", "+12", "é😀", " ", "ab", '="', "7", "@", ".", "-"]
    texts = ["".join(rng.choice(bits) + rng.choice(("", " ")) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    texts += [None, "", "9" * 30000, "a" * 30000, "1.2.3.4 " * 2000] + [f"my password={hashlib.md5(str(i).encode()).hexdigest()} ok and year 2024-05-01 then" for i in range(40)]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, email string")
    got = by_id(personal_data.personal_data(df))
    for i, t in enumerate(texts):
        base = brute_spans(t or "")
        shown = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert got[i]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest(), t[:80]
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[3] == k for s in base) for k in ("email", "ip", "card", "phone")]
        assert {f"{k}:{a}:{b}" for a, _, b, k in base} <= set(got[i]["spans"].split(",")) | {""}
    assert all("secret:12:44" in got[i]["spans"] for i in range(len(texts) - 40, len(texts)))
    assert personal_data.personal_data(df.where("false")).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    rows = [(c + rng.normal(scale=s, size=16)).tolist() for c in centres for s in (0.05, 0.1, 0.2, 0.3) for _ in range(12)]
    rows += [rows[0]] * 5 + [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    good = [i for i, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    link = {i: {j for j in good if j != i and len(rows[i]) == len(rows[j]) and np.dot(rows[i], rows[j]) / (np.linalg.norm(rows[i]) * np.linalg.norm(rows[j])) >= 0.95} for i in good}
    low = {i: i for i in range(len(rows))}
    for _ in rows:
        for i in good:
            low[i] = min([low[i], *(low[j] for j in link[i])])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in grid_join.near_vectors(df).collect()}
    assert got == {i: (len(link.get(i, ())), low[i], low[i] == i) for i in range(len(rows))}
    assert grid_join.near_vectors(df.where("false")).count() == 0


def kneser_ney(texts, order=4):
    """Chance of a character after its context by recursion over plain counters."""
    top = Counter()
    for t in texts:
        t = "\x02" * (order - 1) + " ".join(t.split())
        top.update(t[i : i + order] for i in range(len(t) - order + 1))
    level = {order: top}
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    cuts = {}
    for k, c in level.items():
        n = [sum(v == j for v in c.values()) for j in range(5)]
        y = n[1] / (n[1] + 2 * n[2])
        cuts[k] = [0, *(min(j, max(0.05, j - (j + 1) * y * n[j + 1] / n[j] if n[j] else 0.5)) for j in (1, 2, 3))]

    def chance(g):
        if not g:
            return 1 / (len(level[1]) + 1)
        k, ctx = len(g), g[:-1]
        after = [v for h, v in level[k].items() if h[:-1] == ctx]
        if not after:
            return chance(g[1:])
        d = cuts[k]
        c = level[k].get(g, 0)
        return max(0, c - d[min(c, 3)]) / sum(after) + sum(d[min(v, 3)] for v in after) / sum(after) * chance(g[1:])

    return chance


def test_model_equals_recursion_and_rejects_junk(spark):
    rng = random.Random(4)
    parts = "the of and ing er on an re en at".split()
    prose = lambda n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."
    rows = [(i, prose(rng.randint(5, 60)), "en") for i in range(120)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in prose(30).split()), "en") for i in range(10)] + [(300, None, "en"), (301, " ", None), (302, "etwas anderes", "de"), (303, prose(10), "en"), (303, prose(10), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2).cache()
    labels = spark.createDataFrame([(i, 1, 0) for i in range(90)] + [(200, 0, 0), (5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = ngram_quality.KneserNey(ngram_quality.gram_counts(docs.where("doc_id < 60").select("lang", "text")))
    chance = kneser_ney([t for i, t, _ in rows if i < 60])
    asked = spark.createDataFrame([("en", g) for g in ("the ", "\x02\x02\x02t", "zzzz", "ing!", " of ")], "lang string, gram string")
    for r in model.log_chance(asked).collect():
        assert abs(np.exp(r["logp"]) - chance(r["gram"])) < 1e-9
    got = ngram_quality.quality(docs, labels).collect()
    kept = {r["doc_id"]: r["keep"] for r in got}
    assert len(got) == len(rows) and all(kept[i] for i in range(120)) and not any(kept[200 + i] for i in range(10))
    assert (kept[300], kept[301], kept[302], kept[303]) == (False, False, True, True)
    assert ngram_quality.quality(docs.where("false"), labels).count() == 0


def test_main_text(spark):
    prose = [f"{w} word, other words and {w} more of the text number {i}." for i, w in enumerate("alpha beta gamma delta epsilon".split() * 8)]
    pages = [html_text._training_page(random.Random(i), prose).replace("§", "") for i in range(60)]
    model = html_text.fit_extractor(pages, made=250)
    hit = total = 0
    for i in range(1000, 1080):  # held-out pages of known make
        nodes = html_text.parse(html_text._training_page(random.Random(i), prose))
        truth = ["§" in n.text for n in nodes]
        for n in nodes:
            n.text = n.text.replace("§", "")
        out = html_text.decode(nodes, model.predict(html_text.features(nodes)))
        assert all(out[k] <= out[nodes.index(n.parent)] for k, n in enumerate(nodes) if n.parent is not None)
        hit += sum(o for o, t in zip(out, truth) if t)
        total += sum(truth)
    assert hit / total > 0.95
    odd = [None, "", "<", "<p", "plain", "<article><p>A &amp; B<br>C</p><p>D&nbsp;&eacute;</article><nav><a href=x>no</a></nav>" * 1, "<b>" * 3000]
    df = spark.createDataFrame([(i, "u", h, "t") for i, h in enumerate(odd)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract_main_text(df).collect()}
    assert got[0]["text"] == "" and got[1]["n_chars"] == 0 and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_text.extract_main_text(df.where("false")).count() == 0


def test_quality_threshold_is_a_quantile_of_the_language(spark):
    """Texts of repeated words: nearly all must go; a language without held-out text has a threshold too."""
    rng = random.Random(6)
    parts = "the of and ing er on an re en at".split()
    prose = lambda n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))
    ids = spark.range(2000).select("id", (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).alias("held")).collect()
    trained = [r["id"] for r in ids if not r["held"]][-40:]
    rows = [(i, prose(rng.randint(5, 60)), "en") for i in range(300)] + [(i, prose(40), "de") for i in trained] + [(3000 + i, prose(40), "de") for i in range(110)]
    rows += [(5000, "zq xv jw kp " * 40, "de")] + [(6000 + i, " ".join([rng.choice(("Thsh", "Ea", "Rnto", "Gndi"))] * 60), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2).cache()
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(i, 1, 0) for i in trained], "doc_id long, quality int, toxic int")
    got = by_id(ngram_quality.quality(docs, labels))
    held = [r["id"] for r in ids[:300] if r["held"]]
    assert sum(not got[i]["keep"] for i in held) <= 0.02 * len(held)
    # the threshold is a quantile of held-out levels, so none of them is far below it
    levels = [(np.log(got[i]["perplexity"]) * got[i]["n_chars"] + 60 * np.median([np.log(got[j]["perplexity"]) for j in held])) / (got[i]["n_chars"] + 60) for i in held]
    assert np.log(got[0]["threshold"]) <= max(levels) + 0.01
    assert not any(got[6000 + i]["keep"] for i in range(20)) and not got[5000]["keep"]
    assert sum(not got[i]["keep"] for i in trained) <= 1 and sum(not got[3000 + i]["keep"] for i in range(110)) <= 2


def test_mixed_rows_with_null_and_repeated_ids(spark):
    rows = [(None, "n1 a b", "s1"), (None, "n2 c", "s1"), (7, "x y z", "s1"), (7, "other text", "s1"), (7, "x y z", "s1"), (8, "far away " * 9, "s2"), (9, "p q " * 20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    plan = source_mix.mix_sources(docs, carry=True)
    want = Counter()
    for r in plan.collect():
        text = r["row"]["text"]
        want[(r["doc_id"], " ".join(text.split()), r["row"]["source"])] += r["repeats"]
        if r["part"]:
            want[(r["doc_id"], " ".join(text.split()[: r["part"]]), r["row"]["source"])] += 1
    got = Counter((r["doc_id"], " ".join(r["text"].split()), r["source"]) for r in source_mix.take(docs, plan).collect())
    assert got == +want
    taken = sum(r["taken"] for r in plan.collect())
    assert sum(len(t.split()) * n for (_, t, _), n in got.items()) == taken
    with pytest.raises(ValueError):
        source_mix.take(docs, source_mix.mix_sources(docs))


def test_scores_and_threshold_equal_brute_force(spark):
    """Document scores by recursion over counters, the threshold as the held-out quantile, with NUL characters and a text in two segments."""
    rng = random.Random(12)
    parts = "the of and ing er on an re en at".split()
    prose = lambda n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 2))) for _ in range(n))
    rows = [(i, prose(rng.randint(3, 15)), "en") for i in range(60)] + [(100, "the\x00of and", "en"), (101, "\x00", "en"), (102, " \x00 ", None), (103, "漢" * 40, "en"), (None, "the of", "en"), (None, None, "en"), (5, "again the of", "en")]
    docs = spark.createDataFrame([(*r, 1.0, False) for r in rows], "doc_id long, text string, lang string, perplexity double, keep boolean").repartition(2).cache()
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    held = {r[0] for r in spark.range(60).where(F.pmod(F.xxhash64("id"), F.lit(ngram_quality.HELD_OUT)) == 0).collect()}
    trained = [t for i, t, _ in rows if i is not None and i < 60 and i not in held]
    chance = kneser_ney(trained)
    known = {}

    def score(text):
        t = "\x02" * 3 + " ".join((text or "").split())
        grams = [t[k : k + 4] for k in range(len(t) - 3)]
        for g in grams:
            if g not in known:
                known[g] = np.log(chance(g))
        return len(grams), sum(known[g] for g in grams)

    got = ngram_quality.quality(docs, labels, quantile=0.9).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
    for i, t, lang in rows:
        if i is not None and i != 5 and lang == "en" and (t or "").split():
            n, logp = score(t)
            assert of[i][0]["n_chars"] == n and abs(np.log(of[i][0]["perplexity"]) + logp / n) < 1e-6
    mine = [score(t) for i, t, _ in rows if i in held]
    levels = sorted(-p / n for n, p in mine)
    centre = levels[int(np.ceil(0.5 * len(levels))) - 1]
    limit = sorted((-p + 60 * centre) / (n + 60) for n, p in mine)[int(np.ceil(0.9 * len(mine))) - 1]
    assert all(abs(np.log(r["threshold"]) - limit) < 1e-6 for r in got if r["lang"] == "en")
    assert not of[103][0]["keep"] and sorted(r["keep"] for r in of[None]) == [False, True]


def test_grams_of_large_alphabets_stay_apart():
    signs = np.array([c for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000][:70_000], np.uint32)
    grams = np.stack([signs, signs, signs, np.roll(signs, 1)], 1)
    assert len(np.unique(ngram_quality.packed(grams, np.unique(grams)))) == len(grams)
    strings, count = ngram_quality.distinct(np.vstack([grams, grams[:5]]))
    assert len(strings) == len(grams) and sorted(count)[-5:] == [2] * 5


HAND = [
    ("<html><head><title>T</title><script>for(i=0;i<n;i++){document.write('<p>x</p>')}</script><style>p<b{}</style></head><body><header><a href=/>Home</a> <a href=/n>News</a></header><article><h1>{0}</h1><p>{1}</p><p>{2}</p></article><footer>Copyright notice of the site</footer></body></html>", 3),
    ("<body><div class='cookie-banner'>We use cookies to improve things <button>Accept all</button></div><nav class=menu><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><main><h2>{0}</h2><p title=don't>{1}<p>{2}</main><aside class=sidebar><h3>Popular now</h3><ul><li><a href=3>Something else entirely</a></ul></aside></body>", 3),
    ("<!--><body><div id=content class='post entry'><h1>{0}</h1><p>{1}</p><div class='ad-box advert'>Buy cheap things today</div><p>{2}</p></div><section id=comments class=comments><h3>2 comments</h3><div class=comment><p>First reader says something here</p></div></section></body>", 3),
    ("<article><p>{0}</p><blockquote><p>{1}</p></blockquote></article><form class=newsletter><label>Subscribe to our newsletter</label><input name=m><button>Send</button></form><script>if (a</b/.test(x)) { y = \"</article>\" }</script>", 2),
]


def test_main_text_of_hand_written_pages(spark):
    """Precision and recall of words on pages that the training generator did not make."""
    rng = random.Random(3)
    words = "river stone garden winter letter music bridge market window summer paper silver morning travel history kitchen".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    truth, pages = [], []
    for k in range(24):
        page, n = HAND[k % len(HAND)]
        parts = [prose(rng.randint(4, 8))] + [prose(rng.randint(25, 90)) for _ in range(n - 1)]
        for i, part in enumerate(parts):
            page = page.replace(f"{{{i}}}", part)
        truth.append(" ".join(parts))
        pages.append(page)
    stored = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    df = stored.withColumn("page_id", F.col("page_id") + 1000).unionByName(spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "page_id long, url string, html string"))
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(df).where("page_id < 1000").collect()}
    hit = sum(sum((Counter(got[k].split()) & Counter(t.split())).values()) for k, t in enumerate(truth))
    assert hit / sum(len(t.split()) for t in truth) > 0.95
    assert hit / sum(len(t.split()) for t in got.values()) > 0.95
    assert not any(w in t for t in got.values() for w in ("document.write", "test(x)", "<p>"))


def test_raw_elements_end_at_their_own_end_tag():
    texts = lambda page: [n.text for n in html_text.parse(page) if n.tag == "#text"]
    assert texts("<script>for(i=0;i<n;i++){}</script><p>a</p>") == ["a"]
    assert texts("<script>x='</p>'<!-- </SCRIPT\n><p>a") == ["a"] and texts("<style>a<b") == [] and texts("<script src=/a/>x</script>b") == ["b"]
    assert texts("<!--><p>a") == ["a"] == texts("<!-- x > --!><p>a") and texts("<p title=don't>it's</p>") == ["it's"] and texts("</ x>q") == ["q"]


def test_token_operators_on_null_and_repeated_rows(spark, empty):
    pieces, merges = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(None, "a b", 1), (None, None, 2), (7, "a b", 3), (7, "a b", 3), (7, "c" * 70_000 + " d", 4)], "doc_id long, text string, n_tokens int")
    for got in (piece_codec.encode_decode(df, pieces).collect(), token_count.token_counts(df, merges, limit=2048).collect()):
        assert sorted(r["doc_id"] or 0 for r in got) == [0, 0, 7, 7, 7]
        same = [r for r in got if r["doc_id"] == 7]
        assert len({r["n_tokens"] for r in same}) == 2
    assert piece_codec.encode_decode(empty, pieces).count() == 0 == token_count.token_counts(empty, merges, limit=2048).count()


def test_joins_on_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(base)), (1, " ".join(base)), (2, " ".join(base[:-3])), (None, " ".join(base)), (None, "x"), (3, " ".join(base[:150] * 200)), (4, " ".join(base[:150] * 201))]
    got = token_combo_join.jaccard_components(spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_shingles int")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3)]
    vectors = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = grid_join.near_vectors(vectors).collect()
    assert sorted((r["vec_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 2)]


def test_many_vector_lengths_all_join(spark):
    rows = [(i, [(j + 1.0) * (1 + i % 2) for j in range(i // 2 + 1)]) for i in range(2200)]
    got = grid_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links = 1").count()
    assert got == 2200


def test_learned_spans_find_planted_secrets(spark):
    """Votes, EM and the classifier together: planted secrets are added, dates and small numbers are not."""
    rng = random.Random(21)
    secret = lambda: hashlib.sha1(str(rng.random()).encode()).hexdigest()[: rng.choice((20, 32, 40))]
    plain = ["on 2024-05-01 we met", "chapter 12b of 1999", "the A4 paper and 3 pages", "in 1984 or 2001-02", "see fig-7 and table_2"]
    rows, where = [], {}
    for i in range(300):
        if i % 3 == 0:
            s = secret()
            t = f"intro {rng.choice(plain)} {rng.choice(('token', 'password', 'api_key', 'secret'))}{rng.choice(('=', ': ', ' = '))}{s} end"
            where[i] = (t.index(s), t.index(s) + len(s))
        else:
            t = f"{rng.choice(plain)} and {rng.choice(plain)}."
        rows.append((i, t))
    got = by_id(personal_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string")))
    caught = sum(f"secret:{a}:{b}" in got[i]["spans"].split(",") for i, (a, b) in where.items())
    false = sum(got[i]["n_added"] for i, _ in rows if i not in where)
    assert caught >= 0.95 * len(where) and false <= 0.02 * len(rows)
