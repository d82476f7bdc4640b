"""Personal data by weak supervision, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds. Possessive forms match the same texts without backtracking.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9]){11,}+"  # shorter runs fail the count of digits anyway
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: A run of letters, digits, dashes and slashes with a digit in it: what labelers vote on.
CANDIDATE = r"(?<![A-Za-z0-9_/-])(?=[A-Za-z_/-]*+[0-9])[A-Za-z0-9_/-]{6,}+"
#: Gazetteer of words that announce a personal or secret value.
ANNOUNCE = ("password", "passwd", "pwd", "passphrase", "token", "secret", "apikey", "api_key", "key", "auth", "ssn", "iban", "passport", "account", "pin", "tel", "phone", "mobile", "card", "contraseña", "passwort", "kennwort", "motdepasse")
#: Matches of a text that get their places together.
BLOCK = 64
FEATURES = ("v_shape", "v_gazetteer", "v_context", "v_base", "long", "digits", "letters")


def found(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<start, end, hit, left>> of the leftmost non-overlapping matches, in code points.

    The pieces between the matches and the matches themselves give all places; `left` is up to
    32 characters before the match. Texts that fail the cheap test `gate` are not searched.
    """
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.when(gate, F.zip_with(hits, F.slice(between, 1, F.size(hits)), lambda h, b: F.struct(h.alias("hit"), b.alias("left"))))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,hit:string,left:string>>)")
    width = lambda x: F.length(x["left"]) + F.length(x["hit"])
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  # a value used twice is computed once
    step = lambda acc, x: F.struct(
        (acc["at"] + width(x)).alias("at"),
        F.concat(acc["got"], F.array(F.struct((acc["at"] + F.length(x["left"])).alias("start"), (acc["at"] + width(x)).alias("end"), x["hit"].alias("hit"), F.right(x["left"], F.lit(32)).alias("left")))).alias("got"),
    )

    def placed(blocks):
        """Matches in blocks with their places: the blocks' starts first, so that no array that grows by one is long."""
        widths = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + width(x)))
        starts = F.aggregate(widths, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("got")), lambda a, w: F.struct((a["at"] + w).alias("at"), F.concat(a["got"], F.array(a["at"])).alias("got")), lambda a: a["got"])
        return F.flatten(F.zip_with(blocks, starts, lambda block, at: F.aggregate(block, F.struct(at.alias("at"), empty.alias("got")), step, lambda acc: acc["got"])))

    def blocked(pairs):
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(pairs) / BLOCK).cast("int") - 1), lambda b: F.slice(pairs, b * BLOCK + 1, BLOCK))

    return F.coalesce(once(pairs, lambda p: F.when(F.size(p) > 0, once(blocked(p), placed))), empty)


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    value = F.split(F.reverse(digits), "")
    value = F.transform(F.filter(value, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(value, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    octet = lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.right(F.concat(F.lit("000"), x), F.lit(3)).cast("int") <= 255)
    n = lambda x: F.length(digits_of(x))
    return {
        "email": found(text, EMAIL, text.contains("@")),
        "ip": F.filter(found(text, IP, digit & text.rlike(r"[0-9]\.[0-9]")), lambda x: F.forall(F.split(x["hit"], r"\."), octet)),
        "card": F.filter(found(text, CARD, digit), lambda x: n(x["hit"]).between(12, 19) & luhn(digits_of(x["hit"]))),
        "phone": F.filter(found(text, PHONE, digit & text.contains("+")), lambda x: n(x["hit"]).between(9, 15)),
    }


def with_votes(rows: DataFrame) -> DataFrame:
    """Rows with the base spans per kind and `cand`, the candidates with votes and features."""
    text = F.col("_text")
    rows = rows.withColumns(base_spans(text))
    tagged = lambda i, k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("order"), x["end"].alias("end"), F.lit(k).alias("kind")))
    rows = rows.withColumn("_base", F.concat(*[tagged(i, k) for i, k in enumerate(KINDS)]))
    rows = rows.withColumn("_found", found(text, CANDIDATE, text.rlike("[0-9]")))
    gazetteer = "(?i)(?:^|[^a-z])(?:" + "|".join(ANNOUNCE) + r")[\s\"'=:]{0,6}$"

    def vote(x):
        hit, left = x["hit"], x["left"]
        n, d = F.length(hit), F.length(digits_of(hit))
        inside = F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), inside.alias("inside"),
            F.when(hit.rlike("^[0-9a-fA-F]{12,}+$|^[0-9]{9,}+$"), 1).when((n <= 8) | ~hit.rlike("[0-9].*[0-9]"), -1).otherwise(0).alias("v_shape"),
            F.when(left.rlike(gazetteer), 1).otherwise(0).alias("v_gazetteer"),
            F.when(left.rlike(r"[=:]\s*[\"']?$"), 1).when(left.rlike(r"[a-zà-ÿ,.]\s$"), -1).otherwise(0).alias("v_context"),
            F.when(inside, 1).otherwise(0).alias("v_base"),
            F.when(n >= 16, 1).otherwise(0).alias("long"),
            F.when(d * 2 >= n, 1).otherwise(0).alias("digits"),
            F.when(hit.rlike("[A-Za-z]"), 1).otherwise(0).alias("letters"),
        )

    return rows.withColumn("cand", F.transform("_found", vote)).drop("_found")


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 40) -> list[float]:
    """Posterior of each vote pattern (votes, count) by expectation-maximisation.

    Two classes; each labeler votes -1, 0 or 1 with class-wise chances that EM estimates. The
    start is the share of positive votes. Every pattern of votes is one row, so the size of the
    table depends on the labelers, not on the data.
    """
    post = [(1 + sum(v > 0 for v in p)) / (2 + sum(v != 0 for v in p)) for p, _ in patterns]
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        yes = sum(q * n for q, (_, n) in zip(post, patterns))
        prior = (yes + 1) / (total + 2)
        chance = {}
        for j in range(len(patterns[0][0]) if patterns else 0):
            for v in (-1, 0, 1):
                a = sum(q * n for q, (p, n) in zip(post, patterns) if p[j] == v)
                b = sum((1 - q) * n for q, (p, n) in zip(post, patterns) if p[j] == v)
                chance[j, v] = ((a + 1) / (yes + 3), (b + 1) / (total - yes + 3))
        post = []
        for p, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[j, v][0] / chance[j, v][1]) for j, v in enumerate(p))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return post


def fit_classifier(table: list[tuple[tuple[int, ...], int, float]], rounds: int = 300) -> list[float]:
    """Logistic weights (bias first) on rows (features, count, posterior), by scaled gradient steps."""
    w, total = [0.0] * (len(FEATURES) + 1), sum(n for _, n, _ in table) or 1
    for _ in range(rounds):
        g = [0.0] * len(w)
        for x, n, q in table:
            e = n * (q - 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + sum(a * b for a, b in zip(w[1:], x)))))))
            g[0] += e
            for j, v in enumerate(x):
                g[j + 1] += e * v
        w = [a + 2.0 * (b / total - 0.001 * a) for a, b in zip(w, g)]
    return w


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, all_spans.

    Base spans come from fixed patterns and tests. Over runs with digits in them, regex,
    gazetteer and context labelers vote; one aggregate counts each pattern of votes and
    features (a few hundred at most). EM on these counts gives each labeler's reliability and
    each pattern a posterior; a logistic classifier trained on the posteriors decides the spans
    added, as kind "secret", outside base spans. Everything over rows is built-in functions.

    A null text is empty and has no spans. Ties in start go by kind order. Repeated rows each
    give a row; other columns are ignored; an empty table gives none.
    """
    rows = with_votes(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("_text")))
    with_digits = rows.where(F.col("_text").rlike("[0-9]"))
    counted = with_digits.select(F.explode("cand").alias("c")).groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES]).count().collect()
    votes: dict[tuple[int, ...], int] = {}
    for r in counted:
        votes[tuple(r)[:4]] = votes.get(tuple(r)[:4], 0) + r["count"]
    listed = sorted(votes.items())
    post = dict(zip([p for p, _ in listed], reliabilities(listed)))
    w = fit_classifier(sorted((tuple(r)[:7], r["count"], post[tuple(r)[:4]]) for r in counted))
    score = lambda c: sum((F.lit(a) * c[f] for a, f in zip(w[1:], FEATURES)), F.lit(w[0]))
    added = F.transform(F.filter("cand", lambda c: (~c["inside"]) & (score(c) > 0)), lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("order"), c["end"].alias("end"), F.lit("secret").alias("kind")))
    shown = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    rows = rows.withColumn("_added", added)
    every = F.concat("_base", "_added")
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(shown(F.col("_base")), 256).alias("base_sha256"),
        shown(every).alias("spans"), F.size("_added").cast("long").alias("n_added"),
        F.transform(F.array_sort(every), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("all_spans"),
    )
