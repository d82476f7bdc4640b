"""Selectors against a plain matcher over trees, and the order of a queue."""

import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from offerloom.operators import pages, selectors

SELECTORS = [
    "a", "*", ".x", "#i1", "div > p", "div span a", "p + a", "p ~ a", "div.x > .y + a", "ul li:first-child", "li:last-child a", "li:nth-child(2n+1)", "li:nth-child(-n+2)", "li:nth-last-child(2)", "p:nth-of-type(even)", "a:last-of-type", ":only-child",
    "div:not(.x)", "div:not(.x, .y) > p", "a:not(div a)", ":is(ul, div) > .y", "div:has(a)", "div:has(> a.x)", "p:has(+ a)", "p:has(~ a, + div)", "[data-k]", "[data-k=v1]", "[data-k^='v']", '[data-k$="2"]', "[data-k*=v]", "[data-k!=v1]", "[class~=y]", "[lang|=en]", "[data-k='V1' i]",
    "p:empty", "html:root", "a, p.y", "ul > li ~ li a.x", "div div > a:first-of-type",
]


def random_page(rng, depth=0):
    """Nested markup of divs, paragraphs, links and lists; no implied ends."""
    attrs = "".join(x for x in (rng.choice(["", ' class="x"', ' class="y x"', ' class="y"']), rng.choice(["", "", f' id="i{rng.randint(0, 3)}"']), rng.choice(["", f' data-k="v{rng.randint(1, 2)}"']), rng.choice(["", "", ' lang="en-GB"', ' lang="en"'])) if x)
    kind = rng.choice(["div", "div", "a", "span", "ul"] if depth < 4 else ["a"])
    if kind == "ul":
        return f"<ul{attrs}>" + "".join(f"<li>{random_page(rng, depth + 1)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
    if kind == "a":
        return rng.choice([f'<a href="/{rng.randint(0, 9)}"{attrs}>t</a>', f"<p{attrs}></p>", f"<p{attrs}>t</p>"])
    return f"<{kind}{attrs}>" + "".join(random_page(rng, depth + 1) for _ in range(rng.randint(0, 4))) + f"</{kind}>"


class Plain:
    """Matching from right to left over a tree of nodes, straight from the definitions."""

    def __init__(self, nodes):
        self.nodes, self.kids = nodes, {}
        for n in nodes:
            self.kids.setdefault(n["parent"], []).append(n)

    def siblings(self, n):
        return self.kids[n["parent"]]

    def up(self, n):
        return None if n["parent"] is None else self.nodes[n["parent"]]

    def below(self, n):
        for k in self.kids.get(n["pre"], []):
            yield k
            yield from self.below(k)

    def test(self, n, t):
        kind, attrs = t[0], n["attrs"]
        if kind == "any":
            return True
        if kind == "tag":
            return n["tag"] == t[1]
        if kind == "class":
            return t[1] in attrs.get("class", "").split()
        if kind == "attr":
            _, name, op, v, fold = t
            have = attrs.get(name)
            if op == "!=":
                return have != v
            if have is None or op is None:
                return have is not None
            if fold:
                have, v = have.lower(), v.lower()
            return {"=": have == v, "^=": have.startswith(v), "$=": have.endswith(v), "*=": v in have, "~=": v in have.split(), "|=": re.match(re.escape(v) + r"(-|$)", have) is not None}[op]
        if kind.startswith("nth-"):
            row = [s for s in self.siblings(n) if "of-type" not in kind or s["tag"] == n["tag"]]
            at = (row[::-1] if "last" in kind else row).index(n) + 1
            return any(t[1] * k + t[2] == at for k in range(100))
        if kind == "only-child":
            return len(self.siblings(n)) == 1
        if kind == "root":
            return n["parent"] is None
        if kind == "empty":
            return n["empty"] and not self.kids.get(n["pre"])
        if kind == "has":
            return any(self.has(n, s[0]) for s in t[1])
        found = any(self.matches(n, s) for s in t[1])
        return not found if kind == "not" else found

    def all(self, n, tests):
        return all(self.test(n, t) for t in tests)

    def has(self, n, step):
        row = self.siblings(n)
        at = row.index(n)
        pool = {">": self.kids.get(n["pre"], []), "+": row[at + 1 : at + 2], "~": row[at + 1 :]}.get(step[0], list(self.below(n)))
        return any(self.all(m, step[1]) for m in pool)

    def matches(self, n, steps):
        comb, tests = steps[-1]
        if not self.all(n, tests):
            return False
        if len(steps) == 1:
            return True
        row = self.siblings(n)
        before = row[: row.index(n)]
        if comb == ">":
            pool = [self.up(n)]
        elif comb == "+":
            pool = before[-1:]
        elif comb == "~":
            pool = before
        else:
            pool, m = [], self.up(n)
            while m is not None:
                pool.append(m)
                m = self.up(m)
        return any(m is not None and self.matches(m, steps[:-1]) for m in pool)


def test_selectors_equal_plain_matching(spark):
    rng = random.Random(11)
    html = [f"<html><body>{''.join(random_page(rng) for _ in range(6))}</body></html>" for _ in range(12)] + ["", "no markup"]
    table = selectors.node_table(spark.createDataFrame([(i, f"https://s.example/{i}", h) for i, h in enumerate(html)] + [(99, None, None)], "page_id long, url string, html string")).cache()
    want = {}
    for i, h in enumerate(html):
        tree = selectors._Tree("https://s.example/")
        tree.feed(h)
        plain = Plain(tree.finished())
        for n in plain.nodes:
            for css in SELECTORS:
                if any(plain.matches(n, steps) for steps in selectors.parsed_selector(css)):
                    want.setdefault((i, n["pre"]), set()).add(css)
    got = {}
    for some in (SELECTORS[:20], SELECTORS[20:]):
        for r in selectors.select_nodes(table, some).select("page_id", "pre", "hits").collect():
            got.setdefault((r["page_id"], r["pre"]), set()).update(r["hits"])
    assert got == want
    missed = set(SELECTORS) - set().union(*want.values())
    assert not missed, missed


def test_trees_end_what_html_ends():
    tree = selectors._Tree("https://s.example/a/")
    tree.feed('<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>x<div>y</div><table><tr><td>1<td>2<tr><td>3</table><br><img src=x><a href="b?c#d" HREF=z>t')
    got = [(n["tag"], n["parent"] if n["parent"] is None else tree.nodes[n["parent"]]["tag"], n["place"]) for n in tree.finished()]
    assert got == [
        ("ul", None, 1), ("li", "ul", 1), ("li", "ul", 2), ("ul", "li", 1), ("li", "ul", 1), ("li", "ul", 3), ("p", None, 2), ("div", None, 3), ("table", None, 4), ("tbody", "table", 1), ("tr", "tbody", 1), ("td", "tr", 1), ("td", "tr", 2), ("tr", "tbody", 2), ("td", "tr", 1),
        ("br", None, 5), ("img", None, 6), ("a", None, 7),
    ]
    assert tree.nodes[-1]["target"] == "https://s.example/a/b?c#d" and tree.nodes[0]["end"] == 5


@pytest.mark.parametrize("css", ["a:hover", "a::before", "div >", "> a", "a,,b", "a:nth-child(x)", "a[b", "a:not(b", "", "p:has(a b)", "a:contains('x')", "a.b:eq(2)"])
def test_unknown_forms_are_errors(spark, css):
    table = selectors.node_table(spark.createDataFrame([], "page_id long, url string, html string"))
    with pytest.raises(ValueError):
        selectors.select_nodes(table, [css])


def plain_queue(site, seeds, cap):
    """Pages in the order of a queue: {url: next url or None}."""
    seen, queue = [], deque(dict.fromkeys(seeds))
    while queue and len(seen) < cap:
        page = queue.popleft()
        if page in seen:
            continue
        seen.append(page)
        after = site.get(page)
        if after and after not in seen:
            queue.append(after)
    return set(seen)


@pytest.mark.parametrize("cap", [3, 17, 100])
def test_pages_are_seen_in_order_of_a_queue(spark, cap):
    rng = random.Random(cap)
    url = lambda i: f"https://s.example/l/{i}/"
    site = {url(i): url(rng.randint(0, 59)) if rng.random() < 0.9 else None for i in range(60)}
    html = {u: f'<a href="/d/{u.split("/")[4]}">d</a><p><a class="next" href="{n or "#"}">n</a></p>' for u, n in site.items()}
    banks = {b: [url(rng.randint(0, 59)) for _ in range(25)] for b in "abc"}
    stored = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(html.items())], "page_id long, url string, html string")
    seeds = spark.createDataFrame([(b, u, i) for b, us in banks.items() for i, u in enumerate(us)], "bank_id string, url string, seq long")
    recipes = pages.recipe_rows(spark, [{"bank_id": b, "detail_match": "^/d/", "next_css": "a + p > a.next"} for b in banks])
    got = pages.discover(seeds, pages.links_table(pages.parse_pages(stored)), recipes, cap=cap, nodes=selectors.node_table(stored))
    want = {(b, u.replace("/l/", "/d/")) for b, us in banks.items() for u in plain_queue(site, us, cap)}
    assert {(r["bank_id"], r["url"]) for r in got.where(F.col("error").isNull()).collect()} == want


def test_hops_keep_the_order_of_links(spark):
    """Behind a hop, pages come in order of the seeds and of the links in each, so the cap keeps the first ones."""
    html = {"https://s.example/a/": '<a href="/l/9">x</a><a href="/l/2">x</a>', "https://s.example/b/": '<a href="/l/5">x</a><a href="/l/9">x</a><a href="/l/1">x</a>'}
    html |= {f"https://s.example/l/{i}/": f'<a href="/d/{i}">d</a>' for i in range(10)}
    stored = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(html.items())], "page_id long, url string, html string")
    seeds = spark.createDataFrame([("k", "https://s.example/b", 1), ("k", "https://s.example/a", 2)], "bank_id string, url string, seq long")
    recipe = pages.recipe_rows(spark, [{"bank_id": "k", "hops": ["^/l/"], "detail_match": "^/d/", "next_css": "a.next"}])
    got = pages.discover(seeds, pages.links_table(pages.parse_pages(stored)), recipe, cap=3, nodes=selectors.node_table(stored)).collect()
    assert {r["url"] for r in got} == {f"https://s.example/d/{i}/" for i in (5, 9, 1)}
