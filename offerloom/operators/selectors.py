"""CSS selectors over a table of page elements in document order."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Elements without content; which open elements a start tag ends, up to which boundary.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
NODES = "page_id long, url string, pre int, end int, parent int, tag string, classes array<string>, attrs map<string,string>, place int, places int, kind_place int, kind_places int, empty boolean, href string, target string"

#: Elements of a batch that is handed on.
HANDED_ON = 10_000


class _Tree(HTMLParser):
    """Elements of a page in document order; open list items, cells, rows, options and paragraphs end where HTML says so."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.base, self.open, self.nodes, self.last = url, [], [], {}

    def _close(self, to: int) -> None:
        while len(self.open) > to:
            self.open.pop()["end"] = len(self.nodes) - 1

    def _implied(self, tag: str) -> None:
        ended, stop = ENDS.get(tag, ({"p"}, {"button", "table", "td", "th"}) if tag in BLOCKS else (set(), set()))
        cut = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] in stop:
                break
            if self.open[i]["tag"] in ended:
                cut = i
        if cut is not None:
            self._close(cut)

    def handle_starttag(self, tag, attrs):
        self._implied(tag)
        if tag == "tr" and self.open and self.open[-1]["tag"] == "table":
            self.handle_starttag("tbody", [])
        known: dict[str, str] = {}
        for k, v in attrs:
            known.setdefault(k, v or "")
        href, target = known.get("href"), None
        if href and not href.startswith(("#", "javascript:")):
            try:
                target = urljoin(self.base, href)
            except ValueError:
                pass
        up = self.open[-1] if self.open else None
        if up is not None:
            up["empty"] = False
        n = len(self.nodes)
        node = {"pre": n, "end": n, "parent": None if up is None else up["pre"], "tag": tag, "classes": known.get("class", "").split(), "attrs": known, "empty": True, "href": href, "target": target}
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                return self._close(i)

    def handle_data(self, data):
        if self.open:
            self.open[-1]["empty"] = False

    def finished(self) -> list[dict]:
        self._close(0)
        family: dict = {}
        for x in self.nodes:
            for key in ((x["parent"],), (x["parent"], x["tag"])):
                family.setdefault(key, []).append(x)
        for key, members in family.items():
            name = "place" if len(key) == 1 else "kind_place"
            for i, x in enumerate(members):
                x[name], x[f"{name}s"] = i + 1, len(members)
        return self.nodes


def node_table(pages: DataFrame) -> DataFrame:
    """A row for each element of pages (page_id, url, html): pre (place in the page), end (place of its last descendant), parent, tag, classes, attrs, places among its siblings and those of its tag, target of its href."""
    names = [f.split()[0] for f in NODES.split(", ")]
    types = [pa.int64(), pa.string(), *[pa.int32()] * 3, pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), *[pa.int32()] * 4, pa.bool_(), pa.string(), pa.string()]

    def told(some: list[tuple]) -> pa.RecordBatch:
        columns = [[t[0] for t in some], [t[1] for t in some], *([list(x[n].items()) if n == "attrs" else x[n] for _, _, x in some] for n in names[2:])]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            # pages are taken from their batch one at a time, and elements handed on in small batches
            for page_id, url, html in zip(*batch.columns):
                page_id, url = page_id.as_py(), url.as_py()
                tree = _Tree(url or "")
                tree.feed(html.as_py() or "")
                tree.close()
                for x in tree.finished():
                    held.append((page_id, url, x))
                    if len(held) >= HANDED_ON:
                        yield told(held)
                        held = []
            if held:
                yield told(held)

    return pages.select("page_id", "url", "html").mapInArrow(run, NODES)


# --- selectors ---------------------------------------------------------------------------

_NAME = r"(?:[\w-]|[^\x00-\x7F]|\\.)+"
_TOKEN = re.compile(
    rf"""(?P<space>\s*(?P<comb>[>+~,])\s*|\s+)|(?P<any>\*)|(?P<tag>{_NAME})|\.(?P<cls>{_NAME})|\#(?P<id>{_NAME})
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*!]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\s\]]+))\s*(?P<flag>[iIsS])?\s*)?\]
    |:(?P<pseudo>[\w-]+)(?P<args>\()?""",
    re.X,
)


def parsed_selector(css: str) -> list[list[tuple[str, list[tuple]]]]:
    """Alternatives of a selector, each a list of (combinator before it, tests); a form that is not known is an error."""
    out, steps, tests, comb, at = [], [], [], "", 0
    text = css.strip()
    if text[:1] in (">", "+", "~"):  # a relative selector, as in :has()
        comb, text = text[0], text[1:].lstrip()

    def close():
        if not tests:
            raise ValueError(f"selector {css!r}: nothing between combinators")
        steps.append((comb, list(tests)))
        tests.clear()

    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"selector {css!r}: cannot read {text[at:]!r}")
        at = m.end()
        g = m.groupdict()
        plain = lambda v: re.sub(r"\\(.)", r"\1", v)
        if g["space"] is not None:
            close()
            if g["comb"] == ",":
                out.append(list(steps))
                steps.clear()
                comb = ""
            else:
                comb = g["comb"] or " "
        elif g["any"]:
            tests.append(("any",))
        elif g["tag"]:
            if tests:
                raise ValueError(f"selector {css!r}: cannot read {g['tag']!r}")
            tests.append(("tag", plain(g["tag"]).lower()))
        elif g["cls"]:
            tests.append(("class", plain(g["cls"])))
        elif g["id"]:
            tests.append(("attr", "id", "=", plain(g["id"]), False))
        elif g["attr"]:
            value = next((g[k] for k in ("dq", "sq", "bare") if g[k] is not None), None)
            tests.append(("attr", g["attr"].lower(), g["op"], value, (g["flag"] or "").lower() == "i"))
        else:
            inner = None
            if g["args"]:
                depth, start, quote = 1, at, ""
                while depth:
                    if at >= len(text):
                        raise ValueError(f"selector {css!r}: an open parenthesis")
                    c = text[at]
                    if quote or c in "\"'":
                        quote = "" if c == quote else quote or c
                    else:
                        depth += (c == "(") - (c == ")")
                    at += 1
                inner = text[start : at - 1]
            tests.append(_pseudo(css, g["pseudo"].lower(), inner))
    close()
    return [*out, steps]


_FIXED = {"first-child": ("nth-child", 0, 1), "last-child": ("nth-last-child", 0, 1), "first-of-type": ("nth-of-type", 0, 1), "last-of-type": ("nth-last-of-type", 0, 1)}


def _pseudo(css: str, name: str, inner: str | None) -> tuple:
    if inner is None and name in _FIXED:
        return _FIXED[name]
    if inner is None and name in ("only-child", "only-of-type", "root", "empty"):
        return (name,)
    if inner is not None and name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
        m = re.fullmatch(r"\s*(?:(odd)|(even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*", inner.lower())
        if m is None:
            raise ValueError(f"selector {css!r}: cannot read :{name}({inner})")
        odd, even, a, sign, b, only = m.groups()
        if odd or even:
            return name, 2, 1 if odd else 0
        return (name, 0, int(only)) if only else (name, int(a + "1" if a in ("", "+", "-") else a), int((sign or "") + (b or "0")))
    if inner is not None and name in ("not", "is", "where", "matches", "has"):
        return ("is" if name in ("where", "matches") else name), parsed_selector(inner) if name != "has" else _alternatives(inner)
    raise ValueError(f"selector {css!r}: unknown :{name}")


def _alternatives(inner: str) -> list:
    """Relative selectors of a :has()."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(inner):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            parts.append(inner[last:i])
            last = i + 1
    return [parsed_selector(p)[0] for p in [*parts, inner[last:]]]

#: Tests that ask for other nodes or have selectors of their own.
INNER = ("has", "not", "is")


class _Marked:
    """A node table that gets a boolean column for each step of the selectors.

    Nodes of a page are a family in document order, so each combinator is a window over
    them: an ancestor reaches over a node if the farthest end of the chosen nodes before it does;
    a sibling is before it among the children of its parent; a parent is met by its number. What a node shows by itself is tested
    first: nodes that meet no step of any selector go, the others are dealt by page once, and all that follows stays within pages.
    """

    def __init__(self, nodes: DataFrame, page: str, parsed: list[list]):
        self.nodes, self.page, self.n, self.own = nodes, page, 0, {}
        self.order = Window.partitionBy(page).orderBy("pre")
        self.family = Window.partitionBy(page, "parent").orderBy("place")
        self.gather(parsed)
        if self.own:
            some = reduce(lambda a, b: a | b, [F.col(name) for name in self.own.values()])
            self.nodes = self.nodes.where(some).repartition(page)

    def gather(self, alternatives: list[list]) -> None:
        """A column for what each step asks of a node itself, also for the steps inside :not, :is and :has."""
        for steps in alternatives:
            for _, tests in steps:
                plain = self.plain(tests)
                if plain not in self.own:
                    self.keep(reduce(lambda a, b: a & b, [self.test(t) for t in plain], F.lit(True)))
                    self.own[plain] = f"_s{self.n}"
                for t in tests:
                    if t[0] in INNER:
                        self.gather(t[1])

    def plain(self, tests: list[tuple]) -> tuple:
        return tuple(t for t in tests if t[0] not in INNER)

    def keep(self, value: Column) -> Column:
        """A column of its own for a flag, so that windows do not nest."""
        self.n += 1
        name = f"_s{self.n}"
        self.nodes = self.nodes.withColumn(name, F.coalesce(value, F.lit(False)))
        return F.col(name)

    def by_parent(self, flagged: Column, to_children: bool) -> Column:
        """Whether a node's parent is flagged, or one of its children is."""
        own, other = ("parent", "pre") if to_children else ("pre", "parent")
        # each node stands under its own key; a flagged one gives a mark under the other key, which goes again
        at = lambda key, mark: F.struct(F.col(key).alias("key"), F.lit(mark).alias("mark"))
        places = F.when(flagged & F.col(other).isNotNull(), F.array(at(own, False), at(other, True))).otherwise(F.array(at(own, False)))
        told = self.nodes.withColumn("_at", F.explode(places)).withColumns({"_key": F.col("_at.key"), "_mark": F.col("_at.mark")}).drop("_at")
        self.n += 1
        name = f"_s{self.n}"
        self.nodes = told.withColumn(name, F.max("_mark").over(Window.partitionBy(self.page, "_key"))).where("not _mark").drop("_key", "_mark")
        return F.col(name)

    def test(self, t: tuple) -> Column:
        kind = t[0]
        if kind == "any":
            return F.lit(True)
        if kind == "tag":
            return F.col("tag") == t[1]
        if kind == "class":
            return F.array_contains("classes", t[1])
        if kind == "attr":
            _, name, op, value, fold = t
            have = F.try_element_at("attrs", F.lit(name))
            if op is None:
                return have.isNotNull()
            have, value = (F.lower(have), value.lower()) if fold else (have, value)
            if op == "!=":
                return have.isNull() | (have != value)
            some = F.lit(value != "")
            return {
                "=": lambda: have == value, "^=": lambda: some & have.startswith(value), "$=": lambda: some & have.endswith(value), "*=": lambda: some & have.contains(value),
                "~=": lambda: F.lit(value != "" and not re.search(r"\s", value)) & F.array_contains(F.split(have, r"\s+"), value), "|=": lambda: (have == value) | have.startswith(value + "-"),
            }[op]()
        if kind.startswith("nth-"):
            place, places = ("kind_place", "kind_places") if kind.endswith("of-type") else ("place", "places")
            at = F.col(places) - F.col(place) + 1 if "last" in kind else F.col(place)
            a, b = t[1:]
            return at == b if a == 0 else ((at - b) % a == 0) & ((at - b) * (1 if a > 0 else -1) >= 0)
        if kind in ("only-child", "only-of-type"):
            return F.col("places" if kind == "only-child" else "kind_places") == 1
        if kind == "root":
            return F.col("parent").isNull()
        if kind == "empty":
            return F.col("empty")
        if kind == "has":
            return reduce(lambda a, b: a | b, [self.keep(self.has(steps)) for steps in t[1]])
        inside = reduce(lambda a, b: a | b, [self.keep(self.steps(s)) for s in t[1]])
        return ~inside if kind == "not" else inside

    def compound(self, tests: list[tuple]) -> Column:
        return reduce(lambda a, b: a & b, [self.test(t) for t in tests if t[0] in INNER], F.col(self.own[self.plain(tests)]))

    def steps(self, steps: list[tuple[str, list[tuple]]]) -> Column:
        """Whether a node meets the last step, and others the steps before it."""
        if steps[0][0]:
            raise ValueError("a selector begins with a combinator")
        found = self.keep(self.compound(steps[0][1]))
        for comb, tests in steps[1:]:
            if comb == ">":
                before = self.by_parent(found, True)
            elif comb == " ":
                before = self.keep(F.max(F.when(found, F.col("end"))).over(self.order.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("pre"))
            elif comb == "+":
                before = self.keep(F.lag(F.when(found, F.col("place"))).over(self.family) == F.col("place") - 1)
            else:
                before = self.keep(F.max(found).over(self.family.rowsBetween(Window.unboundedPreceding, -1)))
            found = self.keep(before & self.compound(tests))
        return found

    def has(self, steps: list[tuple[str, list[tuple]]]) -> Column:
        """Whether a node reaches, by one relative step, a node that meets the selector."""
        comb, tests = steps[0]
        if len(steps) > 1:
            raise ValueError(":has() with several steps is unknown")
        found = self.keep(self.compound(tests))
        if comb == ">":
            return self.by_parent(found, False)
        after = self.family.rowsBetween(1, Window.unboundedFollowing)
        if comb == "+":
            return F.lead(F.when(found, F.col("place"))).over(self.family) == F.col("place") + 1
        if comb == "~":
            return F.max(found).over(after)
        # the first such node after it is among its descendants
        return F.min(F.when(found, F.col("pre"))).over(self.order.rowsBetween(1, Window.unboundedFollowing)) <= F.col("end")


def select_nodes(nodes: DataFrame, selectors: list[str], page: str = "page_id") -> DataFrame:
    """nodes that meet any of the selectors, with hits, those that they meet.

    Tags, classes, ids, attributes with all operators, descendants, children, siblings, lists, :nth-child and
    its kin, :not, :is, :where, :has with one step, :empty and :root. Any other form is an error.
    """
    parsed = [parsed_selector(css) for css in selectors]
    marked = _Marked(nodes, page, [steps for alternatives in parsed for steps in alternatives])
    flags = []
    for css, alternatives in zip(selectors, parsed):
        each = [marked.keep(marked.steps(steps)) for steps in alternatives]
        flags.append(F.when(reduce(lambda a, b: a | b, each), F.lit(css)))
    if not flags:
        return nodes.withColumn("hits", F.array().cast("array<string>")).where(F.lit(False))
    hits = F.filter(F.array(*flags), lambda x: x.isNotNull())
    return marked.nodes.withColumn("hits", hits).where(F.size("hits") > 0).select(*nodes.columns, "hits")
