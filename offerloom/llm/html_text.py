"""Main text of web pages: boosted trees over DOM nodes, decoded as a hierarchy."""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# comments, other declarations and end tags without a name, tags (a quote counts only after "="), text
TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)|[^<]+|<""", re.S)
ATTR = re.compile(r"""([a-zA-Z_:@-][\w:.-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
# Fixed sets of the HTML standard: elements without content, with raw content, in a line, closing a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br ruby rt rp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

TAGS = {t: i + 1 for i, t in enumerate("#text html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li a span b i em strong nav header footer aside form button input table tr td th blockquote pre figure figcaption dl dt dd label select script style title noscript svg iframe".split())}
#: Groups of attribute words, by what they tell of a node.
WORDS = {
    "content": "article content post entry story body main text page blog prose".split(),
    "menu": "nav menu breadcrumb breadcrumbs toc tabs pagination pager links".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo banner".split(),
    "frame": "header footer masthead copyright legal top bottom site".split(),
    "side": "sidebar aside side widget related recommended popular trending".split(),
    "notice": "cookie consent notice alert popup modal overlay newsletter subscribe signup gdpr".split(),
    "comment": "comment comments reply replies disqus discussion respond".split(),
    "share": "share social follow form search login tags meta".split(),
}
GROUP = {w: i for i, ws in enumerate(WORDS.values()) for w in ws}
LANDMARKS = (("article", "main"), ("nav", "header", "footer", "aside"), ("form", "button", "select"), ("head", "script", "style", "title"))
LANDMARK = {t: i for i, tags in enumerate(LANDMARKS) for t in tags}


class Node:
    __slots__ = ("tag", "parent", "kids", "group", "text", "length", "linked", "tags", "depth", "at", "stops", "marks")

    def __init__(self, tag, parent, group=0, text=""):
        self.tag, self.parent, self.kids, self.group, self.text = tag, parent, [], group, text
        self.depth = parent.depth + 1 if parent is not None else 0
        # for each group of landmark elements, how many steps up the nearest is
        marks = tuple([m + 1 for m in parent.marks]) if parent is not None else (99,) * len(LANDMARKS)
        own = LANDMARK.get(tag)
        self.marks = marks if own is None else marks[:own] + (0,) + marks[own + 1 :]


def parse(page: str) -> list[Node]:
    """Nodes of a page in document order; the first is the root. Broken markup gives some tree, never an error."""
    root = Node("#root", None)
    nodes, here, at = [root], root, 0
    count: dict[str, int] = {}  # open elements by tag, so that nothing is sought that is not open

    def leave(to: Node) -> Node:
        """Close elements up to and with `to`."""
        up = here
        while up is not to.parent:
            count[up.tag] -= 1
            up = up.parent
        return up

    while m := TOKEN.match(page, at):
        tag, at = m[2], m.end()
        if tag is None:
            t = m[0]
            if t[:2] not in ("<!", "<?", "</"):
                node = Node("#space", here, 0, " ") if t.isspace() else Node("#text", here, 0, t)
                here.kids.append(node)
                nodes.append(node)
            continue
        tag = tag.lower()
        if m[1]:
            if count.get(tag):
                up = here
                while up.tag != tag:
                    up = up.parent
                here = leave(up)
            continue
        if (tag in CLOSES_P or tag == "p") and count.get("p"):
            up = here
            while up.tag in INLINE:
                up = up.parent
            if up.tag == "p":
                here = leave(up)
        if tag in SAME:
            same, limit = SAME[tag][0].split(), SAME[tag][1]
            up, last = here, None
            while any(count.get(t) for t in same) and up is not root and up.tag not in limit:
                if up.tag in same:
                    last = up
                up = up.parent
            if last is not None:
                here = leave(last)
        group = 0
        if m[3] and ("class" in m[3] or "id" in m[3] or "role" in m[3]):
            for name, value in ATTR.findall(m[3]):
                if name.lower() in ("class", "id", "role", "itemprop"):
                    for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                        if w in GROUP:
                            group |= 1 << GROUP[w]
        node = Node(tag, here, group)
        here.kids.append(node)
        nodes.append(node)
        if tag in RAW:
            # its content ends at its own end tag only; what looks like markup before that is none
            if tag != "svg" or not m[3].endswith("/"):
                end = RAW_END[tag].search(page, at)
                at = end.start() if end else len(page)
        elif tag not in VOID:
            here = node
            count[tag] = count.get(tag, 0) + 1
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node: densities of its subtree, attribute words, depth and siblings."""
    for node in reversed(nodes):
        if node.tag == "#text":
            node.length, node.linked, node.tags, node.stops = len(node.text), 0, 0, node.text.count(".") + node.text.count(",")
        else:
            kids = node.kids
            node.length, node.tags = sum(k.length for k in kids), sum(k.tags for k in kids) + (node.tag != "#space")
            node.stops = sum(k.stops for k in kids)
            node.linked = node.length if node.tag == "a" else sum(k.linked for k in kids)
        for i, k in enumerate(node.kids):
            k.at = i
    nodes[0].at = 0
    whole = nodes[0].length or 1
    raw, bits = [], []
    above = {id(nodes[0]): 0}
    for node in nodes:
        parent = node.parent or node
        over = above[id(parent)] | (node.group if node.tag not in ("#text", "#space") else 0)
        above[id(node)] = over
        n, sibs = node.length, len(parent.kids) or 1
        prev = parent.kids[node.at - 1].length if node.at and parent is not node else 0
        nxt = parent.kids[node.at + 1].length if parent is not node and node.at + 1 < sibs else 0
        up = parent.parent or parent
        raw.append((TAGS.get(node.tag, 0), TAGS.get(parent.tag, 0), TAGS.get(up.tag, 0), node.depth, n, n / whole, node.linked / (n or 1), n / (node.tags + 1), node.stops / (n or 1) * 100, sibs, node.at / sibs, prev, nxt, parent.length / whole, parent.linked / (parent.length or 1), len(node.kids), *node.marks))
        bits.append((node.group, over))
    g = np.array(bits, np.int64)
    groups = (g[:, :, None] >> np.arange(len(WORDS))) & 1
    return np.hstack([np.array(raw, np.float32), groups.reshape(len(nodes), -1).astype(np.float32)])


class Trees:
    """Gradient-boosted trees for a yes-no label, on features cut at quantiles."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        code = np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T)], 1)
        self.start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        score, self.trees = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            feature, cut, value = np.zeros(2**self.depth, np.int64), np.full(2**self.depth, 1 << 30), np.zeros(2 ** (self.depth + 1))
            node = np.ones(len(y), np.int64)
            for level in range(self.depth):
                size, base = 2**level, 2**level
                best = np.full(size, 1e-6)
                for f in range(x.shape[1]):
                    n = len(self.cuts[f]) + 1
                    if n < 2:
                        continue
                    slot = (node - base) * n + code[:, f]
                    gs, hs = (np.bincount(slot, a, size * n).reshape(size, n).cumsum(1) for a in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = (gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1))[:, :-1]
                    at = gain.argmax(1)
                    top = gain[np.arange(size), at]
                    better = top > best
                    best[better], feature[base : 2 * base][better], cut[base : 2 * base][better] = top[better], f, at[better] + 1
                node = 2 * node + (code[np.arange(len(y)), feature[node]] >= cut[node])
            gs, hs = (np.bincount(node, a, 2 ** (self.depth + 1)) for a in (g, h))
            value = self.rate * gs / (hs + 1)
            score += value[node]
            self.trees.append((feature, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        code = np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T)], 1)
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (code[rows, feature[node]] >= cut[node])
            score += value[node]
        return 1 / (1 + np.exp(-score))


def decode(nodes: list[Node], p: np.ndarray) -> np.ndarray:
    """The likeliest labels in which a node is main only if its parent is.

    Bottom up, a node is either rejected with its whole subtree or kept, each child then taking
    its better case; top down the better case is read off.
    """
    p = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = np.log(p), np.log(1 - p)
    index = {id(n): i for i, n in enumerate(nodes)}
    keep, drop = yes.copy(), no.copy()
    for i in range(len(nodes) - 1, 0, -1):
        up = index[id(nodes[i].parent)]
        keep[up] += max(keep[i], drop[i])
        drop[up] += drop[i]
    out = np.zeros(len(nodes), bool)
    out[0] = keep[0] > drop[0]
    for i in range(1, len(nodes)):
        out[i] = out[index[id(nodes[i].parent)]] and keep[i] > drop[i]
    return out


def main_text(nodes: list[Node], chosen: np.ndarray) -> str:
    """Chosen texts: references decoded, white space in a block one space, blocks joined by one space."""
    blocks, here = [[]], True
    owner = None
    for node, yes in zip(nodes, chosen):
        if node.tag == "br":
            blocks[-1].append(" ")
        elif node.tag in ("#text", "#space"):
            block = node.parent
            while block.parent is not None and block.tag in INLINE:
                block = block.parent
            if block is not owner or not here:
                blocks.append([])
                owner, here = block, True
            if yes or node.tag == "#space":
                blocks[-1].append(html.unescape(node.text))
        elif node.tag not in INLINE:
            here = False
    return " ".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


# --- training pages ----------------------------------------------------------------------

_PROSE = re.compile(r"<p[^>]*>(.*?)(?=<p|</p|</article|</div|</body|\Z)", re.S)


def _training_page(rng: random.Random, prose: list[str]) -> str:
    """A page of known make: paragraphs of real prose in an article, other prose in everything around it.

    Main nodes carry the mark §, which is taken off before features are made.
    """
    pick = lambda lo, hi: " ".join(rng.choice(prose).split()[: rng.randint(lo, hi)])
    link = lambda: f'<a href="/{rng.randint(1, 99)}">{pick(1, 4)}</a>'
    links = lambda n: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"
    name = lambda group: rng.choice(WORDS[group])
    attr = lambda group: f' {rng.choice(("class", "class", "id"))}="{rng.choice(("", "site-", "page-", "js ", "block "))}{name(group)}"'
    inline = lambda t: t.replace(" ", f" <{(k := rng.choice(('b', 'i', 'em', 'span', 'a')))}>", 1).replace(" ", f"</{k}> ", 2) if rng.random() < 0.3 and t.count(" ") > 4 else t

    def para():
        t = pick(1, 400) if rng.random() < 0.8 else pick(1, 6)
        return rng.choice(("<p>§{}</p>", "<p>§{}</p>", "<p>§{}</p>", "<p>§<b>{}<br>", "<p>§{}", "<blockquote><p>§{}</p></blockquote>", "<h2>§{}</h2>", "<ul><li>§{}</li><li>§{}</li></ul>")).replace("{}", inline(t))

    body = f"<h1>§{pick(2, 12)}</h1>" + "".join(para() for _ in range(rng.choice((1, 2, 3, 5, 8, 14))))
    noise = {
        "menu": lambda: rng.choice((f"<nav>{links(rng.randint(2, 9))}</nav>", f"<div{attr('menu')}>{links(rng.randint(2, 9))}</div>", f"<header{rng.choice(('', attr('frame')))}><h2>{pick(1, 5)}</h2>{links(4)}</header>")),
        "advert": lambda: f"<{(t := rng.choice(('div', 'aside', 'section')))}{attr('advert')}>{rng.choice(('', '<p>'))}{pick(2, 25)}</{t}>",
        "side": lambda: rng.choice((f"<aside{rng.choice(('', attr('side')))}><h3>{pick(1, 4)}</h3><p>{pick(3, 60)}</p>{links(rng.randint(0, 5))}</aside>", f"<div{attr('side')}><h3>{pick(1, 4)}</h3><p>{pick(3, 60)}</p></div>")),
        "notice": lambda: f"<div{attr('notice')}>{rng.choice(('', '<p>'))}{pick(4, 40)}<button>{pick(1, 2)}</button></div>",
        "form": lambda: f"<form{rng.choice(('', attr('share')))}><label>{pick(1, 4)}</label><input name=q><button>{pick(1, 2)}</button></form>",
        "comment": lambda: f"<{(t := rng.choice(('div', 'section', 'ol')))}{attr('comment')}><h3>{pick(1, 3)}</h3>" + "".join(f"<div{rng.choice(('', attr('comment')))}><p>{pick(3, 80)}</p></div>" for _ in range(rng.randint(1, 5))) + f"</{t}>",
        "footer": lambda: rng.choice((f"<footer>&copy; {pick(2, 20)}</footer>", f"<div{attr('frame')}><p>&copy; {pick(2, 20)}</p>{links(rng.randint(0, 4))}</div>")),
    }
    some = lambda kinds, most: "".join(noise[rng.choice(kinds)]() for _ in range(rng.randint(0, most)))
    if rng.random() < 0.3:
        body += some(("advert", "side", "form"), 1) + "".join(para() for _ in range(3))
    if rng.random() < 0.3:
        body += some(("comment", "side"), 1)
    wrap = rng.choice(("<article>{}</article>", "<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", "<div class=\"%s\">{}</div>" % name("content"), "<div id=\"%s\">{}</div>" % name("content"), "<section>{}</section>", "<div>{}</div>")).replace("{}", body)
    page = some(("menu", "notice"), 3) + some(("advert", "side"), 1) + wrap + some(("comment", "side", "advert", "form"), 2) + some(("footer", "footer", "notice"), 2)
    if rng.random() < 0.2:
        page = f"<div{rng.choice(('', ' id="page"'))}>{page}</div>"
    return f"<!DOCTYPE html><html><head><title>{pick(2, 12)}</title><script>var t='</p>';</script></head><body>{page}</body></html>"


def fit_extractor(pages: list[str], seed: int = 7, made: int = 500) -> Trees:
    """Boosted trees trained on `made` pages built from the paragraphs of a bounded sample of pages."""
    rng = random.Random(seed)
    prose = [t for page in pages for t in (re.sub(r"<[^>]*>|§", " ", m).strip() for m in _PROSE.findall(page)) if t] or ["lorem ipsum, dolor sit amet. " * 20]
    prose.sort()
    xs, ys = [], []
    for _ in range(made):
        nodes = parse(_training_page(rng, prose))
        main = set()
        for node in nodes:
            if node.tag == "#text" and "§" in node.text:
                node.text = node.text.replace("§", "")
                block = node
                while block is not None and (block is node or block.tag in INLINE):
                    block = block.parent
                todo = [block]  # the whole block is main, and so is everything above it
                while todo:
                    k = todo.pop()
                    main.add(id(k))
                    todo += k.kids
                while block is not None:
                    main.add(id(block))
                    block = block.parent
        xs.append(features(nodes))
        ys.append(np.array([id(n) in main for n in nodes], float))
    return Trees().fit(np.vstack(xs), np.concatenate(ys))


def extract_main_text(pages: DataFrame, sample: int = 400, sample_chars: int = 20_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page from its whole html.

    The model is fitted on the driver on pages made from the paragraphs in the first `sample_chars`
    characters of at most `sample` pages (the ones with the smallest hash of their html), so its
    size has a fixed bound; tasks get it with the function. Every page is scored whole, without a
    shuffle. A null or empty html, or a page without
    main text, gives an empty text; repeated rows each give a row; other columns are ignored; an
    empty table gives none.
    """
    from pyspark.sql import functions as F

    hashed = pages.where(F.col(html_col).isNotNull()).select(F.xxhash64(html_col).alias("h"), F.substring(html_col, 1, sample_chars).alias("html"))
    lowest = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]
    # only the hashes are ordered; the pages up to the last of them are fetched, one a hash
    some = hashed.where(F.col("h") <= lowest[-1]).groupBy("h").agg(F.min("html").alias("html")).collect() if lowest else []
    model = fit_extractor([r["html"] for r in some])
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(2).cast(pa.large_string()), "")
            for i in range(0, batch.num_rows, 128):
                trees = [parse(t) for t in texts.slice(i, 128).to_pylist()]
                p = model.predict(np.vstack([features(t) for t in trees]))
                at, out = 0, []
                for nodes in trees:
                    out.append(main_text(nodes, decode(nodes, p[at : at + len(nodes)])))
                    at += len(nodes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 128), batch.column(1).slice(i, 128), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {id_type}, url {url_type}, text string, n_chars long")
