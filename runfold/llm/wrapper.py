"""Main text of web pages by wrapper induction.

``REFERENCES`` pages per host and layout (a bounded sample, by hash of the page; a layout
is the set of a page's label paths) are parsed and their DOM trees aligned by simple tree
matching. Runs of siblings with one label (tag and class) count as one repeated node, as
wrappers describe lists, so a tree is as large as its layout, not its text. Pages that say
nearly the same (``COPY`` of the characters) are one page. A node that aligns in several
pages and says the same in all of them is constant; where it differs it is a slot. The
wrapper of a host holds its content path (the deepest node with all slots) and its template:
constant nodes outside the content node, and inside it, or in an ``article`` or ``main``,
whole constant containers (div, section, lists, tables) only.

Every page, marked or not, is then read with its host's wrapper, runs compared with runs:
the text of its ``article`` or ``main`` elements, or else of the whole body, without template
text (all of it, if nothing else is left); never of navigation, header, footer, sidebar,
notice, advert, form, script, style or reader comments (by element, role, class or id).

Defined results: null html is empty, no text gives an empty string; a null or broken
address has the host ''; repeated rows are read alike; elements left open (or a page cut
off) are closed at the end, a tag cut off is dropped; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runfold.llm.common import settle, table

REFERENCES = 8
#: share of a page's text that makes it a copy of another
COPY = 0.8
#: elements nested deeper are not aligned (so none of their text is template)
MAX_DEPTH = 200

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead
    tr ul""".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li tbody td tfoot th thead tr".split())
#: an element that ends an open one of its kind, looking no further up than the second set
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "option": ({"option"}, {"select"})}

CHROME_TAGS = frozenset("""head nav footer aside form script style noscript template iframe button select textarea input svg canvas
    dialog menu title object""".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
CHROME_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar
    navigation menu submenu breadcrumb breadcrumbs pagination pager toolbar masthead footer sidebar aside widget cookie cookies
    consent gdpr notice notices banner popup modal overlay newsletter subscribe subscription signup login comment comments
    commentlist respond reply replies disqus share sharing social related recommended skip""".split())
KEEP_TAGS = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: words that say where chrome stands (site-footer, sidebar-left)
PLACES = frozenset("site page main top bottom left right inner outer box block bar area wrap wrapper container section links list items global".split())
#: inside an article only these are chrome by class or id
CONTAINERS = frozenset("div section ul ol dl table details".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]*)|([^\s=/>"']+)""")


class Node:
    """An element: tag, attributes, children (elements and strings)."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def label(self) -> str:
        kind = re.sub(r"[0-9]+", "0", self.attrs.get("class", "").strip().lower())
        return f"{self.tag}.{kind}" if kind else self.tag

    def is_marked(self, beside: frozenset[str] = frozenset()) -> bool:
        """A class or id that is made of chrome words only (cookie-notice, not
        menu-of-the-day), or of these and words ``beside``."""
        tokens = f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}".lower().split()
        return any(parts & CHROME_WORDS and parts <= CHROME_WORDS | beside for parts in (set(re.findall("[a-z]+", t)) for t in tokens))

    def chrome_by_class(self, in_article: bool) -> bool:
        if not self.attrs:
            return False
        if self.tag in KEEP_TAGS:
            return in_article and self.tag == "article" and self.is_marked()
        return self.tag in CONTAINERS and self.is_marked() if in_article else self.tag not in HEADINGS and self.is_marked(PLACES)

    def chrome_by_kind(self, in_article: bool) -> bool:
        return self.tag not in KEEP_TAGS and (
            self.tag in CHROME_TAGS or self.tag == "header" and not in_article or "hidden" in self.attrs
            or self.attrs.get("role", "").lower() in CHROME_ROLES
            or bool(re.search(r"display\s*:\s*none", self.attrs.get("style", ""))))

    def is_chrome(self, in_article: bool) -> bool:
        return self.chrome_by_kind(in_article) or self.chrome_by_class(in_article)

    def length(self) -> int:
        """Characters of the subtree."""
        n, todo = 0, [self]
        while todo:
            for c in todo.pop().children:
                if isinstance(c, Node):
                    todo.append(c)
                else:
                    n += len(c)
        return n


def parse(page: str) -> Node:
    """The element tree of a page, however badly closed."""
    root = Node("#root", {})
    stack, at, is_open = [root], 0, Counter()

    def close(i: int) -> None:
        is_open.subtract(x.tag for x in stack[i:])
        del stack[i:]
    while True:
        m = _TOKEN.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            stack[-1].children.append(entities.unescape(text))
        if not m:
            return root
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if is_open[tag] > 0 else ():
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1) if is_open["p"] > 0 else ():
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK or stack[i].tag == "button":
                    break
        ends, bound = SIBLINGS.get(tag, ((), ()))
        for i in range(len(stack) - 1, 0, -1) if ends else ():
            if stack[i].tag in bound:
                break
            if stack[i].tag in ends:
                close(i)
                break
        node = Node(tag, {(a or c).lower(): entities.unescape(b.strip("\"'")) for a, b, c in _ATTR.findall(m[3])} if m[3].strip() else {})
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if tag != "noscript" and tag != "template":
                at = end.start() if end else len(page)
            stack.append(node)
            is_open[tag] += 1
        elif tag not in VOID and (tag in BLOCK or not m[3].rstrip().endswith("/")):
            stack.append(node)
            is_open[tag] += 1


def pieces(node: Node, in_article: bool, whole: int = 0) -> Iterator[str]:
    """Text of a subtree without chrome, blocks set apart by white space. What a class
    marks stays if it holds over half of ``whole`` characters."""
    todo: list[tuple[object, bool]] = [(node, in_article)]
    while todo:
        x, inside = todo.pop()
        if isinstance(x, str):
            yield x
            continue
        if x is not node and (x.chrome_by_kind(inside) or x.chrome_by_class(inside) and not (whole and 2 * x.length() > whole)):
            yield " " if x.tag in BLOCK else ""
            continue
        inside = inside or x.tag in ("article", "main")
        apart = x.tag in BLOCK or x.tag == "br"
        if apart:
            yield " "
            todo.append((" ", inside))
        todo.extend((c, inside) for c in reversed(x.children))


def clean(parts: Iterator[str]) -> str:
    return " ".join("".join(parts).split())


def own_text(node: Node) -> str:
    return clean(c for c in node.children if isinstance(c, str))


# ------------------------------------------------------------------ induction
class Shape:
    """A node of an aligned tree: runs of equal siblings are one. ``texts`` has what it
    says in each page it stands in."""

    __slots__ = ("label", "texts", "size", "children", "nodes")

    def __init__(self, label: str):
        self.label, self.texts, self.size, self.children, self.nodes = label, {}, 0, [], []


def shape(node: Node, page: int, in_article: bool = False, depth: int = 0) -> Shape:
    s = Shape(node.label())
    _add(s, node, page, in_article, depth)
    return s


def _add(s: Shape, node: Node, page: int, in_article: bool, depth: int) -> None:
    said = own_text(node)
    s.texts[page] = (s.texts.get(page, "") + " " + said).strip()
    s.size += len(said)
    s.nodes.append(node)
    in_article = in_article or node.tag in ("article", "main")
    for c in node.children if depth < MAX_DEPTH else ():
        if isinstance(c, Node) and not c.is_chrome(in_article):
            if s.children and s.children[-1].label == c.label():
                _merge(s.children[-1], shape(c, page, in_article, depth + 1))
            else:
                s.children.append(shape(c, page, in_article, depth + 1))


def matching(a: Shape, b: Shape) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the largest order-preserving matching of two
    trees with equal roots, and which children it pairs."""
    if a.label != b.label:
        return 0, []
    n, m = len(a.children), len(b.children)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    w = [[matching(x, y)[0] for y in b.children] for x in a.children]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w[i - 1][j - 1])
    pairs, i, j = [], n, m
    while i and j:
        if w[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + w[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[n][m] + 1, pairs[::-1]


def _merge(a: Shape, b: Shape) -> None:
    """Lay ``b`` over ``a`` by their matching; what has no partner is put in order."""
    for page, said in b.texts.items():
        a.texts[page] = (a.texts[page] + " " + said).strip() if page in a.texts else said
    a.size += b.size
    a.nodes += b.nodes
    _, pairs = matching(a, b)
    out, i, j = [], 0, 0
    for p, q in [*pairs, (len(a.children), len(b.children))]:
        out += a.children[i:p] + b.children[j:q]
        if p < len(a.children):
            _merge(a.children[p], b.children[q])
            out.append(a.children[p])
        i, j = p + 1, q + 1
    a.children = out


def walk(s: Shape, path: str = "") -> Iterator[tuple[str, Shape]]:
    yield path, s
    for c in s.children:
        yield from walk(c, f"{path}/{c.label}")


def said(s: Shape, page: int) -> Counter:
    """Characters of a page by path and text."""
    return Counter({(path, x.texts[page]): len(x.texts[page]) for path, x in walk(s) if x.texts.get(page)})


def induce(pages: list[str]) -> dict:
    """The wrapper of some pages of one host."""
    trees: list[Shape] = []
    known: list[Counter] = []
    for p in pages:
        tree = shape(parse(p), len(trees))
        text = said(tree, len(trees))
        if not any((text & x).total() >= COPY * min(text.total(), x.total()) for x in known):
            trees.append(tree)
            known.append(text)
    if not trees:
        return {"content": None, "template": []}
    whole = trees[0]
    for t in trees[1:]:
        _merge(whole, t)
    masses: dict[int, int] = {}

    def constant(s: Shape) -> bool:
        return len(s.texts) > 1 and len(set(s.texts.values())) == 1

    def mass(s: Shape) -> int:
        if id(s) not in masses:
            masses[id(s)] = (0 if constant(s) else s.size) + sum(map(mass, s.children))
        return masses[id(s)]
    content, s = [], whole
    while constant(s) or not s.size:
        heavy = max(s.children, key=mass, default=None)
        if heavy is None or not mass(heavy) or mass(heavy) < mass(whole):
            break
        if heavy.label.split(".")[0] not in BLOCK or heavy.label.split(".")[0] in ("p", "li", "ul", "ol", "table", "blockquote"):
            break  # what is in this list is content, not its container
        s, content = heavy, [*content, heavy.label]
    node, template = s, set()

    def visit(s: Shape, path: str, kept: bool) -> None:
        tag = s.label.split(".")[0]
        if kept and tag in CONTAINERS and s is not node and constant(s) and not mass(s):
            kept = False
        kept = kept or s is node or tag in ("article", "main")
        if not kept and constant(s) and s.texts[min(s.texts)]:
            template.add(f"{path}\t{s.texts[min(s.texts)]}")
        for c in s.children:
            visit(c, f"{path}/{c.label}", kept)
    visit(whole, "", False)
    return {"content": content, "template": sorted(template)}


# ----------------------------------------------------------------- extraction
def main_text(page: str, wrapper: dict | None) -> str:
    """The main text of a page, read with its host's wrapper."""
    root = parse(page)
    if wrapper and wrapper["template"]:
        _drop(root, {tuple(t.split("\t", 1)) for t in wrapper["template"]})
    return _read(root) or (_read(parse(page)) if wrapper and wrapper["template"] else "")


def _read(root: Node) -> str:
    marked = list(_marked(root)) or list(_marked(root, False))
    if marked:
        return clean(x for n in marked for x in (" ", *pieces(n, True)))
    body = next((c for h in [root, *root.children] if isinstance(h, Node) for c in h.children if isinstance(c, Node) and c.tag == "body"), root)
    return clean(pieces(body, False, body.length()))


def _marked(root: Node, by_class: bool = True) -> Iterator[Node]:
    """Outermost articles or mains that aren't in chrome (so no reader comments). Where
    all are, a class on what holds them counts for nothing."""
    todo = [root]
    while todo:
        x = todo.pop()
        for c in reversed(x.children):
            if isinstance(c, Node) and not c.chrome_by_kind(False) and not (by_class and c.chrome_by_class(False)):
                if c.tag in ("article", "main") and not c.is_marked():
                    todo.append(c)
                elif c.tag not in ("article", "main"):
                    todo.append(c)
        if x.tag in ("article", "main"):
            yield x
            while todo and todo[-1] in x.children:
                todo.pop()


def _drop(root: Node, template: set[tuple[str, ...]]) -> None:
    """Take template text out of a tree."""
    for path, s in walk(shape(root, 0)):
        if (path, s.texts[0]) in template:
            for x in s.nodes:
                x.children = [c for c in x.children if isinstance(c, Node)]


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def layouts(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``host``, ``layout`` (a hash of the label paths) and ``spot`` (a hash of the page) of all pages."""
    def run(batches):
        for b in batches:
            found = [xxhash.xxh64_intdigest("\n".join(sorted({path for path, _ in walk(shape(parse(p or ""), 0))})), 0) - 2**63
                     for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64()), b.column(1)], names=["host", "layout", "spot"])
    rows = pages.select(host_of(url_col).alias("host"), F.xxhash64(html_col).alias("spot"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "host string, layout long, spot long")


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", references: int = REFERENCES) -> DataFrame:
    """One row per host: its wrapper, as JSON. Every layout has its references; which
    pages they are is decided on hashes alone, and only theirs are moved to their host's task."""
    keyed = pages.select(host_of(url_col).alias("host"), F.xxhash64(html_col).alias("spot"), F.col(html_col).alias("html"))
    order = Window.partitionBy("host", "layout").orderBy("spot")
    spots = layouts(pages, url_col, html_col).distinct()
    chosen = spots.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= references)
    some = keyed.join(chosen.select("host", "spot"), ["host", "spot"]).dropDuplicates(["host", "spot"])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("spot")
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(induce([h or "" for h in rows["html"]]))]})
    return some.groupBy("host").applyInPandas(run, "host string, wrapper string")


def extract(pages: DataFrame, keep: list[str], url_col: str = "url", html_col: str = "html",
            references: int = REFERENCES) -> DataFrame:
    """Columns ``keep`` and ``main_text`` of every page."""
    found = settle(wrappers(pages, url_col, html_col, references), "wrappers")
    source = pages.select(host_of(url_col).alias("__host"), F.col(html_col).alias("__html"), *keep)
    rows = source.join(found.select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper")), "__host", "left") \
        .select("__html", "__wrapper", *keep)
    out = rows.select(*keep).schema.add("main_text", "string")

    def run(batches):
        known: dict[str, dict] = {}
        for b in batches:
            texts = []
            for page, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if w is not None and w not in known:
                    known.clear()  # rows come by host: one wrapper at a time is enough
                    known[w] = json.loads(w)
                texts.append(main_text(page, known.get(w)) if page else "")
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(texts, pa.string())], names=[*b.schema.names[2:], "main_text"])
    return rows.mapInArrow(run, out)


def op6_main_text(spark, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    found = extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
