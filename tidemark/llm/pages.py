"""Main text of web pages by wrapper induction over the pages of a host.

The DOM tree of every page, with equal siblings folded together, is aligned by
simple tree matching with the tree of one reference page of its host. Matched
nodes are slots of the host's wrapper. A text that most of a host's different
pages have in one slot is constant and belongs to the template; what varies is
content, unless it stands in an element made for something else (menus, side
bars, adverts, forms, comments and so on) or outside the page's article.

Texts in slots are counted over all pages, with copies of a page counted once.
The reference page is the one with the smallest hash; only its folded tree is
joined to the others, so a host with a third of all pages is split freely.
"""

from __future__ import annotations

import hashlib
import json
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches
from tidemark.session import checkpointed

#: A text is constant that at least this share, and number, of a host's different pages have.
SHARE = 0.5
PAGES = 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*>|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")

#: What HTML and common page layouts call things. Fixed values.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "audio", "video", "canvas"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav",
    "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
}
_CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
_ELSE_TAGS = {"aside", "button", "dialog", "footer", "form", "head", "label", "menu", "nav", "search", "select"}
_ELSE_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
_ELSE_NAMES = {
    "ad", "ads", "adsense", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments",
    "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "form", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notification", "overlay", "pager", "pagination", "paywall", "popover", "popup", "promo", "rail", "recommended", "related", "replies", "reply",
    "respond", "search", "share", "sharing", "side", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toast", "toolbar", "topbar", "widget",
}
_HEADER = "header"


class _Node:
    __slots__ = ("tag", "label", "parent", "other", "within", "link")

    def __init__(self, tag: str, label: str, parent: _Node | None, other: bool, within: str):
        self.tag, self.label, self.parent, self.other, self.within = tag, label, parent, other, within


def _purpose(tag: str, attributes: str, within: str) -> tuple[bool, str]:
    """Whether an element is made for something other than content; its label for alignment."""
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes and "=" in attributes else {}
    names = found.get("class", "")
    label = tag + "." + re.sub(r"\d+", "0", " ".join(sorted(names.split()))) if names else tag
    other = tag in _ELSE_TAGS or found.get("role") in _ELSE_ROLES or (tag == _HEADER and not within)
    if not other and tag not in ("html", "body", "main", "article"):
        for name in f"{names} {found.get('id', '')}".split():
            parts = re.split(r"[^a-z]+", name)
            for before, part in zip(["", *parts], parts):
                if (part in _ELSE_NAMES or (part == _HEADER and not within)) and before not in ("no", "has", "with", "without"):
                    other = True
    if "hidden" in attributes.lower().split() or found.get("aria-hidden") == "true":
        other = True
    return other, label


class Page:
    """Blocks of text of a page, each with the node that holds it."""

    def __init__(self, html: str):
        self.root = _Node("#", "#", None, False, "")
        self.nodes: list[_Node] = [self.root]
        self.blocks: list[tuple[str, _Node, bool]] = []  # text, node, whether all of it is links
        self._parts: list[str] = []
        self._plain = False
        stack = [self.root]
        links = at = 0
        while at < len(html):
            m = _TOKEN.match(html, at)
            token, at = m[0], m.end()
            if token[0] != "<" or token == "<":
                self._parts.append(token)
                self._plain |= not links and not token.isspace()
                continue
            tag = m[2]
            if tag is None:
                if token.startswith("<![CDATA["):
                    continue
                bad = re.match(r"<(/?)([a-zA-Z][^\s/>]*)", token)
                if not bad:
                    continue
                closing, tag, attributes = bad[1], bad[2].lower(), ""
            else:
                closing, tag, attributes = m[1], tag.lower(), m[3] or ""
            if tag == "a":
                links = 0 if closing else 1
            if tag == "br":
                self._parts.append(" ")
                continue
            if tag == "hr":
                self._end(stack[-1])
                continue
            if tag in _RAW and not closing:
                if attributes.endswith("/"):
                    continue
                end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if tag not in _BLOCK and not (tag in _ELSE_TAGS or "=" in attributes):
                continue  # inline
            if closing:
                if any(n.tag == tag for n in stack[1:]):
                    self._end(stack[-1])
                    while stack.pop().tag != tag:
                        pass
                continue
            if tag in _VOID:
                continue
            if tag not in _BLOCK:
                other, label = _purpose(tag, attributes, stack[-1].within)
                if not other:
                    continue
            else:
                self._end(stack[-1])
                if any(n.tag == "p" for n in stack):
                    while stack.pop().tag != "p":
                        pass
                if tag in _CLOSED_BY:
                    shut, scope = _CLOSED_BY[tag]
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in shut:
                            del stack[i:]
                            break
                        if stack[i].tag in scope:
                            break
                other, label = _purpose(tag, attributes, stack[-1].within)
            up = stack[-1]
            within = up.within or (tag if tag in ("article", "main") and not other and not up.other else "")
            if up.within == "main" and tag == "article" and not other:
                within = "article"
            node = _Node(tag, label, up, up.other or other, within)
            self.nodes.append(node)
            stack.append(node)
        self._end(stack[-1])

    def _end(self, node: _Node) -> None:
        if self._parts:
            text = " ".join(unescape("".join(self._parts)).split())
            if text:
                self.blocks.append((text, node, not self._plain))
            self._parts, self._plain = [], False

    def folded(self) -> tuple[list, dict[int, int]]:
        """The tree with siblings of one label folded together, as nested lists
        [label, number, children], and the number of every node's fold."""
        number: dict[int, int] = {id(self.root): 0}
        tree: list = ["#", 0, []]
        folds = {0: tree}
        for node in self.nodes[1:]:
            up = folds[number[id(node.parent)]]
            own = next((c for c in up[2] if c[0] == node.label), None)
            if own is None:
                own = [node.label, len(folds), []]
                up[2].append(own)
                folds[len(folds)] = own
            number[id(node)] = own[1]
        return tree, number


def _match(a: list, b: list, known: dict) -> int:
    """Simple tree matching: the most nodes of two trees that can be paired, parents and order kept."""
    if a[0] != b[0]:
        return 0
    key = a[1], b[1]
    if key not in known:
        best = [[0] * (len(b[2]) + 1) for _ in range(len(a[2]) + 1)]
        for i, x in enumerate(a[2], 1):
            for j, y in enumerate(b[2], 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + _match(x, y, known))
        known[key] = best[-1][-1] + 1, best
    return known[key][0]


def align(tree: list, reference: list) -> dict[int, int]:
    """Folds of a page paired with those of the reference, in a best match."""
    known: dict = {}
    pairs: dict[int, int] = {}
    if not _match(tree, reference, known):
        return pairs
    stack = [(tree, reference)]
    while stack:
        a, b = stack.pop()
        pairs[a[1]] = b[1]
        best = known[a[1], b[1]][1]
        i, j = len(a[2]), len(b[2])
        while i and j:
            x, y = a[2][i - 1], b[2][j - 1]
            gain = _match(x, y, known)
            if gain and best[i][j] == best[i - 1][j - 1] + gain:
                stack.append((x, y))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return pairs


def _slots(page: Page, blocks: list, reference: list | None) -> list[str]:
    """The wrapper's slot of each block; what is not in the wrapper goes by its path."""
    if not reference:
        return [""] * len(blocks)
    tree, number = page.folded()
    pairs = align(tree, reference)

    def slot(node):
        paired = pairs.get(number[id(node)])
        if paired is not None:
            return str(paired)
        path = []
        while node is not None:
            path.append(node.label)
            node = node.parent
        return "/".join(reversed(path))

    return [slot(b[1]) for b in blocks]


def _sign(slot: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{slot}\n{text}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def content_blocks(html: str | None, reference: list | None = None) -> list[tuple[str, int]]:
    """Text of a page's content blocks in page order, each with the sign of its slot and text.

    Content stands in an article, or if none holds text in the main element,
    or else anywhere; lists of mere links count as menus outside of articles.
    """
    page = Page(html or "")
    content = [b for b in page.blocks if not b[1].other]
    for within in ("article", "main"):
        inside = [b for b in content if b[1].within == within]
        if inside:
            content = inside
            break
    else:
        content = [b for b in content if not (b[2] and b[1].tag in ("li", "ul", "ol", "td"))]
    slots = _slots(page, content, reference)
    return [(b[0], _sign(s, b[0])) for b, s in zip(content, slots)]


# --- over all pages ---------------------------------------------------------


def _tree(batches):
    for batch in batches:
        trees = [json.dumps(Page(h or "").folded()[0]) for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, pa.string())], names=["host", "tree"])


def _loaded(trees):
    """Parsed reference trees of a batch, each once."""
    known: dict = {}
    for t in trees:
        if t not in known:
            known[t] = json.loads(t) if t else None
        yield known[t]


def _blocks(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            trees = _loaded(part.column(5).to_pylist())
            found = [content_blocks(h, t) for h, t in zip(part.column(4).to_pylist(), trees)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(4)), pa.array([[b[0] for b in f] for f in found], pa.list_(pa.string())),
                 pa.array([[b[1] for b in f] for f in found], pa.list_(pa.int64()))],
                names=["page_id", "url", "host", "page", "texts", "signs"],
            )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (empty if the page has none), n_chars (code points), one row per page.

    Null html counts as empty. Pages whose url is null or names no host are
    one host. Hosts with fewer than `PAGES` different pages have no template.
    Repeated rows are kept and counted once for the template; null and
    repeated ids stay as they are. Broken markup is read as browsers do in
    the common cases: unknown ends are ignored, open elements end with what
    holds them, and a quote that is never closed does not hide the end of its
    tag. Other columns are not read. An empty table gives an empty result.
    """
    bounded_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    given = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"),
        host.alias("host"),
    ).withColumn("page", F.xxhash64("html"))
    hosts = checkpointed(given.groupBy("host").agg(F.min("page").alias("first"), F.countDistinct("page").alias("pages")).filter(F.col("pages") >= PAGES))
    chosen = given.join(hosts, "host").filter(F.col("page") == F.col("first")).select("host", "html").dropDuplicates(["host"])
    trees = checkpointed(chosen.mapInArrow(_tree, "host string, tree string"))
    # Every page is parsed once; the folded trees are all that is joined to it.
    blocks = checkpointed(given.join(trees, "host", "left").select("page_id", "url", "host", "page", "html", "tree").mapInArrow(
        _blocks, "page_id long, url string, host string, page long, texts array<string>, signs array<long>"
    ))
    often = (
        blocks.join(hosts.select("host", "pages"), "host").select("host", "page", "pages", F.explode(F.array_distinct("signs")).alias("sign"))
        .distinct().groupBy("host", "sign").agg(F.count("*").alias("n"), F.first("pages").alias("pages"))
        .filter((F.col("n") >= PAGES) & (F.col("n") >= SHARE * F.col("pages")))
    )
    # At most 1 / SHARE times the blocks of a page for each host.
    constant = checkpointed(often.groupBy("host").agg(F.collect_list("sign").alias("constant")))
    varying = F.filter("texts", lambda t, i: ~F.array_contains(F.col("constant"), F.get(F.col("signs"), i)))
    kept = F.when(F.col("constant").isNull(), F.col("texts")).otherwise(varying)
    # A page whose content is all constant keeps it.
    text = F.array_join(F.when(F.size(kept) > 0, kept).otherwise(F.col("texts")), " ")
    return blocks.join(constant, "host", "left").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
