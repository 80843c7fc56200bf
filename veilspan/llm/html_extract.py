"""Main text of web pages by composite text density.

A page becomes a tree in one pass over its tags.  Every element has characters C, tags T, link
characters LC and link tags LT of its subtree.  Its density is the number of characters for each
tag, adjusted by links:

    C / T * log(C/LC * T/LT) to the base  ln(C/nLC * LC + LC_body/C_body * C + e),   nLC = C - LC

A density sum is the sum of the children's densities.  The subtree with the largest sum is the
core; the least density on the path from it to the body is the page's threshold.  The core is kept
whole, and so is an article or main element that holds it.  Of the path's elements, which all reach the
threshold, the loose text (with inline elements) is kept, and the other blocks that reach it; so are
all article and main elements with text, whether they reach it or not.  What consists of links for half or more is left out.
Scripts and hidden elements are left out of the tree.  So are menus, forms, page headers and
footers, asides, and elements that name themselves adverts, notices or comments, but only those that do
not hold the page: a name is not believed where the element holds the core, half of the page's text or
most of its article, nor are the names of a page without an article where they would leave out three quarters.
"""

from __future__ import annotations

import html as entities
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg".split())
IN_HEAD = frozenset("base link meta".split()) | RAW
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
#: An open p ends where one of these begins.
ENDS_P = BLOCK - frozenset("body head html legend optgroup option tbody td tfoot th thead tr".split())
#: Opening one of these closes an open one of the others named, up to the given parents.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
#: Never article text.
BOILERPLATE = frozenset("nav header footer aside form button select dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMES = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|comments?|disqus|respond|replies|sidebar|side|nav|navbar|navigation|menu|"
                   r"breadcrumbs?|header|footer|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|"
                   r"social|related|recommended|widget|toolbar|pagination|pager)(?:$|[-_ ])", re.I)
#: Where a tag, a comment or a declaration begins; the rest of a tag, whose quoted values may hold ``>``.
OPENING = re.compile(r"<(?:(/?)([A-Za-z][A-Za-z0-9:-]*)|(!--)|[!?])")
REST = re.compile(r"((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>")
RAW_ENDS = {name: re.compile(rf"</{name}(?![A-Za-z0-9:-])", re.I | re.A) for name in RAW}
#: One attribute: its name, then a quoted or bare value.
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
JUDGED = ("class", "id", "role", "hidden", "aria-hidden", "style")
BLANKS = re.compile(r"[\s\x00]+")


class Node:
    """An element; items are its texts and child elements in order.  article_chars: those inside article and main elements."""

    __slots__ = ("tag", "parent", "items", "out", "named", "chars", "tags", "link_chars", "link_tags", "article_chars", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", out: bool, named: bool = False):
        self.tag, self.parent, self.items, self.out, self.named = tag, parent, [], out, named
        self.clear()

    def clear(self) -> None:
        self.chars = self.tags = self.link_chars = self.link_tags = self.article_chars = 0
        self.density = self.total = 0.0


def _judged(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is hidden, and whether its tag, role or names tell of boilerplate."""
    named = tag in BOILERPLATE
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, named
    seen = set()
    for found in ATTRIBUTE.finditer(attributes):
        name, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if name not in JUDGED or name in seen:  # of repeated attributes the first one counts
            continue
        seen.add(name)
        if name in ("class", "id") and NAMES.search(value) or name == "role" and value.lower() in ROLES:
            named = True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, named
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, named
    return False, named


class _Open:
    """The open elements, with the places of each name and of the blocks, so that no search walks over them."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks = [root], {}, [-1]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def last(self, names) -> int:
        return max((places[-1] for name in names if (places := self.at.get(name))), default=-1)

    def close(self, name: str) -> None:
        k = self.last((name,))
        if k > 0 and (name in BLOCK or k > self.blocks[-1]):  # an inline end tag closes nothing beyond its block
            self.cut(k)

    def make_way(self, name: str) -> None:
        """Closes what cannot stay open when ``name`` begins."""
        if name in ENDS_P and self.blocks[-1] > 0 and self.stack[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])
        if name in CLOSES:
            same, bounds = CLOSES[name]
            while (k := self.last(same)) > self.last(bounds):
                self.cut(k)
                if name != "tr":
                    break


def parse(page: str) -> Node:
    """The tree of a page; unclosed and stray tags are mended as browsers do in the common cases.

    All content outside the head belongs to the body, also what stands before, behind or without one.
    """
    root = Node("#root", None, False)
    open_, at, size = _Open(root), 0, len(page)
    stack, quotes, body = open_.stack, True, None
    while at < size:
        found = OPENING.search(page, at)
        end = found.start() if found else size
        if found and not found[3] and page.find(">", end) < 0:
            found, end = None, size  # no tag ends any more
        if end > at:
            if stack[-1].tag == "head" and not page[at:end].isspace():
                open_.cut(len(stack) - 1)  # text ends the head
            if not stack[-1].out:
                stack[-1].items.append(page[at:end])
        if not found:
            break
        if found[3]:
            at = page.find("-->", end + 4)
            at = size if at < 0 else at + 3
            continue
        if found[2] is None:
            at = page.find(">", end) + 1
            continue
        name = found[2].lower()
        rest = REST.match(page, found.end()) if quotes else None
        if rest is None:  # a quote stays open: from here on the next bracket ends a tag
            quotes, at = False, page.find(">", found.end()) + 1
            attributes = page[found.end():at - 1]
        else:
            attributes, at = rest[1], rest.end()
        if found[1]:
            if name not in ("body", "html"):  # what follows the body belongs to it
                open_.close(name)
            continue
        if stack[-1].tag == "head" and name not in IN_HEAD:
            open_.cut(len(stack) - 1)
        if name in RAW:
            end_tag = RAW_ENDS[name].search(page, at)
            at = page.find(">", end_tag.end()) + 1 if end_tag else size
            if not at:
                break
            continue
        if name in ("html", "head", "body"):
            if body is not None or len(stack) > 1 + (stack[-1].tag == "html") or name == "html" and len(stack) > 1:
                continue  # there is one of each, before other elements are open
        open_.make_way(name)
        parent = stack[-1]
        hidden, named = _judged(name, attributes)
        node = Node(name, parent, parent.out or hidden, named)
        if not node.out:
            parent.items.append(node)
        if name == "body":
            body = node
        # A slash does not close an element of HTML.
        if name not in VOID and (name in BLOCK or not attributes.rstrip().endswith("/")):
            open_.push(node)
    if body is not None:
        _embody(root, body)
    return root


def _embody(root: Node, body: Node) -> None:
    """Moves what stands before the body into it."""
    frame, before = ("html", "head", "body"), []
    for holder in [root] if body.parent is root else [root, body.parent]:
        before += [x for x in holder.items if type(x) is str or x.tag not in frame]
        holder.items = [x for x in holder.items if type(x) is Node and x.tag in frame]
    for x in before:
        if type(x) is Node:
            x.parent = body
    body.items[:0] = before


def _below(root: Node) -> list[Node]:
    """A subtree's elements, parents before children, without recursion."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in node.items if type(x) is Node)
    return order


def _measure(root: Node) -> list[Node]:
    """Counts of each subtree, children before parents."""
    order = _below(root)
    for node in order:
        node.clear()
    for node in reversed(order):
        for item in node.items:
            if type(item) is Node:
                node.chars += item.chars
                node.article_chars += item.article_chars
                node.tags += item.tags + 1
                node.link_chars += item.chars if item.tag == "a" else item.link_chars
                node.link_tags += item.link_tags + (item.tag == "a")
            else:
                node.chars += len(item) - item.count(" ") - item.count("\n") if item.isspace() else len(item.strip())
        if node.tag in ("article", "main"):
            node.article_chars = node.chars
    return order


def densities(root: Node) -> list[Node]:
    order = _measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(order):
        c, lc = node.chars, node.link_chars
        if c:
            t, lt, plain = max(1, node.tags), max(1, node.link_tags), max(1, c - lc)
            base = math.log(c / plain * lc + share * c + math.e)
            inside = c / max(1, lc) * t / lt
            node.density = max(0.0, c / t * (math.log(max(inside, 1e-9)) / math.log(base) if base > 1.000001 else math.log(max(inside, 1.0)) + 1))
        node.total = sum(x.density for x in node.items if type(x) is Node)
    return order


def _plain(node: Node) -> bool:
    """Most of the text is not links."""
    return node.link_chars * 2 < node.chars


def _core(order: list[Node]) -> Node | None:
    return max((n for n in order if n.total > 0), key=lambda n: n.total, default=None)


def _pruned(root: Node) -> list[Node]:
    """The nodes that are left, measured, once the boilerplate that does not hold the page is out of the tree."""
    order = densities(root)
    if not any(n.named for n in order):
        return order
    page = next((n for n in order if n.tag == "body"), root)
    node, above = _core([n for n in order if _plain(n)]), set()
    while node is not None:
        above.add(id(node))
        node = node.parent
    plain = page.chars - page.link_chars

    def believed(n: Node) -> bool:
        holds = id(n) in above or n.chars * 2 >= page.chars
        article = n.article_chars * 2 >= root.article_chars > 0 and n.chars * 4 >= page.chars
        if n.tag in BOILERPLATE and n.tag != "form" and root.article_chars and not article:
            return True  # a footer beside an article is a footer, however short the article
        return n.named and not (_plain(n) and holds or article)

    dropped = [(n.parent, n) for n in order if believed(n)]
    gone, lost = {id(n) for _, n in dropped}, 0
    inside: set[int] = set()
    for n in order:  # parents come first: what lies in another one counts once
        if id(n.parent) in inside or id(n) in gone:
            if id(n.parent) not in inside:
                lost += n.chars - n.link_chars
            inside.add(id(n))
    # Without an article the names of a page that would leave out three quarters of it say nothing.
    if lost * 4 > plain * 3 and not root.article_chars:
        gone = {id(n) for _, n in dropped if not _plain(n)}
    for parent in {id(p): p for p, _ in dropped}.values():
        parent.items = [x for x in parent.items if id(x) not in gone]
    return densities(root)


def _content(root: Node) -> list[Node]:
    """The subtrees that hold the article, in page order."""
    order = _pruned(root)
    body = next((n for n in order if n.tag == "body"), root)
    core = _core(_below(body))
    if core is None:
        return [body]
    threshold, node, path = core.density, core, []
    while node is not None and node is not body.parent:
        if node.chars:
            threshold = min(threshold, node.density)
        path.append(node)
        node = node.parent
    # An article around the core adds what it holds; it is no bound for text beside it.
    kept = next((n for n in reversed(path) if n.tag in ("article", "main")), core)
    above = path[path.index(kept) + 1:]
    whole, passed = {id(kept)}, {id(n) for n in above}

    def reaches(n: Node) -> bool:
        return n.density >= threshold > 0 and _plain(n)

    for parent in above:
        whole.update(id(x) for x in parent.items if type(x) is Node and x.tag in BLOCK and id(x) not in passed and reaches(x))
    loose = set(passed)
    for n in order:
        if n.tag in ("article", "main") and id(n) not in passed and _plain(n):
            whole.add(id(n))
            up = n.parent
            while up is not None and id(up) not in passed:
                passed.add(id(up))
                up = up.parent
    return _gathered(body, whole, passed, loose)


def _gathered(body: Node, whole: set[int], passed: set[int], loose: set[int]) -> list[Node]:
    """The kept subtrees in page order, with runs of loose text of the elements in ``loose`` as subtrees of their own."""
    out: list[Node] = []
    todo: list[Node] = [body]
    while todo:
        node = todo.pop()
        if id(node) in whole or node.tag == "#run":
            out.append(node)
            continue
        parts: list[Node] = []
        run: Node | None = None
        for item in node.items:
            if type(item) is Node and (item.tag in BLOCK or id(item) in whole or id(item) in passed):
                run = None
                if id(item) in whole or id(item) in passed:
                    parts.append(item)
            elif id(node) in loose:
                if run is None:
                    run = Node("#run", None, False)
                    parts.append(run)
                run.items.append(item)
        todo.extend(p for p in reversed(parts) if p.tag != "#run" or _mostly_text(p))
    return out


def _mostly_text(run: Node) -> bool:
    chars = sum(len(x.strip()) if type(x) is str else x.chars for x in run.items)
    links = sum(x.chars if x.tag == "a" else x.link_chars for x in run.items if type(x) is Node)
    return links * 2 < chars


def _blocks(root: Node) -> list[str]:
    """Texts between block bounds, in order; a line break is white space."""
    out: list[list[str]] = [[]]
    todo: list = [root]
    while todo:
        item = todo.pop()
        if type(item) is str:
            out[-1].append(item)
        elif item is None:
            out.append([])
        elif item.tag == "br":
            out[-1].append("\n")
        else:
            if item.tag in BLOCK:
                out.append([])
                todo.append(None)
            todo.extend(reversed(item.items))
    texts = (BLANKS.sub(" ", entities.unescape("".join(parts))).strip() for parts in out if parts)
    return [t for t in texts if t]


def extract(page: str | None) -> str:
    """The article's blocks, joined by an empty line; '' for null, empty and textless pages."""
    if not page:
        return ""
    blocks = [b for node in _content(parse(page)) for b in _blocks(node)]
    return "\n\n".join(blocks)


def main_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` plus the main text of each; rows stay apart, other columns stay as they are (but one called ``name``)."""

    def texts(pages_of: pd.Series) -> pd.Series:
        return pd.Series([extract(p) for p in pages_of], dtype=object)

    return pages.withColumn(name, F.pandas_udf(texts, "string")(F.col(html)))
