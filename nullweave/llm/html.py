"""HTML main-text extraction.

Method: composite text density.  For every DOM node: characters per tag,
adjusted by the share of link characters and link tags; a node's density sum is
that of its children.  The node with the largest sum is taken; the smallest
density on its path to the body is the page's threshold, and every node at or
above it adds the largest-sum subtree below it.  The text of the taken subtrees
is the page's main text, in page order.

Elements inside a line of text are part of the block that they stand in, not nodes.
Elements that never hold article text (menus, footers, scripts, a page's header ...) are left out
before densities are computed; so are forms and elements whose class, id or role
names an advert, a notice, a sidebar or reader comments, but where nothing else
on the page is an <article> or <main>, not those that hold one or that hold most
of the text (`prune`): such a name is often that of a layout, not of its content.

Defined cases: a null or empty page, or one without text, gives the empty
string; unclosed, crossed or unknown tags are repaired as far as nesting needs
it; every row gives one row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import blocks, plain

# Fixed values of HTML: element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noembed noframes svg math".split())
LEFT_OUT = frozenset("head nav footer aside script style textarea title noscript iframe template button select option input label dialog menu svg math object canvas audio video noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
SECTION = frozenset("article main".split())

#: Elements inside a line of text.
FLOWING = INLINE | {"br", "wbr", "img"}
_NAME, _STOP = re.compile(r"(/?)([a-zA-Z][^\s/>]*)"), re.compile("[>\"']")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Words in a class, id or role that mark what isn't the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar aside widget widgets nav navigation navbar menu menus breadcrumb breadcrumbs pagination pager footer masthead comment comments disqus replies reply respond related recommended share sharing social toolbar search skip legal copyright disclaimer complementary contentinfo".split()
)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("chars", "children", "density", "link_chars", "link_tags", "noise", "parts", "tag", "tags", "total")

    def __init__(self, tag: str):
        self.tag, self.parts, self.children = tag, [], []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.noise = False


def _noise(tag: str, attributes: str) -> bool:
    """Whether an element's name or attributes say that it isn't the article."""
    if tag == "form":
        return True
    if tag in SECTION or tag in ("html", "body") or not attributes:
        return False
    for m in _NAMES.finditer(attributes):
        if any(w.lower() in NOISE for w in _WORD.findall(m[2] or m[3] or m[4] or "")):
            return True
    return False


def _tag_end(page: str, at: int) -> int:
    """Where a tag ends whose attributes start at `at`: after the first > outside of quotes, -1 if there is none."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.end()
        close = page.find(m[0], m.end())
        if close < 0:  # a quote that never closes is a character like others
            return page.find(">", m.end()) + 1 or -1
        at = close + 1
    return -1


def markup(page: str):
    """(text before, slash, tag, attributes, where the markup ends) of each tag, in one pass; comments and declarations have no tag."""
    text, at, end = 0, 0, len(page)
    while (lt := page.find("<", at)) >= 0:
        slash = tag = attributes = ""
        if page.startswith("<!--", lt):
            at = page.find("-->", lt + 4) + 3
            at = end if at < 3 else at
        elif page.startswith(("<!", "<?"), lt):
            at = page.find(">", lt) + 1
        elif m := _NAME.match(page, lt + 1):
            at, (slash, tag) = _tag_end(page, m.end()), m.groups()
            attributes = page[m.end() : at - 1]
        else:
            at = lt + 1
            continue
        if at <= 0:
            break  # no markup ends any more: the rest is text
        text = yield page[text:lt], slash, tag.lower(), attributes, at
        if text is None:
            text = at
        else:  # the parser went on by itself, past the content of a script, say
            at = text
            yield
    yield page[text:], "", "", "", end


def parse(page: str) -> Node:
    """The tree of a page without what never holds article text; `parts` are texts and child nodes in order."""
    root = Node("body")
    stack, left_out = [root], 0  # left_out: depth in the stack of the first element left out
    opened: Counter = Counter()

    def close(k: int) -> None:
        nonlocal left_out
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]
        if left_out >= len(stack):
            left_out = 0

    steps = markup(page)
    for text, slash, tag, attributes, at in steps:
        if text and not left_out:
            stack[-1].parts.append(text)
        if not tag:
            continue
        if slash:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break  # a stray end tag of an inline element
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P or tag in CLOSED_BY_SAME:
            same, until = ("p", ()) if tag in CLOSES_P else (tag, CLOSED_BY_SAME[tag])
            for k in range(len(stack) - 1, 0, -1) if opened[same] else ():
                if stack[k].tag == same:
                    close(k)
                    break
                if stack[k].tag in until or (same == "p" and stack[k].tag not in INLINE):
                    break
        node = Node(tag)
        if not left_out:
            if tag in LEFT_OUT or (tag == "header" and not any(opened[x] for x in SECTION)):
                left_out = len(stack)
                stack[-1].parts.append(" ")
            else:
                node.noise = _noise(tag, attributes)
                stack[-1].parts.append(node)
                stack[-1].children.append(node)
        if tag in VOID or (attributes.endswith("/") and tag not in RAW and tag not in CLOSES_P and tag not in INLINE):
            left_out = 0 if left_out == len(stack) else left_out
            continue
        if tag in RAW:
            ends = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            steps.send(ends.end() if ends else len(page))
            left_out = 0 if left_out == len(stack) else left_out
            continue
        stack.append(node)
        opened[tag] += 1
    return root


def prune(root: Node) -> None:
    """Takes out the elements marked as noise, but for those that seem to hold the page's article.

    Under a node with an <article> or <main> outside all noise, all noise goes.  Elsewhere what holds one stays, and what
    holds more than half of the text; the same is then done inside of it."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.children
    if not any(n.noise for n in order):
        return
    text, section = {}, {}  # characters below a node; whether it is or holds an article with text
    for n in reversed(order):
        text[id(n)] = sum(len(p.strip()) for p in n.parts if isinstance(p, str)) + sum(text[id(c)] for c in n.children)
        section[id(n)] = bool(text[id(n)]) and (n.tag in SECTION or any(section[id(c)] for c in n.children))
    tops, gone = [root], {}
    while tops:
        top = tops.pop()
        found, clean, todo = [], False, [top]
        while todo:
            node = todo.pop()
            clean = clean or (node.tag in SECTION and section[id(node)])
            for c in node.children:
                if c.noise:
                    found.append((node, c))
                else:
                    todo.append(c)
        for parent, node in found:
            if not clean and (section[id(node)] or 2 * text[id(node)] > text[id(top)]):
                tops.append(node)
            else:
                gone.setdefault(id(parent), (parent, set()))[1].add(id(node))
    for parent, ids in gone.values():
        parent.parts = [" " if id(p) in ids else p for p in parent.parts]
        parent.children = [c for c in parent.children if id(c) not in ids]


def measure(root: Node) -> list[Node]:
    """Fills in characters, tags, composite densities and density sums; the nodes that are blocks, children first.

    An element inside a line of text (`INLINE`, br) is no node of its own here: a paragraph's text counts as one, in however
    many pieces it is set.  Links alone count as tags."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.children
    order.reverse()
    inner: dict[int, list] = {}  # the blocks right below a node, through what is inline
    for n in order:
        inner[id(n)] = [b for c in n.children for b in (inner.pop(id(c)) if c.tag in FLOWING else [c])]
        n.chars = sum(len(_SPACE.sub(" ", p).strip()) for p in n.parts if isinstance(p, str)) + sum(c.chars for c in n.children)
        n.tags = sum(c.tags + (c.tag not in FLOWING or c.tag == "a") for c in n.children)
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        else:
            n.link_chars, n.link_tags = sum(c.link_chars for c in n.children), sum(c.link_tags for c in n.children)
    share = root.link_chars / max(1, root.chars)
    blocks = [n for n in order if n.tag not in FLOWING]
    for n in blocks:
        if n.chars:
            text, links, tags, link_tags = n.chars, max(1, n.link_chars), max(1, n.tags), max(1, n.link_tags)
            base = math.log(text / max(1, text - n.link_chars) * n.link_chars + share * text + math.e)
            n.density = text / tags * (math.log(text / links * tags / link_tags + 1) / base)
        n.children = inner[id(n)]
        n.total = sum(c.density for c in n.children) or n.density
    return blocks


def taken(root: Node) -> set[int]:
    """ids of the nodes whose subtrees are the main text."""
    order = measure(root)
    parent = {id(c): n for n in order for c in n.children}
    best: dict[int, Node] = {}
    for n in order:
        best[id(n)] = max((n, *(best[id(c)] for c in n.children)), key=lambda x: x.total)
    top = node = best[id(root)]
    threshold = node.density
    while node is not root:
        node = parent[id(node)]
        threshold = min(threshold, node.density)
    return {id(top)} | {id(best[id(n)]) for n in order if n.chars and n.density >= threshold}


def main_text(page: str | None) -> str:
    """Main text of a page, blocks joined by one space."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    keep = taken(root)
    out: list[str] = []
    todo: list = [(root, False)]
    while todo:
        part, inside = todo.pop()
        if isinstance(part, str):
            if inside:
                out.append(part)
            continue
        inside = inside or id(part) in keep
        gap = [] if part.tag in INLINE or part.tag == "wbr" else [(" ", inside)]
        todo += gap + [(p, inside) for p in reversed(part.parts)] + gap
    return _SPACE.sub(" ", entities.unescape("".join(out))).strip()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, from its whole html."""

    def run(batches):
        import pyarrow as pa

        for part in blocks(batches, "html"):
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = plain(pages, page_id="page_id", url="url", html="html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
