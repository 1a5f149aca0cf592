"""Main text of web pages by composite text density.

The page becomes a tree; what is no article by its tag, role or class (menus,
headers, footers, sidebars, notices, adverts, forms, comments) is left out.
A form, or an element of such a name, is a container instead if it holds an
article or main element or most of the page's text outside links; so is one
whose name may as well be an article's topic or part (widget, tag, side,
social, or a word of the list joined with one that names no part of a page's
layout, as in related-work) if it holds mostly unlinked text, and a section of
an article whose id alone is such a word, as a chapter on search or menus may
have, if it holds no form besides. Comments, cookie
notices, adverts and what is named a sidebar, footer or navigation are never
the article, unless the name is a layout's (content-sidebar-wrap). An article
element named after comments is no article. If nothing is left, only controls,
scripts and the like are left out.
For each remaining element the composite text density is its characters per
tag, adjusted for links: log of (C/L * T/LT) to the base 1 + ln(C/(C-L)
* L + LB/CB * C + e), times C/T, with C characters, T tags, L and LT those in
links, and CB, LB the body's. The element with the greatest sum of its
children's densities is the core; the least density on its path to the body
is the threshold. Going up from the core, an ancestor takes its place while
something else in it passes the threshold, and the article element around it
does so too. Its blocks, in page order, are the text. If none of them is a top
heading, the last one before it that stands beside it or beside an ancestor and
is no link goes first. References are decoded within a run of text, never
across tags.

Every row gets a row: a null or empty page has an empty text, a page without
tags is its own text; repeated and null page_ids are rows like others, and an
empty table gives none. Of elements with equal sums the first in the page
is the core. Bytes that are no UTF-8 become U+FFFD. The time is linear in the
page's length whatever its nesting, which no recursion limits.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table, texts_of

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
DROPPED = frozenset(
    "script style noscript template iframe object embed svg canvas audio video map head title nav footer aside form button select textarea input label fieldset"
    " dialog menu search noframes applet datalist progress meter".split()
)
SIBLINGS = {  # an open element of the second set ends where the first begins
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
}
BARRIERS = frozenset("table ul ol dl select body html article section div main".split())
#: Words in a class, id or role that name something other than the article.
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
OTHER = re.compile(
    r"(?:^|\s|(?<!has)(?<!with)(?<!no)[_-])(?:ad(?:s|box|slot|unit|wrap\w*|container|\d+)?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription"
    r"|signup|login|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|widget|footer|masthead|topbar|toolbar|comments?|commentlist|disqus|respond|replies"
    r"|share|sharing|social|related|recommend\w*|pagination|pager|tags?|skip|contentinfo|complementary|search|hidden|disclaimer)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Words that name parts of a page's layout: joined with one of the list they make no topic.
LAYOUT = re.compile(
    r"[\d_-]*|\w|area|articles?|banner|bars?|block|body|bottom|box|btn|buttons?|cards?|cell|center|col|column|container|content|count|cta|div|dialog|entry|feed|field|footer|form|frame|global|grid|group|header"
    r"|heading|holder|icons?|inline|inner|input|items?|js|label|layer|leaderboard|left|links?|list|lists|main|media|meta|mobile|modal|module|new|news|outer|page|panel|pane|posts?|primary|products?|rail|results?|right"
    r"|row|secondary|section|site|slot|spot|square|sticky|stories|story|tabs?|text|thread|title|toggle|top|tower|unit|us|user|videos?|view|widgets?|wrap|wrapper|zone",
    re.IGNORECASE,
)
#: An article element of such a class is a reader's comment.
_COMMENT = re.compile(r"(?:^|\s)comments?(?:$|[\s_-])", re.IGNORECASE)
#: What never is the article, however much text it holds.
_ENDS = r"(?:$|[\s_-])"
NEVER = re.compile(rf"(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|replies|cookies?|consent|gdpr|sidebar|aside|footer|nav|navbar|navigation|advert\w*|sponsor\w*){_ENDS}", re.IGNORECASE)
#: Of these a name may be a layout's, around the article as well (content-sidebar-wrap).
_PLACED = re.compile(rf"(?<![^\s_-])(?:sidebar|aside|footer|nav|navbar|navigation)(?={_ENDS})", re.IGNORECASE)
_AROUND = re.compile(rf"(?<![^_-])(?:content|main|layout|page|body|wrap\w*){_ENDS}", re.IGNORECASE)
#: Words that name parts of articles as well.
AMBIGUOUS = re.compile(rf"(?<![^\s_-])(?:widget|tags?|side|social)(?={_ENDS})", re.IGNORECASE)
#: Classes that page builders and blogs give to the parts and the topics of an article.
_BUILDER = re.compile(r"(?<!\S)elementor-widget(?!\S)|(?<!\S)elementor-widget-(?=text|heading|theme-post-(?:content|title))", re.IGNORECASE)
_POST, _TOPIC = re.compile(r"(?<!\S)(?:hentry|type-\w+|post)(?!\S)", re.IGNORECASE), re.compile(r"(?<!\S)tag-\S+", re.IGNORECASE)
#: Words that an article's chapters may have for an id.
CHAPTER = re.compile(r"(?<![^\s_-])(?:menu|breadcrumbs?|search|banner|notice|notification|alert|popup|modal|overlay|login|signup|toolbar|pagination|hidden|disclaimer|skip|tags?|social|side|widget)(?=$|[\s_-])", re.IGNORECASE)
#: Left out in any case.
CONTROLS = frozenset("script style noscript template iframe object embed svg canvas audio video map head title button select textarea input label datalist progress meter noframes applet".split())
#: What may hold the article after all, and the least characters outside links that make it do so by themselves.
_MAY_HOLD = {"form": math.inf, "name": math.inf, "ambiguous": 80, "topic": 1, "chapter": 1}
SITE_HEADER = re.compile(r"(?:^|\s)(?:(?:site|page|top|global|main)[_-]?)?header(?:$|\s)", re.IGNORECASE)

_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|$)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


class Node:
    __slots__ = ("tag", "parent", "depth", "barrier", "block", "in_article", "in_main", "children", "chars", "tags", "links", "link_tags", "density", "total", "other", "why")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.other, self.why = tag, parent, False, ""
        self.depth = parent.depth + 1 if parent else 0
        # the innermost barrier and block around a place in this element
        self.barrier = self if tag in BARRIERS or parent is None else parent.barrier
        self.block = self if tag in BLOCKS or parent is None else parent.block
        self.in_article = tag == "article" or (parent is not None and parent.in_article)
        self.in_main = tag == "main" or (parent is not None and parent.in_main)
        self.children: list[Node | str] = []
        self.chars = self.tags = self.links = self.link_tags = 0
        self.density = self.total = 0.0


def _is_topic(names: str) -> bool:
    """Whether each listed word of a class or id stands in a longer name that is about something."""
    hits = [n for n in names.split() if OTHER.search(n)]
    return bool(hits) and all(any(not OTHER.search(part) and not LAYOUT.fullmatch(part) for part in re.split("[_-]+", n)) for n in hits)


def _named_other(tag: str, attributes: str, parent: Node) -> str:
    """Why an element is no part of an article: "tag", "hidden", "form", "name", "ambiguous", "topic" or "chapter"; empty if it may be one."""
    if tag in DROPPED:
        return "form" if tag == "form" else "tag"
    if tag == "header" and not (parent.in_article or parent.in_main):
        return "tag"
    if not attributes or tag in ("html", "body", "main"):
        return ""
    why = ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), _CAMEL.sub("-", next((v for v in values if v), ""))
        if tag == "article":
            if name == "class" and _COMMENT.search(value):
                why = "name"
            continue
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return "hidden"
        if name not in ("class", "id", "role"):
            continue
        if name == "id" and tag == "section" and (parent.in_article or parent.in_main) and OTHER.search(value) and not OTHER.search(CHAPTER.sub("x", value)):
            why = why or "chapter"
            continue
        value = _BUILDER.sub(" ", value)
        if name == "class" and _POST.search(value):
            value = _TOPIC.sub(" ", value)
        if SITE_HEADER.search(value) and not parent.in_article:
            why = "tag"
        elif OTHER.search(value):
            kind = "tag" if _is_never(value) else "topic" if _is_topic(value) else "name" if OTHER.search(AMBIGUOUS.sub("x", value)) else "ambiguous"
            why = kind if not why or why in ("ambiguous", "topic", "chapter") or kind == "tag" else why
    return why


def _closes_itself(attributes: str) -> bool:
    """Whether a tag ends in a slash that is no part of an unquoted value, as in href=/."""
    last = attributes.split()[-1:] or [""]
    return last[0].endswith("/") and ("=" not in last[0] or last[0][-2] in "\"'")


def _is_never(names: str) -> bool:
    """Whether some name of a class or id is of what never is the article, and not of a layout around it."""
    return any(NEVER.search(n) and not (_AROUND.search(n) and not NEVER.search(_PLACED.sub("x", n))) for n in names.split())


class _Open:
    """The open elements; each is found by its tag, so that no step walks the depth."""

    def __init__(self, root: Node):
        self.now, self.by_tag = root, {}

    def push(self, node: Node) -> None:
        self.by_tag.setdefault(node.tag, []).append(node)
        self.now = node

    def close(self, node: Node) -> None:
        """Ends an element and all within it."""
        while self.now.depth >= node.depth:
            self.by_tag[self.now.tag].pop()
            self.now = self.now.parent

    def last(self, tag: str) -> Node | None:
        found = self.by_tag.get(tag)
        return found[-1] if found else None

    def outermost(self, tags: set[str], beyond: int) -> Node | None:
        """The outermost open element of these tags that is deeper than ``beyond``."""
        found = None
        for tag in tags:
            own = self.by_tag.get(tag, [])
            i = bisect_right(own, beyond, key=lambda n: n.depth)
            if i < len(own) and (found is None or own[i].depth < found.depth):
                found = own[i]
        return found


def parse(page: str) -> Node:
    """A tree of the page's elements; unclosed and misplaced tags are put right as browsers do."""
    root = Node("html", None)
    at, opened, every = 0, _Open(root), [root]
    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            opened.now.children.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in VOID:
                if tag == "br":
                    opened.now.children.append(" ")
                continue
            node = opened.last(tag)
            if node is not None and (tag in BLOCKS or node.depth >= opened.now.barrier.depth):
                opened.close(node)
            continue
        if tag in ("html",):
            continue
        if tag in CLOSES_P and opened.now.block.tag == "p":
            opened.close(opened.now.block)
        if tag in SIBLINGS:
            node = opened.outermost(SIBLINGS[tag], opened.now.barrier.depth)
            if node is not None:
                opened.close(node)
        now = opened.now
        if tag == "body" and now.tag == "head":
            opened.close(now)
            now = opened.now
        if tag == "br":
            now.children.append(" ")
            continue
        node = Node(tag, now)
        node.why = _named_other(tag, m[3], now)
        node.other = bool(node.why)
        now.children.append(node)
        every.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}", re.IGNORECASE | re.ASCII).search(page, at)
            end = end.start() if end else len(page)
            node.children.append(page[at:end])
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
        elif tag not in VOID and (tag in BLOCKS or not _closes_itself(m[3])):
            opened.push(node)
    if at < len(page):
        opened.now.children.append(page[at:])
    # what holds the article is no advert, whatever its class says
    holds: set[int] = set()
    for node in reversed(every):
        if id(node) in holds:
            node.other = node.other and node.tag in DROPPED and node.tag != "form"
        if node.parent is not None and (id(node) in holds or (node.tag in ("article", "main") and not node.other)):
            holds.add(id(node.parent))
    return root


def _free(root: Node) -> None:
    """Makes containers of forms and named elements that hold the page's text."""
    nodes = [root]
    for node in nodes:
        nodes.extend(c for c in node.children if isinstance(c, Node) and c.tag not in CONTROLS and c.why != "hidden")
    if not any(n.other and n.why in _MAY_HOLD for n in nodes):
        return
    chars, links, forms = {}, {}, set()
    for node in reversed(nodes):
        if node.parent is not None and (node.tag == "form" or id(node) in forms):
            forms.add(id(node.parent))
        own = [c for c in node.children if isinstance(c, Node) and id(c) in chars]
        chars[id(node)] = sum(chars[id(c)] for c in own) + sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        links[id(node)] = chars[id(node)] if node.tag == "a" else sum(links[id(c)] for c in own)
    text = chars[id(root)] - links[id(root)]
    for node in nodes:
        if node.other and node.why in _MAY_HOLD:
            c, own = chars[id(node)], chars[id(node)] - links[id(node)]
            if node.why == "chapter" and id(node) in forms:
                continue
            if 2 * own > text or (own >= _MAY_HOLD[node.why] and 5 * own >= 4 * c):
                node.other = False


def _elements(root: Node) -> list[Node]:
    """All elements that may be of the article, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.other)
    return out


def _measure(nodes: list[Node], body: Node) -> None:
    for node in reversed(nodes):
        linked = node.tag == "a"
        for c in node.children:
            if isinstance(c, str):
                node.chars += len("".join(c.split()))
            elif not c.other:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.links += c.links
                node.link_tags += c.link_tags + (c.tag == "a")
        if linked:
            node.links, node.link_tags = node.chars, node.tags
    share = body.links / max(body.chars, 1)
    for node in nodes:
        c, t, l, lt = node.chars, max(node.tags, 1), node.links, node.link_tags
        if c:
            base = 1 + math.log(c / max(c - l, 1) * l + share * c + math.e)
            node.density = c / t * math.log(c / max(l, 1) * t / max(lt, 1)) / math.log(base)
    for node in nodes:
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.other)
        node.total += sum(len(c.strip()) for c in node.children if isinstance(c, str))


def _blocks(top: Node) -> list[str]:
    """The texts of the blocks under an element, in page order."""
    out, now = [], []

    def end() -> None:
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    stack: list[Node | str | None] = [top]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(entities.unescape(x))
        elif not x.other:
            if x.tag in BLOCKS:
                end()
                stack.append(None)
            stack.extend(reversed(x.children))
    end()
    return out


def _headline(body: Node, found: Node) -> Node | None:
    """The last unlinked top heading before an element without one, beside it or beside an ancestor."""
    if any(n.tag == "h1" and n.chars for n in _elements(found)):
        return None
    inner = found
    while inner is not body and inner.parent is not None:
        before, outer = None, inner.parent
        for c in outer.children:
            if c is inner:
                break
            if isinstance(c, Node) and c.tag == "h1" and not c.other and c.chars > 2 * c.links:
                before = c
        if before is not None:
            return before
        inner = outer
    return None


def _candidates(root: Node) -> tuple[Node, list[Node]]:
    """The body, and its elements with text that may be of the article, measured."""
    nodes = _elements(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    _measure(nodes, body)
    return body, [n for n in (nodes if body is root else _elements(body)) if n.chars]


def main_text(page: str) -> str:
    """The blocks of the page's article, one to a line."""
    if "<" not in page:
        return " ".join(entities.unescape(page).split())
    root = parse(page)
    _free(root)
    body, within = _candidates(root)
    if not within:
        stack = [root]
        for node in stack:
            node.other = node.tag in CONTROLS or node.why == "hidden"
            node.chars = node.tags = node.links = node.link_tags = 0
            stack.extend(c for c in node.children if isinstance(c, Node))
        body, within = _candidates(root)
    if not within:
        return ""
    core = max(within, key=lambda n: n.total)
    path = [core]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min((n.density for n in path if n.density > 0), default=0.0)
    top = 0
    for i, (inner, outer) in enumerate(zip(path, path[1:], strict=False), 1):
        others = [c for c in outer.children if isinstance(c, Node) and not c.other and c is not inner and c.chars]
        if any(c.density >= threshold for c in others) or any(isinstance(c, str) and c.strip() for c in outer.children):
            top = i
    around = next((i for i, n in enumerate(path) if n.tag in ("article", "main")), 0)
    found = path[max(top, around)]
    headline = _headline(body, found)
    return "\n".join((_blocks(headline) if headline else []) + _blocks(found))


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages(page_id, url, html)``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(x.decode("utf-8", "replace")) for x in texts_of(batch.column(2))]
        kinds = [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
        return pa.record_batch(kinds, names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages, ["page_id", "url", "html"], run, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))
