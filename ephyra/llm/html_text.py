"""Main text of web pages by tree scoring."""

from __future__ import annotations

import heapq
import re
from html import unescape

from pyspark.sql import DataFrame, types as T

from .common import field, table, with_arrow

#: Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
FOREIGN = frozenset("svg math".split())
#: Start tags that end an open svg or math element.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article section main aside header footer nav figure".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROP = frozenset("nav footer aside form script style noscript head title button select option input textarea iframe object embed canvas audio video svg math template dialog menu".split())
PARAGRAPH = frozenset("p pre td blockquote dd".split())
CONTAINER = frozenset("article main section div body td blockquote".split())
#: What an open element of the key is closed by.
CLOSED_BY = {"p": BLOCK - {"br"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
#: An end tag of the key's element reaches no further out than these.
SCOPE = frozenset("article section div main body table td th".split())
#: Words in class, id or role that mark what is not the article.
NOT_TEXT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo|promotion|sidebar|side|nav|navbar|navigation|menu|menubar|breadcrumbs?|footer|foot|masthead|site-header|page-header|contentinfo|complementary|search|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|paywall|social|share|sharing|related|recommended|comments?|commentlist|disqus|respond|replies|widget|toolbar|pagination|pager|tags?|hidden)(?=$|[\s_-])",
    re.I,
)
#: Names of what readers write below an article.
READERS = re.compile(r"(?:^|\s)(?:(?:user|reader|post|article)[_-])?(?:comments?|replies|reply|respond|discussion)(?:[_-](?:list|area|section|thread|body|box|wrapper|content|text|\d+))*(?=$|\s)|commentlist|disqus", re.I)
#: Names that only tell how a page is laid out around its article, such as "no-sidebar"; and styles that show nothing.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:no|with|without|has|left|right|two|one)[_-]\S+", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Whole names that mark the article; beside them, a name that only has one of the words above in it says nothing.
ARTICLE = re.compile(r"(?:^|\s)(?:post|entry|article|story|content|main|hentry|(?:post|entry|article|story|main|page)[_-](?:content|body|text))(?=$|\s)", re.I)
ALONE = re.compile(r"(?:(?<=\s)|^)[^\s_-]+(?=\s|$)")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTR = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:([\"'])|([^\s>]*)))?")
SPACE = re.compile(r"[\s/]*")


class Node:
    """items: text and child nodes in order. dropped: it and all in it are no text. noise: 1 or 2 (readers' words) if its names say that it is
    not the article. inner: it lies in an article. near: itself or the nearest block around it. held: how many elements of each name are
    open between the nearest element of SCOPE (itself or around it) and the place that is read."""

    __slots__ = ("tag", "parent", "items", "dropped", "noise", "kind", "score", "points", "chars", "linked", "block", "inner", "near", "held", "inside")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, noise: int = 0, kind: str = ""):
        self.tag, self.parent, self.items, self.dropped, self.noise, self.kind = tag, parent, [], dropped, noise, kind
        self.score, self.points, self.chars, self.linked, self.block = 0.0, 0, 0, 0, tag in BLOCK
        self.inner = parent is not None and (parent.inner or parent.tag == "article")
        self.near = self if self.block or parent is None else parent.near
        self.held: dict[str, int] = {} if parent is None or tag in SCOPE else parent.held
        self.inside = 0


class Reader:
    """Tags one after the other, in one pass over the page."""

    def __init__(self, html: str):
        self.html, self.ends = html, {}

    def find(self, what: str, at: int) -> int:
        """Where `what` comes next from `at` on, or -1. What a page has no more of is not looked for again."""
        if self.ends.get(what, -1) < 0 and what in self.ends:
            return -1
        self.ends[what] = found = self.html.find(what, at)
        return found

    def comment(self, at: int) -> int:
        """The end of the comment or declaration that begins at `at`."""
        html = self.html
        if html.startswith("<!--", at):
            if html.startswith((">", "->"), at + 4):
                return html.index(">", at + 4) + 1
            end = self.find("-->", at + 4)
            return len(html) if end < 0 else end + 3
        end = self.find(">", at)
        return len(html) if end < 0 else end + 1

    def tag(self, at: int) -> tuple[str, dict[str, str], bool, int]:
        """(name, attributes, whether it closes itself, end) of the tag whose name begins at `at`. A quote that never ends is a character."""
        html, attrs = self.html, {}
        m = NAME.match(html, at)
        name, at = m[0].lower(), m.end()
        while True:
            begin, at = at, SPACE.match(html, at).end()
            if at >= len(html):
                return name, attrs, False, at
            if html[at] == ">":
                return name, attrs, at > begin and html[at - 1] == "/", at + 1
            m = ATTR.match(html, at)
            if m is None:  # a stray equals sign
                at += 1
                continue
            value, at = m[3] or "", m.end()
            if m[2]:
                end = self.find(m[2], at)
                if end >= 0:
                    value, at = html[at:end], end + 1
            attrs.setdefault(m[1].lower(), value)


def parse(html: str) -> tuple[Node, list[Node]]:
    """The tree, and its nodes in page order. Unclosed, crossed and stray tags are taken as browsers take them, nearly. Linear in the page:
    an end tag climbs only over what it closes."""
    root = node = Node("html", None, False)
    nodes, at, size = [root], 0, len(html)
    read, low, body, foreign, open_ = Reader(html), None, False, None, {}
    while at < size:
        lt = read.find("<", at)
        if lt < 0:
            node.items.append(html[at:])
            break
        after = html[lt + 1 : lt + 3]
        closing = after[:1] == "/" and after[1:].isascii() and after[1:].isalpha()
        if not closing and not (after[:1].isascii() and after[:1].isalpha()):
            skip = after[:1] in ("!", "?", "/") and after != ""
            node.items.append(html[at : lt if skip else lt + 1])
            at = read.comment(lt) if skip else lt + 1
            continue
        if lt > at:
            node.items.append(html[at:lt])
        tag, attrs, own, at = read.tag(lt + 1 + closing)
        if closing:
            up = node
            if open_.get(tag) if tag in SCOPE else node.held.get(tag):
                while up is not root and up.tag != tag and not (up.tag in SCOPE and tag not in SCOPE):
                    up = up.parent
                if up is not root and up.tag == tag:
                    node = _closed(node, up, open_)
            if foreign is not None and not open_.get(foreign.tag):
                foreign = None
            continue
        if tag == "html" or tag == "body" and node is root and body:
            continue
        body = body or tag == "body"
        if foreign is not None and tag in BREAKOUT:
            node, foreign = _closed(node, foreign, open_), None
        while node.tag in CLOSED_BY and tag in CLOSED_BY[node.tag]:
            node = _closed(node, node, open_)
        if tag in BLOCK and tag not in ("br", "hr"):
            # a block closes the paragraph that is open above inline elements
            while node.near.tag in CLOSED_BY and tag in CLOSED_BY[node.near.tag] and node.near is not root:
                node = _closed(node, node.near, open_)
        dropped = tag in DROP or (tag == "header" and not node.inner and node.tag != "article")
        noise, names = 0, ""
        if attrs and tag not in ("html", "body"):
            dropped = dropped or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(UNSEEN.search(attrs.get("style", "")))
            if tag != "main":
                names = LAYOUT.sub(" ", " ".join(attrs.get(k, "") for k in ("class", "id", "role")))
                noise = 2 if READERS.search(names) else 1 if NOT_TEXT.search(names) else 0
                if noise == 1 and ARTICLE.search(names) and not NOT_TEXT.search(" ".join(ALONE.findall(names))):
                    noise = 0
        new = Node(tag, node, dropped or node.dropped, noise, attrs.get("class", "").partition(" ")[0])
        node.items.append(new)
        nodes.append(new)
        if tag in RAW and foreign is None:
            if low is None:
                low = html.lower()
                if len(low) != size:
                    low = "".join(c.lower() if c < "\x80" else c for c in html)
            end = low.find(f"</{tag}", at)
            if tag not in DROP:
                new.items.append(html[at : size if end < 0 else end])
            close = html.find(">", end) if end >= 0 else -1
            at = size if close < 0 else close + 1
            continue
        if tag not in VOID and not (own and (foreign is not None or tag in FOREIGN or tag not in BLOCK)):
            node = new
            open_[tag] = open_.get(tag, 0) + 1
            new.parent.held[tag] = new.parent.held.get(tag, 0) + 1
            if foreign is None and tag in FOREIGN:
                foreign = new
    return root, nodes


def _closed(node: Node, last: Node, open_: dict[str, int]) -> Node:
    """What is open after node and all around it up to `last` are closed."""
    while True:
        open_[node.tag] -= 1
        node.parent.held[node.tag] -= 1
        if node is last:
            return node.parent
        node = node.parent


#: Elements whose names say that they are something else weigh this much less: they are dropped only if the others' points are at least
#: this share of all points.
LEAST_SHARE = 0.3


def main_text(html: str | None) -> str:
    """The article of a page.

    Each paragraph outside dropped elements has a point, one for each comma and one for each 100 characters (three at
    most). Elements whose names (class, id, role) say that they are something else weigh nothing, unless the others have less than
    LEAST_SHARE of the page's points: then the heaviest of them counts in full, with its like siblings, and so on. Paragraphs pass
    their points whole to their parent, halved to the grandparent, then by thirds, sixths and so on up to the eighth element around.
    A container's points count less by the share of its text in links. The best container is the article, or what holds it and
    more than as much again; a sibling is
    kept if it reaches a fifth of its points, or if it is a long paragraph with few links. Then all text below those
    is taken in page order but for dropped elements. A page without any paragraph gives its body's text that isn't dropped.
    """
    if not html:
        return ""
    root, nodes = parse(html)
    _weigh_names(nodes)
    return _article(root, nodes)


def _weigh_names(nodes: list[Node]) -> None:
    """Drops the elements whose names say that they are not the article, but not the article."""
    total = clean = 0
    outer: list[Node | None] = []  # the outermost marked element around each node
    place, weight, kin = {}, {}, {}
    for i, n in enumerate(nodes):
        n.points, place[n] = _points(n), i
        around = outer[place[n.parent]] if n.parent is not None else None
        if around is None and n.noise and not n.dropped:
            around, weight[n] = n, 0
            kin.setdefault((n.parent, n.tag, n.kind), []).append(n)
        outer.append(around)
        total += n.points
        if around is None:
            clean += n.points
        else:
            weight[around] += n.points
    inside = {n: n.points for n in nodes}  # the points of each element and all in it
    for n in reversed(nodes):
        if n.parent is not None:
            inside[n.parent] += inside[n]
    heap = [(-w, place[n], n) for n, w in weight.items() if w]
    readers = [x for x in heap if x[2].noise == 2]
    heap = [x for x in heap if x[2].noise == 1]
    heapq.heapify(heap)
    while clean < LEAST_SHARE * total and (heap or not clean and readers):
        if not heap:
            heap, readers = readers, []
            heapq.heapify(heap)
        _, _, top = heapq.heappop(heap)
        if not top.noise:
            continue
        # what lies in it and its like counts, but for what is marked by itself
        stack = list(kin.get((top.parent, top.tag, top.kind), [top]))
        for n in stack:
            n.noise = 0
        while stack:
            n = stack.pop()
            if n.noise and not n.dropped:
                if n.noise == 1 and inside[n]:
                    heapq.heappush(heap, (-inside[n], place[n], n))
                elif inside[n]:
                    readers.append((-inside[n], place[n], n))
                continue
            clean += n.points
            stack.extend(x for x in n.items if type(x) is not str)
    for n in nodes:
        n.dropped = n.dropped or n.noise > 0 or (n.parent is not None and n.parent.dropped)
    if not total and not any(type(x) is str and x.strip() for n in nodes if not n.dropped for x in n.items):
        for n in nodes:  # no paragraph at all, and names would leave the page empty
            n.dropped = n.tag in DROP or n.parent is not None and n.parent.dropped


def _points(n: Node) -> int:
    if n.dropped or n.tag not in PARAGRAPH and not (n.tag in ("div", "section", "article") and any(type(x) is str and len(x) > 80 for x in n.items)):
        return 0
    text = _flat(n)
    return 1 + text.count(",") + text.count("，") + min(len(text) // 100, 3) if text else 0


def _article(root: Node, nodes: list[Node]) -> str:
    for n in reversed(nodes):
        for x in n.items:
            if type(x) is str:
                n.chars += len(x)
            elif not x.dropped:
                n.chars += x.chars
                n.linked += x.chars if x.tag == "a" else x.linked
    for n in nodes:
        if n.dropped or not n.points:
            continue
        up, level = n.parent if n.tag in PARAGRAPH else n, 0
        while up is not None and level < 8:
            up.score += n.points / (1 if level == 0 else 2 if level == 1 else 3 * (level - 1))
            up, level = up.parent, level + 1
    best, top = None, 0.0
    for n in nodes:
        if n.score and not n.dropped and n.tag in CONTAINER:
            s = n.score * (1 - n.linked / n.chars if n.chars else 1)
            if s > top:
                best, top = n, s
    if best is None:
        return _text([n for n in nodes if n.tag == "body"][:1] or [root])
    best = _widened(best, nodes)
    while best.parent is not None and best.tag not in ("article", "main") and best.inner:
        best = best.parent  # a part of an article stands for the article
    kept = [best]
    if best.parent is not None and best.tag not in ("article", "main", "body"):
        kept = []
        for x in best.parent.items:
            if type(x) is str or x.dropped:
                continue
            density = x.linked / x.chars if x.chars else 0
            if x is best or x.score * (1 - density) >= max(10, top / 5) or x.tag == "p" and (x.chars > 80 and density < 0.25) or re.fullmatch("h[1-6]", x.tag) and not density:
                kept.append(x)
    elif best.tag in ("article", "main"):
        # pages of several articles at one level: those that score like the best one
        kept = [x for x in best.parent.items if type(x) is not str and not x.dropped and (x is best or x.tag == best.tag and x.score >= max(10, top / 5))] if best.parent is not None else [best]
    return _text(kept)


def _widened(best: Node, nodes: list[Node]) -> Node:
    """The element around best that holds the article, if best is only one of many alike wrappers: the lowest one in which most
    points lie outside of best. Text in links doesn't count."""
    for n in nodes:
        n.inside = 0 if n.dropped else n.points
    for n in reversed(nodes):
        if n.parent is not None and not n.dropped and not (n.linked * 2 > n.chars):
            n.parent.inside += n.inside
    up = best
    while up.parent is not None and best.tag not in ("article", "main", "body"):
        up = up.parent
        if up.tag in CONTAINER and up.inside > 2 * best.inside:
            best = up
    return best


def _text(nodes: list[Node]) -> str:
    out: list[str] = []
    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if type(x) is str:
            out.append(x)
        elif x is None:
            out.append(" ")
        elif not x.dropped:
            if x.block:
                out.append(" ")
                stack.append(None)
            stack.extend(reversed(x.items))
    return " ".join(unescape("".join(out)).split())


def _flat(node: Node) -> str:
    """The text of a paragraph with its inline elements."""
    out, stack = [], list(reversed(node.items))
    while stack:
        x = stack.pop()
        if type(x) is str:
            out.append(x)
        elif not x.dropped and x.tag not in PARAGRAPH and x.tag not in CONTAINER:
            stack.extend(reversed(x.items))
    return "".join(out).strip()


def extract(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars (code points), from the whole html. Row by row, without a shuffle. Null or empty html, or a
    page without text: an empty string and 0. Clashing columns are replaced; repeated rows are done each."""

    def start():
        def of(htmls):
            texts = [main_text(h) for h in htmls]
            return texts, list(map(len, texts))

        return of

    return with_arrow(pages, start, ["html"], [field("text", T.StringType()), field("n_chars", T.LongType())])


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
