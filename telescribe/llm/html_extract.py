"""Main text of web pages by tree scoring: paragraphs pass points to their ancestors; what is kept lies around the best container.

Scripts, styles and hidden elements go at once. Whether an element goes by its tag or name (of class, id or role) is judged
once the whole page is measured, so that nothing that holds the article, main or most of the text goes that way.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame

from telescribe.llm.common import map_rows

#: Element kinds of HTML, and names of page furniture in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
NO_TEXT = frozenset("script style noscript template iframe button select textarea svg canvas object head title".split())
FURNITURE = frozenset("nav footer aside form dialog menu".split())
#: Names of page furniture in class, id and role, and words that say no more than that something is a part.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies disqus cookie cookies consent notice notices banner promo popup modal share sharing social related recommended subscribe newsletter toolbar widget complementary contentinfo".split()
)
#: Names of reader comments, and how such a section is headed; names that stand on text of the article as well.
COMMENTS = frozenset("comment comments commentlist reply replies respond response responses disqus discussion discussions talkback guestbook".split())
HEADED = re.compile(r"(?:\d+\s+)?(?:reader\s+|user\s+)?(?:comments?|responses|replies|discussion|leave a (?:comment|reply)|join the (?:discussion|conversation)|what do you think)\b[\s\W\d]*", re.I)
OPEN_NAMES = frozenset("banner social header footer masthead menu promo related widget toolbar complementary share sharing".split())
PARTS = frozenset("area bar block box button buttons column container content form holder icon icons inner item items label left link links list main outer panel right row section slot top bottom unit wrap wrapper".split())
#: A tag from its < on: quotes count only behind =, and an open one ends nothing. No part gives back what it has taken.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
RAW = {t: re.compile(f"</{t}\\b[^>]*+>", re.I) for t in ("script", "style", "textarea", "title")}
#: What a start tag ends if it is open: the outermost up to the next fence.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSABLE = frozenset(("p", *CLOSES))
#: Blocks that are text themselves, not containers of others' text.
TEXT_BLOCKS = frozenset("p pre blockquote li dd dt td th tr table ul ol dl figure figcaption caption h1 h2 h3 h4 h5 h6 hr address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FENCE = frozenset("ul ol dl table article section div body".split())
SPACE = re.compile(r"\s+")


class Node:
    """An element. open: of a fence, the last of each closable tag below it, not below another fence. name: what furniture()
    says; within: it lies in an article or main; holds: it is or holds one."""

    __slots__ = ("tag", "up", "kids", "score", "gone", "name", "closed", "fence", "open", "number", "within", "chars", "links", "commas", "holds")

    def __init__(self, tag: str, up: Node | None, gone: bool = False, name: str = "", within: bool = False, number: int = 0):
        self.tag, self.up, self.kids, self.score, self.gone, self.name, self.within, self.closed, self.number = tag, up, [], 0.0, gone, name, within, False, number
        self.chars = self.links = self.commas = 0
        self.holds = False
        own = up is None or tag in FENCE
        self.fence, self.open = (self if own else up.fence), ({} if own else None)


def furniture(tag: str, attributes: str, within: bool, in_article: bool) -> str:
    """What tag and names say of an element: gone (never text), tag, comments, strong, open or weak (furniture, less and less
    sure), or nothing. within: it lies in an article or main.

    A name of furniture is weak if it says something else, too: notice and notice-box are strong, notice-period is weak;
    outside an article or main the latter is strong. Open names stand on an article's own text as well.
    """
    if tag in NO_TEXT:
        return "gone"
    found: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        value, name = value.strip("\"'"), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "gone"
        if name in ("class", "id", "role") and tag not in ("html", "body", "main"):
            for token in value.lower().split():
                words = [w for w in re.split(r"[_-]+", token) if w]
                names = [w for w in words if w in NAMES or w in COMMENTS]
                if not names:
                    continue
                sure = not within or all(w in NAMES or w in COMMENTS or w in PARTS for w in words)
                found.add("weak" if not sure else "comments" if any(w in COMMENTS for w in names) else "open" if all(w in OPEN_NAMES for w in names) else "strong")
    if tag == "article":
        found &= {"comments"}
    if tag in FURNITURE or tag == "header" and not in_article:
        return "tag"
    return next((x for x in ("comments", "strong", "open", "weak") if x in found), "")


def parse(html: str) -> Node:
    """The element tree; strings among kids are text. End tags that close nothing are ignored, open ones end with their parent.

    Each character and each element is passed a bounded number of times, however odd the page.
    """
    root = top = Node("#root", None)
    at, held, number, last = 0, {}, 0, html.rfind(">")

    def close(node: Node) -> None:
        """Ends node and all that is open in it."""
        nonlocal top
        while True:
            top.closed = True
            held[top.tag] -= 1
            done, top = top is node, top.up
            if done:
                return

    def text(start: int, end: int) -> None:
        if end > start and not top.gone:
            top.kids.append(html[start:end])

    while (lt := html.find("<", at)) >= 0:
        follow = html[lt + 1 : lt + 2]
        if follow in "!?" and follow:
            text(at, lt)
            long = html.startswith("<!--", lt)
            end = html.find("-->" if long else ">", lt + 4 if long else lt)
            if end < 0:
                return root
            at = end + (3 if long else 1)
            continue
        m = TAG.match(html, lt)
        if m is None:
            if last < lt:
                break
            if not (follow.isalpha() or follow == "/" and html[lt + 2 : lt + 3].isalpha()):
                # no tag: the sign itself
                text(at, lt + 1)
                at = lt + 1
                continue
            # a tag that the page's end cuts off, and all behind it with it
            text(at, lt)
            return root
        text(at, lt)
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if held.get(tag):
                node = top
                while node.tag != tag:
                    node = node.up
                close(node)
            continue
        if tag in BLOCK and (p := top.fence.open.get("p")) is not None and not p.closed:
            close(p)
        if tag in CLOSES:
            ends = [x for t in CLOSES[tag] if (x := top.fence.open.get(t)) is not None and not x.closed]
            if ends:
                close(min(ends, key=lambda x: x.number))
        within = bool(held.get("article") or held.get("main"))
        name = "gone" if top.gone else furniture(tag, m[3], within, bool(held.get("article")))
        number += 1
        node = Node(tag, top, name == "gone", name, within, number)
        if tag in RAW:
            end = RAW[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if not node.gone or tag not in VOID:
            top.kids.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            if tag in CLOSABLE:
                top.fence.open[tag] = node
            held[tag] = held.get(tag, 0) + 1
            top = node
    text(at, len(html))
    return root


def measure(root: Node) -> list[Node]:
    """Sets characters, characters in links and commas of every kept node, and whether it holds an article or main; gives
    the nodes, children before parents."""
    out = []
    stack: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while stack:
        node, linked, done = stack.pop()
        linked = linked or node.tag == "a"
        if not done:
            stack.append((node, linked, True))
            stack.extend((k, linked, False) for k in node.kids if isinstance(k, Node) and not k.gone)
            continue
        node.chars = node.links = node.commas = 0
        node.holds = node.tag in ("article", "main")
        for k in node.kids:
            if isinstance(k, str):
                n = len(SPACE.sub(" ", k).strip())
                node.chars, node.links, node.commas = node.chars + n, node.links + n * linked, node.commas + k.count(",")
            elif not k.gone:
                node.chars, node.links, node.commas, node.holds = node.chars + k.chars, node.links + k.links, node.commas + k.commas, node.holds or k.holds
        out.append(node)
    return out


#: Characters from which a container of an open name is taken for prose.
PROSE = 60


def judge(root: Node, every: list[Node]) -> None:
    """Marks the furniture as gone. Parents are judged before children, and what is gone takes its children with it."""
    # the page's text, but for what lies in navigation and the like
    beside = sum(n.chars for n in every if n.tag in ("nav", "footer", "aside", "menu", "dialog") and not n.holds)
    total = max(1, root.chars - beside)
    for node in reversed(every):
        if node.up is not None and node.up.gone:
            node.gone = True
        elif node.name and node.name != "gone":
            much = 2 * node.chars > total and 2 * node.links <= node.chars
            linked = 2 * node.links > node.chars
            text = node.tag not in BLOCK or node.tag in TEXT_BLOCKS
            if node.name == "tag" and node.tag not in ("form", "header") or node.name == "comments" and not text:
                node.gone = not much or node.chars < PROSE
            elif much or node.holds:
                pass
            elif node.name == "weak" or node.within and node.name != "tag" and text:
                node.gone = linked
            elif node.within and node.name == "open":
                node.gone = linked or node.chars < PROSE
            else:
                node.gone = True
        elif node.tag in HEADINGS and node.up is not None and node.up.tag not in ("article", "main", "body", "html", "#root"):
            # comments by their heading, whatever they are named
            own = node.up
            if HEADED.fullmatch(SPACE.sub(" ", unescape("".join(words(node)))).strip()) and 2 * own.chars <= total and not (own.holds and not own.within):
                own.gone = True


def words(node: Node) -> list[str]:
    """The text below a node in order."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.gone:
            stack.extend(x.kids[::-1])
    return out


def blocks(node: Node) -> list[str]:
    """The texts of a node's blocks in page order, white space made one space."""
    out, now = [], []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append("".join(now))
            now = []
        elif isinstance(x, str):
            now.append(x)
        elif not x.gone:
            wide = x.tag in BLOCK
            if x.tag in ("br", "td", "th"):
                now.append(" ")
            stack.extend([None, *x.kids[::-1], None] if wide else x.kids[::-1])
    out.append("".join(now))
    return [t for t in (SPACE.sub(" ", unescape(b)).strip() for b in out) if t]


def main_text(html: str | None) -> str:
    """The main text of a page: blocks joined by two line feeds; empty for null, empty or textless pages."""
    if not html:
        return ""
    root = parse(html)
    judge(root, measure(root))
    every = measure(root)
    for node in every:
        if not node.chars or node.tag not in ("p", "pre", "td", "blockquote", "li", "div", "section"):
            continue
        if node.tag in ("div", "section", "blockquote", "li") and any(isinstance(k, Node) and not k.gone and k.tag in BLOCK for k in node.kids):
            continue
        points, up, share = 1 + node.commas + min(3, node.chars / 100), node.up, 1.0
        for _ in range(3):
            if up is None:
                break
            up.score += points * share
            up, share = up.up, share / 2
    best, most = None, 0.0
    for node in every:
        score = (node.score + (25 if node.tag in ("article", "main") and node.chars else 0)) * (1 - node.links / node.chars if node.chars else 0)
        if score > most:
            best, most = node, score
    if best is None:
        return "\n\n".join(blocks(root))
    # the outermost article or main around the best container
    node, whole = best, None
    while node is not None:
        whole = node if node.tag in ("article", "main") else whole
        node = node.up
    if whole is not None:
        return "\n\n".join(blocks(whole))
    # without one the container, and beside it and what it lies in: headings, and what reads like a part of the text
    node, after = best, False
    while node.up is not None:
        after = False
        for k in node.up.kids:
            if k is node:
                after = True
            elif isinstance(k, Node):
                k.gone = k.gone or not (belongs(k, most) or k.tag in HEADINGS and not after)
        node = node.up
    return "\n\n".join(blocks(root))


def belongs(node: Node, most: float) -> bool:
    """Whether an element beside the best container, which scored most, is a part of the text."""
    if not node.chars or 2 * node.links > node.chars:
        return False
    own = node.score * (1 - node.links / node.chars)
    if own >= 0.2 * most or node.holds:
        return True
    if node.tag not in BLOCK or node.chars > 80 and 4 * node.links < node.chars:
        return True
    # a short block without links that ends like a sentence
    return not node.links and re.search(r"[.?:;\u3002]\s*$", "".join(words(node))) is not None


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row.

    Null and empty html give an empty text; null ids and urls stay; repeated rows give repeated rows; very long pages are
    read whole; other columns are left out.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def rows(cols):
        for key, url, html in zip(*cols):
            text = main_text(html)
            yield key, url, text, len(text)

    return map_rows(df.select(id_col, url_col, html_col), rows, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars bigint")
