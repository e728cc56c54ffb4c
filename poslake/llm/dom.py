"""Text blocks of an HTML page with what a classifier needs to know about their place.

One pass over the tags, linear in the page's length whatever it holds; a page that ends inside a tag, a comment or a
script ends there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSHOWN = frozenset("template noscript svg math object canvas audio video select datalist".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
#: Elements that hold one block; others that hold blocks are its container.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre td th tr caption summary legend figcaption".split())
#: What an element of the same kind ends, and where looking for it stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "a": ({"a"}, {"table"})}
#: Places by element, role and class or id words.
STICKY_TAGS = frozenset("nav footer aside".split())
WEAK_TAGS = frozenset("form header menu dialog button fieldset label".split())
CONTENT_TAGS = frozenset("article main".split())
STICKY_ROLES = frozenset("navigation contentinfo complementary search".split())
WEAK_ROLES = frozenset("banner form alert alertdialog dialog menu menubar toolbar".split())
STICKY_WORDS = frozenset("comment comments disqus reply replies respond reactions".split())
WEAK_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer
    form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo
    promotion recommended related search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget""".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())

#: Places: certain boilerplate, likely boilerplate, not told, content.
STICKY, WEAK, NONE, CONTENT = -2, -1, 0, 1

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}


@dataclass
class Block:
    text: str
    words: int
    linked: float
    tag: str
    place: int
    container: int


@dataclass
class Page:
    """Blocks in page order, and parent and depth of every element."""

    blocks: list[Block]
    parent: list[int]
    depth: list[int]


def place_of(tag: str, attributes: str, above: int) -> int:
    """Where text in an element stands, from its tag and attributes and the place of its parent; the innermost
    hint counts, but nothing inside navigation, footers, asides, comments or hidden elements is content."""
    if above == STICKY or tag in STICKY_TAGS:
        return STICKY
    found = {}
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), "".join(values))
    role = found.get("role", "").lower()
    words = set() if tag in ("html", "body") else {w.lower() for w in _WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    if hidden or role in STICKY_ROLES or words & STICKY_WORDS:
        return STICKY
    if tag in CONTENT_TAGS or role in CONTENT_TAGS:
        return CONTENT
    if above == CONTENT and (tag == "header" or words & CONTENT_WORDS and words & WEAK_WORDS == {"header"}):
        return CONTENT  # an article's own headline
    if tag in WEAK_TAGS or role in WEAK_ROLES or words & WEAK_WORDS:
        return WEAK
    return CONTENT if words & CONTENT_WORDS and above == NONE else above


class _Parser:
    def __init__(self, html: str):
        self.html = html
        self.tags, self.parent, self.depth, self.places, self.links, self.unshown = [""], [0], [0], [NONE], [False], [False]
        self.stack, self.open = [0], {}
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.blocks: list[Block] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            link = sum(map(len, "".join(self.linked).split()))
            at = self.stack[-1]
            while at and self.tags[at] not in BLOCK:
                at = self.parent[at]
            tag, place, container = self.tags[at], self.places[self.stack[-1]], at
            while container and self.tags[container] in LEAF:
                container = self.parent[container]
            words = text.count(" ") + 1
            self.blocks.append(Block(text, words, link / (len(text) - words + 1), tag, place, container))
        self.parts, self.linked = [], []

    def text(self, start: int, end: int) -> None:
        at = self.stack[-1]
        if end > start and not self.unshown[at]:
            text = unescape(self.html[start:end])
            self.parts.append(text)
            if self.links[at]:
                self.linked.append(text)

    def pop(self, upto: int) -> None:
        """Close elements until the stack has ``upto``."""
        while len(self.stack) > upto:
            self.open[self.tags[self.stack.pop()]] -= 1

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.flush()
            if self.open.get("p"):
                self.end("p")
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in ENDS:
            ended, stops = ENDS[tag]
            if any(self.open.get(x) for x in ended):
                at = len(self.stack) - 1
                while at and self.tags[self.stack[at]] not in ended and self.tags[self.stack[at]] not in stops:
                    at -= 1
                if at and self.tags[self.stack[at]] in ended:
                    self.pop(at)
        above = self.stack[-1]
        self.stack.append(len(self.tags))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.tags.append(tag)
        self.parent.append(above)
        self.depth.append(self.depth[above] + 1)
        self.places.append(place_of(tag, attributes, self.places[above]) if attributes or tag in BLOCK else self.places[above])
        self.links.append(self.links[above] or tag == "a")
        self.unshown.append(self.unshown[above] or tag in UNSHOWN)

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if not self.open.get(tag):
            return
        at = len(self.stack) - 1
        while self.tags[self.stack[at]] != tag:
            at -= 1
        self.pop(at)

    def parse(self) -> Page:
        html, at, quoted = self.html, 0, True
        while True:
            tag_at = html.find("<", at)
            if tag_at < 0:
                self.text(at, len(html))
                break
            if html.startswith("<!--", tag_at):
                self.text(at, tag_at)
                end = html.find("-->", tag_at + 2)
                if end < 0:
                    break
                at = end + 3
                continue
            name = _NAME.match(html, tag_at + 1)
            if not name:
                if html[tag_at + 1:tag_at + 2] in ("!", "?", "/"):
                    self.text(at, tag_at)
                    end = html.find(">", tag_at)
                    if end < 0:
                        break
                    at = end + 1
                else:  # a plain character
                    self.text(at, tag_at + 1)
                    at = tag_at + 1
                continue
            self.text(at, tag_at)
            rest = _REST.match(html, name.end()) if quoted else None
            end = rest.end() if rest else html.find(">", name.end()) + 1
            quoted = quoted and rest is not None  # an open quotation is looked for once
            if not end:
                break
            at, tag = end, name[0].lower()
            if tag[0] == "/":
                self.end(tag[1:])
            elif tag in RAW:
                found = _RAW_END[tag].search(html, at)
                if not found:
                    break
                at = html.find(">", found.end()) + 1 or len(html)
            else:
                self.start(tag, html[name.end():end - 1])
        self.flush()
        return Page(self.blocks, self.parent, self.depth)


def parse(html: str) -> Page:
    return _Parser(html).parse()
