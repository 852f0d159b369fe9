"""Web pages cut into text blocks, each with its place in the element tree.

One pass over the markup keeps a stack of open block elements and links; inline and unknown elements do not matter
here. A block is the text between two block boundaries. A tag, comment or script that is not closed ends the page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|)|["'])*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
GAP = re.compile(r"[\x09-\x0D\x20\xA0]+")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element names of HTML.
#: text that is no markup up to the closing tag
RAW = frozenset("script style title textarea iframe noembed noframes noscript template xmp".split())
#: elements whose content is no running text
EMBEDDED = frozenset("svg select datalist object video audio canvas".split())
BLOCKS = frozenset(
    "html head body address article aside blockquote button caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup legend li listing main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption address summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REPEATED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
TRACKED = frozenset(["a"])  # the one inline element that is kept on the stack

# Names of elements, roles, classes and ids that say what they hold.
AROUND = frozenset("nav footer aside menu dialog".split())
SOFT_AROUND = frozenset("header form fieldset button".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())
AROUND_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright "
    "disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe tags toolbar widget".split()
)
WITHIN = frozenset("article main".split())
WITHIN_WORDS = frozenset("article body content entry main post story text".split())


@dataclass(slots=True)
class Element:
    tag: str
    number: int
    within: bool  # an element around it, or itself, is an article
    hinted: bool  # likewise by class or id
    around: tuple[tuple[int, bool], ...]  # elements around it that hold no main text: number, and whether it is sure


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    link_chars: int
    container: int
    apart: int  # steps in the tree from the block before
    element: Element
    words: int = field(init=False)

    def __post_init__(self):
        self.words = self.text.count(" ") + 1


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(raw)}


def _close(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE | re.ASCII)


CLOSERS = {tag: _close(tag) for tag in RAW | EMBEDDED}


class Page:
    """The blocks of a page in order."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.stack = [Element("", 0, False, False, ())]
        self.open: dict[str, int] = {}
        self.elements = 1
        self.pieces: list[str] = []
        self.links: list[bool] = []
        self.low = 1  # smallest height of the stack since the last block
        self.height = 1  # its height at that block
        self.unclosed: set[str] = set()
        self._read(html)
        self._flush()

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            begin = html.find("<", at)
            if begin < 0:
                self._text(html[at:])
                return
            if begin > at:
                self._text(html[at:begin])
            after = html[begin + 1:begin + 2]
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 2)
                if end < 0:
                    return
                at = end + 3
            elif after in ("!", "?") or after == "/" and not html[begin + 2:begin + 3].isalpha():
                end = html.find(">", begin)
                if end < 0:
                    return
                at = end + 1
            elif after == "/" or after.isascii() and after.isalpha():
                m = TAG.match(html, begin)
                if m is None:
                    return
                at = m.end()
                tag = m[2].lower()
                if m[1]:
                    self._end(tag)
                elif tag in RAW or tag in EMBEDDED and tag not in self.unclosed:
                    end = CLOSERS[tag].search(html, at)
                    if end is not None:
                        at = end.end()
                    elif tag in RAW:
                        return
                    else:
                        self.unclosed.add(tag)
                    self._text(" ")
                else:
                    self._start(tag, m[3])
            else:
                self._text("<")
                at = begin + 1

    def _text(self, raw: str) -> None:
        self.pieces.append(raw)
        self.links.append(self.open.get("a", 0) > 0)

    def _flush(self) -> None:
        if not self.pieces:
            return
        text = GAP.sub(" ", unescape("".join(self.pieces))).strip(" ")
        if text:
            link_chars = sum(len(p) for p, link in zip(self.pieces, self.links) if link)
            top = len(self.stack) - 1
            while self.stack[top].tag in TRACKED:
                top -= 1
            own = self.stack[top]
            container = self.stack[top - 1] if own.tag in LEAVES and top else own
            apart = len(self.stack) + self.height - 2 * self.low
            self.blocks.append(Block(text, own.tag, min(link_chars, len(text)), container.number, apart, own))
            self.low = self.height = len(self.stack)
        self.pieces, self.links = [], []

    def _push(self, tag: str, raw: str) -> None:
        above = self.stack[-1]
        within, hinted, around = above.within, above.hinted, above.around
        if raw and not raw.isspace():
            given = _attributes(raw)
            words = {w.lower() for w in TOKEN.findall(given.get("class", "") + " " + given.get("id", ""))}
            role = given.get("role", "").lower()
            gone = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
        else:
            words, role, gone = set(), "", False
        if tag in AROUND or role in AROUND_ROLES or gone:
            around += ((self.elements, True),)
        elif tag in SOFT_AROUND or words & AROUND_WORDS:
            around += ((self.elements, False),)
        else:
            within = within or tag in WITHIN or role in WITHIN
            hinted = hinted or bool(words & WITHIN_WORDS)
        self.stack.append(Element(tag, self.elements, within, hinted, around))
        self.elements += 1
        self.open[tag] = self.open.get(tag, 0) + 1

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.open[self.stack.pop().tag] -= 1
        self.low = min(self.low, len(self.stack))

    def _start(self, tag: str, raw: str) -> None:
        if tag == "br":
            self._text(" ")
        elif tag == "hr":
            self._flush()
        if tag not in BLOCKS and tag not in TRACKED:
            return
        if tag in TRACKED:
            if self.open.get(tag):  # links do not nest
                self._end(tag)
            self._push(tag, raw)
            return
        self._flush()
        top = len(self.stack) - 1
        while self.stack[top].tag in TRACKED:
            top -= 1
        if self.stack[top].tag == "p" or tag in HEADINGS and self.stack[top].tag in HEADINGS:
            self._pop_to(top)
        elif tag in REPEATED:
            same, stops = REPEATED[tag]
            if any(self.open.get(s) for s in same):
                k = len(self.stack) - 1
                while k > 0 and self.stack[k].tag not in same and self.stack[k].tag not in stops:
                    k -= 1
                if self.stack[k].tag in same:
                    self._pop_to(k)
        self._push(tag, raw)

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if self.open.get(tag):
            k = len(self.stack) - 1
            while self.stack[k].tag != tag:
                k -= 1
            if tag not in TRACKED or all(e.tag in TRACKED for e in self.stack[k:]):
                self._pop_to(k)
