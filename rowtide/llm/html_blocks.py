"""Leaf blocks of HTML pages: runs of text that no block element interrupts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math svg mglyph malignmark object canvas iframe noscript".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style template".split())
# Formulas and drawings: their elements are inline, but for what stands in one that takes HTML.
FOREIGN = frozenset(["math", "svg"])
TAKES_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
SPACED = frozenset("text title desc mtd annotation annotation-xml".split())
# Elements that end a formula or drawing which was left open.
BREAKS_OUT = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 head hr li listing menu ol p pre table ul".split())
# Elements that a new one of the second kinds closes.
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
    "head": frozenset(["body"]),
}
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Names:
    """Names that an element adds to those of the elements around it, as a chain: nested
    elements share what they have in common, so a page costs what its own names do."""

    __slots__ = ("new", "above", "weight")

    def __init__(self, new: list[str], above: Names | None):
        self.new, self.above, self.weight = new, above, None

    def __iter__(self) -> Iterator[str]:
        at = self
        while at is not None:
            yield from at.new
            at = at.above


@dataclass
class Block:
    text: str
    tag: str
    names: Names  # of its ancestors: tags, and words in their class, id and role
    linked: int  # characters of the text in links


@dataclass
class Element:
    tag: str
    names: Names
    block: str  # the nearest block element
    base: int  # where among the open elements the nearest one is that is not inline
    inline: bool = False
    foreign: bool = False  # whether elements in it are those of a formula or drawing


class Blocks(HTMLParser):
    """Each tag costs the same whatever is open: where the open elements of a name are is known."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[Block] = []
        self.open = [Element("", Names([], None), "", 0)]
        self.at: dict[str, list[int]] = {}
        self.held: Counter[str] = Counter()
        self.parts: list[str] = []
        self.place = self.open[0]
        self.linked = self.links = self.unread = 0
        self.begun = False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append(Block(text, self.place.block, self.place.names, self.linked))
        self.parts, self.linked, self.begun = [], 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open[-1].foreign and tag in BREAKS_OUT:
            while self.open[-1].foreign:
                self.leave(len(self.open) - 1)
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.parts.append(" ")
            return
        foreign = self.open[-1].foreign
        inline = foreign or tag in INLINE
        if foreign and tag in SPACED:
            self.parts.append(" ")
        if not inline:
            self.flush()
            i = self.open[-1].base
            while i and tag not in CLOSED_BY.get(self.open[i].tag, ()) and self.open[i].tag == "p":
                i = self.open[i - 1].base
            if i and tag in CLOSED_BY.get(self.open[i].tag, ()):
                self.leave(i)
        top = self.open[-1]
        own = {f"<{tag}>"}
        for name, value in attrs:
            if value and name in ("class", "id", "role", "aria-label"):
                own.update(w.lower() for w in NAME.findall(value))
        new = [n for n in own if not self.held[n]]
        names = Names(new, top.names) if new else top.names
        if new:
            self.held.update(new)
        self.at.setdefault(tag, []).append(len(self.open))
        base = top.base if inline else len(self.open)
        self.open.append(Element(tag, names, top.block if inline else tag, base, inline, tag in FOREIGN or foreign and tag not in TAKES_HTML))
        self.links += tag == "a"
        self.unread += tag in UNREAD

    def leave(self, at: int) -> None:
        while len(self.open) > at:
            element = self.open.pop()
            self.at[element.tag].pop()
            if element.names is not self.open[-1].names:
                self.held.subtract(element.names.new)
            self.links -= element.tag == "a"
            self.unread -= element.tag in UNREAD

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        places, base = self.at.get(tag), self.open[-1].base
        if tag in INLINE:
            if not places or places[-1] < base:
                return  # opened outside the block, if at all
        elif not places:
            self.flush()
            return
        if base >= places[-1]:
            self.flush()
        elif tag in SPACED:
            self.parts.append(" ")
        self.leave(places[-1])

    def handle_data(self, data: str) -> None:
        if self.unread:
            return
        if not self.begun:
            self.place, self.begun = self.open[-1], bool(data.strip())
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def leaf_blocks(html: str) -> list[Block]:
    """Blocks in page order, character references decoded, white space as single spaces."""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.found
