"""Leaf blocks of a web page, with the tags and names around each; a tolerant reader for broken markup."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# Element names by their role.
BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre
    search section select summary table tbody td textarea tfoot th thead title tr ul video audio canvas""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DIVIDERS = frozenset("article main nav header footer aside form section menu dialog table".split())
RAW_TAGS = frozenset("script style template noembed noframes xmp".split())
# An opening tag ends an open element of the listed kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
        "body": {"head"}}
STOPS = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "dt": {"dl"}, "dd": {"dl"}}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_SPACE = re.compile(r"\s+")


class Element:
    """An open block element.  ``new`` holds its tag and names as far as no element around it has them, so that a path is read
    once however many blocks hang on it; ``part`` and ``inner`` are the nearest divider and names from here outwards."""

    __slots__ = ("tag", "parent", "new", "part", "inner", "score")

    def __init__(self, tag: str, parent: Element | None, new: tuple[str, ...], part: str, inner: tuple[str, ...]):
        self.tag, self.parent, self.new, self.part, self.inner, self.score = tag, parent, new, part, inner, None


class Block(NamedTuple):
    text: str
    link_chars: int
    element: Element | None  # the innermost one


class _Open:
    """The open elements, with the places of each tag and the count of each tag and name."""

    def __init__(self):
        self.elements: list[Element] = []
        self.own: list[list[str]] = []
        self.places: dict[str, list[int]] = {}
        self.counts: dict[str, int] = {}

    def top(self) -> Element | None:
        return self.elements[-1] if self.elements else None

    def last(self, tags) -> int:
        """The place of the innermost element with one of the tags, -1 without any."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        around = self.top()
        own = [f"in {tag}", *(f"name {n}" for n in names)]
        new = tuple(x for x in own if not self.counts.get(x))
        for x in own:
            self.counts[x] = self.counts.get(x, 0) + 1
        part = tag if tag in DIVIDERS else around.part if around else ""
        self.places.setdefault(tag, []).append(len(self.elements))
        self.elements.append(Element(tag, around, new, part, names or (around.inner if around else ())))
        self.own.append(own)

    def cut(self, place: int) -> None:
        """Close all elements from ``place`` inwards."""
        while len(self.elements) > place:
            self.places[self.elements.pop().tag].pop()
            for x in self.own.pop():
                self.counts[x] -= 1


def _names(attributes: str) -> tuple[str, ...]:
    out = []
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), html.unescape(value.strip("\"'")).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            out.append("hidden")
        elif key in ("class", "id", "role"):
            out += re.findall(r"[a-z]+", value)
    return tuple(dict.fromkeys(out))


def leaf_blocks(page: str | None) -> list[Block]:
    """The runs of text between tags of block elements, in page order: references decoded, white space made one
    space and trimmed.  Scripts, styles and comments have no text."""
    page = page or ""
    blocks: list[Block] = []
    stack = _Open()
    parts: list[str] = []
    links = depth = 0
    at = 0

    def flush() -> None:
        nonlocal links
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            blocks.append(Block(text, min(links, len(text)), stack.top()))
        parts.clear()
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        if piece:
            piece = html.unescape(piece)
            parts.append(piece)
            if depth:
                links += len(piece.strip())

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        found = _MARKUP.match(page, start)
        if not found:
            if re.match(r"<[/a-zA-Z!?]", page[start:start + 2]) and page.find(">", start) < 0:
                break  # a tag that the page's end cut off
            add("<")
            at = start + 1
            continue
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW_TAGS and not closing:
            end = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag == "a":
            depth = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            if closing:
                place = stack.last((tag,))
                if place >= 0:
                    stack.cut(place)
            else:
                around = stack.top()
                if around and around.tag == "p":
                    stack.cut(len(stack.elements) - 1)
                ends = stack.last(ENDS.get(tag, ()))
                if ends > stack.last(STOPS.get(tag, ())):
                    stack.cut(ends)
                if tag not in VOID_TAGS:
                    stack.push(tag, _names(attributes))
    flush()
    return blocks
