"""Leaf blocks of a page: runs of text between block-level tags, with the features of their ancestors."""

from __future__ import annotations

import html
import re
from collections.abc import Collection
from dataclasses import dataclass

#: Elements of running text and those without content or end tag; fixed values of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup, and those whose text is never shown with the page; fixed values of HTML.
RAW = frozenset("script style textarea iframe title noembed noframes xmp".split())
UNSEEN = frozenset("select datalist template".split())
#: Elements that stand in running text and show what is in them; in the first two all tags are part of a formula or drawing.
FOREIGN = frozenset("math svg".split())
INLINE |= frozenset("object canvas audio video picture map meter progress slot".split())
#: Open elements that a start tag ends; fixed values of HTML.
_P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": set(), "tbody": {"thead", "tr", "td", "th"}}
_SCOPE = frozenset("table ul ol dl body html article section div main aside nav header footer form".split())

#: A tag. Quotes hold a value only after ``=``; a quote that isn't closed is a character like others. Another ``<`` outside
#: a value shows that this one was no tag. Nothing is tried twice, so a page takes time in proportion to its length.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)>""")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden|data-content)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Block:
    context: frozenset[str]
    tag: str
    text: str
    linked: int
    content: bool = False


def _own(tag: str, attributes: str) -> tuple[set[str], bool]:
    """Features that an element gives to what is inside it; and whether training marks it as content."""
    out, content = {tag}, False
    if attributes and not attributes.isspace():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "data-content":
                content = True
            elif name in ("hidden", "aria-hidden") and value.lower() != "false" or name == "style" and "none" in value.replace(" ", "").lower() and "display" in value.lower():
                out.add("is-hidden")
            elif name in ("class", "id", "role"):
                out.update(f".{w}" for w in _NAME.findall(_CAMEL.sub(" ", value).lower()))
    return out, content


def leaf_blocks(page: str, known: Collection[str] | None = None) -> list[Block]:
    """The blocks of a page in order. With ``known``, other ancestor features are left out."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], bool, bool]] = [("", frozenset(), False, False)]  # tag, features, content, unseen
    places: dict[str, list[int]] = {}  # of open elements in the stack
    scopes = [0]
    pieces: list[str] = []
    links = linked = foreign = 0
    blank = True  # the open block has no text but white space so far
    inside = stack[0]  # where the first text of the open block stands

    def flush():
        nonlocal linked, blank
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(inside[1], inside[0], text, linked, inside[2]))
            pieces.clear()
        linked, blank = 0, True

    def pop(to: int):
        while len(stack) > to:
            tag = stack.pop()[0]
            places[tag].pop()
            if tag in _SCOPE:
                scopes.pop()

    def add(text: str):
        nonlocal linked, inside, blank
        if not text or stack[-1][3]:
            return
        if blank:
            inside, blank = stack[-1], text.isspace()
        pieces.append(text)
        if links:
            linked += len(text)

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        begin = page.find("<", at)
        if begin < 0 or begin > last and not page.startswith("<!--", begin):
            add(page[at:])
            break
        add(page[at:begin])
        if page.startswith("<!--", begin):
            at = page.find("-->", begin + 4)
            if at < 0:
                break
            at += 3
            continue
        if page.startswith(("<!", "<?"), begin):
            at = page.index(">", begin) + 1
            continue
        m = _TAG.match(page, begin)
        if m is None:
            add("<")
            at = begin + 1
            continue
        at = m.end()
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in FOREIGN:
            foreign = max(0, foreign - 1) if closing else foreign + (m[3][-1:] != "/")
            continue
        if tag in RAW and not closing:
            if not foreign:
                flush()
            if m[3][-1:] != "/":
                end = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if foreign and tag not in _P_ENDERS and tag not in _ENDS and tag != "body":
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag in INLINE:
            continue
        foreign = 0
        if tag == "br" or tag == "hr" or tag == "p" and closing and not places.get("p"):
            flush()
            continue
        if tag in VOID:
            continue
        flush()
        links = 0
        if closing:
            if places.get(tag):
                pop(places[tag][-1])
            continue
        ends = {"p"} if tag in _P_ENDERS else _ENDS.get(tag, ())
        open_at = max((places[x][-1] for x in ends if places.get(x)), default=0)
        if open_at > scopes[-1]:
            pop(open_at)
        own, content = _own(tag, m[3])
        if known is not None:
            own = {f for f in own if f in known}
        above = stack[-1]
        places.setdefault(tag, []).append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append((tag, above[1] if own <= above[1] else above[1] | own, above[2] or content, above[3] or tag in UNSEEN))
    flush()
    return out


def block_features(block: Block, place: float) -> list[str]:
    """Features of a block beside its ancestors'. ``place``: 0 for the first block, 1 for the last."""
    text = block.text
    n = len(text)
    density = block.linked / max(n, 1)
    return [
        "bias",
        f"in:{block.tag}",
        "long" if n >= 200 else "medium" if n >= 80 else "short" if n >= 25 else "tiny",
        "linked" if density > 0.6 else "some-links" if density > 0.15 else "no-links",
        "ends" if text[-1] in ".!?…:;\"”»)" else "open-end",
        "commas" if text.count(",") >= 2 else "no-commas",
        "mark" if text[0] in "©®|»›•" or "©" in text or "rights reserved" in text.lower() else "no-mark",
        "first" if place < 0.1 else "last" if place > 0.9 else "middle",
    ]
