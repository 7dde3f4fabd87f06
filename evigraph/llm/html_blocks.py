"""Leaf blocks of an HTML page: text, tag path and a few figures, read with one pattern and a stack of open elements."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = ("script", "style", "title", "template", "textarea", "iframe", "svg", "canvas", "noframes")
#: Their text is a block of its own; without text they do not part the block around them.
EMBEDDED_TAGS = frozenset({"noscript", "object"})
#: An opening tag closes an open element of these kinds up to the given borders.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
P_KEEPERS = frozenset({"button", "table", "td", "th", "caption"})

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|(?P<icon><svg\b(?:[^>\"'/]++|\"[^\"]*+\"|'[^']*+'|/(?!>)|[\"'])*+/>)"  # closes itself
    r"|<(?P<hidden>" + "|".join(HIDDEN_TAGS) + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*?>.*?(?:</(?P=hidden)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)", re.IGNORECASE | re.DOTALL)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
NAME_PARTS = re.compile(r"[a-z]+")
GAPS = re.compile(r"\s+")


@dataclass
class Block:
    """``path`` holds the names of the open elements from the outside in: tags and the parts of their classes, ids and roles."""

    text: str
    path: tuple[tuple[str, ...], ...]
    link_chars: int


def leaf_blocks(page: str) -> list[Block]:
    """The text between tags of block level, in page order, without hidden elements, comments and markup; blocks without text are left out."""
    blocks: list[Block] = []
    tags: list[str] = []
    names: list[tuple[str, ...]] = []
    parts: list[str] = []
    outer: tuple[tuple[str, ...], ...] = ()
    linked = links_open = embedded_open = embedded = 0  # embedded: how many were open at the last text

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = GAPS.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                blocks.append(Block(text, tuple(names) if embedded == embedded_open else outer, linked))
            parts.clear()
            linked = 0

    def drop_to(size: int) -> None:
        nonlocal links_open, embedded_open, outer
        links_open -= tags[size:].count("a")
        if embedded_open:
            if embedded == embedded_open:
                outer = tuple(names)
            embedded_open -= sum(t in EMBEDDED_TAGS for t in tags[size:])
        del tags[size:], names[size:]

    for token in TOKEN.finditer(page):
        kind = token.lastgroup
        if kind == "text":
            piece = token["text"]
            if embedded != embedded_open and piece.strip():
                end_block()
                embedded = embedded_open
            parts.append(piece)
            if links_open:
                linked += len(piece)
            continue
        if kind == "icon":
            continue
        tag = token["tag"]
        if tag is None:  # comment, declaration, hidden element
            if token["hidden"] is None or token["hidden"].lower() in ("textarea", "iframe", "canvas"):
                parts.append(" ")
            continue
        tag = tag.lower()
        block = tag in BLOCK_TAGS
        if block:
            end_block()
        elif tag == "br" or tag in EMBEDDED_TAGS:
            parts.append(" ")
        if token["close"]:
            for at in range(len(tags) - 1, -1, -1):
                if tags[at] == tag:
                    drop_to(at)
                    break
                if tags[at] in BLOCK_TAGS and not block and tag not in EMBEDDED_TAGS:
                    break
            continue
        if tag in VOID_TAGS:
            continue
        if block:
            closing, borders = CLOSES.get(tag, ((), ()))
            for at in range(len(tags) - 1, -1, -1):
                if tags[at] == "p" or tags[at] in closing:
                    drop_to(at)
                elif tags[at] in borders or tags[at] in P_KEEPERS or tags[at] in BLOCK_TAGS and not closing:
                    break
        rest = token["rest"]
        named: list[str] = [tag]
        if rest and "=" in rest:
            for found in NAMES.findall(rest):
                named += NAME_PARTS.findall("".join(found).lower())
        if not rest or not rest.endswith("/") or block:
            if tag in EMBEDDED_TAGS:
                if embedded == embedded_open:
                    outer = tuple(names)
                embedded_open += 1
            tags.append(tag)
            names.append(tuple(named))
            links_open += tag == "a"
    end_block()
    return blocks
