"""Blocks of HTML pages: a fold over tags with a stack of open elements.

Headings, p, li, pre and table are blocks; only the outermost one counts, so a
list item keeps its inner paragraphs, inner lists and the text after them.
What is left open ends where HTML ends it: a paragraph at the next block-level
element, a list item at the next item of its list, a heading at the next block,
anything at the end of an element around it.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from evigraph.sources.text import strip

# Block tags and the block type each yields.
BLOCK_TYPES = {"li": "list", "table": "table", "pre": "code", "p": "paragraph"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Elements without content, and elements that end an open paragraph.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
ENDS_PARAGRAPH = (
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", *HEADINGS,
    "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul")
LISTS = ("ul", "ol")
TOKEN = r"<[!?/a-zA-Z][^>]*>?|[^<]+|<"
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")


def _last(stack: list[str], *tags: str) -> int:
    """Place of the last open element of ``tags``, -1 if none is open."""
    return next((i for i in range(len(stack) - 1, -1, -1) if stack[i] in tags), -1)


def _after_tag(stack: list[str], tag: str, closing: bool) -> list[str]:
    """The open elements after a tag."""
    if closing:
        at = _last(stack, tag)
        return stack if at < 0 or (tag == "li" and at < _last(stack, *LISTS)) else stack[:at]
    if tag in ENDS_PARAGRAPH and (at := _last(stack, "p")) >= 0:
        stack = stack[:at]
    if (tag in BLOCK_TYPES or tag in HEADINGS) and (at := _last(stack, *HEADINGS)) >= 0:
        stack = stack[:at]
    if tag == "li" and (at := _last(stack, "li")) > _last(stack, *LISTS):
        stack = stack[:at]
    return stack if tag in VOID else [*stack, tag]


def page_blocks(page: str) -> list[tuple[str, str]]:
    """(tag, raw text) of every outermost block; each tag inside leaves a gap, and references are decoded."""
    blocks: list[tuple[str, list[str]]] = []
    stack: list[str] = []
    begun = 0  # how many elements are open inside and including the block; 0 between blocks
    for token in re.findall(TOKEN, page):
        tag = _TAG.match(token)
        if tag:
            closing, name = tag[1] == "/", tag[2].lower()
            opens = not closing and name not in VOID
            stack = _after_tag(stack, name, closing)
            if begun and len(stack) - opens < begun:
                begun = 0
            if opens and not begun and (name in BLOCK_TYPES or name in HEADINGS):
                begun = len(stack)
                blocks.append((name, []))
            elif begun:
                blocks[-1][1].append("\n" if blocks[-1][0] in ("pre", "table") else " ")
        elif begun and not (len(token) > 1 and token[0] == "<"):
            blocks[-1][1].append(html.unescape(token))
    return [(name, "".join(parts)) for name, parts in blocks]


@F.pandas_udf(ArrayType(StructType([StructField("tag", StringType()), StructField("raw", StringType())])))
def _blocks(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: [{"tag": t, "raw": r} for t, r in page_blocks(p)] if p is not None else None)


@F.pandas_udf(StringType())
def decoded(text: pd.Series) -> pd.Series:
    """All named and numeric character references."""
    return text.map(html.unescape, na_action="ignore")


def _tidy(raw: Column, tag: Column) -> Column:
    """Spaces collapse; tables and code keep their lines."""
    lines = strip(F.regexp_replace(raw, "[ \\t\\r]*\n[ \\t\\r\\n]*", "\n"))
    return F.when(tag.isin("pre", "table"), lines).otherwise(strip(F.regexp_replace(raw, "[ \\t\\r\\n]+", " ")))


def html_without_scripts(html_text: Column) -> Column:
    out = F.regexp_replace(html_text, r"(?s)<!--.*?-->", "")
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return out


def html_title(html_text: Column) -> Column:
    title = F.regexp_extract(html_without_scripts(html_text), r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    return F.nullif(_tidy(decoded(F.regexp_replace(title, "<[^>]*>", " ")), F.lit("title")), F.lit(""))


def html_blocks(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """The outermost blocks of every page in order, as ``position``, ``tag``, ``text``; empty ones are left out."""
    found = pages.select(page_id, F.posexplode(_blocks(html_without_scripts(F.col(html)))).alias("position", "b"))
    text = _tidy(F.col("b.raw"), F.col("b.tag"))
    return found.select(page_id, F.col("position").cast("bigint").alias("position"), F.col("b.tag").alias("tag"), text.alias("text")).where("text <> ''")
