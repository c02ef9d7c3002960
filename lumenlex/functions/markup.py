"""From wiki markup to plain text, step by step.

All steps are column expressions but three: nested blocks and links, whose nesting takes a scan with a stack, and the
decoding of entities, for which Spark has no function. These are Arrow-batched.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlex.functions.text import not_blank, strip

# Link prefixes that are not running text, and patterns of the markup (in Java's syntax).
DROPPED_PREFIXES = ("file", "image", "media", "category", "ፋይል", "መደብ")
LANGUAGE_PREFIX = r"[a-z]{2,3}(-[a-z0-9]+)*"
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
REF_EMPTY = r"(?iU)<ref\b[^>]*/>"
REF_BLOCK = r"(?isU)<ref\b[^>]*>.*?(?:</ref\s*>|\z)"
LINE_BREAK = r"(?iU)<br\s*/?>"
TAG = r"</?[A-Za-z][^>]*>"
EXTERNAL_LINK = r"(?U)\[(?:https?|ftp)://[^\s\]]+(?:[ \t]+([^\]]*))?\]"
BARE_URL = r"(?U)(?:https?|ftp)://\S+"
MAGIC_WORD = r"__[A-Z]+__"
QUOTES = r"'{2,}"
HEADING = r"(?d)\A=+.*?=+\z"
LIST_MARKERS = r"\A[*#:;]+"


def remove_comments(text: Column) -> Column:
    """Without comments; an unclosed one runs to the end."""
    return F.regexp_replace(text, COMMENT, "")


def remove_references(text: Column) -> Column:
    """Without self-closing references, then without reference blocks; an unclosed one runs to the end."""
    return F.regexp_replace(F.regexp_replace(text, REF_EMPTY, ""), REF_BLOCK, "")


def fill_page_name(text: Column, title: Column) -> Column:
    return F.replace(text, F.lit("{{PAGENAME}}"), F.coalesce(title, F.lit("")))


def outside_blocks(text: str, opener: str, closer: str) -> str:
    """Without balanced blocks of two-character marks. An unclosed block runs to the end; a stray closer stays."""
    if opener not in text:
        return text
    kept, depth, at = [], 0, 0
    for mark in re.finditer(f"{re.escape(opener)}|{re.escape(closer)}", text):
        if mark[0] == opener:
            if not depth:
                kept.append(text[at : mark.start()])
            depth += 1
        elif depth:
            depth -= 1
            at = at if depth else mark.end()
    return "".join(kept if depth else [*kept, text[at:]])


def remove_nested(text: Column, opener: str, closer: str) -> Column:
    """``outside_blocks`` of a column: one scan over the marks of each text."""
    return _mapped(lambda t: outside_blocks(t, opener, closer), text)


def is_dropped_link(target: str) -> bool:
    """Does a link lead to a file, a category or another language's page?"""
    prefix, colon, _ = target.partition(":")
    prefix = prefix.strip().lower()
    return bool(colon) and (prefix in DROPPED_PREFIXES or re.fullmatch(LANGUAGE_PREFIX, prefix) is not None)


def link_text(text: str) -> str:
    """Internal links as their labels.

    Openers and closers are matched with one stack over the whole text; then every outermost link is replaced by what
    follows its last bar, or by all of it, in which links are replaced in turn.
    """
    out, todo = [], [(text, True)]  # what is open may hold links; a stack, as labels nest to any depth
    while todo:
        text, is_open = todo.pop()
        if not is_open or "[[" not in text:
            out.append(text)
            continue
        marks, closed, stack = [*re.finditer(r"\[\[|\]\]", text)], {}, []
        for m in marks:
            if m[0] == "[[":
                stack.append(m.start())
            elif stack:
                closed[stack.pop()] = m.end()
        parts, at = [], 0
        for m in marks:
            if m.start() < at or m[0] != "[[":
                continue
            parts.append((text[at : m.start()], False))
            end = closed.get(m.start())
            if end is None:
                at = m.end()  # an unclosed opener loses its mark only
                continue
            inner = text[m.end() : end - 2]
            target, bar, _ = inner.partition("|")
            if not is_dropped_link(target):
                label = inner[inner.rfind("|") + 1 :] if bar else inner
                parts.append((label if label.strip() else target, True))
            at = end
        todo += reversed([*parts, (text[at:], False)])
    return "".join(out)


#: Texts that are Python strings at one time.
TEXTS = 64


def _mapped(function: Callable[[str], str], text: Column) -> Column:
    """A text function in Arrow batches; null stays null. A few texts at a time are Python strings, whatever a batch holds."""

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for at in range(0, len(texts), TEXTS):
                yield pa.array([None if t is None else function(t) for t in texts.slice(at, TEXTS).to_pylist()], pa.string())
            del texts
            pa.default_memory_pool().release_unused()

    each.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(each, "string")(text)


def replace_links(text: Column) -> Column:
    return _mapped(link_text, text)


def plain_entities(text: str) -> str:
    return html.unescape(text).replace("\xa0", " ")


def decode_entities(text: Column) -> Column:
    """Character references decoded, no-break spaces as spaces. Runs after the tags are gone: decoded < and > are text."""
    return _mapped(plain_entities, text)


def replace_external_links(text: Column) -> Column:
    """[url label] as its label, [url] as nothing; a bare url as one space."""
    return F.regexp_replace(F.regexp_replace(text, EXTERNAL_LINK, "$1"), BARE_URL, " ")


def remove_tags(text: Column) -> Column:
    """Line-break tags as newlines; all other tags go, what they enclose stays."""
    return F.regexp_replace(F.regexp_replace(text, LINE_BREAK, "\n"), TAG, "")


def remove_emphasis(text: Column) -> Column:
    """Without runs of two or more apostrophes, and without magic words."""
    return F.regexp_replace(F.regexp_replace(text, QUOTES, ""), MAGIC_WORD, "")


def clean_lines(text: Column) -> Column:
    """Lines stripped; blank ones, headings and rests of tables go; list marks go from the rest."""
    lines = F.transform(F.split(text, "\n"), strip)
    kept = F.filter(lines, lambda s: (s != "") & ~F.rlike(s, F.lit(HEADING)) & ~F.rlike(s, F.lit(r"\A[|!]")))
    return F.array_join(F.filter(F.transform(kept, lambda s: strip(F.regexp_replace(s, LIST_MARKERS, ""))), not_blank), "\n")


def strip_markup(text: Column, title: Column | None = None) -> Column:
    """All steps in their order. Python runs twice: for blocks with links, and for entities."""
    text = fill_page_name(remove_references(remove_comments(text)), F.lit("") if title is None else title)
    text = _mapped(lambda t: link_text(outside_blocks(outside_blocks(t, "{{", "}}"), "{|", "|}")), text)
    text = decode_entities(remove_tags(replace_external_links(text)))
    return clean_lines(remove_emphasis(text))
