"""HTML → text, title and anchors, by one parser pass per page.

The parser keeps the stack of open elements: an end tag closes its nearest
opener (and what is open inside it) and is ignored if there is none, so
unclosed and nested elements cannot lose the rest of a page. It runs as an
Arrow-batched scalar pandas UDF; what it returns is a small part of the page,
so HTML never has to leave the scan stage.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import limit_batches

# Elements whose whole subtree is dropped before text extraction.
REMOVED_TAGS = ["script", "style", "nav", "footer", "header", "aside", "noscript",
                "iframe", "svg"]
# Whitespace that the finished text may not keep (three or more
# newlines become two, two or more blanks or tabs one space).
NEWLINES = re.compile(r"\n{3,}")
BLANKS = re.compile(r"[ \t]{2,}")

BATCH_PAGES = 100   # sent to a Python worker at once

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
         "param", "source", "track", "wbr"}
_REMOVED = set(REMOVED_TAGS)
_CODE = {"script", "style", "template"}


class _Page(HTMLParser):
    """Stripped text pieces outside removed elements, anchors, and the title."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.removed_at: int | None = None   # stack depth of the outermost removed element
        self.data: list[str] = []            # of the text node being read
        self.texts: list[str] = []
        self.links: list[list] = []          # [href, [pieces], stack depth or None]
        self.open_links: list[list] = []
        self.title: str | None = None

    def end_text(self) -> None:
        """A text node ends where markup begins; only then is it stripped."""
        if not self.data:
            return
        node, self.data = "".join(self.data), []
        inside = self.stack[-1] if self.stack else ""
        if inside == "title" and self.title is None:
            self.title = node.strip()
        node = node.strip()
        if not node:
            return
        if self.removed_at is None:
            self.texts.append(node)
        if inside not in _CODE:
            for link in self.open_links:
                link[1].append(node)

    def handle_starttag(self, tag, attrs):
        self.end_text()
        if tag == "a":
            href = dict(attrs).get("href", ...)
            if href is not ...:
                link = [href or "", [], len(self.stack)]
                self.links.append(link)
                self.open_links.append(link)
        if tag in _VOID:
            return
        if tag in _REMOVED and self.removed_at is None:
            self.removed_at = len(self.stack)
        self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.end_text()
        if tag not in self.stack:
            return
        while self.stack.pop() != tag:
            pass
        depth = len(self.stack)
        if self.removed_at is not None and self.removed_at >= depth:
            self.removed_at = None
        self.open_links = [link for link in self.open_links if link[2] < depth]

    def handle_data(self, data):
        self.data.append(data)

    def handle_comment(self, data):
        self.end_text()

    handle_decl = handle_pi = unknown_decl = handle_comment


def _parsed(html: str) -> _Page:
    page = _Page()
    try:
        page.feed(html)
        page.close()
    except (AssertionError, ValueError):  # markup that the parser gives up on: keep what was read
        pass
    page.end_text()
    return page


def _joined(page: _Page) -> str:
    return BLANKS.sub(" ", NEWLINES.sub("\n\n", "\n".join(page.texts)))


def page_text(html: str | None) -> str | None:
    return None if html is None else _joined(_parsed(html))


def page_title_and_text(html: str | None) -> tuple[str | None, str | None]:
    if html is None:
        return None, None
    page = _parsed(html)
    return page.title or "", _joined(page)


LINK_SCHEMA = T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())]))
PAGE_SCHEMA = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])


def page_anchors(html: str | None) -> list[dict] | None:
    return None if html is None else [{"href": h, "text": "".join(t)} for h, t, _ in _parsed(html).links]


@F.pandas_udf(T.StringType())
def _clean_html(html: pd.Series) -> pd.Series:
    return html.map(page_text)


@F.pandas_udf(LINK_SCHEMA)
def _anchors(html: pd.Series) -> pd.Series:
    return html.map(page_anchors)


@F.pandas_udf(PAGE_SCHEMA)
def _title_and_text(html: pd.Series) -> pd.DataFrame:
    # A parsed page is dropped before the next one is read.
    return pd.DataFrame([page_title_and_text(h) for h in html], columns=["title", "text"], dtype=object)


def _pages(html) -> Column:
    """The column, to be parsed in batches of at most ``BATCH_PAGES`` pages."""
    limit_batches(SparkSession.active(), BATCH_PAGES)
    return F.col(html) if isinstance(html, str) else html


def clean_html(html) -> Column:
    """Text of a page: removed elements dropped, every other text node
    stripped, empty ones dropped, joined with '\\n'; long runs of newlines and
    blanks shortened."""
    return _clean_html(_pages(html))


clean_html_exact = clean_html


def anchors(html) -> Column:
    """Array of struct<href, text> of every ``<a href>`` in document order; the
    text is the stripped text nodes inside, glued."""
    return _anchors(_pages(html))


def title_and_text(html) -> Column:
    """struct<title, text> by one pass over the page."""
    return _title_and_text(_pages(html))
