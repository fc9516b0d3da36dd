"""Anchor tables, link predicates, per-page link dedupe and first-k links."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import anchors
from ..functions.text import py_strip
from ..functions.urls import resolve_url

# Download-link extensions (substring match on the lowered
# href), detail-link patterns, and the fallback and document limits that a
# caller may ask for (by default all links are followed).
DOWNLOAD_EXTS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip"]
DETAIL_LINK_PATTERNS = ["tender", "tawaran", "perolehan", "sebutharga", "procurement",
                        "announcement", "notice", "iklan", "finance/"]
FALLBACK_LINKS = 20
MAX_DOCS = 3


def usable_href(href) -> Column:
    """Trimmed href is non-empty and does not start with '#', 'javascript:'
    or 'mailto:' (case-sensitive; 'tel:' passes)."""
    h = F.col(href) if isinstance(href, str) else href
    return ((h != "") & ~h.startswith("#") & ~h.startswith("javascript:")
            & ~h.startswith("mailto:"))


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    cond = F.lit(False)
    for n in needles:
        cond = cond | (F.instr(c, n) > 0)
    return cond


def is_download(href) -> Column:
    h = F.col(href) if isinstance(href, str) else href
    return contains_any(F.lower(h), DOWNLOAD_EXTS)


def is_detail(url, text, patterns: Sequence[str] = DETAIL_LINK_PATTERNS) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    t = F.col(text) if isinstance(text, str) else text
    return contains_any(F.lower(u), patterns) | contains_any(F.lower(t), patterns)


def page_links(pages: DataFrame, page_id: str = "page_id", url: str = "url",
               html: str = "html") -> DataFrame:
    """One row per usable ``<a href>``: (page_id, page_url, pos, href, text,
    link_url). ``pos`` is the anchor's 0-based document position; ``href`` is
    stripped; ``link_url`` is the href joined with the page URL."""
    found = pages.select(F.col(page_id), F.col(url).alias("page_url"), anchors(html).alias("_a"))
    # An outer explode: the optimizer would filter a plain one on the array's
    # size below the projection, and so parse every page twice.
    raw = (found.select(page_id, "page_url", F.posexplode_outer("_a").alias("pos", "a")).where("pos IS NOT NULL")
                .select(page_id, "page_url", "pos", py_strip(F.col("a.href")).alias("href"), F.col("a.text").alias("text")))
    return (raw.where(usable_href("href"))
               .withColumn("link_url", resolve_url(F.col("page_url"), F.col("href"))))


def unique_links(links: DataFrame, page_id: str = "page_id", url: str = "link_url",
                 pos: str = "pos") -> DataFrame:
    """First-seen link per (page, absolute URL), keeping document order."""
    from .dedupe import first_seen
    return first_seen(links, [page_id, url], [pos])


def first_k(df: DataFrame, k: int | None, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First ``k`` rows per group (None: all), with their ``rank``. A limit is
    planned as a WindowGroupLimit, which also trims each group on the map side
    before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def download_links(links: DataFrame) -> DataFrame:
    """Unique download links per page; empty text → 'document'."""
    d = links.where(is_download("href")).withColumn(
        "text", F.when(F.col("text") == "", F.lit("document")).otherwise(F.col("text")))
    return unique_links(d)


def detail_links(links: DataFrame, patterns: Sequence[str] = DETAIL_LINK_PATTERNS,
                 k: int | None = None) -> DataFrame:
    """Unique links per page whose URL or text hits a pattern, with their
    ``rank`` in document order; only the first ``k`` if given."""
    d = links.where(is_detail("link_url", "text", patterns))
    return first_k(unique_links(d), k, ["page_id"], ["pos"])
