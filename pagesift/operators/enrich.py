"""Ordered enrichment merge, document text assembly and the document manifest.

The merge groups one record's sources: seq 0 = listing, 1 = detail page,
2.. = documents. By construction (one listing row per stored key, at most one
detail page and the documents that page links) a group holds one record's own
sources, so the ordered string aggregate gathers what its output holds.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cap, contact_string, ne, py_strip
from ..functions.urls import file_name, mime_type
from ..schemas import MERGE_FIRST_FIELDS


def _first_nonempty(field: str, seq: str):
    v = ne(F.col(field))
    return F.min(F.when(v.isNotNull(), F.struct(F.col(seq), v.alias("v"))))["v"]


def merge_enrichment(sources: DataFrame, key: str = "fingerprint", seq: str = "seq",
                     description: str = "description",
                     first_fields: Sequence[str] = MERGE_FIRST_FIELDS) -> DataFrame:
    """Merge a record's sources in seq order.

    * description: non-empty parts joined by a blank line, in seq order;
    * each of ``first_fields``: first non-empty value by seq;
    * contact: built (name | email | phone) from the *last* source with
      seq >= 1 that has any contact part, else the listing's own contact.
    """
    cs = contact_string("contact_name", "contact_email", "contact_phone")
    aggs = [
        F.expr(f"listagg(nullif({description}, ''), '\\n\\n') WITHIN GROUP (ORDER BY {seq})")
         .alias("description"),
    ]
    aggs += [_first_nonempty(f, seq).alias(f) for f in first_fields]
    aggs += [
        F.coalesce(
            F.max(F.when((F.col(seq) >= 1) & cs.isNotNull(), F.struct(F.col(seq), cs.alias("v"))))["v"],
            F.min(F.when(F.col(seq) == 0, F.struct(F.col(seq), ne(F.col("contact")).alias("v"))))["v"],
        ).alias("contact"),
        F.count(F.lit(1)).cast("long").alias("n_sources"),
    ]
    return sources.groupBy(key).agg(*aggs)


def document_text(doc_pages: DataFrame, doc: str = "doc_url", page_no: str = "page_no",
                  text: str = "page_text", cap_chars: int | None = None,
                  paragraphs: bool = False) -> DataFrame:
    """Text of a document from its pages: non-empty pages in order, each
    followed by a newline (``paragraphs``: joined by newlines, without one at
    the end); documents whose text is blank are dropped. ``n_pages`` counts all
    non-empty pages. ``cap_chars`` keeps only the first characters and
    ``truncated`` tells where that cut something.

    With a cap, pages that start beyond it lose their text (not their count)
    before the ordered string aggregate, so that one only gathers what can reach
    the output.
    """
    p = doc_pages.where(F.col(text).isNotNull() & (F.col(text) != "")).select(doc, page_no, F.col(text).alias("_t"))
    p = p.withColumn("_n", F.length("_t") + 1)
    if cap_chars is not None:
        w = Window.partitionBy(doc).orderBy(page_no).rowsBetween(Window.unboundedPreceding, -1)
        p = p.withColumn("_t", F.when(F.coalesce(F.sum("_n").over(w), F.lit(0)) < cap_chars, F.col("_t")))
    joined = (f"listagg(_t, '\\n') WITHIN GROUP (ORDER BY {page_no})" if paragraphs
              else f"listagg(concat(_t, '\\n'), '') WITHIN GROUP (ORDER BY {page_no})")
    agg = p.groupBy(doc).agg(F.expr(joined).alias("_full"), F.count(F.lit(1)).cast("long").alias("n_pages"),
                             F.sum("_n").alias("_n"))
    size = F.col("_n") - int(paragraphs)
    out = agg.select(doc, cap(F.col("_full"), cap_chars).alias("text"), "n_pages",
                     (size > cap_chars if cap_chars is not None else F.lit(False)).alias("truncated"))
    return out.where(py_strip("text") != "")


def file_manifest(docs: DataFrame, key: str = "fingerprint", url: str = "url",
                  name: str = "text", pos: str = "pos", k: int | None = None) -> DataFrame:
    """Storage manifest of a record's document links (the first ``k`` if given):
    path tender-docs/{key}/{file name}, mime type by extension, link text as
    name, ``rank`` in link order. The same path twice keeps the last link
    (overwrite)."""
    from .dedupe import last_seen
    from .links import first_k
    top = first_k(docs, k, [key], [pos])
    m = (top.withColumn("file_name", file_name(F.col(url)))
            .withColumn("path", F.concat(F.lit("tender-docs/"), F.col(key), F.lit("/"),
                                         F.col("file_name")))
            .withColumn("mime_type", mime_type(F.col("file_name"))))
    return last_seen(m.select(key, "path", pos, "file_name", "mime_type",
                              F.col(name).alias("name"), F.col(url).alias("url"), "rank"),
                     [key, "path"], [pos])


def document_refs(manifest: DataFrame, key: str = "fingerprint", pos: str = "pos") -> DataFrame:
    """Per record: ordered list of {name, url} and its JSON text."""
    agg = manifest.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(pos, "name", "url"))).alias("_d"))
    refs = F.transform("_d", lambda x: F.struct(x["name"].alias("name"), x["url"].alias("url")))
    return agg.select(key, refs.alias("document_urls"),
                      F.to_json(refs).alias("document_urls_json"))
