"""Whole-run composites: the batch run over all sites, record enrichment with
detail pages and documents, and the zero-result fallback.

``stage`` writes an intermediate to the shared checkpoint folder where several
consumers would otherwise recompute an expensive branch; such a job runs while
the plan is built. HTML is reduced to records, text or links where it is
scanned and is in no exchange.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..functions.urls import document_kind
from ..operators import dedupe, enrich, extract, frontier, links
from ..schemas import DETAIL_FIELDS, LISTING_FIELDS, TENDER_SCHEMA
from ..session import stage

HOST_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)"
PAGE_KEYS = ["site_id", "page_num", "page_id", "url"]


def _texts(pages: DataFrame) -> DataFrame:
    """Pages with their text instead of their HTML, if they still have that."""
    return pages if "text" in pages.columns else pages.withColumn("text", H.clean_html("html")).drop("html")


def line_records(pages: DataFrame) -> DataFrame:
    """Candidate records, one per non-blank line of a page's cleaned text
    (title := line, reference := first reference number in the line)."""
    keys = [c for c in PAGE_KEYS if c in pages.columns]
    ln = extract.lines(_texts(pages).select(*keys, "text"))
    return ln.select(*[c for c in keys if c != "url"], F.col("url").alias("page_url"),
                     F.col("line_no").alias("pos"), F.col("line").alias("title"),
                     F.try_element_at(extract.reference_numbers("line"), F.lit(1)).alias("reference"))


def rule_records(pages: DataFrame) -> DataFrame:
    """Records found by the rule extractor (section rules, reference
    numbers, enum keywords, closed/awarded dropped) in the whole page text."""
    keys = [c for c in PAGE_KEYS if c in pages.columns]
    return extract.rule_extract(_texts(pages).select(*keys, "text"), unit=keys).withColumnRenamed("url", "page_url")


def page_records(pages: DataFrame, extractor: Callable[[DataFrame], DataFrame] = line_records,
                 materialize: bool = True) -> DataFrame:
    """Extract, fingerprint and keep the first record per key within each
    page (in record order)."""
    rec = extractor(pages)
    rec = (rec.withColumn("fingerprint", X.fingerprint(F.col("reference"), F.col("title")))
              .withColumn("keyless", X.is_keyless(F.col("reference"), F.col("title"))))
    rec = dedupe.first_seen(rec, ["page_id", "fingerprint"], ["pos"])
    return stage(rec, "page-records") if materialize else rec


def run_batch(records: DataFrame, history: DataFrame, pages: DataFrame | None = None,
              sites: DataFrame | None = None, can_stop=None,
              errors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Early stop per site against the history, then first-seen across sites
    (site, page, position order). ``pages`` are the fetched pages (an empty one
    stops its site), ``sites`` those that ran (every one gets a summary row),
    ``errors`` (site_id, error_message) what went wrong. Returns (stored records
    with all their columns, run summary)."""
    place = F.struct("page_id", "pos").alias("place")
    keys = records.select("site_id", "page_num", "fingerprint", place)
    kept, stats = frontier.early_stop(keys, history, pages, pos="place", can_stop=can_stop)
    first = dedupe.first_seen(kept, ["fingerprint"], ["site_id", "page_num", "place"])
    stored = records.join(first.select("site_id", "page_num", "fingerprint", F.col("place.page_id").alias("page_id"),
                                       F.col("place.pos").alias("pos")),
                          ["site_id", "page_num", "fingerprint", "page_id", "pos"], "left_semi")
    return stored, frontier.run_summary(stats, first, sites=sites, errors=errors)


def stored_pages(pages: DataFrame) -> DataFrame:
    """One stored page id per URL (the smallest): (url, page_id)."""
    return pages.groupBy("url").agg(F.min("page_id").alias("page_id"))


def fetch_pages(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages a run over ``sites`` fetches: every generated page URL (tabs ×
    pagination strategy) that is stored, without its content. One row per
    (site, tab, page): (site_id, page_num := struct(tab_no, page_num), page_id :=
    the fetch id 'site:tab:page', url, stored_id)."""
    pu = frontier.page_urls(sites)
    j = pu.join(stored_pages(pages).withColumnRenamed("page_id", "stored_id"), "url")
    return j.select("site_id", F.struct("tab_no", "page_num").alias("page_num"),
                    F.concat_ws(":", "site_id", F.col("tab_no").cast("string"),
                                F.col("page_num").cast("string")).alias("page_id"),
                    "url", "stored_id")


def fetched_records(fetched: DataFrame, pages: DataFrame,
                    extractor: Callable[[DataFrame], DataFrame] = line_records) -> DataFrame:
    """Records of fetched pages: each stored page is parsed once, where it is
    scanned, and its records join the fetches of that page."""
    rec = page_records(pages.select("page_id", "url", "html"), extractor)
    return (fetched.join(rec.withColumnRenamed("page_id", "stored_id"), "stored_id").drop("stored_id", "url"))


def stoppable_in_tab(page: Column) -> Column:
    """A fetched page may stop its site only when it is past page 1 of its tab."""
    return page["page_num"] > 1


def site_pages(pages: DataFrame) -> DataFrame:
    """Stored pages as site pages: site := URL host, page_num := the ``page``
    URL parameter (1 when absent)."""
    host = F.regexp_extract("url", HOST_RE, 1)
    page_num = F.coalesce(F.regexp_extract("url", r"[?&]page=([0-9]+)", 1).try_cast("int"),
                          F.lit(1))
    return pages.withColumns({"site_id": host, "page_num": page_num})


def annotate(stored: DataFrame, sites: DataFrame, run_ts: Column) -> DataFrame:
    """Stored records in the shape of the record table: the site's name as
    source_site, the time of the run, and every declared column (null if the
    records lack it). ``sites``: (site_id, source_site)."""
    j = stored.join(sites.select("site_id", "source_site"), "site_id", "left").withColumn("scraped_at", run_ts)
    return j.select(*[(F.col(f.name) if f.name in j.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                      for f in TENDER_SCHEMA.fields])


# ------------------------------------------------------------------ enrichment

# Lines are matched with explicit '\n' boundaries so every engine agrees on
# what a line is.
EMAIL_RE = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
# Same matches on the JVM, but a match may only start where a run of
# local-part characters starts and that run is never given back, so long
# letter runs without '@' cost linear time.
EMAIL_RE_JVM = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE_RE = r"\+?[0-9][0-9 \-]{7,}[0-9]"
REQ_LINE = r"(?i)(^|\n)([^\n]*\b(requirement|eligib|must)\b[^\n]*)"
SUB_LINE = r"(?i)(^|\n)([^\n]*\b(submit|submission)\b[^\n]*)"


def detail_record_rules(text: Column, cap_chars: int | None = None) -> dict[str, Column]:
    """Rule-based detail fields from a detail page's text (or its first
    ``cap_chars`` characters): the first e-mail address, phone-like number, and
    the first line naming requirements / submission."""
    t = X.cap(text, cap_chars)
    email = F.regexp_extract(t, EMAIL_RE_JVM, 0)
    phone = F.regexp_extract(t, PHONE_RE, 0)
    req = F.regexp_extract(t, REQ_LINE, 2)
    sub = F.regexp_extract(t, SUB_LINE, 2)
    return {"full_description": X.ne(t), "contact_email": X.ne(email), "contact_phone": X.ne(phone),
            "requirements": X.ne(req), "submission_method": X.ne(sub)}


def _model_source(rec: DataFrame, seq: Column, fields) -> DataFrame:
    """A merge source from a model-extracted detail/file record."""
    return rec.select("fingerprint", seq.alias("seq"), F.col("full_description").alias("description"),
                      *[(F.col(f) if f in rec.columns else F.lit(None).cast("string")).alias(f)
                        for f in fields if f != "full_description"])


def _rule_source(rows: DataFrame, seq: Column, text: str, fields) -> DataFrame:
    """A merge source from the rule extractor."""
    rules = detail_record_rules(F.col(text))
    return rows.select("fingerprint", seq.alias("seq"), rules["full_description"].alias("description"),
                       *[(rules[f] if f in rules else F.lit(None).cast("string")).alias(f)
                         for f in fields if f != "full_description"])


def enrich_records(stored: DataFrame, pages: DataFrame, site_url: Column | None = None,
                   detail: bool = True, documents: DataFrame | None = None,
                   max_docs: int | None = None, detail_fn: Callable | None = None,
                   file_fn: Callable | None = None) -> DataFrame:
    """Merge detail-page and document information into stored records.

    ``stored`` has (fingerprint, url, description, contact, listing fields);
    ``pages`` is the stored page table (page_id, url, and html and/or its
    cleaned ``text`` — pass ``text`` when it was already computed so the
    HTML is not parsed twice; link-following needs html); ``documents`` is
    (doc_url, text) of already-extracted document text. A record is enriched
    only when its URL starts with 'http' and differs from its listing page
    URL (trailing '/' ignored); of pages stored twice under a URL the one with
    the smallest id counts. Sources are merged in order: listing (0), detail
    page (1), its download links (2..; the first ``max_docs`` if given) that are
    documents by their name. Detail and document fields come from the rule
    extractor, or from a model when ``detail_fn`` / ``file_fn`` (batch functions as
    in ``extract.infer``) are given. With ``documents`` the result has
    ``document_urls``, the links in order.

    A page is parsed once, where it is scanned, however many records name it.
    """
    base = stored
    u = F.col("url")
    listing = F.col("page_url") if site_url is None else site_url
    enrichable = (u.startswith("http")
                  & (F.rtrim(u, F.lit("/")) != F.rtrim(listing, F.lit("/"))))
    # JN-3: record → its detail page (equi-join on URL, 0..1 page per record)
    cand = base.where(enrichable).select("fingerprint", "url")
    owner = cand.join(stored_pages(pages), "url")
    srcs, refs = [], None
    fields = sorted(set(DETAIL_FIELDS) | {"contact_name", "contact_email", "contact_phone"})
    if detail:
        texts = _texts(pages.select("page_id", *[c for c in ("text", "html") if c in pages.columns][:1]))
        d = owner.join(texts, "page_id")
        if detail_fn is not None:
            rec = extract.extract_objects(d, detail_fn, ["fingerprint"], "url", "text", "detail")
            srcs.append(_model_source(rec, F.lit(1), fields))
        else:
            srcs.append(_rule_source(d, F.lit(1), "text", fields))
    if documents is not None:
        # JN-4: detail page → download links → document text
        lk = links.download_links(links.page_links(pages.select("page_id", "url", "html")))
        top = links.first_k(lk.join(owner.select("page_id", "fingerprint"), "page_id"), max_docs, ["fingerprint"], ["pos"])
        refs = enrich.document_refs(top.select("fingerprint", F.col("rank").alias("pos"), F.col("text").alias("name"),
                                               F.col("link_url").alias("url"))).select("fingerprint", "document_urls")
        readable = top.where(document_kind(F.substring_index("link_url", "?", 1)).isNotNull())
        docs = readable.join(documents.select(F.col("doc_url").alias("link_url"), F.col("text").alias("doc_text")), "link_url")
        if file_fn is not None:
            rec = extract.extract_objects(docs, file_fn, ["fingerprint", "rank"], "link_url",
                                          "doc_text", "file")
            srcs.append(_model_source(rec, F.col("rank") + 1, fields))
        else:
            srcs.append(_rule_source(docs, F.col("rank") + 1, "doc_text", fields))
    listing_src = base.select("fingerprint", F.lit(0).alias("seq"), "description",
                              *[(F.col(f) if f in base.columns else F.lit(None).cast("string")).alias(f)
                                for f in fields if f != "full_description"], "contact")
    allsrc = listing_src
    for s in srcs:
        allsrc = allsrc.unionByName(s.withColumn("contact", F.lit(None).cast("string")))
    merged = enrich.merge_enrichment(allsrc)
    keep = [c for c in base.columns if c not in merged.columns or c == "fingerprint"]
    out = base.select(*keep).join(merged, "fingerprint", "left")
    return out if refs is None else out.join(refs, "fingerprint", "left")


def fallback_targets(listing_pages: DataFrame, records: DataFrame,
                     patterns=links.DETAIL_LINK_PATTERNS, k: int | None = None) -> DataFrame:
    """Page-1 listings that produced no record (anti-join on page_id) and
    their unique detail links (the first ``k`` if given): (site_id, page_num,
    listing_page_id, listing_url, link_rank, link_url). Links are taken where the pages are
    scanned; only they meet the records."""
    first = listing_pages.where(F.col("page_num") == 1)
    lk = links.detail_links(links.page_links(first.select("page_id", "url", "html")), patterns, k)
    owner = (first.select("page_id", "site_id", "page_num", F.col("url").alias("listing_url"))
             .join(records.select("page_id").distinct(), "page_id", "left_anti"))
    return lk.join(owner, "page_id").select(
        "site_id", "page_num", F.col("page_id").alias("listing_page_id"), "listing_url",
        F.col("rank").alias("link_rank"), "link_url")


def zero_result_fallback(listing_pages: DataFrame, records: DataFrame, pages: DataFrame,
                         extractor: Callable[[DataFrame], DataFrame] = line_records,
                         patterns=links.DETAIL_LINK_PATTERNS, k: int | None = None) -> DataFrame:
    """For page-1 listings with no record: follow their detail links (stored
    pages joined by URL; a link once per listing), extract from those pages and
    set each record's url to the link. Each key comes once per listing, from its
    first link. Returns extra records of the listing page (union them with the
    others)."""
    targets = fallback_targets(listing_pages, records, patterns, k)
    linked = targets.join(stored_pages(pages).select(F.col("url").alias("link_url"), F.col("page_id").alias("pid")), "link_url")
    rec = extractor(pages.select("page_id", "url", "html"))
    rec = rec.withColumn("fingerprint", X.fingerprint(F.col("reference"), F.col("title"))).withColumnRenamed("page_url", "url")
    joined = linked.select("site_id", "page_num", "listing_page_id", F.col("listing_url").alias("page_url"), "link_rank", F.col("pid").alias("page_id")).join(rec, "page_id")
    once = dedupe.first_seen(joined, ["listing_page_id", "fingerprint"], ["link_rank", "pos"])
    return once.withColumn("page_id", F.col("listing_page_id")).drop("listing_page_id")


def full_run(pages: DataFrame, sites: DataFrame, history: DataFrame, run_ts: Column,
             extractor: Callable[[DataFrame], DataFrame] = rule_records,
             patterns=links.DETAIL_LINK_PATTERNS, documents: DataFrame | None = None,
             min_chars: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole run over stored site pages (site_id, page_num, page_id, url,
    html): records of each page, those of detail links where page 1 has none,
    early stop, first-seen across sites, enrichment, annotation. Pages of fewer
    than ``min_chars`` characters count as fetched but are set aside with a
    reason. ``sites``: (site_id, source_site). Returns (records in the shape of the
    record table, run summary, pages set aside)."""
    small = F.length("html") < min_chars
    aside = pages.where(small).select("site_id", "page_num", "page_id", "url", F.lit("page too small").alias("reason"))
    usable = pages.where(~small | small.isNull())
    found = page_records(usable, extractor)
    more = zero_result_fallback(usable, found, pages, extractor, patterns)
    names = ["site_id", "page_num", "page_id", "page_url", "pos", "title", "reference", "fingerprint"]
    extra = [c for c in ("status", "tender_type") if c in found.columns]
    rec = stage(found.select(*names, *extra, F.col("page_url").alias("url"))
                .unionByName(more.select(*names, *extra, "url")), "run-records")
    stored, summary = run_batch(rec, history, pages=pages, sites=sites)
    have = set(stored.columns)
    stored = stage(stored.select(*stored.columns, *[F.lit(None).cast("string").alias(f) for f in LISTING_FIELDS if f not in have]), "run-stored")
    done = enrich_records(stored, pages.select("page_id", "url", "html"), documents=documents)
    return annotate(done, sites, run_ts), summary, aside
