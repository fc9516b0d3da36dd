"""Page enumeration per site (tabs × strategy) and the early-stop rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import with_page_param
from ..session import stage

# Pagination defaults and strategies that need a browser.
DEFAULT_MAX_PAGES = 20
DEFAULT_PARAM = "page"
DEFAULT_START = 1
DEFAULT_INCREMENT = 1
BROWSER_STRATEGIES = ["next_button", "load_more", "infinite"]


def page_urls(sites: DataFrame) -> DataFrame:
    """One row per page to fetch: (site_id, tab_no, page_num, url, strategy,
    needs_browser).

    With ``tab_urls`` the strategy runs once per tab (page numbers restart)
    and the tab URL is the base. ``url_param`` yields pages 1..max_pages (none
    if that is 0); every other strategy yields page 1 only; browser strategies are flagged.
    """
    cfg = F.col("pagination")
    strategy = F.coalesce(cfg["strategy"], F.lit("none"))
    max_pages = F.coalesce(cfg["max_pages"], F.lit(DEFAULT_MAX_PAGES))
    tabs = (sites.select(F.col("id").alias("site_id"), "url", "pagination",
                         F.posexplode_outer("tab_urls").alias("tab_no", "tab_url"))
                 .withColumn("base", F.coalesce("tab_url", "url"))
                 .withColumn("tab_no", F.coalesce("tab_no", F.lit(0)))
                 .withColumn("strategy", strategy))
    n = F.when(F.col("strategy") == "url_param",
               F.when(max_pages >= 1, F.sequence(F.lit(1), max_pages))).otherwise(F.array(F.lit(1)))
    pages = tabs.select("*", F.explode(n).alias("page_num"))
    value = (F.coalesce(cfg["start"], F.lit(DEFAULT_START))
             + (F.col("page_num") - 1) * F.coalesce(cfg["increment"], F.lit(DEFAULT_INCREMENT)))
    url = F.when(F.col("strategy") == "url_param",
                 with_page_param(F.col("base"), F.coalesce(cfg["param"], F.lit(DEFAULT_PARAM)),
                                 value)).otherwise(F.col("base"))
    return pages.select("site_id", "tab_no", "page_num", url.alias("url"), "strategy",
                        F.col("strategy").isin(*BROWSER_STRATEGIES).alias("needs_browser"))


def early_stop(records: DataFrame, history: DataFrame, pages: DataFrame | None = None,
               site: str = "site_id", page: str = "page_num", pos: str = "pos",
               key: str = "fingerprint", materialize: bool = True,
               can_stop=None) -> tuple[DataFrame, DataFrame]:
    """Apply the per-site early stop.

    A record is *new* when it is the first occurrence of its key within the
    site (by page, pos) and the key is not in the history. Within a site the
    first page > 1 with no new record stops the site: it and all later pages
    contribute nothing (a page 1 without new records does not stop).

    ``pages`` are the fetched pages (site, page): one without any record is
    empty and so without new ones; without ``pages`` only pages with records
    are known. ``page`` may be a number or a struct that orders pages (tab,
    page); ``can_stop(page)`` says which pages may stop a site (default page > 1).

    Returns ``(kept, page_stats)``: the keys (site, key, page, pos) of the new
    records on pages before the stop — join them with the records for the rest —
    and one row per (site, page) with n_extracted, n_new and ``scraped`` (pages up
    to and including the stop page).

    Only keys are shuffled: they are aggregated on (site, key) and (site,
    page), combined on the map side, and joined with one row per site or per
    page. ``materialize`` writes the new keys and the page table once to the
    shared folder, so the records and the history are read once.
    """
    new = (records.groupBy(site, key).agg(F.min(F.struct(page, pos)).alias("_f"))
                  .select(site, key, F.col("_f")[page].alias(page), F.col("_f")[pos].alias(pos))
                  .join(history.select(key), key, "left_anti"))
    if materialize:
        new = stage(new, "new-keys")
    n_new = new.groupBy(site, page).agg(F.count(F.lit(1)).alias("n_new"))
    n_ext = records.groupBy(site, page).agg(F.count(F.lit(1)).alias("n_extracted"))
    if pages is not None:  # fetched pages without any record count too
        n_ext = (n_ext.unionByName(pages.select(site, page).distinct()
                                   .withColumn("n_extracted", F.lit(0).cast("long")))
                      .groupBy(site, page).agg(F.sum("n_extracted").alias("n_extracted")))
    stats = (n_ext.join(n_new, [site, page], "left")
                  .withColumn("n_new", F.coalesce("n_new", F.lit(0)).cast("long")))
    if materialize:
        stats = stage(stats, "page-counts")
    stoppable = can_stop(F.col(page)) if can_stop is not None else (F.col(page) > 1)
    stops = stats.where(stoppable & (F.col("n_new") == 0)).groupBy(site).agg(F.min(page).alias("stop_page"))
    stats = stats.join(stops, site, "left").withColumn(
        "scraped", F.col("stop_page").isNull() | (F.col(page) <= F.col("stop_page")))
    kept = (new.join(stops, site, "left")
               .where(F.col("stop_page").isNull() | (F.col(page) < F.col("stop_page")))
               .select(site, key, page, pos))
    return kept, stats


def coupled_stop(records: DataFrame, history: DataFrame, pages: DataFrame | None = None,
                 site: str = "site_id", page: str = "page_num", pos: str = "pos",
                 key: str = "fingerprint", can_stop=None) -> tuple[DataFrame, DataFrame, int]:
    """Early stop and first-seen across sites together, as a run over the sites
    one after the other decides them: a record is new if its key is neither in
    the history, nor earlier in its site, nor on a page that an earlier site
    (in the order of the site ids) really visited. The first page > 1 without a
    new record stops its site; what lies behind it is not visited and
    suppresses nothing elsewhere.

    The two rules depend on each other, so the stops are found in rounds: new
    records by the stops known so far, stops by the new records, until no stop
    moves. A site's stop depends on the sites before it alone, so the rounds end
    with the one solution after at most as many as there are sites (and in a few,
    as chains of stops that move each other are short).

    Only keys of more than one site (one row per site and key) are shuffled in
    a round, combined on the map side by key; the driver sees whether a stop
    moved. ``pages`` and ``can_stop`` are as in ``early_stop``. Site ids are not null.

    Returns ``(kept, page_stats, rounds)``: the keys (site, key, page, pos) that the
    run stores, one row per (site, page) with n_extracted, n_new, stop_page and
    ``scraped``, and the number of rounds.
    """
    firsts = stage(records.groupBy(site, key).agg(F.min(F.struct(page, pos)).alias("_f"))
                   .select(site, key, F.col("_f")[page].alias(page), F.col("_f")[pos].alias(pos))
                   .join(history.select(key), key, "left_anti"), "first-keys")
    several = firsts.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    contested = stage(firsts.join(several, key, "left_semi").select(site, key, page), "contested")
    counted = records.groupBy(site, page).agg(F.count(F.lit(1)).alias("n_extracted")).withColumn("n_first", F.lit(0).cast("long"))
    counted = counted.unionByName(firsts.groupBy(site, page).agg(F.count(F.lit(1)).alias("n_first"))
                                  .withColumn("n_extracted", F.lit(0).cast("long")))
    if pages is not None:  # fetched pages without any record count too
        counted = counted.unionByName(pages.select(site, page, F.lit(0).cast("long").alias("n_extracted"),
                                                   F.lit(0).cast("long").alias("n_first")))
    counted = stage(counted.groupBy(site, page).agg(F.sum("n_extracted").alias("n_extracted"), F.sum("n_first").alias("n_first")),
                    "page-counts")
    stoppable = can_stop(F.col(page)) if can_stop is not None else (F.col(page) > 1)
    stops, rounds = None, 0
    while True:
        rounds += 1
        visited = contested if stops is None else contested.join(stops, site, "left").where(
            F.col("stop_page").isNull() | (F.col(page) < F.col("stop_page")))
        owner = visited.groupBy(key).agg(F.min(site).alias("_owner"))
        suppressed = (contested.join(owner, key).where(F.col(site) > F.col("_owner"))
                      .groupBy(site, page).agg(F.count(F.lit(1)).alias("_n")))
        stats = (counted.join(suppressed, [site, page], "left")
                 .withColumn("n_new", F.col("n_first") - F.coalesce("_n", F.lit(0))).drop("_n", "n_first"))
        now = stage(stats.where(stoppable & (F.col("n_new") == 0)).groupBy(site).agg(F.min(page).alias("stop_page")), "stops")
        if stops is None:
            moved = not now.isEmpty()
        else:
            moved = not (now.join(stops.withColumnRenamed("stop_page", "_before"), site, "full")
                         .where(~F.col("stop_page").eqNullSafe(F.col("_before"))).isEmpty())
        stops = now
        if not moved:
            break
    stats = stats.join(stops, site, "left").withColumn(
        "scraped", F.col("stop_page").isNull() | (F.col(page) <= F.col("stop_page")))
    kept = (firsts.join(owner, key, "left").join(stops, site, "left")
            .where((F.col("_owner").isNull() | (F.col(site) <= F.col("_owner")))
                   & (F.col("stop_page").isNull() | (F.col(page) < F.col("stop_page"))))
            .select(site, key, page, pos))
    return kept, stats, rounds


def run_summary(stats: DataFrame, stored: DataFrame, site: str = "site_id",
                sites: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """Per-site run row: pages_scraped (including the stop page) and
    tenders_found (records of the site that were stored). ``sites`` (site): every
    one has a row, with zeros if nothing was fetched. ``errors`` (site,
    error_message): these sites' runs ended with status 'error'."""
    pages = stats.groupBy(site).agg(
        F.count(F.when(F.col("scraped"), 1)).cast("long").alias("pages_scraped"),
        F.sum(F.when(F.col("scraped"), F.col("n_extracted")).otherwise(0))
         .cast("long").alias("records_extracted"))
    if sites is not None:
        pages = sites.select(site).distinct().join(pages, site, "left")
    found = stored.groupBy(site).agg(F.count(F.lit(1)).cast("long").alias("tenders_found"))
    out = pages.join(found, site, "left").fillna(0, ["pages_scraped", "records_extracted", "tenders_found"])
    if errors is None:
        return out.withColumn("status", F.lit("success"))
    first = errors.groupBy(site).agg(F.min("error_message").alias("error_message"))
    return out.join(first, site, "left").withColumn(
        "status", F.when(F.col("error_message").isNull(), "success").otherwise("error"))
