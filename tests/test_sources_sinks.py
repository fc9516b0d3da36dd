import json
import os
import tempfile

import pytest

from pyspark.sql import functions as F

from pagesift.functions import text as X
from pagesift.functions.urls import document_kind
from pagesift.operators import frontier as R
from pagesift.plans import batch as B
from pagesift.sinks import store
from pagesift.sources import tables as S

SITES = [
    {"note": "----", "note2": "separator"},
    {"name": "Single", "url": "https://t.example/all", "enabled": True,
     "pagination": {"strategy": "none"}, "delay_ms": 2000},
    {"name": "Paged", "url": "https://p.example/s?page=1", "enabled": True,
     "pagination": {"strategy": "url_param", "param": "page", "start": 1, "increment": 1,
                    "max_pages": 3}},
    {"name": "Tabs", "url": "https://q.example/", "tab_urls": ["https://q.example/a", "https://q.example/b#x"],
     "pagination": {"strategy": "url_param", "param": "pg", "start": 0, "increment": 10, "max_pages": 2}},
    {"name": "Button", "url": "https://b.example/", "enabled": False,
     "pagination": {"strategy": "next_button", "next_selector": "a[rel=next]"}},
]


def test_sites_json_and_page_urls(spark):
    d = tempfile.mkdtemp(prefix="ps-sites-")
    path = os.path.join(d, "sites.json")
    with open(path, "w") as f:
        json.dump(SITES, f)
    sites = S.sites_from_json(spark, path)
    assert sites.count() == 4
    assert sites.where("name = 'Button'").first().enabled is False
    assert sites.where("name = 'Single'").first().delay_ms == 2000
    urls = R.page_urls(sites.join(sites.select("id", "name"), "id").drop("name"))
    got = sorted((r.tab_no, r.page_num, r.url, r.needs_browser) for r in urls.collect())
    assert (0, 1, "https://t.example/all", False) in got
    assert (0, 3, "https://p.example/s?page=3", False) in got
    assert (0, 2, "https://q.example/a?pg=10", False) in got
    assert (1, 1, "https://q.example/b?pg=0#x", False) in got
    assert (0, 1, "https://b.example/", True) in got
    assert len(got) == 1 + 3 + 4 + 1


def test_html_files_source(spark):
    d = tempfile.mkdtemp(prefix="ps-html-")
    for i in range(3):
        with open(os.path.join(d, f"p{i}.html"), "w") as f:
            f.write(f"<html><body><p>page {i}</p></body></html>")
    with open(os.path.join(d, "skip.txt"), "w") as f:
        f.write("x")
    df = S.html_files(spark, d)
    assert df.count() == 3
    from pagesift.functions.html import clean_html
    assert sorted(r.t for r in df.select(clean_html("html").alias("t")).collect()) == \
        ["page 0", "page 1", "page 2"]


def test_document_kind_and_key_fallback(spark):
    df = spark.createDataFrame([("a/x.PDF",), ("b.docx",), ("c.doc",), ("d.xls",), ("e.zip",)], "p string")
    assert [r.k for r in df.select(document_kind("p").alias("k")).collect()] == \
        ["pdf", "docx", "docx", None, None]
    r = spark.createDataFrame([("keep", "R", "T"), ("", "R", "T")], "fp string, r string, t string")
    got = [x.k for x in r.select(X.key_fallback("fp", "r", "t").alias("k")).collect()]
    assert got[0] == "keep" and got[1] == r.select(X.fingerprint("r", "t").alias("f")).collect()[1].f


def test_seed_insert_with_explicit_key_and_keyed_merge(spark):
    d = tempfile.mkdtemp(prefix="ps-store-")
    t = os.path.join(d, "sites")
    seed = spark.createDataFrame([("UK", "https://x"), ("UK", "https://x")], "name string, url string")
    keyed = seed.withColumn("k", F.concat_ws("\u0000", "name", "url"))
    assert store.insert_if_absent(keyed, t, "k") == 1
    assert store.insert_if_absent(keyed, t, "k") == 0
    assert store.insert_if_absent(keyed.limit(0), t, "k") == 0
    up1 = spark.createDataFrame([("s1", "c1", 1), ("s2", "c2", 1)], "site_id string, cookies string, ts int")
    up2 = spark.createDataFrame([("s1", "c1b", 2)], "site_id string, cookies string, ts int")
    got = {x.site_id: x.cookies for x in store.merge_by_key(up1, up2, "site_id", ["ts"]).collect()}
    assert got == {"s1": "c1b", "s2": "c2"}


def test_events_are_appended_once(spark):
    t = os.path.join(tempfile.mkdtemp(prefix="ps-events-"), "events")
    ev = spark.createDataFrame([("j1", 1, "running"), ("j1", 2, "done")], "id string, seq long, status string")
    for _ in range(2):
        store.append_events(ev, t, ["id", "seq"])
    assert spark.read.parquet(t).count() == 2


def test_cluster_without_a_shared_folder_is_an_error():
    from pagesift.session import checkpoint_dir

    class Conf(dict):
        def get(self, k, default=None):
            return dict.get(self, k, default)

    class Session:
        conf = Conf({"spark.master": "spark://m:7077"})

    with pytest.raises(ValueError):
        checkpoint_dir(Session())


PAGE = "<html><head><title>{t}</title></head><body>{body}</body></html>"


def test_zero_result_fallback_and_document_enrichment(spark):
    listing = PAGE.format(t="L", body='<a href="/tender/9">Tender nine</a><a href="/about">About</a>')
    detail = PAGE.format(t="D", body='<p>Road works KDN/T/001/2026</p><p>Contact ann@x.example</p>'
                                     '<p>Bidders must hold grade G7</p>'
                                     '<a href="/docs/spec.pdf">Spec</a><a href="/docs/terms.pdf">Terms</a>')
    pages = spark.createDataFrame([(1, "https://h.example/list", listing),
                                   (2, "https://h.example/tender/9", detail)],
                                  "page_id long, url string, html string")
    sp = B.site_pages(pages).where("page_id = 1")
    no_records = spark.createDataFrame([], "page_id long")
    extra = B.zero_result_fallback(sp, no_records, pages, B.rule_records)
    rows = extra.collect()
    assert [r.reference for r in rows] == ["KDN/T/001/2026"]
    assert rows[0].url == "https://h.example/tender/9"
    stored = extra.select("fingerprint", "url", "title", F.lit("listing text").alias("description"),
                          F.lit(None).cast("string").alias("contact"), "page_url")
    pages = pages.unionByName(spark.createDataFrame([(3, "https://h.example/tender/9", PAGE.format(t="later", body="copy"))], pages.schema))
    docs = spark.createDataFrame([("https://h.example/docs/spec.pdf", "Submit by e-mail\nphone +60 3 1234 5678"),
                                  ("https://h.example/docs/terms.pdf", "Eligibility: must be registered")],
                                 "doc_url string, text string")
    out = B.enrich_records(stored, pages, documents=docs).first()
    assert out.n_sources == 4
    assert out.description.startswith("listing text\n\nD\nRoad works")
    assert out.contact_email == "ann@x.example"
    assert out.requirements == "Bidders must hold grade G7"
    assert out.submission_method == "Submit by e-mail"
    assert out.contact == "+60 3 1234 5678"
    assert [(x.name, x.url) for x in out.document_urls] == [("Spec", "https://h.example/docs/spec.pdf"), ("Terms", "https://h.example/docs/terms.pdf")]


def test_full_run_annotates_and_sets_small_pages_aside(spark):
    from pagesift.schemas import TENDER_SCHEMA
    rows = [(1, "https://h.example/list", PAGE.format(t="L", body='<a href="/tender/9">Tender nine</a>' + "x" * 80)),
            (2, "https://h.example/tender/9", PAGE.format(t="D", body="<p>Road works KDN/T/001/2026 open</p><p>Submit to ann@x.example</p>")),
            (3, "https://g.example/list", PAGE.format(t="G", body="<p>Chairs UTM/BID/2026 RFQ</p>" + "y" * 60)),
            (4, "https://s.example/list", "<p>tiny</p>")]
    pages = B.site_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    listings = pages.where("page_id <> 2").unionByName(pages.where("page_id = 2").withColumn("page_num", F.lit(2)))
    sites = spark.createDataFrame([(f"{x}.example", x.upper()) for x in "hgs"], "site_id string, source_site string")
    done, summ, aside = B.full_run(listings, sites, spark.createDataFrame([], "fingerprint string"),
                                   F.to_timestamp(F.lit("2026-12-01 09:00:00")), min_chars=60)
    assert done.schema.fieldNames() == TENDER_SCHEMA.fieldNames()
    got = {r.reference: r for r in done.collect()}
    assert set(got) == {"KDN/T/001/2026", "UTM/BID/2026"}
    r = got["KDN/T/001/2026"]
    assert (r.source_site, r.url, r.status, r.submission_method) == ("H", "https://h.example/tender/9", "Open", "Submit to ann@x.example")
    assert [(a.page_id, a.reason) for a in aside.collect()] == [(4, "page too small")]
    assert {s.site_id: s.pages_scraped for s in summ.collect()}["s.example"] == 1


def test_partitioned_record_table_prunes_by_site(spark):
    d = tempfile.mkdtemp(prefix="ps-part-")
    t = os.path.join(d, "tenders")
    rows = [(f"f{i}", f"site{i % 3}", f"title {i}") for i in range(30)]
    batch = spark.createDataFrame(rows, "fingerprint string, source_site string, title string")
    assert store.insert_if_absent(batch, t, partition_by=["source_site"]) == 30
    q = spark.read.parquet(t).where(F.col("source_site") == "site1")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_site" in plan and "site1" in plan
    assert q.count() == 10
    assert store.insert_if_absent(batch, t, partition_by=["source_site"]) == 0


def test_enrichment_with_model_functions(spark):
    import json as _json
    detail = PAGE.format(t="D", body='<p>Scope text</p><a href="/d/a.pdf">A</a><a href="/d/b.docx">B</a>')
    pages = spark.createDataFrame([(2, "https://h.example/t/1", detail)], "page_id long, url string, html string")
    stored = spark.createDataFrame(
        [("fp1", "https://h.example/t/1", "T", "listing", None, "https://h.example/list")],
        "fingerprint string, url string, title string, description string, contact string, page_url string")

    def detail_model(prompts):
        assert all("Source URL: https://h.example/t/1" in p for p in prompts)
        return ['```json\n{"full_description": "D-full", "contact_name": "Ann", "tender_type": "RFQ"}\n```'
                for _ in prompts]

    def file_model(prompts):
        out = []
        for p in prompts:
            if "a.pdf" in p:
                out.append(_json.dumps({"full_description": "A-doc", "contact_email": "a@x", "deadline": "x"}))
            else:
                out.append("not json")
        return out

    docs = spark.createDataFrame([("https://h.example/d/a.pdf", "pdf text"), ("https://h.example/d/b.docx", "docx")],
                                 "doc_url string, text string")
    r = B.enrich_records(stored, pages, documents=docs, detail_fn=detail_model, file_fn=file_model).first()
    assert r.description == "listing\n\nD-full\n\nA-doc"
    assert r.contact_name == "Ann" and r.contact_email == "a@x" and r.tender_type == "RFQ"
    assert r.contact == "a@x"   # last source with any contact part
    assert r.n_sources == 4
