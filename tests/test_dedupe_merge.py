import random

from pyspark.sql import functions as F

from pagesift.operators import dedupe as D
from pagesift.operators import enrich as N
from pagesift.operators import frontier as R
from pagesift.schemas import MERGE_FIRST_FIELDS


def test_early_stop_fixture(spark):
    pages = {1: "ab", 2: "bc", 3: "ac", 4: "d"}
    rows = [("s", p, i, k) for p, ks in pages.items() for i, k in enumerate(ks)]
    rec = spark.createDataFrame(rows, "site_id string, page_num int, pos int, fingerprint string")
    hist = spark.createDataFrame([], "fingerprint string")
    kept, stats = R.early_stop(rec, hist)
    assert sorted(r.fingerprint for r in kept.collect()) == ["a", "b", "c"]
    summ = R.run_summary(stats, kept).first()
    assert summ.pages_scraped == 3 and summ.tenders_found == 3


def test_early_stop_page1_empty_continues(spark):
    rows = [("s", 1, 0, "old"), ("s", 2, 0, "x"), ("s", 3, 0, "x")]
    rec = spark.createDataFrame(rows, "site_id string, page_num int, pos int, fingerprint string")
    hist = spark.createDataFrame([("old",)], "fingerprint string")
    kept, stats = R.early_stop(rec, hist)
    assert [r.fingerprint for r in kept.collect()] == ["x"]
    assert R.run_summary(stats, kept).first().pages_scraped == 3


def test_insert_if_absent_idempotent(spark):
    hist = spark.createDataFrame([("a",)], "fingerprint string")
    batch = spark.createDataFrame([("a", 0), ("b", 1), ("b", 2), ("c", 3)], "fingerprint string, seq int")
    ins = D.insert_if_absent(batch, hist, order=["seq"])
    assert sorted((r.fingerprint, r.seq) for r in ins.collect()) == [("b", 1), ("c", 3)]
    hist2 = hist.unionByName(ins.select("fingerprint"))
    assert D.insert_if_absent(batch, hist2, order=["seq"]).count() == 0
    assert D.inserted_count(batch, hist, order=["seq"]).first().inserted == 2


def test_first_seen_partition_invariant(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abcdefg"), i, rnd.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o int, v double")
    a = sorted(D.first_seen(df, ["k"], ["o"]).collect())
    b = sorted(D.first_seen(df.repartition(7), ["k"], ["o"]).collect())
    assert a == b
    assert all(r.o == min(x[1] for x in rows if x[0] == r.k) for r in a)


def _sources(spark, rows):
    cols = ["fingerprint", "seq", "description", "contact", *MERGE_FIRST_FIELDS]
    full = []
    for r in rows:
        d = {c: None for c in cols}
        d.update(r)
        full.append(tuple(d[c] for c in cols))
    return spark.createDataFrame(full, ", ".join(
        f"{c} {'int' if c == 'seq' else 'string'}" for c in cols))


def test_merge_fixture_and_order_invariance(spark):
    rows = [{"fingerprint": "t", "seq": 0, "description": "L", "contact": "old"},
            {"fingerprint": "t", "seq": 1, "description": "D", "contact_name": "Ann", "requirements": ""},
            {"fingerprint": "t", "seq": 2, "description": "F", "contact_name": "Bob",
             "contact_email": "b@x", "requirements": "iso"}]
    for perm in (rows, rows[::-1], [rows[1], rows[2], rows[0]]):
        r = N.merge_enrichment(_sources(spark, perm).repartition(3)).first()
        assert r.description == "L\n\nD\n\nF"
        assert r.contact_name == "Ann" and r.contact_email == "b@x" and r.requirements == "iso"
        assert r.contact == "Bob | b@x"


def test_merge_keeps_listing_contact(spark):
    rows = [{"fingerprint": "t", "seq": 0, "description": "", "contact": "old"},
            {"fingerprint": "t", "seq": 1, "description": "D"}]
    r = N.merge_enrichment(_sources(spark, rows)).first()
    assert r.contact == "old" and r.description == "D"


def test_document_text_cap_and_blank(spark):
    rows = [("u", 0, "a" * 9000), ("u", 1, ""), ("u", 2, "b" * 9000), ("u", 3, "c" * 10),
            ("v", 0, "   "), ("w", 0, None)]
    df = spark.createDataFrame(rows, "doc_url string, page_no int, page_text string")
    whole = "a" * 9000 + "\n" + "b" * 9000 + "\n" + "c" * 10 + "\n"
    for cap, cut in ((None, False), (15000, True), (len(whole), False), (9001, True)):
        out = {r.doc_url: r for r in N.document_text(df, cap_chars=cap).collect()}
        assert set(out) == {"u"}
        assert (out["u"].text, out["u"].n_pages, out["u"].truncated) == (whole[:cap], 3, cut)
    assert N.document_text(df, paragraphs=True).first().text == whole[:-1]


def test_manifest_and_refs(spark):
    rows = [("f", "http://h/a/x.pdf", "X", 0), ("f", "http://h/b/x.pdf", "X2", 1),
            ("f", "http://h/c/y", "", 2), ("f", "http://h/z.doc", "Z", 3)]
    df = spark.createDataFrame(rows, "fingerprint string, url string, text string, pos int")
    m = N.file_manifest(df, k=3).orderBy("pos").collect()
    assert [(r.path, r.name) for r in m] == [("tender-docs/f/x.pdf", "X2"), ("tender-docs/f/y.pdf", "")]
    assert m[0].mime_type == "application/pdf"
    assert [r.rank for r in N.file_manifest(df).orderBy("pos").collect()] == [2, 3, 4]
    refs = N.document_refs(N.file_manifest(df, k=3)).first()
    assert refs.document_urls_json == '[{"name":"X2","url":"http://h/b/x.pdf"},{"name":"","url":"http://h/c/y"}]'


def test_keyless_records_share_one_key(spark):
    from pagesift.functions import text as X
    df = spark.createDataFrame([(None, " "), ("", None), ("R", None)], "r string, t string")
    rows = df.select(X.fingerprint("r", "t").alias("fp"), X.is_keyless("r", "t").alias("k")).collect()
    assert [r.k for r in rows] == [True, True, False]
    assert rows[0].fp == rows[1].fp == X.KEYLESS_FINGERPRINT


def test_run_batch_is_partitioning_invariant(spark):
    from pagesift.plans import batch as B
    from conftest import SF001
    pages = B.site_pages(spark.read.parquet(f"{SF001}/pages.parquet"))
    hist = spark.createDataFrame([], "fingerprint string")
    outs = []
    for n in (1, 7):
        rec = B.page_records(pages.repartition(n), materialize=False)
        _, summ = B.run_batch(rec, hist)
        outs.append(sorted(tuple(r) for r in summ.collect()))
    assert outs[0] == outs[1] and len(outs[0]) > 0


TABBED = "site_id string, page_num struct<tab_no:int,page_num:int>, pos int, fingerprint string"


def test_early_stop_with_tabs_ends_later_tabs(spark):
    from pagesift.plans.batch import stoppable_in_tab
    # tab 0: page 1 {a}, page 2 {a} (no new -> stop); tab 1: page 1 {b}
    rows = [("s", (0, 1), 0, "a"), ("s", (0, 2), 0, "a"), ("s", (1, 1), 0, "b")]
    rec = spark.createDataFrame(rows, TABBED)
    hist = spark.createDataFrame([], "fingerprint string")
    kept, stats = R.early_stop(rec, hist, can_stop=stoppable_in_tab)
    assert [r.fingerprint for r in kept.collect()] == ["a"]
    # page 1 of a later tab never stops a site on its own, whatever its number
    rows2 = [("s", (0, 5_000_000), 0, "a"), ("s", (3000, 1), 0, "a"), ("s", (3000, 2), 0, "c")]
    kept2, _ = R.early_stop(spark.createDataFrame(rows2, TABBED), hist, can_stop=stoppable_in_tab)
    assert sorted(r.fingerprint for r in kept2.collect()) == ["a", "c"]


def test_empty_page_stops_its_site_and_every_site_has_a_row(spark):
    from pagesift.plans import batch as B
    page = "<p>{}</p>"
    rows = [(1, "https://h.example/l?page=1", page.format("one")), (2, "https://h.example/l?page=2", "<p> </p>"),
            (3, "https://h.example/l?page=3", page.format("three")), (4, "https://e.example/l", "")]
    sp = B.site_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    sites = spark.createDataFrame([("h.example",), ("e.example",), ("n.example",)], "site_id string")
    failed = spark.createDataFrame([("n.example", "no answer")], "site_id string, error_message string")
    stored, summ = B.run_batch(B.page_records(sp), spark.createDataFrame([], "fingerprint string"),
                               pages=sp.select("site_id", "page_num"), sites=sites, errors=failed)
    assert [(r.title, r.page_url) for r in stored.collect()] == [("one", "https://h.example/l?page=1")]
    got = {r.site_id: (r.pages_scraped, r.records_extracted, r.tenders_found, r.status, r.error_message) for r in summ.collect()}
    assert got == {"h.example": (2, 1, 1, "success", None), "e.example": (1, 0, 0, "success", None),
                   "n.example": (0, 0, 0, "error", "no answer")}


def test_page_urls_limits(spark):
    rows = [("a", "https://h/l", ("url_param", None, None, None, n), None) for n in (0, 2, None)]
    sites = spark.createDataFrame(rows, "id string, url string, pagination struct<strategy:string,param:string,start:int,"
                                        "increment:int,max_pages:int>, tab_urls array<string>")
    assert R.page_urls(sites).count() == 0 + 2 + 20
