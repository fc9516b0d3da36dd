import os
import tempfile

from pyspark.sql import functions as F

from pagesift.plans import batch as B
from pagesift.schemas import JOB_EVENT_SCHEMA
from pagesift.sinks import store
from pagesift.streaming import queue as Qs

REC_SCHEMA = "fingerprint string, seq long, v string"


def _write_parts(spark, root, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, REC_SCHEMA).coalesce(1).write.mode("append").parquet(root)


def test_stream_dedupe_matches_batch_and_replay_adds_nothing(spark):
    base = tempfile.mkdtemp(prefix="ps-stream-")
    src = os.path.join(base, "src")
    parts = [[("a", 0, "x"), ("b", 1, "x"), ("a", 2, "y")],
             [("b", 3, "y"), ("c", 4, "x")],
             [("c", 5, "z"), ("d", 6, "x"), ("d", 7, "y")]]
    _write_parts(spark, src, parts)
    hist = os.path.join(base, "hist")
    spark.createDataFrame([("c", -1, "old")], REC_SCHEMA).write.parquet(hist)

    def run(table, ckpt):
        stream = spark.readStream.schema(REC_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        q = Qs.dedupe_into(stream, table, "fingerprint", ["seq"], checkpoint=ckpt)
        q.awaitTermination()
        return spark.read.parquet(table)

    t1 = os.path.join(base, "t1")
    spark.read.parquet(hist).write.parquet(t1)
    got = run(t1, os.path.join(base, "ck1"))
    keys = sorted(r.fingerprint for r in got.collect())
    assert keys == ["a", "b", "c", "d"]
    assert got.where("fingerprint = 'c'").first().v == "old"
    # one batch gives the same table
    t2 = os.path.join(base, "t2")
    spark.read.parquet(hist).write.parquet(t2)
    n = store.insert_if_absent(spark.read.parquet(src), t2, "fingerprint", ["seq"])
    assert n == 3
    assert sorted(spark.read.parquet(t2).collect()) == sorted(got.collect())
    # replay from scratch (new checkpoint): nothing is appended
    again = run(t1, os.path.join(base, "ck1b"))
    assert again.count() == 4


def test_change_feed(spark):
    base = tempfile.mkdtemp(prefix="ps-feed-")
    table = os.path.join(base, "t")
    store.insert_if_absent(spark.createDataFrame([("a", 0, "x")], REC_SCHEMA), table)
    feed = Qs.change_feed(spark, table, REC_SCHEMA)
    q = feed.writeStream.format("memory").queryName("feed_t").trigger(availableNow=True) \
        .option("checkpointLocation", os.path.join(base, "ck")).start()
    q.awaitTermination()
    assert spark.sql("select count(*) c from feed_t").first().c == 1


PAGE = ("<html><head><title>{t}</title></head><body><p>{body}</p>"
        "<p>Supply of chairs IIUM/DEV/3/2026</p></body></html>")


def test_queue_worker_end_to_end(spark):
    base = tempfile.mkdtemp(prefix="ps-queue-")
    queue = os.path.join(base, "queue")
    tenders = os.path.join(base, "tenders")
    sites = spark.createDataFrame([("h1.example", "One", True), ("h2.example", "Two", True)],
                                  "id string, name string, enabled boolean")
    pages = spark.createDataFrame(
        [(1, "https://h1.example/list?page=1", PAGE.format(t="A", body="alpha line")),
         (2, "https://h1.example/list?page=2", PAGE.format(t="A", body="beta line")),
         (3, "https://h2.example/list", PAGE.format(t="B", body="gamma line"))],
        "page_id long, url string, html string")
    sp = B.site_pages(pages)
    ts = F.to_timestamp(F.lit("2026-12-01 09:00:00"))
    ev = spark.createDataFrame(
        [("j1", "h1.example", None, "pending", None, 0, None),
         ("j2", "nowhere.example", None, "pending", None, 0, None)],
        "id string, site_id string, triggered_by string, status string, ts timestamp, seq long, error string"
    ).withColumn("ts", ts)
    ev.select(*[f.name for f in JOB_EVENT_SCHEMA.fields]).write.parquet(queue)

    def run(site_pages, hist):
        return B.run_batch(B.page_records(site_pages), hist)

    events_out = os.path.join(base, "events")
    q = Qs.consume_queue(spark, queue, sites, sp, run, tenders, events_out,
                         checkpoint=os.path.join(base, "ck"))
    q.awaitTermination()
    t = spark.read.parquet(tenders)
    titles = sorted(r.title for r in t.collect())
    assert "Supply of chairs IIUM/DEV/3/2026" in titles and "alpha line" in titles
    assert all(r.site_id == "h1.example" for r in t.collect())
    evs = {(r.id, r.status): r.error for r in spark.read.parquet(events_out).collect()}
    assert ("j1", "done") in evs and ("j2", "error") in evs
    assert evs[("j2", "error")] == "Site not found"


def test_one_failing_site_and_a_replay(spark):
    base = tempfile.mkdtemp(prefix="ps-queue-")
    tenders, events_out = os.path.join(base, "tenders"), os.path.join(base, "events")
    sites = spark.createDataFrame([("good.example",), ("bad.example",)], "id string")
    sp = B.site_pages(spark.createDataFrame(
        [(1, "https://good.example/l", PAGE.format(t="A", body="alpha")), (2, "https://bad.example/l", "<p>x</p>")],
        "page_id long, url string, html string"))
    ev = spark.createDataFrame([(f"j{i}", s, "pending", 0, None) for i, s in enumerate(["good.example", "bad.example", "gone.example"])],
                               "id string, site_id string, status string, seq long, error string"
                               ).withColumn("ts", F.to_timestamp(F.lit("2026-12-01 09:00:00")))

    def run(site_pages, hist):
        errors = site_pages.where("html = '<p>x</p>'").select("site_id", F.lit("x" * 3000).alias("error_message"))
        good = site_pages.where("html <> '<p>x</p>'")
        return B.run_batch(B.page_records(good), hist, pages=good, sites=site_pages.select("site_id"), errors=errors)

    for _ in range(2):  # the same micro-batch twice
        Qs.process_queue_batch(ev, sites, sp, run, tenders, events_out, F.current_timestamp(), epoch_id=7)
    rows = spark.read.parquet(events_out).collect()
    assert len(rows) == 6
    ends = {r.id: (r.status, r.error) for r in rows if r.seq == 2}
    assert ends == {"j0": ("done", None), "j1": ("error", "x" * 3000), "j2": ("error", "Site not found")}
    assert spark.read.parquet(tenders).where("title = 'alpha'").count() == 1


def test_pages_stream_clean_incremental(spark):
    """The same page operators run incrementally on a page stream."""
    from pagesift.functions.html import clean_html
    from pagesift.sources.tables import pages_stream
    from conftest import SF001
    base = tempfile.mkdtemp(prefix="ps-pages-")
    src = os.path.join(base, "pages")
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    pages.limit(20).write.parquet(src)
    s = pages_stream(spark, src).select("page_id", clean_html("html").alias("text"))
    q = s.writeStream.format("memory").queryName("clean_stream").trigger(availableNow=True) \
        .option("checkpointLocation", os.path.join(base, "ck")).start()
    q.awaitTermination()
    got = {r.page_id: r.text for r in spark.sql("select * from clean_stream").collect()}
    want = {r.page_id: r.t for r in spark.read.parquet(src).select("page_id", clean_html("html").alias("t")).collect()}
    assert got == want and len(got) == 20


def test_stream_restart_resumes_from_checkpoint(spark):
    """Stopping and restarting with the same checkpoint processes only new
    files; the table equals a one-shot insert of everything."""
    base = tempfile.mkdtemp(prefix="ps-restart-")
    src = os.path.join(base, "src")
    table = os.path.join(base, "t")
    ckpt = os.path.join(base, "ck")
    _write_parts(spark, src, [[("a", 0, "x"), ("b", 1, "x")], [("a", 2, "y")]])

    def run():
        stream = spark.readStream.schema(REC_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        Qs.dedupe_into(stream, table, "fingerprint", ["seq"], checkpoint=ckpt).awaitTermination()

    run()
    assert spark.read.parquet(table).count() == 2
    _write_parts(spark, src, [[("c", 3, "x"), ("b", 4, "z")]])
    run()
    got = sorted((r.fingerprint, r.seq) for r in spark.read.parquet(table).collect())
    assert got == [("a", 0), ("b", 1), ("c", 3)]


def test_bounded_state_stream_dedupe_is_opt_in(spark):
    """dropDuplicatesWithinWatermark drops repeats of a key inside the
    watermark; it is the bounded-state alternative to dedupe_into."""
    base = tempfile.mkdtemp(prefix="ps-wm-")
    src = os.path.join(base, "src")
    sch = "fingerprint string, ts timestamp"
    spark.createDataFrame([("a", None), ("a", None), ("b", None)], sch) \
        .withColumn("ts", F.to_timestamp(F.lit("2026-01-01 00:00:00"))).write.parquet(src)
    s = Qs.first_seen_stream(spark.readStream.schema(sch).parquet(src), "fingerprint", ["ts"],
                             watermark=("ts", "1 hour"))
    q = s.writeStream.format("memory").queryName("wm_dedupe").outputMode("append") \
        .trigger(availableNow=True).option("checkpointLocation", os.path.join(base, "ck")).start()
    q.awaitTermination()
    assert sorted(r.fingerprint for r in spark.sql("select * from wm_dedupe").collect()) == ["a", "b"]
