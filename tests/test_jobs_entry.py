from pyspark.sql import functions as F

from pagesift.operators import jobs as J
from pagesift.operators import report as R
from conftest import SF001


def test_enqueue_and_state(spark):
    sites = spark.createDataFrame([("s1", "Alpha", True), ("s2", "Beta", False), ("s3", "alphabet", True)],
                                  "id string, name string, enabled boolean")
    ts = F.to_timestamp(F.lit("2026-12-01 09:00:00"))
    q = J.enqueue(sites, ts, triggered_by="u1")
    assert sorted(r.site_id for r in q.collect()) == ["s1", "s3"]
    assert J.enqueue(sites, ts, site_id="s3").count() == 1
    assert sorted(r.name for r in J.name_filter(sites, "ALPHA").collect()) == ["Alpha", "alphabet"]


def test_current_state_and_next(spark):
    rows = [("j1", "pending", "2026-01-01 00:00:00", 0, None),
            ("j1", "running", "2026-01-01 00:01:00", 1, None),
            ("j1", "error", "2026-01-01 00:02:00", 2, "Site not found"),
            ("j2", "pending", "2026-01-01 00:00:30", 0, None),
            ("j3", "pending", "2026-01-01 00:00:10", 0, None)]
    ev = spark.createDataFrame(rows, "id string, status string, t string, seq long, error string") \
        .withColumn("ts", F.to_timestamp("t")).drop("t")
    st = {r.id: r for r in J.current_state(ev).collect()}
    assert st["j1"].status == "error" and st["j1"].error == "Site not found"
    assert st["j1"].started_at is not None and st["j1"].finished_at is not None
    assert [r.id for r in J.next_jobs(J.current_state(ev), 1).collect()] == ["j3"]
    counts = {r.status: r.n for r in J.status_counts(J.current_state(ev)).collect()}
    assert counts == {"error": 1, "pending": 2}


def test_site_lookup_missing(spark):
    jobs = spark.createDataFrame([("j1", "s1"), ("j2", "gone")], "job_id string, site_id string")
    sites = spark.createDataFrame([("s1", "A")], "id string, name string")
    out = {r.job_id: r for r in J.site_lookup(jobs, sites).collect()}
    assert out["j1"].lookup_status == "running" and out["j2"].lookup_error == "Site not found"


def test_referential_actions(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, site string")
    deleted = spark.createDataFrame([("a",)], "sid string")
    sn = {r.id: r.site for r in J.delete_set_null(rows, deleted, "site", "sid").collect()}
    assert sn == {1: None, 2: "b", 3: None}
    assert sorted(r.id for r in J.delete_cascade(rows, deleted, "site", "sid").collect()) == [2, 3]


def test_digest(spark):
    rec = spark.createDataFrame([("f1", "A <b>", None, "", "Open", "S")],
                                "fingerprint string, title string, issuer string, deadline string, "
                                "status string, source_site string")
    r = R.digest_rows(rec).first()
    assert r.title == "A &lt;b&gt;" and r.issuer == "—" and r.deadline == "—"
    ts = F.to_timestamp(F.lit("2026-12-02 10:00:00"))
    h = R.digest_header(rec, ts).first()
    assert h.n_new == 1 and h.subject.endswith("2026-12-02") and h.heading.endswith("02 December 2026")
    assert R.digest_header(rec.limit(0), ts).count() == 0


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"site_id", "pages_scraped", "records_extracted", "tenders_found", "status"}
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(E.QUERIES) <= set(o)


def test_all_queries_run_on_smoke_data(spark):
    import __spark_entry__ as E
    for name, fn in E.QUERIES.items():
        df = fn(spark, SF001)
        df.write.format("noop").mode("overwrite").save()


def test_udfs_do_not_need_the_package_on_worker_path(spark):
    """Python workers receive the package's UDFs by value, so queries work
    when the driver runs from another directory (and on executors)."""
    from pyspark import cloudpickle
    import pagesift
    from pagesift.functions import html as H
    assert cloudpickle.cloudpickle._is_registered_pickle_by_value(H)
    assert pagesift.__name__ == "pagesift"
