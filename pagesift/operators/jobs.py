"""Queue jobs and run logs as append-only event tables.

Parquet has no in-place update, so every state change is an appended event
row (id, status, ts, seq, ...) and the current state of an id is an
aggregation over its events (``current_state``) — partial-aggregated per
id, so a job with many events never lands whole in one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Job and run statuses.
JOB_PENDING, JOB_RUNNING, JOB_DONE, JOB_ERROR = "pending", "running", "done", "error"
RUN_RUNNING, RUN_SUCCESS, RUN_ERROR = "running", "success", "error"
SITE_NOT_FOUND = "Site not found"


def active_sites(sites: DataFrame, enabled: str = "enabled") -> DataFrame:
    return sites.where(F.col(enabled))


def name_filter(sites: DataFrame, needle: str, name: str = "name") -> DataFrame:
    """Case-insensitive substring match on the site name."""
    return sites.where(F.instr(F.lower(F.col(name)), needle.lower()) > 0)


def enqueue(sites: DataFrame, run_ts: Column, triggered_by: str | None = None,
            site_id: str | None = None, id_col: str = "id") -> DataFrame:
    """One pending job per active site (optionally only ``site_id``). No
    check for an already-pending job. Job ids are generated (``uuid()``)."""
    s = active_sites(sites)
    if site_id is not None:
        s = s.where(F.col(id_col) == F.lit(site_id))
    return s.select(F.expr("uuid()").alias("job_id"), F.col(id_col).alias("site_id"),
                    F.lit(triggered_by).cast("string").alias("triggered_by"),
                    F.lit(JOB_PENDING).alias("status"), run_ts.alias("created_at"))


def transition(jobs: DataFrame, status: str, ts: Column, seq: int,
               error: Column | None = None) -> DataFrame:
    """Event rows moving jobs to ``status`` (running / done / error)."""
    return jobs.select(F.col("job_id").alias("id"), "site_id", F.lit(status).alias("status"),
                       ts.alias("ts"), F.lit(seq).cast("long").alias("seq"),
                       (error if error is not None else F.lit(None)).cast("string").alias("error"))


def current_state(events: DataFrame, id_col: str = "id", ts: str = "ts", seq: str = "seq",
                  status: str = "status", error: str = "error",
                  running: Sequence[str] = (JOB_RUNNING,),
                  finished: Sequence[str] = (JOB_DONE, JOB_ERROR)) -> DataFrame:
    """Latest status/error per id by (ts, seq); created_at = first event,
    started_at = first running event, finished_at = last finishing event."""
    last = F.max(F.struct(F.col(ts), F.col(seq), F.col(status).alias("s"),
                          F.col(error).alias("e")))
    return events.groupBy(id_col).agg(
        last["s"].alias("status"),
        last["e"].alias("error"),
        F.min(ts).alias("created_at"),
        F.min(F.when(F.col(status).isin(*running), F.col(ts))).alias("started_at"),
        F.max(F.when(F.col(status).isin(*finished), F.col(ts))).alias("finished_at"),
        F.count(F.lit(1)).cast("long").alias("n_events"))


def status_counts(state: DataFrame, status: str = "status") -> DataFrame:
    return state.groupBy(status).agg(F.count(F.lit(1)).cast("long").alias("n"))


def next_jobs(state: DataFrame, n: int = 1, id_col: str = "id") -> DataFrame:
    """Oldest pending jobs first (created_at, then id). ``n`` = how many a
    worker takes per poll."""
    return (state.where(F.col("status") == JOB_PENDING)
                 .orderBy(F.col("created_at").asc(), F.col(id_col).asc()).limit(n))


def site_lookup(jobs: DataFrame, sites: DataFrame, job_site: str = "site_id",
                site_id: str = "id") -> DataFrame:
    """Job → site (many-to-one left join); a missing site marks the job as
    error 'Site not found'. AQE broadcasts the site side when its measured
    size is below the broadcast threshold, else it is a sort-merge join."""
    s = sites.withColumnRenamed(site_id, "_sid")
    j = jobs.join(s, jobs[job_site] == s["_sid"], "left")
    missing = F.col("_sid").isNull()
    return (j.withColumn("lookup_status", F.when(missing, F.lit(JOB_ERROR)).otherwise(F.lit(JOB_RUNNING)))
             .withColumn("lookup_error", F.when(missing, F.lit(SITE_NOT_FOUND)))
             .drop("_sid"))


def delete_set_null(rows: DataFrame, deleted: DataFrame, fk: str, pk: str) -> DataFrame:
    """ON DELETE SET NULL: rows referencing a deleted parent keep the row
    with a null foreign key."""
    d = deleted.select(F.col(pk).alias("_del")).distinct()
    j = rows.join(d, rows[fk] == d["_del"], "left")
    return j.withColumn(fk, F.when(F.col("_del").isNull(), F.col(fk))).drop("_del")


def delete_cascade(rows: DataFrame, deleted: DataFrame, fk: str, pk: str) -> DataFrame:
    """ON DELETE CASCADE: rows referencing a deleted parent are removed."""
    d = deleted.select(F.col(pk).alias(fk))
    return rows.join(d, fk, "left_anti")


def listing(rows: DataFrame, order: str, key: str, where: Column | None = None) -> DataFrame:
    """Rows newest first (``order`` descending, then ``key``), of one site or
    status if ``where`` says so."""
    return (rows if where is None else rows.where(where)).orderBy(F.col(order).desc_nulls_last(), F.col(key).asc())


def start_run(sites: DataFrame, run_ts: Column, id_col: str = "id", run_id: Column | None = None) -> DataFrame:
    """Opening run events, one per site."""
    return sites.select((F.expr("uuid()") if run_id is None else run_id).alias("id"), F.col(id_col).alias("site_id"),
                        F.lit(RUN_RUNNING).alias("status"), run_ts.alias("ts"),
                        F.lit(0).cast("long").alias("seq"), F.lit(None).cast("int").alias("pages_scraped"),
                        F.lit(None).cast("int").alias("tenders_found"), F.lit(None).cast("string").alias("error_message"))


def finish_run(summary: DataFrame, runs: DataFrame, run_ts: Column) -> DataFrame:
    """Closing run events from a per-site summary (pages_scraped,
    tenders_found, status, and error_message if it has one). A run without a
    summary row ends with an error."""
    if "error_message" not in summary.columns:
        summary = summary.withColumn("error_message", F.lit(None).cast("string"))
    j = runs.select("id", "site_id").join(summary, "site_id", "left")
    return j.select("id", "site_id", F.coalesce("status", F.lit(RUN_ERROR)).alias("status"),
                    run_ts.alias("ts"), F.lit(1).cast("long").alias("seq"),
                    F.col("pages_scraped").cast("int"), F.col("tenders_found").cast("int"),
                    F.when(F.col("status").isNull(), F.lit("no result for the site")).otherwise(F.col("error_message")).alias("error_message"))
