"""Structured Streaming: queue consumption, replay-safe dedupe into the record
table, and change feeds.

* ``consume_queue`` — the worker: a file stream over the append-only job
  event table; each micro-batch takes the jobs that are pending in it, looks
  up their sites, runs the batch run for those sites' stored pages, inserts
  new records if absent and appends running/done/error events. Tests use
  ``availableNow``; deployments use ``processingTime`` (30 s poll).
* ``dedupe_into`` — stateless streaming dedupe against all history: every
  micro-batch is first-seen-deduplicated and anti-joined with the sink
  table's key column before the append, so a replayed batch (at-least-once
  ``foreachBatch``) appends nothing and no unbounded key state is kept in the
  stream itself.
* ``change_feed`` — readers follow an append-only table as a stream.

Progress lives in the stream checkpoint, which every stream names for itself, so
a restarted worker resumes after the last committed batch; two workers cannot
take the same micro-batch.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import jobs
from ..schemas import JOB_EVENT_SCHEMA
from ..session import stage
from ..sinks import store


def change_feed(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows appended to the Parquet table at ``path``, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def _writer(stream: DataFrame, fn, checkpoint: str, available_now: bool, poll: str):
    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True) if available_now else w.trigger(processingTime=poll)


def dedupe_into(stream: DataFrame, table_path: str, key: str = "fingerprint",
                order: Sequence[str] = (), *, checkpoint: str, available_now: bool = True,
                poll: str = "30 seconds") -> StreamingQuery:
    """Insert each micro-batch into ``table_path`` if its key is absent."""

    def batch(df: DataFrame, epoch_id: int) -> None:
        store.insert_if_absent(df, table_path, key, order)

    return _writer(stream, batch, checkpoint, available_now, poll).start()


def process_queue_batch(events: DataFrame, sites: DataFrame, pages: DataFrame,
                        run: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]],
                        tenders_path: str, events_path: str, run_ts, epoch_id: int = 0) -> dict:
    """One worker step over a micro-batch of job events.

    ``pages`` are stored site pages (site_id, page_num, page_id, url, html);
    ``run(site_pages, history)`` returns (stored records, run summary) — e.g.
    ``plans.batch`` composed with an extractor. Every pending job gets a
    'running' event, then the end of its own site's run: 'error' with its
    message if the summary says so, or if the site is not found, else 'done'. A
    failure of the whole step (not of a site) is recorded for all its jobs.
    Event times are the step's; a replay of the same ``epoch_id`` appends
    nothing.
    """
    spark = events.sparkSession
    pending = (jobs.current_state(events.withColumn("seq", F.coalesce("seq", F.lit(0))))
               .where(F.col("status") == jobs.JOB_PENDING)
               .join(events.select("id", "site_id").distinct(), "id"))
    looked = jobs.site_lookup(pending.withColumnRenamed("id", "job_id"), sites.select("id"))
    looked = stage(looked, "queue-jobs")  # used several times below; small

    def note(rows: DataFrame) -> None:
        store.append_events(rows.withColumn("epoch_id", F.lit(epoch_id).cast("long")), events_path, ["id", "seq", "epoch_id"])

    note(jobs.transition(looked, jobs.JOB_RUNNING, run_ts, 1))
    ended = looked.select("job_id", "site_id", F.col("lookup_error").alias("error"))
    result = {"inserted": 0, "error": None}
    try:
        found = looked.where(F.col("lookup_status") == jobs.JOB_RUNNING)
        site_pages = pages.join(found.select("site_id").distinct(), "site_id", "left_semi")
        hist = store.read_or_empty(spark, tenders_path, "fingerprint string").select("fingerprint")
        stored, summary = run(site_pages, hist)
        if "error_message" in summary.columns:
            failed = stage(summary.where(F.col("error_message").isNotNull()).select("site_id", "error_message"), "site-errors")
            ended = ended.join(failed, "site_id", "left").withColumn("error", F.coalesce("error", "error_message"))
        result["inserted"] = store.insert_if_absent(stored, tenders_path, "fingerprint")
    except Exception as e:  # the step fails, the worker goes on
        result["error"] = f"{type(e).__name__}: {e}"
        ended = ended.withColumn("error", F.coalesce("error", F.lit(result["error"])))
    note(jobs.transition(ended.where(F.col("error").isNull()), jobs.JOB_DONE, run_ts, 2)
         .unionByName(jobs.transition(ended.where(F.col("error").isNotNull()), jobs.JOB_ERROR, run_ts, 2, F.col("error"))))
    return result


def consume_queue(spark: SparkSession, queue_path: str, sites: DataFrame, pages: DataFrame,
                  run: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]],
                  tenders_path: str, events_path: str, checkpoint: str,
                  available_now: bool = True, poll: str = "30 seconds") -> StreamingQuery:
    """Start the queue worker over the job-event directory ``queue_path``."""
    stream = spark.readStream.schema(JOB_EVENT_SCHEMA).parquet(queue_path)

    def batch(df: DataFrame, epoch_id: int) -> None:
        process_queue_batch(df, sites, pages, run, tenders_path, events_path,
                            F.current_timestamp(), epoch_id)

    return _writer(stream, batch, checkpoint, available_now, poll).start()


def first_seen_stream(stream: DataFrame, key: str, order: Sequence[str],
                      watermark: tuple[str, str] | None = None) -> DataFrame:
    """Bounded-state alternative: ``dropDuplicatesWithinWatermark`` forgets
    keys older than the watermark, so it is opt-in (results then depend on
    lateness); the default pipeline uses ``dedupe_into``."""
    if watermark:
        return stream.withWatermark(*watermark).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])

