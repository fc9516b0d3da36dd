"""Views that are kept up with each batch of events instead of being computed
from all of them again.

A view is a set of keys with measures that merge: minimum, maximum or sum of a
row's value (the last row of a key is the maximum of a struct led by the order).
``partials`` turns the events of one batch into a row per key, ``merge`` brings
rows of any number of batches together; the order and the split of batches do
not matter. Both are plain aggregations combined on the map side, so a hot key
is one row per task before it is shuffled. ``sinks.views`` stores the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jobs

MERGE: dict[str, Callable[[str | Column], Column]] = {"min": F.min, "max": F.max, "sum": F.sum}


@dataclass(frozen=True)
class View:
    """``measures``: name → (min, max or sum, value of a row). Null values do not
    count; a key whose values are all null has a null measure. Null keys are a key
    like any other."""
    keys: tuple[str, ...]
    measures: dict[str, tuple[str, Column]]

    def partials(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[MERGE[kind](value).alias(name) for name, (kind, value) in self.measures.items()])

    def merge(self, partials: DataFrame) -> DataFrame:
        return partials.groupBy(*self.keys).agg(*[MERGE[kind](name).alias(name) for name, (kind, _) in self.measures.items()])


def job_view(id_col: str = "id") -> View:
    """What ``jobs.current_state`` needs of job events."""
    status, ts = F.col("status"), F.col("ts")
    return View((id_col,), {
        "last": ("max", F.struct("ts", "seq", status.alias("s"), F.col("error").alias("e"))),
        "created_at": ("min", ts),
        "started_at": ("min", F.when(status == jobs.JOB_RUNNING, ts)),
        "finished_at": ("max", F.when(status.isin(jobs.JOB_DONE, jobs.JOB_ERROR), ts)),
        "n_events": ("sum", F.lit(1).cast("long"))})


def job_states(kept: DataFrame, id_col: str = "id") -> DataFrame:
    """The columns of ``jobs.current_state``."""
    return kept.select(id_col, F.col("last.s").alias("status"), F.col("last.e").alias("error"),
                       "created_at", "started_at", "finished_at", "n_events")


RUN_FIELDS = ("status", "pages_scraped", "tenders_found", "error_message")


def run_view() -> View:
    """Runs from their opening and closing events (``jobs.start_run``, ``finish_run``)."""
    return View(("id", "site_id"), {
        "last": ("max", F.struct("ts", "seq", *RUN_FIELDS)),
        "started_at": ("min", F.col("ts")),
        "finished_at": ("max", F.when(F.col("status") != jobs.RUN_RUNNING, F.col("ts")))})


def runs(kept: DataFrame) -> DataFrame:
    return kept.select("id", "site_id", *[F.col("last")[c].alias(c) for c in RUN_FIELDS], "started_at", "finished_at")
