"""The life of a queue job as a state machine with a lease.

A job is opened by its first ``pending`` event, goes from pending to running
and from running to done or error, which are final. A running job must show a
``running`` event at least every ``lease_seconds``; if it does not, it is
pending again from the end of the lease on (its worker is taken for lost). An
event that is no legal step changes nothing and is reported as refused.

Each event gives one row, and so does each end of a lease:

* ``applied``: a step (from_status → to_status)
* ``renewed``: running again while running, which moves the lease
* ``refused``: no legal step; to_status is from_status
* ``lease_end``: running → pending, at the time the lease ended; without seq

Events are taken in the order (ts, seq, status), only those before ``as_of``.
Exact repeats (a replayed write) count once. Rows without id or ts, or with
another status, are no events and are left out. A null seq comes first.
"""

from __future__ import annotations

from typing import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jobs import JOB_DONE, JOB_ERROR, JOB_PENDING, JOB_RUNNING

LEASE_SECONDS = 1800
STATUSES = (JOB_PENDING, JOB_RUNNING, JOB_DONE, JOB_ERROR)
COLUMNS = ("id", "ts", "seq", "from_status", "to_status", "verdict")


def events_only(events: DataFrame) -> DataFrame:
    """(id, ts, seq, status) of the rows that are events."""
    return (events.select("id", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), "status")
            .where(F.col("id").isNotNull() & F.col("ts").isNotNull() & F.col("status").isin(*STATUSES)))


def as_of_all(events: DataFrame):
    """The first millisecond after the last event (None without events)."""
    return events_only(events).agg(F.expr("timestamp_millis(unix_millis(max(ts)) + 1)")).first()[0]


def lifecycle(events: DataFrame, as_of=None, lease_seconds: int = LEASE_SECONDS, cell_seconds: int = 86_400) -> DataFrame:
    """The rows (id, ts, seq, from_status, to_status, verdict) of the module's text,
    in batch. ``as_of`` is a timestamp of whole milliseconds (default: all events).

    Whether a job runs before an event depends on its last running event alone,
    so nothing is folded one by one: opening and end of a job are aggregates
    combined before the shuffle, and the last running event is a window within
    (job, cell of time) that starts from the cells before. A job with a large
    part of all events is spread over its cells.
    """
    as_of = as_of if as_of is not None else as_of_all(events)
    e = events_only(events).where(F.col("ts") < F.lit(as_of).cast("timestamp")).distinct()
    e = e.withColumns({"at": F.struct("ts", "seq", "status"), "cell": F.expr(f"unix_seconds(ts) div {int(cell_seconds)}")})
    lease = F.expr(f"INTERVAL {int(lease_seconds)} SECONDS")

    opened = e.where(F.col("status") == JOB_PENDING).groupBy("id").agg(F.min("at").alias("opened"))
    e = e.join(opened, "id", "left")
    start = F.when((F.col("status") == JOB_RUNNING) & (F.col("at") > F.col("opened")), F.col("at"))
    cells = e.groupBy("id", "cell").agg(F.max(start).alias("r"))
    before_cell = Window.partitionBy("id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("id", "cell", F.max("r").over(before_cell).alias("carried"))
    in_cell = Window.partitionBy("id", "cell").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("last", F.max(start).over(in_cell)).join(cells, ["id", "cell"])
    e = e.withColumn("last", F.coalesce("last", "carried"))
    e = e.withColumn("runs", F.coalesce(F.col("ts") <= F.col("last.ts") + lease, F.lit(False)))

    ends = F.col("status").isin(JOB_DONE, JOB_ERROR)
    finish = e.where(ends & F.col("runs")).groupBy("id").agg(F.min("at").alias("finish"))
    e = e.join(finish, "id", "left")
    over = F.coalesce(F.col("at") > F.col("finish"), F.lit(False))
    known = F.coalesce(F.col("at") > F.col("opened"), F.lit(False))
    state = (F.when(~known, F.lit(None)).when(over, F.col("finish.status"))
             .when(F.col("runs"), F.lit(JOB_RUNNING)).otherwise(F.lit(JOB_PENDING)))
    opens = F.coalesce(F.col("at") == F.col("opened"), F.lit(False))
    live = known & ~over
    verdict = (F.when(opens, "applied")
               .when(live & (F.col("status") == JOB_RUNNING), F.when(F.col("runs"), "renewed").otherwise("applied"))
               .when(live & ends & F.col("runs"), "applied").otherwise("refused"))
    steps = e.select("id", "ts", "seq", state.alias("from_status"), verdict.alias("verdict"), "status") \
        .select("id", "ts", "seq", "from_status", F.when(F.col("verdict") == "refused", F.col("from_status")).otherwise(F.col("status")).alias("to_status"), "verdict")

    # A lease ends if the next running or ending event comes after it, or none.
    signs = e.where(live & (F.col("status") != JOB_PENDING))
    own = signs.where(F.col("status") == JOB_RUNNING).select("id", F.col("at").alias("r"), F.lit(None).cast("timestamp").alias("next"))
    following = signs.where(F.col("last").isNotNull()).select("id", F.col("last").alias("r"), F.col("ts").alias("next"))
    end = F.col("r.ts") + lease
    lapsed = (own.unionByName(following).groupBy("id", "r").agg(F.min("next").alias("next"))
              .where((end < F.lit(as_of).cast("timestamp")) & (F.col("next").isNull() | (F.col("next") > end)))
              .select("id", end.alias("ts"), F.lit(None).cast("long").alias("seq"), F.lit(JOB_RUNNING).alias("from_status"),
                      F.lit(JOB_PENDING).alias("to_status"), F.lit("lease_end").alias("verdict")))
    return steps.unionByName(lapsed)


def order_of(event: tuple) -> tuple:
    """Sort key of (us, seq, status): a null seq first."""
    us, seq, status = event
    return us, seq is not None, seq or 0, status


def fold(state: tuple, events: Iterable[tuple], until_us: int, lease_us: int) -> Iterator[tuple]:
    """The same rows one by one, for a state kept between batches.

    ``state`` is (status, lease start us, last event); ``events`` are ordered
    (us, seq, status) before ``until_us``. Yields (row, state after it), a row
    being (us, seq, from, to, verdict).
    """
    status, since, last = state

    def lapse(now: int):
        return status == JOB_RUNNING and since + lease_us < now

    for event in events:
        us, seq, wanted = event
        if event == last:
            continue
        last = event
        if lapse(us):
            status = JOB_PENDING
            yield (since + lease_us, None, JOB_RUNNING, JOB_PENDING, "lease_end"), (status, since, last)
        legal = (status, wanted) in ((None, JOB_PENDING), (JOB_PENDING, JOB_RUNNING), (JOB_RUNNING, JOB_DONE), (JOB_RUNNING, JOB_ERROR))
        renewed = status == wanted == JOB_RUNNING
        before, status = status, wanted if legal else status
        since = us if wanted == status == JOB_RUNNING else since
        yield (us, seq, before, status, "applied" if legal else "renewed" if renewed else "refused"), (status, since, last)
    if lapse(until_us):
        status = JOB_PENDING
        yield (since + lease_us, None, JOB_RUNNING, JOB_PENDING, "lease_end"), (status, since, last)
