import random
import tempfile

from pagesift.operators.lifecycle import COLUMNS, as_of_all, fold, lifecycle, order_of
from pagesift.streaming.lifecycle import lifecycle_stream, state_store
from pyspark.sql import functions as F

SCHEMA = "id string, us long, seq long, status string"
MS = 1_000
T0 = 1_700_000_000_000_000


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("id", F.timestamp_micros("us").alias("ts"), "seq", "status")


def found(df):
    return sorted(map(tuple, df.select("id", F.unix_micros("ts"), *COLUMNS[2:]).collect()), key=repr)


def by_hand(rows, until, lease_seconds):
    out, jobs = [], {}
    for i, us, seq, status in rows:
        if i is not None and us is not None and status in ("pending", "running", "done", "error") and us < until:
            jobs.setdefault(i, set()).add((us, seq, status))
    for i, events in jobs.items():
        out += [(i, *row) for row, _ in fold((None, 0, None), sorted(events, key=order_of), until, lease_seconds * 1_000_000)]
    return sorted(out, key=repr)


def random_rows(seed, jobs=12, n=400, span=40_000):
    rnd = random.Random(seed)
    statuses = ["pending", "running", "running", "running", "done", "error", "other", None]
    rows = [(f"j{min(rnd.randrange(jobs), rnd.randrange(jobs))}", T0 + rnd.randrange(span) * 7 * MS + rnd.choice([0, 1, 999]), rnd.choice([None, 1, 2, 3]), rnd.choice(statuses))
            for _ in range(n)]
    return rows + rows[:20] + [(None, T0, 1, "pending"), ("j1", None, 1, "pending")]


def test_literal_life(spark):
    s = 1_000_000
    rows = [("a", T0, 0, "pending"), ("a", T0 + s, 1, "done"), ("a", T0 + 2 * s, 2, "running"), ("a", T0 + 12 * s, 3, "running"),
            ("a", T0 + 23 * s, 4, "done"), ("a", T0 + 24 * s, 5, "running"), ("a", T0 + 25 * s, 6, "error"), ("a", T0 + 26 * s, 7, "running"),
            ("b", T0, 0, "running"), ("c", T0, 0, "pending"), ("c", T0 + 1, 0, "running")]
    got = found(lifecycle(frame(spark, rows), lease_seconds=10))
    assert got == sorted([
        ("a", T0, 0, None, "pending", "applied"), ("a", T0 + s, 1, "pending", "pending", "refused"),
        ("a", T0 + 2 * s, 2, "pending", "running", "applied"), ("a", T0 + 12 * s, 3, "running", "running", "renewed"),
        ("a", T0 + 22 * s, None, "running", "pending", "lease_end"), ("a", T0 + 23 * s, 4, "pending", "pending", "refused"),
        ("a", T0 + 24 * s, 5, "pending", "running", "applied"), ("a", T0 + 25 * s, 6, "running", "error", "applied"),
        ("a", T0 + 26 * s, 7, "error", "error", "refused"), ("b", T0, 0, None, None, "refused"),
        ("c", T0, 0, None, "pending", "applied"), ("c", T0 + 1, 0, "pending", "running", "applied"),
        ("c", T0 + 1 + 10 * s, None, "running", "pending", "lease_end")], key=repr)


def test_batch_equals_the_fold(spark):
    for seed, lease, cell in ((1, 5, 3600), (2, 30, 20), (3, 1, 1)):
        rows = random_rows(seed)
        df = frame(spark, rows)
        until = int(as_of_all(df).timestamp() * 1000 + 0.5) * MS
        assert found(lifecycle(df, lease_seconds=lease, cell_seconds=cell)) == by_hand(rows, until, lease)


def test_empty(spark):
    assert lifecycle(frame(spark, [])).collect() == []


def test_stream_in_parts_and_restarted_equals_batch(spark):
    state_store(spark)
    base = tempfile.mkdtemp(prefix="pagesift-life-")
    rows = sorted((r for r in random_rows(4) if r[1] is not None), key=lambda r: r[1])
    schema = frame(spark, []).schema
    out = []
    for part in (rows[:150], rows[150:151], rows[151:]):   # each run resumes from the checkpoint
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{base}/in")
        q = (lifecycle_stream(spark.readStream.schema(schema).parquet(f"{base}/in"), delay="1 minute", lease_seconds=5)
             .writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        out.append(spark.read.parquet(f"{base}/out").count())
    last = max(r[1] for r in rows if r[0] is not None and r[3] in ("pending", "running", "done", "error"))
    assert out == sorted(out) and out[0] < out[-1]
    assert found(spark.read.parquet(f"{base}/out")) == by_hand(rows, (last // MS - 60_000) * MS, 5)
