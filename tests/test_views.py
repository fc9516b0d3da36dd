"""Kept views equal the views over all events, however they are split."""
import os
import random

import pytest
from pyspark.sql import functions as F

from pagesift.operators import jobs, views
from pagesift.sinks import views as stored
from pagesift.streaming.views import keep_view

SCHEMA = "id string, status string, ts timestamp, seq long, error string"


def events(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        status = r.choice(["pending", "running", "done", "error"])
        job = "hot" if i % 3 == 0 else r.choice([None, "", *map(str, range(30))])
        rows.append((job, status, None if i % 41 == 0 else f"2026-01-{r.randint(1, 9):02d} 00:00:00", i, "e" if status == "error" else None))
    df = spark.createDataFrame(rows, "id string, status string, ts string, seq long, error string")
    return df.withColumn("ts", F.to_timestamp("ts"))


def rows(df):
    return sorted(map(str, df.collect()))


def states(view, spark, path):
    return rows(views.job_states(stored.read(view, spark, path)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_split_with_replays_and_bases(spark, tmp_path, seed):
    ev, view, path = events(spark, seed=seed), views.job_view(), str(tmp_path / "v")
    r = random.Random(seed)
    parts = r.randint(2, 6)
    at = F.pmod(F.xxhash64("seq", F.lit(seed)), F.lit(parts))
    done = ev.limit(0)
    for n in range(parts):
        batch = ev.where(at == n)
        stored.add_batch(view, batch, path, 3 * n)   # gaps between numbers
        if r.random() < 0.5:
            stored.add_batch(view, batch, path, 3 * n)
        done = done.unionByName(batch)
        if r.random() < 0.6:
            assert stored.compact(view, spark, path) > 0 and stored.compact(view, spark, path) == 0
            stored.add_batch(view, batch, path, 3 * n)  # below the base: not read again
        assert states(view, spark, path) == rows(jobs.current_state(done))


def test_a_write_that_did_not_commit_does_not_count(spark, tmp_path):
    ev, view, path = events(spark), views.job_view(), str(tmp_path / "v")
    assert stored.read(view, spark, path) is None and stored.compact(view, spark, path) == 0
    stored.add_batch(view, ev.where("seq < 200"), path, 0)
    before = states(view, spark, path)
    for folder, name in (("delta", "batch=1"), ("base", "upto=0")):
        ev.limit(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(os.path.join(path, folder, name))
        assert states(view, spark, path) == before
    stored.add_batch(view, ev.where("seq >= 200"), path, 1)
    assert states(view, spark, path) == rows(jobs.current_state(ev))


def test_empty_batches_and_other_columns(spark, tmp_path):
    ev, view, path = events(spark), views.job_view(), str(tmp_path / "v")
    stored.add_batch(view, ev.limit(0), path, 0)
    assert states(view, spark, path) == []
    stored.add_batch(view, ev.withColumn("last", F.lit(1)).withColumn("batch", F.lit(2)), path, 1)
    stored.compact(view, spark, path)
    assert states(view, spark, path) == rows(jobs.current_state(ev))


def test_a_batch_is_one_row_per_key_and_a_base_alone_is_not_merged(spark, tmp_path):
    ev, view, path = events(spark), views.job_view(), str(tmp_path / "v")
    stored.add_batch(view, ev, path, 0)
    stored.compact(view, spark, path)
    kept = stored.read(view, spark, path)
    assert kept.count() == ev.select("id").distinct().count()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_stream_with_a_restart(spark, tmp_path):
    ev, view, path = events(spark), views.job_view(), str(tmp_path / "v")
    for n in range(5):
        ev.where(F.pmod("seq", F.lit(5)) == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n in (1, 2, 4):   # the stream is started three times
            src = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            keep_view(src, view, path, str(tmp_path / "ckpt"), compact_every=2).awaitTermination()
    assert states(view, spark, path) == rows(jobs.current_state(ev))
    assert os.path.isdir(os.path.join(path, "base", "upto=3"))
