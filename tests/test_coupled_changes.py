"""Coupled stop against a fold over the sites, change rows, bucket upserts."""
import os
import random

import pytest
from pagesift.operators import changes as C
from pagesift.operators import frontier as R
from pagesift.sinks import store
from pyspark.sql import functions as F

REC = "site_id int, page_num int, pos int, fingerprint string"


def fold(rows, history, pages=()):
    """The run, page after page."""
    seen, kept, visited = set(history), [], set()
    every = {(s, p) for s, p, _, _ in rows} | set(pages)
    stopped = set()
    for s, p in sorted(every):
        if s in stopped:
            continue
        visited.add((s, p))
        new = []
        for _, _, pos, k in sorted(r for r in rows if r[:2] == (s, p)):
            if k not in seen:
                seen.add(k)
                new.append((s, k, p, pos))
        if not new and p > 1:
            stopped.add(s)
        kept += new
    return sorted(kept), visited


def check(spark, rows, history, pages=()):
    rec = spark.createDataFrame(rows, REC)
    hist = spark.createDataFrame([(h,) for h in history], "fingerprint string")
    more = spark.createDataFrame(list(pages), "site_id int, page_num int") if pages else None
    kept, stats, rounds = R.coupled_stop(rec, hist, more)
    want, visited = fold(rows, history, pages)
    assert sorted((r.site_id, r.fingerprint, r.page_num, r.pos) for r in kept.collect()) == want
    assert {(r.site_id, r.page_num) for r in stats.collect() if r.scraped} == visited
    return rounds


def test_a_stopped_page_suppresses_nothing(spark):
    # Site 1 stops on page 2, so its page 3 does not take x from site 2; x keeps
    # site 2 going to page 3, whose y ends site 3.
    rows = [(1, 1, 0, "a"), (1, 2, 0, "a"), (1, 3, 0, "x"), (2, 1, 0, "b"), (2, 2, 0, "x"), (2, 3, 0, "y"),
            (3, 1, 0, "c"), (3, 2, 0, "y"), (3, 3, 0, "z"), (4, 1, 0, "d"), (4, 2, 0, "z")]
    assert check(spark, rows, []) >= 3
    # A suppressed record causes a stop.
    assert check(spark, [(1, 1, 0, "a"), (1, 2, 0, "k"), (2, 1, 0, "b"), (2, 2, 0, "k"), (2, 3, 0, "m"), (3, 1, 0, "m")], []) >= 2


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_fold(spark, seed):
    rnd = random.Random(seed)
    keys = [f"k{i}" for i in range(rnd.choice((12, 40, 80)))]
    rows = [(s, p, i, rnd.choice(keys)) for s in range(1, 13) for p in range(1, 7) for i in range(rnd.randrange(4))]
    check(spark, rows, rnd.sample(keys, 4), [(s, p) for s in range(1, 14) for p in range(1, 7)])


def test_long_chain_and_empty(spark):
    # Each site's second page is freed or taken by the site before.
    rows = [(1, 1, 0, "s"), (1, 2, 0, "s"), (1, 3, 0, "c1")]
    for s in range(2, 9):
        rows += [(s, 1, 0, f"o{s}"), (s, 2, 0, f"c{s - 1}"), (s, 3, 0, f"c{s}")]
    rounds = check(spark, rows, [])
    assert 3 <= rounds <= 9
    kept, stats, rounds = R.coupled_stop(spark.createDataFrame([], REC), spark.createDataFrame([], "fingerprint string"))
    assert kept.collect() == stats.collect() == [] and rounds == 1
    assert check(spark, [(1, 1, 0, "a"), (1, 2, 0, "b")], ["a", "b"]) >= 1


# --------------------------------------------------------------- changes

TAB = "k string, v int, w string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_changes_lead_from_old_to_new(spark):
    rnd = random.Random(4)
    for _ in range(3):
        old = {rnd.choice([None, *"abcdefgh"]): (rnd.choice([None, 1, 2]), rnd.choice([None, "x"])) for _ in range(8)}
        new = {k: v if rnd.random() < 0.5 else (rnd.choice([None, 1, 2]), "x") for k, v in old.items() if rnd.random() < 0.7}
        new |= {k: (3, None) for k in rnd.sample("ijkl", 2)}
        a = spark.createDataFrame([(k, *v) for k, v in old.items()], TAB)
        b = spark.createDataFrame([(k, *v) for k, v in new.items()], TAB)
        ch = C.snapshot_changes(a, b, "k", 7)
        want = sorted(((7, k, "insert" if k not in old else "delete" if k not in new else "update", old.get(k), new.get(k))
                       for k in old.keys() | new.keys() if old.get(k) != new.get(k)), key=str)
        got = sorted(((r.version, r.k, r.op, r.before and tuple(r.before), r.after and tuple(r.after)) for r in ch.collect()), key=str)
        assert got == want
        after = C.apply_changes(a, ch, "k")
        assert rows(after) == rows(b) and rows(C.apply_changes(after, ch, "k")) == rows(b)
    assert C.snapshot_changes(b, b, "k", 8).count() == 0


def test_deletes_cascade(spark):
    old = spark.createDataFrame([("s1", 1, "x"), ("s2", 2, "y"), ("s3", 3, "z")], TAB)
    ch = C.snapshot_changes(old, old.where("k = 's1'"), "k", 5)
    kids = spark.createDataFrame([(1, "s1", "p"), (2, "s2", "q"), (3, "s3", None), (4, None, "r")], "id int, site string, t string")
    gone = C.cascade(ch, "k", kids, "id", "site")
    assert sorted((r.version, r.id, r.op, tuple(r.before), r.after) for r in gone.collect()) == [
        (5, 2, "delete", ("s2", "q"), None), (5, 3, "delete", ("s3", None), None)]
    assert rows(C.apply_changes(kids, gone, "id")) == [(1, "s1", "p"), (4, None, "r")]
    blank = C.cascade(ch, "k", kids, "id", "site", set_null=True)
    assert rows(C.apply_changes(kids, blank, "id")) == [(1, "s1", "p"), (2, None, "q"), (3, None, None), (4, None, "r")]


# --------------------------------------------------------------- buckets

def files(path):
    return {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, ts int, v string"
    first = spark.createDataFrame([(f"k{i}", 1, "a") for i in range(200)] + [(None, 1, "n")], schema)
    assert store.upsert_buckets(first, path, "k", ["ts"], buckets=16) == 201
    before = files(path)
    update = spark.createDataFrame([("k3", 2, "b"), ("k3", 3, "c"), ("new", 1, "d"), ("k9", 0, "late")], schema)
    assert store.upsert_buckets(update, path, "k", ["ts"], buckets=16) == 2
    after = files(path)
    changed = {d for d, _ in before.keys() ^ after.keys()}
    assert 1 <= len(changed) <= 2 and all(after[f] == t for f, t in before.items() if f[0] not in changed)
    got = {r.k: r.v for r in spark.read.parquet(path).collect()}
    assert len(got) == 202 and (got["k3"], got["new"], got["k9"], got[None], got["k5"]) == ("c", "d", "a", "n", "a")
    # A replay, and nothing, write no file.
    assert store.upsert_buckets(update, path, "k", ["ts"], buckets=16) == 0
    assert store.upsert_buckets(update.where("false"), path, "k", ["ts"], buckets=16) == 0
    assert files(path) == after


def test_interrupted_upsert_leaves_the_old_version(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, ts int, v string"
    store.upsert_buckets(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema), path, "k", ["ts"], buckets=4)
    before = files(path)
    broken = spark.createDataFrame([("a", 2, "z")], schema).withColumn("v", F.expr("raise_error('lost')").cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.upsert_buckets(broken, path, "k", ["ts"], buckets=4)
    assert files(path) == before and rows(spark.read.parquet(path).select("k", "v")) == [("a", "x"), ("b", "y")]
