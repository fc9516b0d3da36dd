import zlib
from collections import Counter, defaultdict

from pagesift.llm import queries, shard

from .edge import SCHEMA, SF, both, collect, edge, edge_rows


def test_law_slots_and_mixture(spark):
    out = collect(queries.op1_stratified_shards(spark, SF))
    docs = {r["doc_id"]: r for r in collect(queries.documents(spark, SF))}
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    by = defaultdict(list)
    for r in out:
        raw = docs[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        by[r["shard"]].append(r)
    assert set(by) == set(range(40))
    assert {len(v) for v in by.values()} <= {len(out) // 40, -(-len(out) // 40)}
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())


def test_each_source_is_spread_evenly(spark):
    rows = [(i, "t", "en", "hot" if i % 3 else f"s{i % 7}", 1) for i in range(3000)]
    out = collect(shard.shard(spark.createDataFrame(rows, SCHEMA), 10, seed=3))
    per = Counter((r["shard"], r["source"]) for r in out)
    total = Counter(r["source"] for r in out)
    for s, n in total.items():
        for k in range(10):
            assert abs(per[k, s] - n / 10) <= 3, (s, k)


def test_partitioning_and_partition_count_do_not_matter(spark):
    df = both(spark)
    a = sorted(map(str, collect(shard.shard(df, 7))))
    assert a == sorted(map(str, collect(shard.shard(df.repartition(13), 7))))
    assert a != sorted(map(str, collect(shard.shard(df, 7, seed=1))))


def test_edge_rows(spark):
    out = collect(shard.shard(edge(spark, clash=("shard", "slot", "size", "id", "rnd", "cell", "f")), 4))
    want = Counter((r[0], 16 + len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode())) for r in edge_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert collect(shard.shard(spark.createDataFrame([], SCHEMA), 4)) == []


def test_no_python_in_the_plan(spark):
    plan = queries.op1_stratified_shards(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
