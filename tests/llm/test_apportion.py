import math
from collections import defaultdict
from fractions import Fraction

from pagesift.llm import apportion, queries
from pyspark.sql import functions as F

from .edge import SCHEMA, SF, WORDS, collect, edge, edge_rows


def targets_by_hand(sizes):
    """Weights 5, 2, 1 repeat; what is above 3 times a size is shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), Fraction(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] > 3 * sizes[s] * total]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = Fraction(3 * sizes[s])
            free.discard(s)
        left -= sum(target[s] for s in over)
    return target


def verify(rows, out, block=64, n_shards=16):
    sizes, taken, dealt = defaultdict(int), defaultdict(int), defaultdict(lambda: [0] * n_shards)
    for r in rows:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    want = targets_by_hand(sizes)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in out) == sorted(
        (r[0] is None, r[0] or 0, len(WORDS.findall(r[1] or ""))) for r in rows)
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        if not isinstance(r["shards"], str):
            assert sum(x["words"] for x in r["shards"]) == r["taken"] and all(x["words"] > 0 for x in r["shards"])
            for x in r["shards"]:
                dealt[r["source"]][x["shard"]] += x["words"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1.5 * block + 1, s
    return want, dealt


def test_query(spark):
    docs = [tuple(r[c] for c in SCHEMA.names) for r in collect(queries.documents(spark, SF))]
    out = collect(queries.op7_sainte_lague_mix(spark, SF))
    verify(docs, out)
    again = collect(queries.op7_sainte_lague_mix(spark, SF))
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_edge_rows(spark):
    verify(edge_rows(), collect(apportion.mix(edge(spark, clash=("size", "taken", "n", "id", "target", "cell", "rest")))))
    assert collect(apportion.mix(spark.createDataFrame([], SCHEMA))) == []
    blank = [(i, t, "en", s, 0) for i, (t, s) in enumerate([(None, "a"), ("", "b"), (" ", None)])]
    assert all(r["taken"] == 0 and r["target"] == 0 for r in collect(apportion.mix(spark.createDataFrame(blank, SCHEMA))))


def test_capped_and_hot_sources(spark):
    rows = [(i, "w " * (1 + i % 90), "en", "a" if i < 5 else ("m" if i % 3 else f"z{i % 4}"), 1) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = collect(apportion.mix(df))
    verify(rows, out)
    tiny = [r for r in out if r["source"] == "a"]
    assert all(r["taken"] == 3 * r["size"] for r in tiny)


def seats_one_by_one(targets, houses):
    held = dict.fromkeys(targets, 0)
    for _ in range(houses):
        best = min(targets, key=lambda s: (Fraction(2 * held[s] + 1) / targets[s], s))
        held[best] += 1
    return held


def test_quotas_equal_the_highest_quotients_one_by_one(spark):
    targets = {f"s{i:02d}": (37 * i * i + 11 * i + 5) % 900 + 1 for i in range(23)}
    block, shards = 16, 6
    df = spark.createDataFrame([(s, t * 10, float(t)) for s, t in targets.items()], "skey string, source_size long, target double")
    quota = defaultdict(dict)
    for r in collect(apportion.sainte_lague(df, block, shards)):
        quota[r["skey"]][r["shard"]] = r["quota"]
    total = sum(targets.values())
    for j in range(shards):
        houses = math.floor(total * (j + 1) / (block * shards) + 0.5)
        held = seats_one_by_one(targets, houses)
        assert {s: sum(q for k, q in quota[s].items() if k <= j) for s in targets} == held
        assert all(q >= 0 for s in quota for q in quota[s].values())


def test_every_shard_gets_its_quotas(spark):
    """Of each source, in blocks; and so each shard is near the mixture."""
    rows = [(i, "w " * (1 + i * 37 % 190), "en", "a" if i < 40 else ("m" if i % 3 else f"z{i % 4}"), 1) for i in range(900)]
    for block, shards in ((16, 5), (64, 16), (7, 1)):
        out = collect(apportion.mix(spark.createDataFrame(rows, SCHEMA), block=block, n_shards=shards))
        want, dealt = verify(rows, out, block, shards)
        for s, by_shard in dealt.items():
            blocks = {r["blocks"] for r in out if r["source"] == s}
            held = [seats_one_by_one(want, math.floor(sum(want.values()) * (j + 1) / (block * shards) + Fraction(1, 2)))[s] for j in range(shards)]
            assert blocks == {held[-1]}
            quota = [b - a for a, b in zip([0, *held], held)]
            assert by_shard[:-1] == [q * block for q in quota[:-1]]
            assert abs(by_shard[-1] - quota[-1] * block) <= 1.5 * block + 1
    # More shards part the same words more finely.
    assert sorted((r["doc_id"], r["taken"]) for r in collect(apportion.mix(spark.createDataFrame(rows, SCHEMA), n_shards=3))) == sorted(
        (r["doc_id"], r["taken"]) for r in collect(apportion.mix(spark.createDataFrame(rows, SCHEMA), n_shards=9)))


def test_native_plan(spark):
    plan = queries.op7_sainte_lague_mix(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
