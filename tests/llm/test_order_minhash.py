import random
from collections import Counter, defaultdict

import numpy as np
from pagesift.llm import order_minhash as om
from pagesift.llm import queries
from pagesift.llm.components import components, extend

from .edge import SCHEMA, SF, WORDS, both, collect, edge


def kmers(text):
    w = WORDS.findall(text or "")
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def similar(a, b):
    if not a or not b:
        return False
    # No alignment has more matches than the bags share.
    if 9 * sum((Counter(a) & Counter(b)).values()) < 4 * (len(a) + len(b)):
        return False
    return 9 * lcs(a, b) >= 4 * (len(a) + len(b))


def groups_by_hand(rows):
    """Smallest id of the group of each text, over all pairs."""
    ids = defaultdict(list)
    for i, t in rows:
        if t is not None:
            ids[t].append(i)
    texts, ks = list(ids), [kmers(t) for t in ids]
    root = list(range(len(texts)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    where = defaultdict(set)
    for n, k in enumerate(ks):
        for g in set(k):
            where[g].add(n)
    for pair in {(a, b) for s in where.values() for a in s for b in s if a < b}:
        if find(pair[0]) != find(pair[1]) and similar(ks[pair[0]], ks[pair[1]]):
            root[find(pair[0])] = find(pair[1])
    least = defaultdict(list)
    for n, t in enumerate(texts):
        least[find(n)] += [i for i in ids[t] if i is not None]
    return {t: (min([i for i in ids[t] if i is not None], default=None), min(least[find(n)], default=None)) for n, t in enumerate(texts)}


def check(df, rows):
    want = groups_by_hand(rows)
    out = collect(om.near_duplicates(df))
    got = sorted(str((r["doc_id"], r["copy_id"], r["class_id"])) for r in out)
    assert got == sorted(str((i, *(want[t] if t is not None else (i, i)))) for i, t in rows)
    # One row of each group is kept, and every null text.
    n_groups = len({str((want[t][1], "" if want[t][1] is not None else t)) for _, t in rows if t is not None})
    assert sum(r["is_kept"] for r in out) == n_groups + sum(t is None for _, t in rows)
    assert all(r["doc_id"] == r["class_id"] for r in out if r["is_kept"])


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in collect(queries.documents(spark, SF))]
    check(queries.documents(spark, SF), rows)
    assert len(collect(queries.op6_order_minhash(spark, SF))) == 200


def test_planted_copies_chains_and_blocks(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for size in (4, 6, 12, 40, 120, 300):
        base = rnd.choices(vocabulary, k=size)
        w = list(base)
        for step in range(30):
            rows.append((i := i + 1, " ".join(w)))
            if size >= 40 and step % 2:
                w = list(w) if step % 3 else list(base)   # chains and stars
                for _ in range(max(1, size // 100)):
                    w[rnd.randrange(size)] = rnd.choice(vocabulary)
    block = rnd.choices(vocabulary, k=60)
    rows += [(i := i + 1, " ".join(block + rnd.choices(vocabulary, k=60))) for _ in range(40)]  # share a passage
    rows += [(i := i + 1, " ".join(block[30:] + block[:30]))] + [(i := i + 1, " ".join(block))]  # order matters
    check(spark.createDataFrame([(a, t, "", "", 0) for a, t in rows], SCHEMA), rows)


def test_near_pairs_inside_a_shared_passage(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rnd.choices(vocabulary, k=425)
    rows, i = [], 0
    for n in range(160):
        own = rnd.choices(vocabulary, k=75)
        rows.append((i := i + 1, " ".join(passage + own)))
        if n < 60:   # a near copy of every text, but none of the passage
            rows.append((i := i + 1, " ".join(passage + own[:45] + rnd.choices(vocabulary, k=30))))
    want = groups_by_hand(rows)
    assert sum(a != g for a, g in want.values()) == 60
    check(spark.createDataFrame([(a, t, "", "", 0) for a, t in rows], SCHEMA), rows)


def test_near_pairs_inside_a_passage_of_thousands(spark):
    """Recall of planted pairs among 2,000 documents around one passage, all in
    the same buckets: pairs reach the limit, all others stay below it."""
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    passage = rnd.choices(vocabulary, k=425)
    rows, planted = [], []
    for n in range(1000):
        own = rnd.choices(vocabulary, k=75)
        near = list(own)
        for at in rnd.sample(range(75), rnd.choice((1, 2, 4))):
            near[at] = rnd.choice(vocabulary)
        rows += [(2 * n, " ".join(passage + own)), (2 * n + 1, " ".join(passage + near))]
        planted.append((2 * n, 2 * n + 1))
    a, b, c = (kmers(rows[i][1]) for i in (0, 1, 2))
    assert similar(a, b) and not similar(a, c)
    out = {r["doc_id"]: r["class_id"] for r in collect(om.near_duplicates(
        spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA)))}
    found = sum(out[x] == out[y] for x, y in planted)
    assert found >= 0.97 * len(planted)
    assert len(set(out.values())) >= 1000   # nothing else is linked


def test_edge_rows(spark):
    e = edge(spark, clash=("fp", "id", "keys", "band", "best", "lead", "nth"))
    check(e, [(r["doc_id"], r["text"]) for r in collect(e)])
    assert collect(om.near_duplicates(spark.createDataFrame([], SCHEMA))) == []


def test_one_of_each_keeps_whole_rows(spark):
    df = both(spark)
    kept = collect(om.one_of_each(df))
    ids = Counter(str(r["doc_id"]) for r in collect(om.near_duplicates(df)) if r["is_kept"])
    assert Counter(str(r["doc_id"]) for r in kept) == ids
    whole = Counter(str(sorted(r.items())) for r in collect(df))
    assert all(whole[str(sorted(r.items()))] for r in kept) and list(kept[0]) == df.columns


def test_banded_alignment_equals_the_full_table():
    rnd = random.Random(7)
    for _ in range(300):
        a = [rnd.randrange(rnd.choice((3, 12, 200))) for _ in range(rnd.randrange(1, 60))]
        b = [x for x in a if rnd.random() < 0.95] + [rnd.randrange(200) for _ in range(rnd.randrange(3))] if rnd.random() < 0.8 else [rnd.randrange(12) for _ in range(40)]
        if b:
            assert om.common(a, b, 10**6) == lcs(a, b)
            assert om.aligned(np.array(a), np.array(b)) == (9 * lcs(a, b) >= 4 * (len(a) + len(b)))


def test_sketch_respects_order_and_repeats():
    def keys(*texts):
        x = np.concatenate([np.array(t, np.uint64) for t in texts])
        return om.sketch(x, np.repeat(np.arange(len(texts)), [len(t) for t in texts]), len(texts), 40, 1)
    base = list(range(50))
    same, back, few, twice = keys(base, base[::-1], base[:45], base + base)[0:4]
    assert (same == few).mean() > 0.5 > (same == back).mean() and not (same == twice).all()
    assert (keys([5], [5, 5])[0] != keys([5], [5, 5])[1]).any()


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["root"] for r in collect(components(df))} == want
    assert collect(components(df.filter("false"))) == []
    # Some edges first, the rest later.
    first = components(df.limit(120))
    for part in (df, df.filter("a % 3 = 0"), df.filter("false")):
        grown = collect(extend(first, part))
        known = {r["node"] for r in grown}
        assert len(known) == len(grown)
        if part is df:
            assert {r["node"]: r["root"] for r in grown} == want


def test_links_that_no_chosen_member_sees(spark):
    """Pairs inside one passage whose texts meet neither in a chosen member nor,
    with a single band, in a key: all links are found."""
    rnd = random.Random(23)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = rnd.choices(vocabulary, k=90)
    rows, i = [], 0
    for _ in range(60):
        own = rnd.choices(vocabulary, k=30)
        near = own[:-7] + rnd.choices(vocabulary, k=7)
        rows += [(i := i + 1, " ".join(passage + own)), (i := i + 1, " ".join(passage + near))]
    for n in range(60):   # far from all others, and one edit in the middle
        own = rnd.choices(vocabulary, k=70)
        rows += [(i := i + 1, " ".join(own)), (i := i + 1, " ".join(own[:35] + ["x"] + own[36:]))]
    want = groups_by_hand(rows)
    df = spark.createDataFrame([(a, t, "", "", 0) for a, t in rows], SCHEMA)
    out = {r["doc_id"]: r["class_id"] for r in collect(om.near_duplicates(df, bands=1))}
    assert out == {a: want[t][1] for a, t in rows} and len(set(out.values())) == 120
