import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pagesift.llm import queries, suffix_tree
from pyspark.sql import functions as F

from .edge import SCHEMA, SF, WORDS, both, collect, edge

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def tokens(text):
    return [*WORDS.findall((text or "").translate(LOW)), "\n"]


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def base_by_hand(rows):
    c = Counter(x for i, t in rows if not is_held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = tokens(t)
        out.append((str(i), is_held(i), len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return sorted(out)


def check_base(rows, out):
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out)
    for g, w in zip(got, base_by_hand(rows), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)


def test_base_and_gain(spark):
    rows = [(r["doc_id"], r["text"]) for r in collect(queries.documents(spark, SF))]
    out = collect(queries.op2_suffix_tree_scores(spark, SF))
    check_base(rows, out)
    held = [r for r in out if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in out)


def test_rare_words_by_join_and_edge_rows(spark, monkeypatch):
    df = both(spark)
    rows = [(r["doc_id"], r["text"]) for r in collect(df)]
    held = suffix_tree.held_out(F.col("doc_id"))
    def run():
        return collect(suffix_tree.score(df, *suffix_tree.train(df, train_on=~held), held=held))
    plain = run()
    monkeypatch.setattr(suffix_tree, "ENTRY_SCALE", 10)   # most words go through the join
    monkeypatch.setattr(suffix_tree, "CONTEXT_SCALE", 5)
    joined = run()
    check_base(rows, plain)
    check_base(rows, joined)
    assert all(r["score"] <= 0 for r in joined)


def test_clashing_and_empty(spark):
    e = edge(spark, clash=("id", "h", "n", "score", "rid"))
    assert len(collect(suffix_tree.score(e, *suffix_tree.train(e)))) == 15
    none = spark.createDataFrame([], SCHEMA)
    tree, counts = suffix_tree.train(none)
    assert collect(suffix_tree.score(none, tree, counts)) == []
    untrained = collect(suffix_tree.score(edge(spark), tree, counts))
    assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in untrained)


@pytest.fixture(scope="module")
def small_tree(spark):
    rnd = np.random.default_rng(4)
    def text():
        w, out = "a", []
        for _ in range(60):  # x after "b a" or "c a" depends on two words
            w = {"a": "x" if out[-2:-1] == ["b"] else "y", "x": "b", "y": "c"}.get(w) or rnd.choice(["a", "a", "b", "c"])
            out.append(str(w))
        return " ".join(out)
    df = spark.createDataFrame([(i, text(), "", "", 0) for i in range(80)], SCHEMA)
    return df, *suffix_tree.train(df)


def test_every_distribution_sums_to_one(small_tree):
    _, tree, _ = small_tree
    assert abs(tree.root.sum() - 1) < 1e-9
    assert any(level.state.any() for level in tree.levels)
    everything = np.arange(tree.symbols)
    for d, level in enumerate(tree.levels):
        for s in np.flatnonzero(level.state):
            shorter = [np.full(tree.symbols, suffix_tree.place_of(level.spelled[s:s + 1, -k:], tree.levels)[0]) for k in range(1, d + 2)]
            assert abs(suffix_tree.probabilities(everything, shorter, tree).sum() - 1) < 1e-9


def scored_by_hand(text, tree):
    """log10 probability of a text of head words, token by token through dicts."""
    symbol = {h: s for h, s in zip(tree.head.tolist(), tree.head_symbol.tolist())}
    w = suffix_tree.words(pa.array([text]), lower=True)
    seen = [symbol[h] for h in suffix_tree.hashes(w, suffix_tree.Roller())[0].tolist()] + [0]
    states = [{tuple(s): k for k, s in enumerate(level.spelled.tolist()) if level.state[k]} for level in tree.levels]
    entries = [dict(zip(level.keys.tolist(), level.counts.tolist())) for level in tree.levels]
    total = 0.0
    for i, x in enumerate(seen):
        p = tree.root[x]
        for d, level in enumerate(tree.levels, 1):
            k = states[d - 1].get(tuple(seen[max(0, i - d):i])) if i >= d else None
            if k is not None:
                p = (entries[d - 1].get(k * tree.symbols + x, 0) + level.left[k] * p) / (level.total[k] + level.kinds[k])
        total += math.log10(p)
    return total


def test_scores_equal_a_walk_by_hand(small_tree):
    df, tree, counts = small_tree
    assert (tree.head_symbol >= 0).all()
    texts = {r["doc_id"]: r["text"] for r in collect(df)}
    for r in collect(suffix_tree.score(df, tree, counts)):
        assert math.isclose(r["score"], scored_by_hand(texts[r["doc_id"]], tree), rel_tol=1e-9)


def test_the_tree_grows_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "CONTEXT_SCALE", 4)
    monkeypatch.setattr(suffix_tree, "ENTRY_SCALE", 20)
    rnd = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in np.minimum(rnd.zipf(1.3, 100), 5000)) for _ in range(1600)]
    def held(n):
        tree, _ = suffix_tree.train(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts[:n])], SCHEMA))
        for level in tree.levels:   # within the bound of what is broadcast
            assert len(level.contexts) <= max(tree.symbols, 4 * tree.tokens ** (1 / 3)) and len(level.counts) <= 20 * tree.tokens ** (1 / 3)
        return tree.symbols - suffix_tree.CLASSES, len(tree.head), len(tree.levels[0].counts)
    small, large = held(200), held(1600)
    assert all(b > 1.5 * a for a, b in zip(small, large)), (small, large)


def test_states_are_closed_and_longest_is_used(small_tree):
    df, tree, counts = small_tree
    for k in range(1, len(tree.levels)):
        kept = tree.levels[k].spelled[tree.levels[k].state]
        if len(kept):
            assert tree.levels[k - 1].state[suffix_tree.place_of(kept[:, 1:], tree.levels)].all()
    assert len(tree.levels) > 1 and tree.levels[1].state.any()
    cut = tree._replace(levels=tree.levels[:1])
    deep, flat = (sum(r["score"] for r in collect(suffix_tree.score(df, t, counts))) for t in (tree, cut))
    assert deep > flat


def test_counts_of_contexts_equal_brute_force(small_tree):
    df, tree, _ = small_tree
    texts = [r["text"].split() for r in collect(df)]
    want = Counter(x for w in texts for x in zip(w, [*w[1:], "\n"]))
    level = tree.levels[0]
    assert level.total.sum() == sum(want.values())
    assert sorted(level.counts.astype(int).tolist()) == sorted(n for n in want.values() if n >= 2)


def scores_by_hand(train, texts):
    """Scores by a whole tree kept in dicts: every context seen twice is tested,
    with all its next symbols, whatever the size of the corpus."""
    n = Counter(x for t in train for x in tokens(t))
    total, types = sum(n.values()), len(n)
    def cls(word):
        return int(suffix_tree.hashes(suffix_tree.words(pa.array([word]), lower=True), suffix_tree.Roller())[1][0])
    def symbol(word):
        return word if word == "\n" or n[word] >= 2 else cls(word)
    rare = [x for x in n if x != "\n" and n[x] < 2]
    norm = Counter(cls(x) for x in rare)
    norm = {c: 2 * k + 1 for c, k in norm.items()}   # each occurs once
    size = Counter(symbol(x) for t in train for x in tokens(t))
    symbols = 513 + sum(n[x] >= 2 for x in n if x != "\n")
    follow = {}
    for t in train:
        s = [symbol(x) for x in tokens(t)]
        for i, x in enumerate(s):
            for d in range(1, min(3, i) + 1):
                follow.setdefault(tuple(s[i - d:i]), Counter())[x] += 1
    follow = {c: f for c, f in follow.items() if sum(f.values()) >= 2}
    states = set()
    def p(context, x):
        if not context:
            return (size[x] + 1) / (total + symbols)
        shorter = p(context[1:], x)
        if context not in states:
            return shorter
        f = follow[context]
        return (f[x] + len(f) * shorter) / (sum(f.values()) + len(f))
    for d in (1, 2, 3):
        found = set()
        for c, f in follow.items():
            if len(c) == d:
                t = sum(f.values())
                if sum(k * math.log(k / t / p(c[1:], x)) for x, k in f.items()) > 0.5 * len(f) * math.log(t):
                    found.add(c)
        states |= found
    states |= {c[k:] for c in states for k in range(1, len(c))}
    def share(word):
        return 1.0 if word == "\n" or n[word] >= 2 else (n[word] + 1) / norm.get(cls(word), 1)
    out = []
    for t in texts:
        w, got = tokens(t), 0.0
        s = [symbol(x) for x in w]
        for i, x in enumerate(s):
            got += math.log10(p(tuple(s[max(0, i - 3):i]), x)) + math.log10(share(w[i]))
        out.append(got)
    return out, states, follow


@pytest.fixture(scope="module")
def twice(spark):
    """Texts of frequent and rare words, some of them there twice, by id."""
    rnd = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in np.minimum(rnd.zipf(1.4, rnd.integers(0, 60)), 3000)) for _ in range(150)]
    texts += texts[:15] + ["", "lone", "the end of the line of the end of the line"] + [f"the the of the {k % 3} of the of {k}" for k in range(40)]
    return texts


@pytest.mark.parametrize("bucket", [1 << 20, 60, 8])
def test_scores_equal_a_whole_tree_by_hand(spark, monkeypatch, twice, bucket):
    monkeypatch.setattr(suffix_tree, "BUCKET_TOKENS", bucket)
    monkeypatch.setattr(suffix_tree, "SMALL_BUCKET", max(1, bucket // 10))
    monkeypatch.setattr(suffix_tree, "CHUNK_TOKENS", 40 * bucket)
    hots, tested = [], suffix_tree.hot_tested
    monkeypatch.setattr(suffix_tree, "hot_tested", lambda *a: hots.append(tested(*a)) or hots[-1])
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(twice)], SCHEMA).repartition(3)
    held = suffix_tree.held_out(F.col("doc_id"))
    want, states, follow = scores_by_hand([t for i, t in enumerate(twice) if not is_held(i)], twice)
    assert any(len(c) == 3 and sum(follow[c].values()) == 2 for c in states)   # seen twice only
    got = {r["doc_id"]: r["score"] for r in collect(suffix_tree.score(df, *suffix_tree.train(df, train_on=~held), held=held))}
    assert len(got) == len(twice)
    for i, w in enumerate(want):
        assert math.isclose(got[i], w, rel_tol=1e-9), (i, got[i], w)
    if bucket < 60:   # hot contexts of every length, and some that are no states by themselves
        assert len(hots) == 3 and all(h.spread.max() > 1 for h, _ in hots) and not all(h.grown.all() for h, _ in hots)
    assert bool(hots) == (bucket < 1 << 20)


def test_other_texts_are_scored_by_the_trained_tree(spark, monkeypatch, twice):
    monkeypatch.setattr(suffix_tree, "BUCKET_TOKENS", 200)
    monkeypatch.setattr(suffix_tree, "SMALL_BUCKET", 20)
    train, other = twice[::2], twice[1::2]
    df, more = (spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(x)], SCHEMA) for x in (train, other))
    got = {r["doc_id"]: r["score"] for r in collect(suffix_tree.score(more, *suffix_tree.train(df)))}
    for i, w in enumerate(scores_by_hand(train, other)[0]):
        assert math.isclose(got[i], w, rel_tol=1e-9)


def test_levels_hold_every_state_of_the_whole_tree(spark, monkeypatch, twice):
    monkeypatch.setattr(suffix_tree, "BUCKET_TOKENS", 8)
    monkeypatch.setattr(suffix_tree, "SMALL_BUCKET", 1)
    monkeypatch.setattr(suffix_tree, "CONTEXT_SCALE", 1e9)   # least: as seldom as they may be
    _, states, follow = scores_by_hand(twice, [])
    tree, _ = suffix_tree.train(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(twice)], SCHEMA))
    names = {}
    for word in {x for t in twice for x in tokens(t)}:
        h, cls = (int(k[0]) for k in suffix_tree.hashes(suffix_tree.words(pa.array([word]), lower=True), suffix_tree.Roller())) if word != "\n" else (0, 0)
        at = suffix_tree.find(tree.head, np.array([h]))[0]
        names[0 if word == "\n" else tree.head_symbol[at] if at >= 0 else 1 + cls] = word if at >= 0 or word == "\n" else cls
    found = {tuple(names[x] for x in c) for level in tree.levels for c in level.spelled[level.state].tolist()}
    assert found == states
    for level in tree.levels:
        for k, n in zip(level.keys.tolist(), level.counts.tolist()):
            assert n == follow[tuple(names[x] for x in level.spelled[k // tree.symbols].tolist())][names[k % tree.symbols]]
