import re
from collections import Counter

from pagesift.llm import queries, stripes
from pyspark.sql import functions as F

from .edge import SCHEMA, SF, both, collect, edge

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_count=10, max_words=3, top=2000, subsumed=50):
    f, n = Counter(), Counter()
    for r in rows:
        lang = r["lang"] if r["lang"] is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r["text"] or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, max_words + 1):
                for i in range(len(ws) - m + 1):
                    f[lang, tuple(ws[i:i + m])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    inside = Counter()
    for (lang, ws), a in candidates.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                inside[lang, ws[i:i + m]] = max(inside[lang, ws[i:i + m]], a)
    found = {}
    for (lang, ws), a in candidates.items():
        if 100 * inside[lang, ws] >= subsumed * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, r, n[lang], -s)
                  for lang, rows in found.items() for i, (s, a, p, left, r) in enumerate(sorted(rows)[:top]))


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collect(df))


def test_equals_brute_force(spark):
    df = both(spark)
    rows = collect(df)
    assert got(stripes.mine(df)) == brute(rows)
    assert got(stripes.mine(df, min_count=3, max_words=5, top=300, subsumed=80)) == brute(rows, 3, 5, 300, 80)
    assert got(stripes.mine(df, max_words=2)) == brute(rows, max_words=2)
    assert len(collect(queries.op13_stripe_collocations(spark, SF))) > 100


def test_tasks_that_send_often_and_hot_prefixes(spark, monkeypatch):
    df = both(spark)
    monkeypatch.setattr(stripes, "TOKENS", 500)
    monkeypatch.setattr(stripes, "HEAD", 40)
    assert got(stripes.mine(df)) == brute(collect(df))


def test_a_hot_prefix_is_dealt_out(spark):
    text = ". ".join(f"of w{i} x" for i in range(500))
    docs = spark.createDataFrame([("en", text)], "lang string, text string")
    head = {"en": frozenset([b"of"])}
    rows = collect(stripes.stripes(docs, 2, head))
    parts = Counter(r["prefix"] for r in rows)
    assert 50 < parts["of"] <= 2 * stripes.FRAGMENTS and parts["w7"] == 1 and "" not in parts
    merged = collect(stripes.merge(stripes.stripes(docs, 2, head)).filter("prefix = 'of'"))
    assert sorted(r["word"] for r in merged) == sorted(e for i in range(500) for e in (f"w{i}", f"w{i} x")) and all(r["f"] == 1 for r in merged)
    words = collect(stripes.stripes(docs, 0, {}))
    assert len(words) == 1 + stripes.FRAGMENTS and [r["counts"] for r in words if r["fragment"] == stripes.TOTAL] == [[1500]]


def test_edge_rows_and_breaks(spark):
    df = edge(spark, clash=("n", "phrase", "m", "words", "first"))
    assert got(stripes.mine(df, min_count=2)) == brute(collect(edge(spark)), 2)
    assert collect(stripes.mine(spark.createDataFrame([], SCHEMA))) == []
    assert collect(stripes.mine(edge(spark).withColumn("text", F.lit(None).cast("string")))) == []
    # Products beyond 64 bits.
    big = spark.createDataFrame([("en", "a b")], "lang string, text string")
    totals, phrases = stripes.count_phrases(big, min_count=1)
    assert collect(totals) == [{"lang": "en", "n": 2}]
    assert sorted((r["phrase"], r["m"], r["f"]) for r in collect(phrases)) == [("a", 1, 1), ("a b", 2, 1), ("b", 1, 1)]
