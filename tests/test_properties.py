"""Seeded property tests: Spark column functions equal their Python
definitions on random text (one DataFrame per property, not one job per
example)."""
import random

from pyspark.sql import functions as F

from pagesift.functions import text as X

ALPHABET = ("abcXYZ019 .,;/-_&<>\"'éüßçÉÜΣσςΑαİıﬁ  　\t\n\r\x0b\x0c\x1c\x85"
            " ​﻿😀中文")


def _rand_text(rnd, n):
    return "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, n)))


def test_strip_and_fingerprint_properties(spark):
    rnd = random.Random(2024)
    rows = [(_rand_text(rnd, 20) if rnd.random() > 0.1 else None,
             _rand_text(rnd, 120) if rnd.random() > 0.1 else None) for _ in range(2000)]
    df = spark.createDataFrame(rows, "r string, t string")
    stripped = df.select("t", X.py_strip("t").alias("s")).collect()
    assert all(o.t is None or o.s == o.t.strip() for o in stripped)
    pad = F.lit("\u3000 \n")
    out = df.select(
        "r", "t", X.fingerprint("r", "t").alias("fp"),
        X.fingerprint(F.concat(pad, "r", pad), F.concat(pad, "t")).alias("padded"),
        X.fingerprint(F.coalesce("r", F.lit("")), F.coalesce("t", F.lit(" "))).alias("blank"),
        X.fingerprint(F.lower("r"), F.lower("t")).alias("lower"),
        X.fingerprint("r", F.concat("t", F.lit("!tail"))).alias("longer"),
        X.fingerprint("r", "t", digits=16).alias("short")).collect()
    for o in out:
        # outer space, case and null or empty do not matter; the end of a title does
        assert o.r is None or o.t is None or o.fp == o.padded
        assert o.fp == o.blank == o.lower and len(o.fp) == 64 and o.short == o.fp[:16]
        assert o.t is None or o.longer != o.fp


def test_chunk_reassembles_text(spark):
    rnd = random.Random(7)
    rows = [(i, _rand_text(rnd, 30000)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {}
    for r in X.chunk(df, "text", size=5000, overlap=700).collect():
        got.setdefault(r.id, []).append((r.chunk_no, r.chunk_start, r.chunk))
    for i, t in rows:
        ch = sorted(got[i])
        rebuilt = ch[0][2] + "".join(c[2][700:] for c in ch[1:]) if len(t) > 5000 else ch[0][2]
        assert rebuilt[:len(t)] == t
        assert all(len(c[2]) <= 5000 for c in ch)
        assert [c[1] for c in ch] == ([0] if len(t) <= 5000 else list(range(0, len(t), 4300)))


def test_email_rule_forms_agree(spark):
    import re
    from pagesift.plans import batch as B
    rnd = random.Random(3)
    alpha = "ab.@-_x1 \n%+"
    texts = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += ["mail ann.b@x.example now", "a" * 20000 + " b@c.de", "x@y", "q.w@e.r.tt"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.e for r in df.select(F.regexp_extract("t", B.EMAIL_RE_JVM, 0).alias("e")).collect()]
    want = [(m.group(0) if (m := re.search(B.EMAIL_RE, t)) else "") for t in texts]
    assert got == want
