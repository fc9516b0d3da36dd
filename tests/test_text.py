import pytest
from pyspark.sql import functions as F

from pagesift.functions import text as X


FP_CASES = [
    ("IIUM/DEV/3/2026", "Supply of Servers", "0f7d82fd1dd38152"),
    (" iium/dev/3/2026 ", "SUPPLY OF SERVERS", "0f7d82fd1dd38152"),
    (None, "Supply of Servers", "6cc14c60b88236c9"),
    ("IIUM/DEV/3/2026", None, "83d448833f03978b"),
    (None, None, "e3b0c44298fc1c14"),
    ("", "", "e3b0c44298fc1c14"),
    ("A", "B C", "0e9f64031fcb2bc7"),
    ("A B", "C", "0e9f64031fcb2bc7"),
    ("R1", "x" * 60 + "tail1", "088ffe1e77da0a22"),
    ("R1", "x" * 60 + "tail2", "088ffe1e77da0a22"),
]


def test_fingerprint_fixtures(spark):
    df = spark.createDataFrame([(r, t) for r, t, _ in FP_CASES], "reference string, title string")
    got = [r.fp for r in df.select(X.fingerprint("reference", "title", X.TITLE_KEY_CHARS, X.KEY_DIGITS).alias("fp")).collect()]
    assert got == [e for _, _, e in FP_CASES]
    # Uncut, titles that differ at their ends have keys of their own.
    full = [r.fp for r in df.select(X.fingerprint("reference", "title").alias("fp")).collect()]
    assert full[-1] != full[-2] and [a[:16] == b for a, b in zip(full, got)] == [True] * 8 + [False] * 2


def test_py_strip_matches_python(spark):
    samples = ["  a  ", "　\xa0x \n", "​x​", "\t\t", "", "\x1cé\x85", "a b"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r.t for r in df.select(X.py_strip("s").alias("t")).collect()]
    assert got == [s.strip() for s in samples]


@pytest.mark.parametrize("n,expected", [(0, 1), (12000, 1), (12001, 2), (22000, 2), (22001, 3),
                                        (22500, 3), (33001, 4)])
def test_chunk_counts(spark, n, expected):
    df = spark.createDataFrame([("x" * n,)], "text string")
    rows = X.chunk(df, "text").orderBy("chunk_no").collect()
    assert len(rows) == expected


def test_chunks_cover_and_overlap(spark):
    import random
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("ab \n") for _ in range(rnd.randint(0, 40000))) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = X.chunk(df, "text").orderBy("id", "chunk_no").collect()
    by = {}
    for r in out:
        by.setdefault(r.id, []).append(r)
    for i, t in enumerate(texts):
        ch = by[i]
        expected = [t] if len(t) <= 12000 else [t[s:s + 12000] for s in range(0, len(t), 11000)]
        assert [c.chunk for c in ch] == expected
        for a, b in zip(ch, ch[1:]):
            assert a.chunk[-1000:] == b.chunk[:1000] or len(b.chunk) < 1000


def test_chunk_rejects_bad_overlap():
    with pytest.raises(ValueError):
        X.chunk_starts(F.lit(10), 100, 100)


def test_contact_and_hint(spark):
    df = spark.createDataFrame([("Ann", None, "1"), ("", "", None), (None, "e@x", "")],
                               "n string, e string, p string")
    got = [r.c for r in df.select(X.contact_string("n", "e", "p").alias("c")).collect()]
    assert got == ["Ann | 1", None, "e@x"]
    h = spark.createDataFrame([("hint",), (None,), ("",)], "h string")
    got = [r.s for r in h.select(X.hint_section("h").alias("s")).collect()]
    assert got == ["\nSITE-SPECIFIC HINT: hint\n", "", ""]


def test_prompt_render(spark):
    df = spark.createDataFrame([("http://s", "TEXT", None)], "site string, text string, hint string")
    got = df.select(X.listing_prompt("site", "text", "hint").alias("p")).first().p
    assert got == X.LISTING_TEMPLATE.format(site="http://s", hint="", text="TEXT")


def test_dates(spark):
    df = spark.createDataFrame([("2026-12-02 10:11:12",)], "s string") \
        .select(F.to_timestamp("s").alias("ts"))
    r = df.select(X.subject_date("ts").alias("a"), X.body_date("ts").alias("b")).first()
    assert (r.a, r.b) == ("2026-12-02", "02 December 2026")
