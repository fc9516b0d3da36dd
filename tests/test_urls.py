from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagesift.functions import urls as U

JOIN_CASES = [
    ("https://h.example/a/b?page=2", "c.pdf", "https://h.example/a/c.pdf"),
    ("https://h.example/a/b?page=2", "/c", "https://h.example/c"),
    ("https://h.example/a/b?page=2", "?p=3", "https://h.example/a/b?p=3"),
    ("https://h.example/a/b/", "../c", "https://h.example/a/c"),
    ("https://h.example/a", "//cdn.example/x.zip", "https://cdn.example/x.zip"),
    ("https://h.example/a", "http://o.example/z", "http://o.example/z"),
    ("https://h.example/a", "/x/../y", "https://h.example/y"),
    ("https://h.example/a", "tel:1", "tel:1"),
    ("https://h.example/a", "", "https://h.example/a"),
]


def test_url_join(spark):
    df = spark.createDataFrame([(b, h) for b, h, _ in JOIN_CASES], "base string, href string")
    got = [r.u for r in df.select(U.resolve_url("base", "href").alias("u")).collect()]
    assert got == [e for _, _, e in JOIN_CASES]
    assert got == [urljoin(b, h) for b, h, _ in JOIN_CASES]


def test_record_url(spark):
    df = spark.createDataFrame([("c.pdf",), ("http://x/y",), ("",), (None,), ("httpish",)], "u string")
    got = [r.v for r in df.select(U.resolve_record_url("u", F.lit("https://h.example/a/b")).alias("v")).collect()]
    assert got == ["https://h.example/a/c.pdf", "http://x/y", "", None, "httpish"]


@pytest.mark.parametrize("base,expected", [
    ("http://h/a?mypage=7&page=3", "http://h/a?mypage=9&page=9"),
    ("http://h/a", "http://h/a?page=9"),
    ("http://h/a?x=1", "http://h/a?x=1&page=9"),
    ("http://h/a?page=x", "http://h/a?page=x"),
    ("http://h/a#top", "http://h/a?page=9#top"),
])
def test_page_param(spark, base, expected):
    df = spark.createDataFrame([(base,)], "b string")
    assert df.select(U.with_page_param("b", F.lit("page"), F.lit(9)).alias("u")).first().u == expected


def test_file_name_and_mime(spark):
    import mimetypes
    urls = ["http://h/x/a.pdf?x=1", "http://h/x/", "http://h/x/report", "http://h/x/A.DOCX",
            "http://h/x/t.tar"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    rows = df.select(U.file_name("u").alias("f")).select("f", U.mime_type("f").alias("m")).collect()
    names = [r.f for r in rows]
    assert names == ["a.pdf", "document.pdf", "report.pdf", "A.DOCX", "t.tar"]
    for r in rows:
        assert r.m == (mimetypes.guess_type(r.f)[0] or "application/octet-stream")


def test_mime_equals_the_standard_table(spark):
    import mimetypes
    table = mimetypes.MimeTypes(filenames=())
    exts = [*table.types_map[True], *table.suffix_map, *table.encodings_map, ".tar.gz", ".pdf.Z", ".pdf.z", ".PDF.gz", ".pdf.GZ",
            ".TGZ", ".svgz", ".none", ".", "..", "", ".txt.", ".gz.gz", ".csv.bz2.gz"]
    names = [stem + x for x in exts for stem in ("a", "a.b", "", "..", "\u00e9 \U0001F600\n")]
    df = spark.createDataFrame([(n,) for n in [*names, None]], "n string")
    found = {r.n: r.m for r in df.select("n", U.mime_type("n").alias("m")).collect()}
    assert found.pop(None) == U.DEFAULT_MIME
    wrong = [(n, m) for n, m in found.items() if m != (table.guess_type(n)[0] or U.DEFAULT_MIME)]
    assert not wrong
    own = spark.createDataFrame([("A" + x.upper(), t) for x, t in U.OFFICE_TYPES.items()], "n string, t string")
    assert own.where(U.mime_type("n") != F.col("t")).count() == 0


def test_url_join_property_against_urljoin(spark):
    import random
    rnd = random.Random(5)
    bases = ["https://h.example", "https://h.example/", "https://h.example/a", "https://h.example/a/b",
             "https://h.example/a/b/", "http://h.example:8080/a/b?x=1#f", "https://h.example/a/./b",
             "https://h.example/a/b?page=2", "https://h.example/a;p/b", "ftp://f.example/x/y"]
    parts = ["c.pdf", "d/e", "?q=1", "#frag", "/root", "//cdn.example/z", "../up", "./same", "..",
             ".", "http://o.example/p", "tel:123", "mailto:a@b", "x:y", "a b", "", "c?x#y", "%20x",
             "/a/../b", "HTTPS://Up.example/", "z/./w"]
    cases = [(b, h) for b in bases for h in parts] + \
        [(rnd.choice(bases), rnd.choice(parts) + rnd.choice(["", "/k", "?t", "#u"])) for _ in range(200)]
    df = spark.createDataFrame(cases, "base string, href string")
    got = [r.u for r in df.select(U.resolve_url("base", "href").alias("u")).collect()]
    want = [urljoin(b, h) for b, h in cases]
    bad = [(c, g, w) for c, g, w in zip(cases, got, want) if g != w]
    assert not bad, bad[:5]
