from pyspark.sql import functions as F

from pagesift.operators import extract as E
from pagesift.schemas import DETAIL_SCHEMA


def test_reply_parsing_fixtures(spark):
    replies = ["```json\n[{\"title\":\"a\"}]\n```", "{\"title\":\"x\"}", "Here are [3]: [{\"a\":1}]",
               "[{\"a\":1}] see [2]", "[oops", "[{\"title\":5}]", None, "[1, {\"title\": \"k\"}]"]
    df = spark.createDataFrame(list(enumerate(replies)), "id long, reply string")
    out = {r.id: r for r in E.parse_listing_replies(df).collect()}
    assert len(out[0].records) == 1 and out[0].records[0].title == "a"
    assert out[1].records == [] and out[1].ok
    assert not out[2].ok and out[2].records == []
    assert not out[3].ok
    assert not out[4].ok
    assert out[5].records[0].title == "5"
    assert out[6].records == []
    assert [r.title for r in out[7].records] == ["k"]


def test_object_replies(spark):
    df = spark.createDataFrame([(0, '{"requirements": "iso"}'), (1, "[1]"), (2, "nope")],
                               "id long, reply string")
    out = {r.id: r for r in E.parse_object_replies(df, DETAIL_SCHEMA).collect()}
    assert out[0].record.requirements == "iso"
    assert out[1].record is None and out[2].record is None


def test_rules(spark):
    lines = ["Active Tenders", "Supply of servers IIUM/DEV/3/2026 open RFQ", "Keputusan",
             "Awarded cleaning PTPTN/2026/SH11", "Tender Proposal",
             "Road works KDN/T/001/2026 closed", "Hall repair UTM/BID/2026 tender"]
    df = spark.createDataFrame([(1, "\n".join(lines))], "page_id long, text string")
    out = E.rule_extract(df).orderBy("pos").collect()
    assert [r.reference for r in out] == ["IIUM/DEV/3/2026", "UTM/BID/2026"]
    assert [r.status for r in out] == ["Open", "Unknown"]
    assert [r.tender_type for r in out] == ["RFQ", "Tender"]
    s = spark.createDataFrame([("Open",), ("Weird",), (None,)], "s string")
    assert [r.n for r in s.select(E.normalise_status("s").alias("n")).collect()] == \
        ["Open", "Unknown", "Unknown"]


def test_infer_retries_and_errors(spark):
    calls = {"n": 0}

    def fn(prompts):
        out = []
        for p in prompts:
            if "bad" in p:
                out.append("no json here")
            elif "boom" in p:
                raise RuntimeError("down")
            else:
                out.append('[{"title": "%s"}]' % p)
        return out

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, prompt string")
    out = {r.id: r for r in E.infer(df, fn, keep=["id"], attempts=2, accept=E.strict_json).collect()}
    assert out[1].reply == '[{"title": "good"}]' and out[1].attempts == 1 and out[1].error is None
    assert out[2].reply is None and out[2].attempts == 2 and out[2].error
    df2 = spark.createDataFrame([(3, "boom")], "id long, prompt string")
    r = E.infer(df2, fn, keep=["id"], attempts=2).first()
    assert r.reply is None and "down" in r.error
    del calls


def test_extract_listings_end_to_end(spark):
    def fake_model(prompts):
        out = []
        for p in prompts:
            text = p.split("Page text:\n", 1)[1]
            recs = [{"title": ln, "reference": None, "url": "/d/" + str(i)}
                    for i, ln in enumerate(text.splitlines()) if ln.strip()]
            out.append("```json\n" + __import__("json").dumps(recs + recs) + "\n```")
        return out

    ch = spark.createDataFrame([(1, "https://h.example/l", 0, "A\nB\nA"), (1, "https://h.example/l", 1, "B\nC")],
                               "page_id long, page_url string, chunk_no int, chunk string")
    out = E.extract_listings(ch, fake_model).orderBy("chunk_no", "pos").collect()
    assert [r.title for r in out] == ["A", "B", "C"]
    assert out[0].url == "https://h.example/d/0"


def test_rules_see_the_whole_text_and_long_headers(spark):
    many = "\n".join(f"Item {i} IIUM/DEV/{i:05d}/2026 " + "x" * 20 for i in range(1200))
    head = "Keputusan " + "y" * 100
    tail = "\n".join(f"Old {i} KDN/T/{i}/2025 " + "z" * 200 for i in range(200))
    df = spark.createDataFrame([(1, many), (2, head + "\n" + tail)], "page_id long, text string")
    rows = E.rule_extract(df).collect()
    assert len(rows) == 1200 and len({r.reference for r in rows}) == 1200 and {r.page_id for r in rows} == {1}


def test_failed_chunks_are_rows_and_closed_records_go(spark):
    import json

    def model(prompts):
        return ["sorry" if "BAD" in p else json.dumps(
            [{"title": "a", "status": "Closed"}, {"title": "b", "status": "open?"}, {"title": "c", "status": "Open", "tender_type": "RFQ"}])
            for p in prompts]

    ch = spark.createDataFrame([(1, "https://h/l", 0, "GOOD", "per site"), (1, "https://h/l", 1, "BAD", None)],
                               "page_id long, page_url string, chunk_no int, chunk string, hint string")
    out = E.extract_listings(ch, model, hint=F.col("hint"), keep_failed=True).orderBy(F.col("pos").asc_nulls_last()).collect()
    assert [(r.title, r.status, r.tender_type, r.error) for r in out] == [
        ("b", "Unknown", "Unknown", None), ("c", "Open", "RFQ", None), (None, None, None, "rejected reply")]
    assert out[2].attempts == 2 and out[2].chunk_no == 1


def test_object_prompts_hold_the_whole_text_unless_capped(spark):
    long = "x" * 20_000
    docs = spark.createDataFrame([(1, "https://h/d", long)], "id long, url string, text string")
    for cap, size in ((None, 20_000), (15_000, 15_000)):
        r = E.extract_objects(docs, lambda ps: ['{"requirements": "%d"}' % p.count("x" * 10) for p in ps], ["id"], cap_chars=cap).first()
        assert int(r.requirements) == size // 10
