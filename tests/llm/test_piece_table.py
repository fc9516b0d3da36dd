import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pagesift.llm import piece_table as pt
from pagesift.llm import queries

from .edge import SCHEMA, SF, both, collect, edge

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(units[a:b]) for a, b in ((0, p), (p, q), (q, n)))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, form, len(pre), len(mid), sha(out), sha(text)


def test_equals_brute_force(spark):
    df = both(spark)
    out = pt.restore(pt.transform(df, with_output=True))
    found = sorted((str(tuple(r)) for r in out.collect()))
    assert found == sorted(str(brute(r["doc_id"], r["text"])) for r in collect(df))
    rows = collect(queries.op11_piece_table_fim(spark, SF))
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"} and len(rows) == 200


def test_edge_rows(spark):
    df = edge(spark, clash=("form", "n", "output", "pieces", "restored"))
    out = collect(pt.restore(pt.transform(df, with_output=True, with_pieces=True), with_text=True))
    assert sorted(r["restored"] for r in out) == sorted(r["text"] or "" for r in collect(edge(spark)))
    assert all(len(r["pieces"]) == (1 if r["form"] == "plain" else 6) for r in out)
    empty = spark.createDataFrame([], SCHEMA)
    assert collect(pt.restore(pt.transform(empty, with_output=True))) == []


def test_texts_with_sentinels_stay_plain(spark):
    texts = ["a <P> b c", "x<S>", "<M>", "<P", "<<P>>", "< P >"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 20)], "doc_id long, text string")
    forms = {r["doc_id"]: r["form"] for r in collect(pt.transform(df, share=100))}
    assert all((forms[i] == "plain") == any(s in t for s in ("<P>", "<S>", "<M>")) for i, t in enumerate(texts * 20))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<>PSM é世\n ", max_size=40), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.integers(0, 99))
def test_round_trip_of_pieces(text, h1, h2, h4):
    raw = text.encode()
    row = pt.arrange(np.frombuffer(raw, np.uint8), memoryview(raw), (h1, h2, 0, h4), 100, 50)
    assert row["n"] == len(UNIT.findall(text))
    buffers = (memoryview(raw), memoryview(b"".join(pt.SENTINELS)))
    out = b"".join(pt.stream(row["pieces"], buffers))
    if row["form"] == "plain":
        assert out == raw
        return
    order = pt.ARRANGEMENTS[row["form"]]
    # Descriptors of the transformation and those found in its output name the same bytes.
    found = pt.split_output(out, row["form"])
    assert [out[p.start:p.start + p.length] for p in found] == [bytes(x) for x in pt.stream(row["pieces"], buffers)]
    back = pt.permute(row["pieces"], pt.inverse(order))[:3]
    assert b"".join(pt.stream(back, buffers)) == raw
    assert b"".join(pt.stream(pt.permute(found, pt.inverse(order))[:3], (out,))) == raw


def test_cut_and_long_texts():
    whole = [pt.Piece(0, 0, 10)]
    assert pt.cut(pt.cut(whole, 10), 0) == [pt.Piece(0, 0, 0), pt.Piece(0, 0, 10), pt.Piece(0, 10, 0)]
    mask = np.zeros(300_000, bool)
    mask[::3] = True
    assert [pt.nth_true(mask, k) for k in (0, 21_845, 99_999, 100_000)] == [0, 65_535, 299_997, 300_000]
