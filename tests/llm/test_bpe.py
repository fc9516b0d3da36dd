import hashlib

import pytest
from pagesift.llm import bpe, queries

from .edge import SCHEMA, SF, both, collect, edge


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_equals_the_library(spark, library):
    df = both(spark)
    texts = sorted(((r["doc_id"], r["text"]) for r in collect(df)), key=str)
    out = sorted(collect(bpe.encode(df, queries.tokenizer_path())), key=lambda r: str(r["doc_id"]))
    want = sorted(((str(i), *expected(library, t)) for i, t in texts))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == want
    assert len(collect(queries.op3_forced_boundary_bpe(spark, SF))) == 200


def test_every_character_and_odd_neighbours(library):
    enc = bpe.ForcedBoundaryBPE(queries.tokenizer_path())
    texts = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)} '{chr(c)}s\n" for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000)
             for lo in [*range(0, 0x3000, 64), *range(0xF900, 0x10000, 64), *range(0x1F300, 0x1FB00, 64)]]
    texts += ["<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "a" * 5000, "é" * 777, "  \n \t  ", "I'LL can't'd 's's"]
    for text, joined in zip(texts, enc.batch(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert joined == ",".join(map(str, ids)), text[:20]
        assert bpe.readable(enc.decode(bpe.numbers(joined))) == library.decode(ids, skip_special_tokens=False)


def test_cuts_are_forced_and_caches_stay_bounded(library, monkeypatch):
    enc = bpe.ForcedBoundaryBPE(queries.tokenizer_path())
    raw = ["qzxj世wvk".encode(), b"the", b"q"]
    parts, first = enc.cut(raw)
    assert [b"".join(parts[i:j]) for i, j in zip(first, first[1:])] == raw and first[1] > 1
    tokens = set(enc.bytes_of.values())
    own = parts[:first[1]]
    assert all(a[-1:] + b[:1] not in t for a, b in zip(own, own[1:]) for t in tokens)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    texts = [" ".join(f"w{i * j}q" for j in range(30)) for i in range(40)]
    for text, joined in zip(texts, (x for t in texts for x in enc.batch([t]))):
        assert joined == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))
        assert len(enc.words) + len(enc.older) <= 250


def test_edge_rows(spark):
    path = queries.tokenizer_path()
    out = collect(bpe.encode(edge(spark, clash=("ids", "n_tokens", "decoded")), path, with_ids=True, with_text=True))
    texts = sorted(r["text"] or "" for r in collect(edge(spark)))
    assert sorted(r["decoded"] for r in out) == texts
    assert all(len(r["ids"]) == r["n_tokens"] for r in out)
    assert collect(bpe.encode(spark.createDataFrame([], SCHEMA), path)) == []


def test_decoding_any_ids_equals_the_library(spark, library):
    """Ids in any order spell partial characters; unknown ids spell nothing."""
    size = library.get_vocab_size()
    arrays = [[(i * i * 31 + 7 * j) % size for j in range(i % 40)] for i in range(300)]
    arrays += [[size + 5, 1, 2 ** 31 - 1, 2], [], [0] * 3000, list(range(size))]
    rows = [(i, a, "x") for i, a in enumerate(arrays)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, decoded string")
    out = {r["doc_id"]: r["decoded"] for r in collect(bpe.decode(df, queries.tokenizer_path()))}
    assert out == {i: library.decode(a, skip_special_tokens=False) for i, a, _ in rows}


def test_decode_edge_rows(spark):
    path = queries.tokenizer_path()
    ids = bpe.encode(edge(spark), path, with_ids=True, passed=("text",))
    out = collect(bpe.decode(ids, path, passed=("text",)))
    assert len(out) == edge(spark).count() and all(r["decoded"] == (r["text"] or "") for r in out)
    odd = spark.createDataFrame([(None, None), (1, [None, 5, -3, None]), (1, [None])], "doc_id long, ids array<int>")
    assert sorted(r["decoded"] for r in collect(bpe.decode(odd, path))) == ["", "", bpe.ForcedBoundaryBPE(path).bytes_of[5].decode()]
    assert collect(bpe.decode(odd.limit(0), path)) == []
