import base64
import math
import random
from collections import Counter

from pagesift.llm import compression, queries

from .edge import SCHEMA, SF, WORDS, both, collect, edge

SYMBOLS = set("#*$%&|<>")


def base_by_hand(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dups += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in SYMBOLS for c in text), dups, len(hit), failed


def key(i, v):
    return (str(i), *v)


def test_base_counts_equal_brute_force(spark):
    df = both(spark)
    want = sorted(key(r["doc_id"], base_by_hand(r["text"])) for r in collect(df))
    out = collect(compression.rules(df))
    got = sorted(key(r["doc_id"], [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]) for r in out)
    assert got == want
    assert not any(r["kept"] and r["base_failed"] for r in out)
    assert len(collect(queries.op4_compression_bands(spark, SF))) == 200


def test_lines_and_windows(spark):
    texts = ["a\nb\na\n\n\n \na", "\n\n", "x y\nx y \nx y", "a\n" * 50, "é 世\né 世", " ".join(map(str, range(100))) * 2, "q\r\nq\r\nq"]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA)
    for r in collect(compression.rules(df)):
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")] == list(base_by_hand(texts[r["doc_id"]]))


def test_bands(spark):
    rnd = random.Random(5)
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "o", "an", "er", "on")]
    def prose(n):
        return " ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(n))
    good = [prose(n) for n in (25, 60, 200, 800, 5000)]
    filler = lambda n: " ".join(rnd.choice(["spam", "buy", "now"]) for _ in range(n))
    coded = [" ".join(base64.b64encode(rnd.randbytes(60)).decode() for _ in range(n)) for n in (30, 200, 2000)]
    bad = [filler(400), filler(4000), *coded, prose(900) + " " + " ".join(coded[1:])]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(good + bad)], SCHEMA)
    kept = {r["doc_id"]: r["kept"] for r in collect(compression.rules(df))}
    assert [kept[i] for i in range(len(kept))] == [True] * len(good) + [False] * len(bad)


def test_prose_mixed_with_encoded_or_repeated_text(spark):
    rnd = random.Random(8)
    prose = max((r["text"] for r in collect(queries.documents(spark, SF)) if r["text"] and compression.verdict(r["text"].encode())[3]), key=len)
    words = prose.split()
    def text(n):
        return " ".join(rnd.choices(words, k=n // 4))[:n]
    def b64(n):
        return base64.b64encode(rnd.randbytes(n)).decode()[:n]
    def hexed(n):
        return rnd.randbytes(n).hex()[:n]
    good = [text(n) for n in (4096, 4097, 8000, 41_000, 200_000)] + [text(100_000) + b64(4096) + text(100_000)]
    bad = [text(24_600) + b64(16_400), text(20_500) + b64(20_500), text(110_000) + b64(90_000), text(4096) + b64(4096), text(3200) + hexed(4900),
           text(120_000) + hexed(80_000), text(20_000) + "spam buy now " * 1600, text(380_000) + b64(20_480)]
    assert [compression.verdict(t.encode())[3] for t in good + bad] == [True] * len(good) + [False] * len(bad)


def test_short_texts_are_judged_like_long_ones(spark):
    rnd = random.Random(9)
    prose = [r["text"] for r in collect(queries.documents(spark, SF)) if r["text"] and len(r["text"]) > 3000 and compression.verdict(r["text"].encode())[3]]
    words = " ".join(prose).split()
    def text(n):
        return " ".join(rnd.choices(words, k=n // 4))[:n]
    coded = {"base64": lambda n: base64.b64encode(rnd.randbytes(n)).decode()[:n], "hex": lambda n: rnd.randbytes(n).hex()[:n],
             "digits": lambda n: "".join(rnd.choices("0123456789", k=n)), "spaced hex": lambda n: rnd.randbytes(n).hex(" ", 8)[:n]}
    for size in (600, 1200, 2500, 3800, 4096, 4097, 9000, 60_000):
        assert compression.verdict(text(size).encode())[3], size
        for name, junk in coded.items():
            for share in (1.0, 0.75, 0.5):
                mixed = text(int(size * (1 - share))) + " " + junk(int(size * share))
                assert not compression.verdict(mixed.encode())[3], (size, name, share)
    # One digest in a text is no reason to drop it.
    assert all(compression.verdict((text(1500) + " " + coded["hex"](64) + " " + text(1500)).encode())[3] for _ in range(20))


def test_small_chunks_by_hand():
    import zstandard

    z = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    rnd = random.Random(2)
    for n in (0, 255, 256, 300, 512, 513, 768, 769, 5000, 1_200_000):
        raw = bytes(rnd.choices(b"eeeeaaatttoin shrdlu", k=n // 2)) + rnd.randbytes(n - n // 2).hex()[:n - n // 2].encode()
        size = compression.SMALL
        spots = [] if n < size else [*range(0, n - size, compression.SMALL_STEP), n - size]
        assert compression.small_chunks(raw, z)[0] == len(spots)
        if n <= 5000:
            bad = 0
            for at in spots:
                c = raw[at:at + size]
                counts = Counter(c).values()
                entropy = -sum(k / size * math.log2(k / size) for k in counts)
                bad += entropy > compression.MAX_EVENNESS * math.log2(len(counts)) or compression.outside(len(z.compress(c)) / size, size, compression.SMALL_BANDS)
            assert compression.small_chunks(raw, z)[1] == bad


def test_clean_labelled_documents_are_kept(spark):
    out = compression.rules(queries.documents(spark, SF)).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    good = collect(out.filter("quality = 1 and not base_failed"))
    assert good and all(r["kept"] for r in good)


def test_edge_rows(spark):
    out = collect(compression.rules(edge(spark, clash=("kept", "ratio", "n_words"))))
    assert len(out) == 15 and all(not r["kept"] for r in out if r["n_words"] == 0)
    assert collect(compression.rules(spark.createDataFrame([], SCHEMA))) == []
