"""Phrase collocation mining by the stripes pattern.

A stripe is a prefix with an associative counter of what follows it. The
counter of the empty prefix holds the words, that of a word its extensions: the
next word, the next two words, and so on. A task builds stripes for the texts
it reads and sends each as one row (prefix, extensions, counts); stripes of one
prefix meet in one partition and are merged elementwise. All that the scores
need is in the merged stripes: a phrase is an entry of its first word's stripe,
the total of a prefix is its entry in the stripe of the empty one, and the
largest entry around a phrase decides whether a longer phrase subsumes it.

The stripe of a frequent prefix is dealt out to partitions by the hash of
the extension: the empty prefix always, words if they are among the ``HEAD``
heaviest that counting the words in a first pass has shown. So no prefix,
however common, lies in one task, and merging is an aggregation that can
spill.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm._words import map_texts
from pagesift.session import stage

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
UNKNOWN = "und"
HEAD = 2000            # a word of the head makes up at least 1 / HEAD of all words
FRAGMENTS = 64         # of a stripe that is dealt out
TOKENS = 2_000_000     # words after which a task sends its stripes
ROWS = 10_000          # stripes in one Arrow batch
TOTAL = -1             # fragment of the row that counts all words

# The marks that end a piece; letters that are lowered.
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
FOLD = bytes.maketrans(_UPPER + _BREAKS, _UPPER.lower() + b"\n" * len(_BREAKS))


class Stripes:
    """The stripes of one task since it last sent some: words alone (``depth`` 0),
    or the extensions of words by up to ``depth`` words."""

    def __init__(self, depth: int, head: dict[str, frozenset[bytes]]):
        self.depth, self.head = depth, head
        self.clear()

    def clear(self) -> None:
        self.vocab: defaultdict[bytes, int] = defaultdict()
        self.vocab.default_factory = self.vocab.__len__
        self.tokens: dict[str, array] = {}
        self.n = 0

    def add(self, lang: str, text: bytes) -> None:
        """Numbers of the words, -1 at the end of each piece."""
        out, number = self.tokens.setdefault(lang, array("i")), self.vocab.__getitem__
        before = len(out)
        for piece in text.translate(FOLD).split(b"\n"):
            if found := piece.split():
                out.extend(map(number, found))
                out.append(-1)
        self.n += len(out) - before

    def rows(self) -> Iterator[pa.RecordBatch]:
        """All stripes, language by language."""
        words = list(self.vocab)
        strings = pa.array(words, pa.string())
        crc = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
        for lang, numbers in self.tokens.items():
            a = np.frombuffer(numbers, np.int32)
            if not self.depth:
                counts = np.bincount(a[a >= 0], minlength=len(words))
                yield self.batch(lang, pa.array([""]), np.array([TOTAL]), pa.array([""]), pa.array([[int(counts.sum())]], pa.list_(pa.int32())))
                entry = np.flatnonzero(counts)
                yield from self.dealt(lang, pa.array([""]), np.zeros(len(entry), np.int64), crc[entry] % FRAGMENTS,
                                      strings.take(pa.array(entry)), counts[entry])
                continue
            hot = np.fromiter((w in self.head.get(lang, ()) for w in words), bool, len(words))
            # Runs of k + 1 words: where their last words stand, the number of
            # each one's run among the distinct ones, and those runs' words.
            at = np.flatnonzero(a >= 0)
            parts, run = [np.arange(len(words))], a[at].astype(np.int64)
            for _ in range(self.depth):
                on = a[at + 1] >= 0   # a piece ends with -1
                at, run = at[on] + 1, run[on]
                keys, run, counts = np.unique(run * len(words) + a[at], return_inverse=True, return_counts=True)
                before, last = keys // len(words), keys % len(words)
                parts = [p[before] for p in parts] + [last]
                mixed = crc[parts[1]]
                for p in parts[2:]:
                    mixed = mixed * 31 + crc[p]
                entries = [strings.take(pa.array(p)) for p in parts[1:]]
                entries = pc.binary_join_element_wise(*entries, " ") if len(entries) > 1 else entries[0]
                yield from self.dealt(lang, strings, parts[0], np.where(hot[parts[0]], mixed % FRAGMENTS, 0), entries, counts)

    def dealt(self, lang, owners, prefix, fragment, entries, counts) -> Iterator[pa.RecordBatch]:
        """Entries as stripes, one for each prefix and fragment. Entries of a
        prefix come in the order of their words, so that they compress well."""
        order = np.lexsort((fragment, prefix))
        prefix, fragment = prefix[order], fragment[order]
        new = np.ones(len(order), bool)
        new[1:] = (prefix[1:] != prefix[:-1]) | (fragment[1:] != fragment[:-1])
        lead = np.flatnonzero(new)
        offsets = pa.array(np.append(lead, len(order)).astype(np.int32))
        nexts = pc.binary_join(pa.ListArray.from_arrays(offsets, entries.take(pa.array(order))), "\n")
        counted = pa.ListArray.from_arrays(offsets, pa.array(counts[order].astype(np.int32)))
        whole = self.batch(lang, owners.take(pa.array(prefix[lead])), fragment[lead], nexts, counted)
        for lo in range(0, whole.num_rows, ROWS):
            yield whole.slice(lo, ROWS)

    def batch(self, lang, owners, fragment, nexts, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(owners), pa.string()), owners, pa.array(fragment.astype(np.int32)), nexts, counts],
            ["lang", "prefix", "fragment", "nexts", "counts"])


def stripes(docs: DataFrame, depth: int, head: dict[str, frozenset[bytes]]) -> DataFrame:
    """Stripes as the tasks send them: of the empty prefix (``depth`` 0), or of all
    words with extensions of up to ``depth`` words; docs: (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Stripes(depth, head)
        for b in batches:
            langs = b.column(0).to_pylist()
            for lang, text in zip(langs, b.column(1).cast(pa.large_binary()).to_pylist()):
                if text:
                    own.add(lang, text)
                    if own.n >= TOKENS:
                        yield from own.rows()
                        own.clear()
        if own.n:
            yield from own.rows()

    return map_texts(docs, run, "lang string, prefix string, fragment int, nexts string, counts array<int>")


def merge(parts: DataFrame) -> DataFrame:
    """(lang, prefix, fragment, word, f): stripes added up element by element.
    Only stripes are shuffled: their entries are added where they meet."""
    met = parts.repartition("lang", "prefix", "fragment")
    entry = F.explode(F.arrays_zip(F.split("nexts", "\n").alias("word"), F.col("counts").alias("c"))).alias("e")
    return (met.select("lang", "prefix", "fragment", entry).select("lang", "prefix", "fragment", "e.word", "e.c")
            .groupBy("lang", "prefix", "fragment", "word").agg(F.sum("c").alias("f")))


def count_phrases(df: DataFrame, *, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, lang_col: str = "lang",
                  text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(totals (lang, n), phrases (lang, phrase, m, f)): how many words a language
    has, and every phrase of up to ``max_words`` words that occurs ``min_count`` times."""
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    words = merge(stripes(docs, 0, {}))
    words = stage(words.filter((F.col("fragment") == TOTAL) | (F.col("f") >= min_count)), "words")
    totals = words.filter(F.col("fragment") == TOTAL).select("lang", F.col("f").alias("n"))
    words = words.filter(F.col("fragment") != TOTAL)
    every = totals.agg(F.sum("n")).first()[0] or 0
    head = defaultdict(set)
    # At most HEAD rows: each holds that share of all words.
    for r in words.filter(F.col("f") * HEAD >= F.lit(every)).select("lang", "word").collect():
        head[r["lang"]].add(r["word"].encode())
    head = {lang: frozenset(found) for lang, found in head.items()}
    longer = stage(merge(stripes(docs, max_words - 1, head)).filter(F.col("f") >= min_count), "phrases")
    phrases = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("m"), "f").unionByName(
        longer.select("lang", F.concat_ws(" ", "prefix", "word").alias("phrase"),
                      (F.size(F.split("word", " ")) + 1).alias("m"), "f"))
    return totals, phrases


def _part(words: str, first: str, n: str) -> Column:
    return F.expr(f"array_join(slice({words}, {first}, {n}), ' ')")


def mine(df: DataFrame, *, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, subsumed: int = 50,
         lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The best collocations of each language.

    Returns (lang, rank, phrase, a, l, r, n, score): ``a`` occurrences of the
    phrase, ``l`` and ``r`` those of its first and second part at the cut with the
    lowest ``score`` = floor(1000000 a a / (l r)) (of equal ones the first), ``n`` words
    of the language. Phrases have 2 to ``max_words`` words and ``min_count``
    occurrences; one that lies inside a longer such phrase with ``subsumed`` of a
    hundred of its occurrences is dropped.

    Defined cases: a null language is ``und``; null and empty texts and pieces
    without a word count nothing; equal texts count as often as they come; ties
    are ordered by occurrences, then by phrase in byte order; an empty table
    gives no rows; other columns are ignored. Counts are exact, and scores are
    computed in decimals.
    """
    totals, phrases = count_phrases(df, min_count=min_count, max_words=max_words, lang_col=lang_col, text_col=text_col)
    candidates = phrases.filter("m > 1").withColumn("words", F.split("phrase", " "))
    part = phrases.select("lang", "phrase", "f")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", "m", F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
    cuts = (cuts.withColumn("first", _part("words", "1", "k")).withColumn("rest", _part("words", "k + 1", "m - k"))
            .join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    # Up to 1e15 occurrences: products stay below 38 digits.
    big = {c: f"cast({c} as decimal(15, 0))" for c in "alr"}
    score = F.expr(f"cast((cast(1000000 as decimal(7, 0)) * {big['a']} * {big['a']}) div ({big['l']} * {big['r']}) as bigint)")
    scored = (cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
              .select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r"))
    # The most frequent longer phrase around each candidate.
    inner = F.explode(F.expr("flatten(transform(sequence(2, m - 1), k -> transform(sequence(1, m - k + 1), i -> array_join(slice(words, i, k), ' '))))"))
    around = (candidates.filter("m > 2").select("lang", "f", inner.alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    kept = scored.join(around, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(subsumed) * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
