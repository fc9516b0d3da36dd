"""Near duplicates by order MinHash, verified by banded alignment.

The k-mers of a text are its runs of five words, each labelled with its
occurrence number. For each of ``BANDS`` seeds the ``PICK`` k-mers with the
smallest hashes are taken in the order in which they stand in the text; the
hash of that tuple is the key of the band. Two texts share a key with about
the probability (share of common labelled k-mers) ** PICK if the common ones
stand in the same order, so the sketch is sensitive to edits, not just to the
set of k-mers.

Equal texts form one class first; classes are what is compared. Texts that share
too few k-mers with all others have no link and leave (``linkable``). Texts with a
common key are first paired with one member chosen by hash, another one for
each band and for each two neighbouring bands: a text meets one other for each of
its keys, whatever the size of a bucket. What these pairs leave out is found
exactly: texts that can have no link outside their group leave (``open_texts``),
the others are paired across groups by their rarest k-mers (``rare_pairs``), so
that no link is lost, whatever keys its texts have.
A pair is a link if the longest common subsequence of the two k-mer sequences,
aligned within the band that the limit allows, gives

    common / (k-mers of both - common) >= 0.8

(the Jaccard similarity of the k-mers with order and repeats respected).
Linked classes form groups. Texts under five words have one k-mer, all their words.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm._words import Roller, as_long, map_texts, mix, slices, words
from pagesift.llm.components import components, extend
from pagesift.session import stage

K = 5
BANDS = 12
PICK = 2
SIMILARITY = (4, 5)   # common / (both - common), as a fraction
AGREE = 2             # of the band keys, before texts are compared
PART = 3              # of the k-mers tell which texts may have links elsewhere
SIG_LONGS = 16        # of a text's bits


def kmers(doc: np.ndarray, first: np.ndarray, h: np.ndarray, roll: Roller) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of many texts, and the text of each."""
    n = np.diff(first)
    count = np.where(n >= K, n - K + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    lo = first[owner] + at
    return roll.run_hashes(h, lo, np.minimum(lo + K, first[owner + 1] if len(owner) else lo)), owner


def occurrence(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How many equal values of the same text stand before each."""
    order = np.lexsort((x, owner))
    new = np.ones(len(x), bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    lead = np.flatnonzero(new)
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.repeat(lead, np.diff(np.append(lead, len(x))))
    return out


def labelled_kmers(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """K-mers with their occurrence number: a text holds each once."""
    return mix(x + occurrence(x, owner).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def sketch(x: np.ndarray, owner: np.ndarray, n: int, bands: int, seed: int) -> np.ndarray:
    """Band keys (texts x bands). Every text from 0 to n - 1 has a k-mer."""
    labelled = labelled_kmers(x, owner)
    start = np.searchsorted(owner, np.arange(n))
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.empty((n, bands), np.uint64)
    for j in range(bands):
        v = mix(labelled ^ mix(np.full(1, seed * 1000 + j + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        picked, places = [], []
        for _ in range(PICK):
            least = np.minimum.reduceat(v, start)
            hit = np.flatnonzero(v == least[owner])
            own, lead = np.unique(owner[hit], return_index=True)
            place = np.full(n, -1)
            place[own] = hit[lead]
            gone = least == top   # no k-mer left
            picked.append(np.where(gone, 0, least))
            places.append(np.where(gone, len(v) + 1, place))
            v[place[~gone]] = top
        order = np.argsort(np.stack(places), axis=0, kind="stable")
        in_order = np.take_along_axis(np.stack(picked), order, axis=0)
        key = np.full(n, j + 1, np.uint64)
        for row in in_order:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
        out[:, j] = key
    return out


def sketches(docs: DataFrame, bands: int, seed: int) -> DataFrame:
    """(fp, keys) of the texts with a word; docs: (fp, text), a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()
        for whole in batches:
            for b in slices(whole, "text"):
                w = words(b.column(1))
                x, owner = kmers(w.doc, w.first, roll.word_hashes(w), roll)
                has, owner = np.unique(owner, return_inverse=True)
                if not len(has):
                    continue
                keys = sketch(x, owner, len(has), bands, seed)
                off = pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(has)), pa.ListArray.from_arrays(off, pa.array(as_long(keys.ravel())))], ["fp", "keys"])

    return map_texts(docs, run, "fp binary, keys array<long>")


def common(a: list, b: list, band: int) -> int:
    """Length of the longest common subsequence whose matches lie within the
    band |i - j| <= band. Bit j of ``row`` is 0 where the length grows at b[j]."""
    where: dict = {}
    for j, y in enumerate(b):
        where.setdefault(y, []).append(j)
    full = (1 << len(b)) - 1
    row = full
    for i, x in enumerate(a):
        match = 0
        for j in where.get(x, ()):
            if -band <= i - j <= band:
                match |= 1 << j
        if match:
            grow = row & match
            row = ((row + grow) | (row - grow)) & full
    return len(b) - row.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, num: int = SIMILARITY[0], den: int = SIMILARITY[1]) -> bool:
    """Whether two k-mer sequences reach the similarity num / den."""
    both = len(a) + len(b)
    need = -(-num * both // (num + den))          # common k-mers that suffice
    if min(len(a), len(b)) < need:
        return False
    band = both - 2 * need                        # k-mers that may stay unmatched
    short = min(len(a), len(b))
    differs = np.flatnonzero(a[:short] != b[:short])
    head = int(differs[0]) if len(differs) else short
    differs = np.flatnonzero(a[len(a) - short + head:][::-1] != b[len(b) - short + head:][::-1])
    tail = int(differs[0]) if len(differs) else short - head
    if head + tail >= need:
        return True
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    # No more can match than there are equal k-mers, whatever their order.
    ua, na = np.unique(a, return_counts=True)
    ub, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if head + tail + int(np.minimum(na[ia], nb[ib]).sum()) < need:
        return False
    return head + tail + common(a.tolist(), b.tolist(), band) >= need


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of fingerprints that are links; texts: (fp, text)."""
    joined = (pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("text")), "a")
              .join(texts.select(F.col("fp").alias("b"), F.col("text").alias("other")), "b")
              .select("a", "b", "text", "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()

        def sequences(column):
            w = words(column)
            x, owner = kmers(w.doc, w.first, roll.word_hashes(w), roll)
            return x, np.searchsorted(owner, np.arange(len(w.first)))

        for whole in batches:
            for b in slices(whole, "text"):
                x, at = sequences(b.column(2))
                y, to = sequences(b.column(3))
                hit = pa.array([aligned(x[at[i]:at[i + 1]], y[to[i]:to[i + 1]]) for i in range(b.num_rows)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(hit)

    return map_texts(joined, run, "a binary, b binary")


def labelled_rows(texts: DataFrame, part: int = 1) -> DataFrame:
    """The columns of ``texts`` but the last, which is the text, then ``n`` and ``token``:
    a row for each labelled k-mer of a text that has ``n`` of them, or for those of
    one ``part``-th of all hashes (the same ones in every text)."""
    keys = texts.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()
        for whole in batches:
            for b in slices(whole, "text"):
                w = words(b.column("text"))
                x, owner = kmers(w.doc, w.first, roll.word_hashes(w), roll)
                if not len(x):
                    continue
                token = labelled_kmers(x, owner)
                n = np.bincount(owner, minlength=b.num_rows)[owner]
                taken = np.flatnonzero(token % np.uint64(part) == 0)
                of = pa.array(owner[taken])
                yield pa.RecordBatch.from_arrays(
                    [b.column(k.name).take(of) for k in keys] + [pa.array(n[taken]), pa.array(as_long(token[taken]))],
                    [k.name for k in keys] + ["n", "token"])

    return map_texts(texts, run, ", ".join(f"{k.name} {k.dataType.simpleString()}" for k in keys) + ", n long, token long")


def signatures(texts: DataFrame) -> DataFrame:
    """(fp, sig): one bit for the hash of each labelled k-mer, in ``SIG_LONGS`` longs;
    texts: (fp, text). A bit that only one of two texts has is a k-mer that only it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()
        for whole in batches:
            for b in slices(whole, "text"):
                w = words(b.column(1))
                x, owner = kmers(w.doc, w.first, roll.word_hashes(w), roll)
                bit = labelled_kmers(x, owner) >> np.uint64(20)
                sig = np.zeros((b.num_rows, SIG_LONGS), np.uint64)
                np.bitwise_or.at(sig, (owner, ((bit >> np.uint64(6)) % np.uint64(SIG_LONGS)).astype(np.int64)), np.uint64(1) << (bit % np.uint64(64)))
                off = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * SIG_LONGS)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.ListArray.from_arrays(off, pa.array(as_long(sig.ravel())))], ["fp", "sig"])

    return map_texts(texts, run, "fp binary, sig array<long>")


def settled(own: DataFrame) -> DataFrame:
    """(of): texts without a link elsewhere; own: (of, n) for each k-mer that no text
    elsewhere holds. A link leaves at most a fifth of a text's k-mers unmatched."""
    num, den = SIMILARITY
    return own.groupBy("of").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("own")).filter(
        (F.col("n") - F.col("own")) * den < F.col("n") * num).select("of")


def linkable(full: DataFrame) -> DataFrame:
    """(fp, text), each text once, of those that may have a link at all: a text leaves
    once too many of its k-mers are in no other text, counted over one ``PART``-th of
    all k-mers. (Texts and groups go by 64 bits of their fingerprints here.)"""
    keyed = full.select(F.xxhash64("fp").alias("of"), "fp", "text")
    tokens = labelled_rows(keyed.select("of", "text"), PART).groupBy("token").agg(
        F.min("of").alias("of"), F.max("of").alias("last"), F.first("n").alias("n")).filter("of = last")
    kept = keyed.join(stage(settled(tokens), "alone"), "of", "left_anti")
    return stage(kept.groupBy("of", "fp").agg(F.first("text").alias("text")).select("fp", "text"), "texts")


def open_texts(texts: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, root, text): the texts that may have a link to a text of another group; a
    text leaves once too many of its k-mers are held by its own group alone."""
    named = texts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "text")
    rows = labelled_rows(named.select(F.xxhash64("fp").alias("of"), F.xxhash64("root").alias("r"), "text"), PART)
    holders = Window.partitionBy("token")
    own = rows.select("of", "n", F.min("r").over(holders).alias("lo"), F.max("r").over(holders).alias("hi")).filter("lo = hi")
    inside = stage(settled(own), "inside")
    return stage(named.join(inside, F.xxhash64("fp") == F.col("of"), "left_anti").select("fp", "root", "text"), "open")


def rare_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (a < b) of texts (fp, root, text) in different groups that may be links: no
    link between the texts is missing, whatever keys they have.

    The labelled k-mers are put in one order, rare ones first. If ``need`` k-mers
    must be common, the first common one has at least ``need`` k-mers from it to
    the end of either text (``left``), so a passage of many texts only makes pairs
    where it is nearly the whole of a text. Of two groups at a k-mer one is not the
    largest there: its texts meet the others, and members of one group never meet.
    Bits that only one text has (``signatures``) bound what can be common."""
    num, den = SIMILARITY
    tokens = stage(labelled_rows(texts), "tokens")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("df > 1")
    common_first = Window.partitionBy("fp").orderBy(F.desc("df"), F.desc("token"))
    rare = (tokens.join(shared, "token").withColumn("left", F.row_number().over(common_first))
            .filter((F.col("left") * den >= F.col("n") * num) & (F.col("lo") != F.col("hi"))).select("token", "fp", "root", "n", "left"))
    rare = stage(rare, "rare")
    groups = rare.groupBy("token", "root").agg(F.count(F.lit(1)).alias("size"))
    mixed = groups.groupBy("token").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    held = stage(rare.join(mixed.select("token", "main"), "token").join(signatures(texts.select("fp", "text")), "fp"), "held")
    x, y = held.filter("root <> main").drop("main").alias("x"), held.alias("y")

    def only(one: str, other: str) -> Column:
        return sum((F.bit_count(F.col(f"{one}.sig")[i].bitwiseAND(F.bitwise_not(F.col(f"{other}.sig")[i]))) for i in range(SIG_LONGS)), F.lit(0))

    need = (F.col("x.n") + F.col("y.n")) * num
    bounds = [F.col("x.left"), F.col("y.left"), F.col("x.n") - only("x", "y"), F.col("y.n") - only("y", "x")]
    may = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.fp") < F.col("y.fp")))
    for most in bounds:
        may = may & (need <= most * (num + den))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & may)
    return pairs.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def bucketed(keyed: DataFrame, salts: int) -> DataFrame:
    """(fp, band, key, n, least, some): texts with others of the same key, the
    smallest of them, and one chosen by hash, in one of ``salts`` orders."""
    order = F.xxhash64("fp", F.col("band") % salts)
    # Smallest and chosen ones of parts of a bucket first: a hot key lies in no single task.
    parts = keyed.groupBy("band", "key", F.pmod(F.xxhash64("fp"), F.lit(64)).alias("salt")).agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("least"), F.min(F.struct(order.alias("o"), "fp")).alias("some"))
    buckets = parts.groupBy("band", "key").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.min("some")["fp"].alias("some")).filter("n > 1")
    return stage(keyed.join(buckets, ["band", "key"]).select("fp", "band", "key", "n", "least", "some"), "buckets")


def apart(pairs: DataFrame, roots: DataFrame, sk: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts lie in different groups and agree in ``AGREE`` of
    the band keys (fp, keys): similar texts agree in two thirds of them, so this
    leaves out chance meetings before texts are moved."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left")
    pairs = pairs.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    for c in ("a", "b"):
        pairs = pairs.join(sk.select(F.col("fp").alias(c), F.col("keys").alias(f"k{c}")), c)
    agree = F.size(F.filter(F.zip_with("ka", "kb", lambda x, y: x == y), lambda x: x))
    return pairs.filter(agree >= AGREE).select("a", "b")


def met(near: DataFrame) -> DataFrame:
    """The pairs of a text and the chosen one of each of its buckets."""
    return near.filter("fp <> some").select(F.least("fp", "some").alias("a"), F.greatest("fp", "some").alias("b")).distinct()


def fingerprint(text: Column) -> Column:
    return F.unhex(F.md5(text))


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS,
                    seed: int = 1) -> DataFrame:
    """Classes of near-duplicate documents.

    Returns (id, class_id, copy_id, fp, is_kept), one row per input row:
    ``class_id`` is the smallest id of the near-duplicate class, ``copy_id`` the
    smallest id with the same text, ``fp`` the fingerprint of the text, ``is_kept``
    true for one row of each class (one with the smallest id).

    Defined cases: a null text is alone (both ids are its own, and it is
    kept); texts without a word are compared by equality only; null ids are
    larger than others, so they name a class only if all its ids are null;
    repeated rows are one class, and one of them is kept; an empty table gives
    no rows; other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp"), F.col(text_col).alias("text"))
    full = docs.filter("fp is not null")
    texts = linkable(full)
    sk = stage(sketches(texts, bands, seed), "sketches")
    following = F.concat(F.slice("keys", 2, bands - 1), F.slice("keys", 1, 1))
    keyed = sk.select("fp", F.posexplode(F.concat("keys", F.zip_with("keys", following, lambda x, y: F.xxhash64(x, y)))).alias("band", "key"))
    near = bucketed(keyed, 2 * bands)
    # First each text with the smallest of all its buckets, then with the chosen
    # ones that still lie in another group.
    first = near.groupBy("fp").agg(F.min("least").alias("b")).select(F.col("fp").alias("a"), "b").filter("a <> b")
    roots = stage(components(stage(verify(first, texts), "links")), "roots")
    roots = extend(roots, stage(verify(apart(met(near), roots, sk), texts), "links"))
    # Then, exactly, what these pairs have left out.
    apart_still = open_texts(texts, roots)
    roots = extend(roots, stage(verify(rare_pairs(apart_still), apart_still), "links"))

    # Smallest ids of classes and groups.
    classes = full.groupBy("fp").agg(F.min("id").alias("copy_id"))
    classes = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = stage(classes, "classes")
    groups = classes.groupBy("root").agg(
        F.min("copy_id").alias("class_id"),
        F.min_by("fp", F.struct(F.col("copy_id").isNull(), F.col("copy_id"), F.col("fp"))).alias("best"))
    named = classes.join(groups, "root").select("fp", "copy_id", "class_id", (F.col("fp") == F.col("best")).alias("best"))
    rows = docs.select("id", "fp").join(named, "fp", "left")
    # One row of each class is kept: the first of those with its smallest id.
    # All others are dealt out by their id, so that a class of many copies does
    # not meet in one task.
    rows = rows.withColumn("lead", F.col("fp").isNotNull() & F.col("best") & F.col("id").eqNullSafe(F.col("class_id")))
    rows = rows.withColumn("place", F.when(F.col("lead"), -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 16))))
    nth = F.row_number().over(Window.partitionBy("fp", "place").orderBy("id"))
    return rows.withColumn("nth", nth).select(
        F.col("id").alias(id_col),
        F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("copy_id")).alias("copy_id"), "fp",
        (F.col("fp").isNull() | (F.col("lead") & (F.col("nth") == 1))).alias("is_kept"))


def one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, seed: int = 1) -> DataFrame:
    """The rows of ``df`` that near_duplicates keeps, with all their columns.
    Texts are shuffled once, by id and fingerprint."""
    verdict = near_duplicates(df, id_col=id_col, text_col=text_col, bands=bands, seed=seed)
    kept = verdict.filter("is_kept and fp is not null").select(F.col(id_col).alias("__id"), F.col("fp").alias("__kept_fp"))
    rows = df.withColumn("__fp", fingerprint(F.col(text_col)))
    full = rows.filter("__fp is not null")
    # (id, fp) names the kept row up to repeats of it.
    found = full.join(kept, (F.col(id_col).eqNullSafe(F.col("__id"))) & (F.col("__fp") == F.col("__kept_fp")), "left_semi")
    return found.dropDuplicates([id_col, "__fp"]).unionByName(rows.filter("__fp is null")).drop("__fp")
