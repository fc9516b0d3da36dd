"""Quality classifier: ordinal cumulative-link regression on graded ratings.

``P(grade <= k) = sigmoid(threshold_k - score)`` with one score for all grades:
the sum of the weights of a text's hashed features. The thresholds stay
ordered (each is the one before plus a positive gap). The fitted model gives
each document its expected grade and the tail probability of the best grades.

Features, all in one hashed space: the words present (lower-cased, punctuation
at their ends removed), the first bytes of each word, and the share of words
of each form (case, marks at the ends, a repeat of the word before).
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm._words import Roller, Words, map_texts, mix, slices, words
from pagesift.session import stage

SAMPLE = 20_000       # labelled documents to fit on, at most
SAMPLE_WORDS = 20_000_000  # features of theirs brought together for the fit, at most
BUCKETS = 1 << 18     # hashed word features
FORMS = 64            # hashed form features
PREFIX_BYTES = 5
MIN_TEXTS = 5         # a feature in fewer sampled texts has no weight
MIN_TAIL = 0.4        # below one half: in doubt a document stays
BATCH, RATE = 256, 0.3
STEPS = 1_200         # minibatches, but 10 to 30 passes over the sample
SHRINK = 0.1          # L1 shrinkage, over the root of the sample's size: what noise alone moves


class Model(NamedTuple):
    grades: np.ndarray      # the grades seen, ascending
    thresholds: np.ndarray  # one less than grades
    weights: np.ndarray     # of word features
    forms: np.ndarray       # of form features


class Features(NamedTuple):
    doc: np.ndarray     # of each distinct (text, word feature)
    bucket: np.ndarray
    forms: np.ndarray   # texts x FORMS, shares of words


PUNCT = np.zeros(256, bool)
PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def features(w: Words, roll: Roller, wanted: np.ndarray | None = None) -> Features:
    n = len(w.offsets) - 1
    data = w.data
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    s, e = w.start.copy(), w.end.copy()
    marks = np.zeros(len(s), np.uint64)
    for _ in range(4):  # up to four marks at either end
        last = data[np.maximum(e - 1, 0)]
        cut = (e > s) & PUNCT[last]
        marks = np.where(cut, mix(marks * np.uint64(31) + last.astype(np.uint64) + np.uint64(1)), marks)
        e -= cut
        lead = data[np.minimum(s, max(len(data) - 1, 0))] if len(data) else np.zeros(0, np.uint8)
        s += (s < e) & PUNCT[lead]
    text = Words(lower, w.offsets, s, e, w.doc, w.first)
    h = roll.word_hashes(text)
    head = roll.word_hashes(text._replace(end=np.minimum(e, s + PREFIX_BYTES)))
    capital = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 65) & (data <= 90), out=capital[1:])
    caps = (capital[e] - capital[s] > 1).astype(np.uint64)
    repeat = np.zeros(len(h), np.uint64)
    repeat[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    form = (mix(marks ^ (caps << np.uint64(1)) ^ (repeat << np.uint64(2))) % np.uint64(FORMS)).astype(np.int64)
    count = np.bincount(w.doc, minlength=n)
    shares = np.bincount(w.doc * FORMS + form, minlength=n * FORMS).reshape(n, FORMS) / np.maximum(count, 1)[:, None]
    bucket = np.concatenate([h % np.uint64(BUCKETS), mix(head + np.uint64(7)) % np.uint64(BUCKETS)]).astype(np.int64)
    doc = np.concatenate([w.doc, w.doc])
    if wanted is not None:
        has = wanted[bucket] != 0
        bucket, doc = bucket[has], doc[has]
    pair = np.unique(doc * BUCKETS + bucket)
    return Features(pair // BUCKETS, pair % BUCKETS, shares)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade index >= k) for k = 1.. as columns."""
    return sigmoid(score[:, None] - thresholds[None, :])


def fit(grade: np.ndarray, first: np.ndarray, bucket: np.ndarray, shares: np.ndarray, seed: int = 0) -> Model:
    """Minibatch AdaGrad on the log likelihood with an L1 shrinkage of the word
    weights. Text i has the features bucket[first[i]:first[i + 1]]."""
    grades = np.unique(grade)
    y = np.searchsorted(grades, grade)
    k, n = len(grades), len(grade)
    weights, forms = np.zeros(BUCKETS), np.zeros(FORMS)
    if k < 2:
        return Model(grades, np.zeros(0), weights, forms)
    common = np.bincount(bucket, minlength=BUCKETS) >= MIN_TEXTS
    base = np.clip(np.array([(y < j).mean() for j in range(1, k)]), 1e-6, 1 - 1e-6)
    theta = np.log(base / (1 - base))
    first_gap, gaps = theta[0], np.log(np.maximum(np.diff(theta), 1e-3))
    rnd = np.random.default_rng(seed)
    acc = {"w": np.full(BUCKETS, 1e-8), "f": np.full(FORMS, 1e-8), "t": np.full(k - 1, 1e-8)}
    shrink = SHRINK / np.sqrt(n)
    for _ in range(int(np.clip(np.ceil(STEPS * BATCH / n), 10, 30))):
        order = rnd.permutation(n)
        for lo in range(0, n, BATCH):
            rows = order[lo:lo + BATCH]
            length = first[rows + 1] - first[rows]
            at = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            own, b = np.repeat(np.arange(len(rows)), length), bucket[at]
            keep = common[b]
            own, b = own[keep], b[keep]
            score = np.bincount(own, weights[b], minlength=len(rows)) + shares[rows] @ forms
            theta = first_gap + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            up = np.concatenate([np.ones((len(rows), 1)), tails(score, theta), np.zeros((len(rows), 1))], axis=1)
            r = np.arange(len(rows))
            a, c = up[r, y[rows]], up[r, y[rows] + 1]      # P(>= y), P(>= y + 1)
            p = np.maximum(a - c, 1e-12)
            da, dc = a * (1 - a) / p, c * (1 - c) / p
            g_score = -(da - dc) / len(rows)               # d(-log p) / d score
            g_theta = np.zeros(k + 1)
            np.add.at(g_theta, y[rows], da / len(rows))
            np.add.at(g_theta, y[rows] + 1, -dc / len(rows))
            g_theta = g_theta[1:k]
            g_first = g_theta.sum()
            g_gaps = np.array([g_theta[j + 1:].sum() for j in range(k - 2)]) * np.exp(gaps)
            g_t = np.concatenate([[g_first], g_gaps])
            acc["t"] += g_t ** 2
            step = RATE * g_t / np.sqrt(acc["t"])
            first_gap, gaps = first_gap - step[0], gaps - step[1:]
            g_f = g_score @ shares[rows]
            acc["f"] += g_f ** 2
            forms -= RATE * g_f / np.sqrt(acc["f"])
            touched, place = np.unique(b, return_inverse=True)
            g_w = np.bincount(place, g_score[own], minlength=len(touched))
            acc["w"][touched] += g_w ** 2
            rate = RATE / np.sqrt(acc["w"][touched])
            moved = weights[touched] - rate * g_w
            weights[touched] = np.sign(moved) * np.maximum(np.abs(moved) - rate * shrink, 0)
    theta = first_gap + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    return Model(grades, theta, weights, forms)


def _featurise(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()
        for whole in batches:
            for b in slices(whole, "text"):
                f = features(words(b.column(2)), roll)
                off = np.searchsorted(f.doc, np.arange(b.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(f.bucket.astype(np.int32)))
                forms = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * FORMS), pa.array(f.forms.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, forms], ["tie", "grade", "bucket", "forms"])

    return map_texts(df, run, "tie long, grade int, bucket array<int>, forms array<float>")


def train(docs: DataFrame, ratings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          grade_col: str = "grade", sample: int = SAMPLE, seed: int = 0) -> Model:
    """Fit on at most ``sample`` rated documents, the first in a seeded order of
    their ids. The sample's ids are broadcast and its features brought to one
    task: both are bounded by ``sample`` (and by ``SAMPLE_WORDS`` features), whatever
    the corpus. The driver sees the model alone. Ratings without id or grade, and ratings of missing documents, are
    left out."""
    rated = (ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).dropna()
             .groupBy("id").agg(F.min("grade").alias("grade"))
             .withColumn("tie", F.xxhash64(F.lit(seed), "id")).orderBy("tie", "id").limit(sample))
    chosen = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
              .join(F.broadcast(rated), "id").select("tie", "grade", "text"))
    rows = stage(_featurise(chosen), "sample")
    # As many of them, in the same order, as hold SAMPLE_WORDS features: a row
    # of a very long text is only collected if it fits.
    sizes = rows.groupBy("tie").agg(F.sum(F.size("bucket") + FORMS).alias("n")).orderBy("tie").toArrow()
    fits = np.cumsum(sizes["n"].to_numpy()) <= SAMPLE_WORDS
    if not fits.any():
        return fit(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros((0, FORMS)), seed)
    rows = rows.filter(F.col("tie") <= int(sizes["tie"].to_numpy()[fits][-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade, bucket, length, forms = [], [], [], []
        for b in batches:
            grade.append(b.column(0).to_numpy())
            length.append(np.diff(b.column(1).offsets.to_numpy()))
            bucket.append(b.column(1).flatten().to_numpy())
            forms.append(b.column(2).flatten().to_numpy().reshape(-1, FORMS))
        first = np.concatenate([[0], np.cumsum(np.concatenate(length))])
        m = fit(np.concatenate(grade).astype(np.int64), first, np.concatenate(bucket), np.concatenate(forms).astype(np.float64), seed)
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(part).tolist()], pa.list_(t)) for part, t in zip(
            m, (pa.int64(), pa.float64(), pa.float64(), pa.float64()))], list(Model._fields))

    one = rows.coalesce(1).sortWithinPartitions("tie", "grade", "bucket").select("grade", "bucket", "forms")
    fields = ", ".join(f"{c} array<{'long' if c == 'grades' else 'double'}>" for c in Model._fields)
    model = map_texts(one, run, fields).toArrow()
    return Model(*[model[c].chunk(0).flatten().to_numpy() for c in Model._fields])


def _judged(df: DataFrame, model: Model, tail_grade: int, min_tail: float, id_col: str, text_col: str, passed: bool) -> DataFrame:
    """(id, expected_grade, p_tail, kept), and if asked for the whole row, with
    its text as ``text`` and all other columns in ``passed``."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(tuple(model))
    others = [c for c in df.columns if c != text_col]
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*others).alias("passed")] if passed else []))
    kinds = source.schema
    back = ["text", "passed"] if passed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, roll = Model(*shared.value), Roller()
        upper = m.grades[1:] >= tail_grade if len(m.grades) else np.zeros(0, bool)
        for whole in batches:
            for b in slices(whole, "text"):
                n = b.num_rows
                if len(m.grades) < 2:
                    expected = pa.array([float(m.grades[0]) if len(m.grades) else None] * n, pa.float64())
                    tail, kept = pa.array([None] * n, pa.float64()), pa.array([True] * n)
                else:
                    f = features(words(b.column(1)), roll, m.weights)
                    s = np.bincount(f.doc, m.weights[f.bucket], minlength=n) + f.forms @ m.forms
                    t = tails(s, m.thresholds)
                    expected = pa.array(m.grades[0] + t @ np.diff(m.grades).astype(float))
                    p = t[:, int(np.argmax(upper))] if upper.any() else np.zeros(n)
                    p = np.ones(n) if m.grades[0] >= tail_grade else p
                    tail, kept = pa.array(p), pa.array(p >= min_tail)
                yield pa.RecordBatch.from_arrays([b.column(0), expected, tail, kept, *b.columns[1:1 + len(back)]],
                                                 ["id", "expected_grade", "p_tail", "kept", *back])

    return map_texts(source, run, f"id {kinds['id'].dataType.simpleString()}, expected_grade double, p_tail double, kept boolean"
                             + "".join(f", {c} {kinds[c].dataType.simpleString()}" for c in back))


def score(df: DataFrame, model: Model, *, tail_grade: int, min_tail: float = MIN_TAIL, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Expected grade and tail probability of every document.

    Returns (id, expected_grade, p_tail, kept), one row per input row; ``p_tail``
    is P(grade >= tail_grade), and a document is kept if that is at least
    ``min_tail``.

    Defined cases: null and empty texts have no features, so the thresholds
    alone decide; with fewer than two grades rated nothing can be told apart
    and every document is kept (expected grade: the only one, or null); null or
    repeated ids are passed through; an empty table gives no rows; other
    columns are ignored.
    """
    return _judged(df, model, tail_grade, min_tail, id_col, text_col, False).withColumnRenamed("id", id_col)


def select_good(df: DataFrame, model: Model, *, tail_grade: int, min_tail: float = MIN_TAIL, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``score`` keeps, with all their columns."""
    rows = _judged(df, model, tail_grade, min_tail, id_col, text_col, True).filter("kept")
    return rows.select(*[(F.col("text") if c == text_col else F.col(f"passed.`{c}`")).alias(c) for c in df.columns])


def grade_of(quality: Column, toxic: Column) -> Column:
    """The graded rating of two binary labels: 0 toxic, 1 of low quality, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)
