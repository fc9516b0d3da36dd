import numpy as np
import pyarrow as pa
from pagesift.llm import ordinal, queries
from pagesift.llm._words import Roller, words
from pyspark.sql import functions as F

from .edge import SCHEMA, SF, collect, edge

SF1 = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """Fit on the ratings of even ids, judge those of odd ids."""
    docs, rated = queries.documents(spark, SF1), queries.ratings(spark, SF1)
    model = ordinal.train(docs, rated.filter("doc_id % 2 = 0"))
    out = collect(ordinal.score(docs, model, tail_grade=2).join(rated.filter("doc_id % 2 = 1"), "doc_id"))
    good, rest = [r for r in out if r["grade"] == 2], [r for r in out if r["grade"] < 2]
    assert np.mean([r["kept"] for r in good]) > 0.98
    assert np.mean([not r["kept"] for r in rest]) > 0.85
    assert np.mean([r["expected_grade"] for r in good]) > np.mean([r["expected_grade"] for r in rest]) + 0.5


def test_query_covers_all_documents_and_reruns_agree(spark):
    a, b = (sorted(map(str, collect(queries.op8_ordinal_quality(spark, SF)))) for _ in range(2))
    assert len(a) == 200 and a == b


def test_three_grades_are_ordered():
    rnd = np.random.default_rng(1)
    y = rnd.integers(0, 3, 3000)
    lists = [np.unique(np.concatenate([rnd.integers(100, 400, 5), [g] if rnd.random() < 0.9 else []]).astype(int)) for g in y]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    model = ordinal.fit(y, first, np.concatenate(lists), np.zeros((len(y), ordinal.FORMS)))
    assert (np.diff(model.thresholds) > 0).all()
    assert model.weights[0] < model.weights[1] < model.weights[2]
    p = ordinal.tails(model.weights[[0, 1, 2]], model.thresholds)
    assert p[0, 0] < 0.5 < p[1, 0] and p[1, 1] < 0.5 < p[2, 1] and (p[:, 0] >= p[:, 1]).all()


def test_gradient_fits_base_rates():
    y = np.array([0] * 10 + [1] * 20 + [3] * 70)
    model = ordinal.fit(y, np.zeros(101, np.int64), np.zeros(0, np.int64), np.zeros((100, ordinal.FORMS)))
    assert model.grades.tolist() == [0, 1, 3]
    assert np.allclose(1 - ordinal.tails(np.zeros(1), model.thresholds)[0], [0.1, 0.3], atol=0.03)


def test_features_of_forms():
    w = words(pa.array(["Hello, hello (HELLO) x&&& x x", None, "", "###", "é È."]))
    f = ordinal.features(w, Roller())
    assert f.forms.shape == (5, ordinal.FORMS) and np.allclose(f.forms.sum(axis=1), [1, 0, 0, 1, 1])
    assert set(f.doc.tolist()) == {0, 3, 4}
    assert sum(f.doc == 0) == 4  # hello and x, whole and by their first bytes


def test_edge_rows(spark):
    ratings = spark.createDataFrame([(1, 0), (2, 2), (4, 2), (5, 0), (None, 1), (9, None), (4, 2), (777, 1)], "doc_id long, grade int")
    e = edge(spark, clash=("id", "kept", "grade", "tie", "passed"))
    out = collect(ordinal.score(e, ordinal.train(e, ratings), tail_grade=2))
    assert len(out) == 15 and all(0 <= r["p_tail"] <= 1 for r in out)
    kept = collect(ordinal.select_good(e, ordinal.train(e, ratings), tail_grade=2))
    assert sorted(r["text"] or "" for r in kept) and list(kept[0]) == e.columns and len(kept) == sum(r["kept"] for r in out)
    one = collect(ordinal.score(e, ordinal.train(e, ratings.filter("grade = 2")), tail_grade=2))
    assert all(r["kept"] and r["p_tail"] is None for r in one)
    none = collect(ordinal.score(e, ordinal.train(e, ratings.filter("false")), tail_grade=2))
    assert all(r["kept"] and r["expected_grade"] is None for r in none)
    empty = spark.createDataFrame([], SCHEMA)
    assert collect(ordinal.score(empty, ordinal.train(empty, ratings), tail_grade=2)) == []


def test_sample_is_bounded(spark, monkeypatch):
    docs, rated = queries.documents(spark, SF), queries.ratings(spark, SF)
    nothing = np.zeros(1)
    monkeypatch.setattr(ordinal, "fit", lambda grade, *_: ordinal.Model(np.array([len(grade)]), nothing, nothing, nothing))
    sizes = [int(ordinal.train(docs, rated, sample=n).grades[0]) for n in (30, ordinal.SAMPLE)]
    assert sizes == [30, rated.dropna().count()]


def test_grades(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1), (None, 0), (1, None)], "q int, t int")
    assert [r[0] for r in rows.select(ordinal.grade_of(F.col("q"), F.col("t"))).collect()] == [1, 0, 2, 0, None, 2]
