import numpy as np
import pyarrow as pa
from fixtures_llm import awkward, empty, prose
from pyspark.sql import functions as F

from gritstone.llm import kernels
from gritstone.llm import ordinal_quality as oq


def loss(model, bounds, place, value, grade):
    score = np.add.reduceat(np.append(model.weights[place] * value, 0.0), bounds[:-1])
    tails = np.concatenate([np.ones((len(grade), 1)), model.tails(score), np.zeros((len(grade), 1))], axis=1)
    at = np.arange(len(grade))
    return -np.log(np.maximum(tails[at, grade] - tails[at, grade + 1], 1e-12)).mean()


def sample(n=600):
    r = np.random.default_rng(0)
    texts, grade = [], []
    for i in range(n):
        g = int(r.integers(0, 3))
        words = prose(60, i).split()
        for j in range(60 if g == 0 else 8 if g == 1 else 0):
            words[j] = f"{words[j]}!!" if g == 0 else "nasty"
        r.shuffle(words)
        texts.append(" ".join(words))
        grade.append(g)
    return texts, np.array(grade)


def test_fit_orders_grades_and_thresholds():
    texts, grade = sample()
    bounds, place, value = oq.features(*kernels.buffers(pa.array(texts)))
    cut = bounds[400]
    model = oq.fit(bounds[:401], place[:cut], value[:cut].astype(float), grade[:400], 3)
    assert (np.diff(model.thresholds) > 0).all()
    score = np.add.reduceat(model.weights[place] * value, bounds[:-1])
    expected = model.tails(score).sum(1)[400:]
    means = [expected[grade[400:] == g].mean() for g in range(3)]
    assert means[0] < 0.5 < means[1] < 1.6 < means[2]
    assert ((expected.round() == grade[400:]).mean()) > 0.9


def test_gradient_descends_to_a_minimum():
    texts, grade = sample(200)
    bounds, place, value = oq.features(*kernels.buffers(pa.array(texts)))
    value = value.astype(float)
    short, long = (oq.fit(bounds, place, value, grade, 3, steps=s) for s in (5, 250))
    assert loss(long, bounds, place, value, grade) < 0.5 * loss(short, bounds, place, value, grade)
    few = place[np.bincount(place, minlength=oq.BUCKETS)[place] >= oq.LEAST_DOCUMENTS][:5]
    for p in few:  # no small step along a weight lowers the loss by more than rounding
        for d in (0.05, -0.05):
            moved = oq.Ordinal(long.weights.copy(), long.thresholds)
            moved.weights[p] += d
            assert loss(moved, bounds, place, value, grade) > loss(long, bounds, place, value, grade) - 1e-4


def test_repeats_end_with_their_text():
    """The last word or line of one text and the first of the next are no repetition."""
    one, two = (oq.features(*kernels.buffers(pa.array(t))) for t in (["same word"], ["a word", "word", "word"]))
    assert np.diff(two[0]).tolist() == [2, 1, 1] and np.diff(one[0]).tolist() == [2]


def test_features_are_the_same_in_any_batch():
    texts = [prose(50, i) for i in range(5)] + ["", None, "WOW!! WOW!!", prose(40_000, 7)]
    raw, off = kernels.buffers(pa.array(texts))
    whole = []
    for a, b, bounds, place, value in oq.text_features(raw, off):
        whole += [(place[x:y].tolist(), value[x:y].tolist()) for x, y in zip(bounds, bounds[1:])]
    for t, (p, v) in zip(texts, whole):
        one = oq.features(*kernels.buffers(pa.array([t])))
        assert one[1].tolist() == p and np.allclose(one[2], v)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    grades = oq.grades_of(labels)
    model = oq.train(docs, grades.filter("doc_id % 3 <> 0"))
    got = oq.graded(docs, model).join(grades.filter("doc_id % 3 = 0"), "doc_id").toPandas()
    keep = got.tail_probability >= oq.LEAST_TAIL
    assert keep[got.grade == 2].mean() > 0.95
    assert keep[got.grade == 0].mean() < 0.2
    assert got[got.grade == 1].expected_grade.mean() < got[got.grade == 2].expected_grade.mean()


def test_awkward(spark):
    docs = awkward(spark)
    ratings = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (6, 0, 0), (8, 1, 0), (9, 1, 0), (None, 1, 0), (14, None, 0), (13, 1, None), (1, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    grades = {r.doc_id: r.grade for r in oq.grades_of(ratings).collect()}
    assert grades == {1: 1, 2: 1, 6: 0, 8: 2, 9: 2, 99: 2}
    model = oq.train(docs, oq.grades_of(ratings))
    got = oq.graded(docs, model).collect()
    assert len(got) == 16
    assert all(r.expected_grade == 0 == r.tail_probability for r in got if r.doc_id in (3, 4, 5))
    kept = oq.select(docs, model)
    assert kept.columns == docs.columns and not {3, 4, 5, None} & {r.doc_id for r in kept.collect()}
    unrated = oq.select(docs, oq.train(docs, oq.grades_of(ratings.filter("false"))))
    assert sorted(r.doc_id for r in unrated.collect()) == [-5, 1, 2, 6, 7, 8, 9, 10, 11, 12, 12, 13, 14]
    assert oq.graded(empty(spark), model).count() == 0 and oq.train(empty(spark), oq.grades_of(ratings)) is None


def test_no_text_waits_while_it_is_graded(spark):
    """ArrowEvalPython keeps each row, with its text, in the executor's memory until Python has judged its whole batch."""
    docs = awkward(spark).withColumn("doc_id", F.col("doc_id").cast("int"))
    ratings = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (6, 0, 0), (8, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for model in (None, oq.train(docs, oq.grades_of(ratings), least_documents=1)):
        got = oq.graded(docs, model)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
        assert got.dtypes == [("doc_id", "int"), ("expected_grade", "double"), ("tail_probability", "double")]
        by_column = docs.filter("doc_id is not null").select("doc_id", oq.scored(F.col("text"), model).alias("p")).select("doc_id", "p.grade", "p.tail")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, by_column.collect()))
