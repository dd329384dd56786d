import numpy as np
from fixtures_llm import prose

from gritstone.llm import ordinal_quality as oq


def test_held_out_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    grades = oq.grades_of(labels)
    got = oq.graded(docs, oq.train(docs, grades.filter("doc_id % 3 <> 0"))).join(grades.filter("doc_id % 3 = 0"), "doc_id").toPandas()
    keep = got.tail_probability >= oq.LEAST_TAIL
    assert keep[got.grade == 2].mean() > 0.99
    assert keep[got.grade == 1].mean() < 0.2
    assert keep[got.grade == 0].mean() < 0.02


def test_one_toxic_word_counts_in_a_long_text(spark):
    # Rated texts of 60 to 960 words, and others of 1,600 words with and without the mark.
    texts = [prose(60 << i % 5, i) + " nasty" * (i % 3 == 0) for i in range(300)]
    long = [(1000 + i, f"{prose(800, 1000 + i)} {'nasty' * (i % 2)} {prose(800, 2000 + i)}") for i in range(20)]
    docs = spark.createDataFrame([*enumerate(texts), *long], "doc_id long, text string")
    grades = spark.createDataFrame([(i, 1 if i % 3 == 0 else 2) for i in range(300)], "doc_id long, grade int")
    model = oq.train(docs, grades)
    tail = {r.doc_id: r.tail_probability for r in oq.graded(docs, model).collect()}
    assert len(model.markers.word) == 1
    assert all((tail[1000 + i] < oq.LEAST_TAIL) == (i % 2 == 1) for i in range(20))


def test_markers_by_hand():
    # Word 7 is in 20 of 40 toxic and none of 60 clean documents, 8 in all, 9 in clean ones only.
    rows = [(7, 1)] * 20 + [(8, 1)] * 40 + [(8, 2)] * 60 + [(9, 2)] * 30
    word, grade = (np.array(x) for x in zip(*rows))
    got = oq.markers(word.astype(np.uint64), grade, np.array([5, 40, 60]))
    assert got.word.tolist() == [7] and np.isclose(got.strength[0], np.log((20.5 / 41) / (0.5 / 61)))
    assert not len(oq.markers(word.astype(np.uint64), grade, np.array([5, 0, 60])).word)
