import numpy as np
from compare import assert_same

from gritstone.llm import exact_topk as tk


def by_hand(ids, vectors, k):
    v = np.array(vectors, float)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    s = np.round(v @ v.T, tk.DIGITS) + 0.0
    out = set()
    for i, a in enumerate(ids):
        order = sorted((-s[i, j], b) for j, b in enumerate(ids) if b != a)[:k]
        out |= {(a, r + 1, b, -x) for r, (x, b) in enumerate(order)}
    return out


def test_any_tiling_gives_the_same(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(40, 6)).round(1)
    vectors = base[r.integers(0, 40, 150)]  # many ties
    vectors[7] = 0
    ids = (r.permutation(1000)[:150] - 300).tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    want = by_hand(ids, vectors, 5)
    for tile, fan in ((1000, 16), (20, 3), (7, 2)):
        assert {tuple(x) for x in tk.top_k(df, 5, tile, fan).collect()} == want


def test_best_keeps_ties_in_order():
    r = np.random.default_rng(1)
    scores = r.integers(0, 4, (50, 200)).astype(float)
    ids = r.permutation(200)[None, :]
    found, top = tk.best(ids, scores, 10)
    for row in range(50):
        want = sorted(zip(-scores[row], ids[0]))[:10]
        assert list(zip(-top[row], found[row])) == want


def test_table_matches_sql(spark, sf_dir, duck):
    assert_same(tk.query(spark, sf_dir).toPandas(), duck.execute(tk.ORACLE).df())


def test_awkward(spark):
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [1.0, 2.0, 3.0]), (8, [0.0, 0.0]), (None, [1.0, 0.0]), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in data], "vec_id long, embedding array<double>, dims int, tile int, ids string")
    got = {tuple(x) for x in tk.top_k(df, 3).collect()}
    assert got == {(1, 1, 2, 0.0), (1, 2, 8, 0.0), (2, 1, 1, 0.0), (2, 2, 8, 0.0), (8, 1, 1, 0.0), (8, 2, 2, 0.0)}
    assert tk.top_k(df.filter("false"), 3).count() == 0


def test_lists_are_not_shuffled(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(200, 4)))], "vec_id long, embedding array<double>")
    plan = tk.top_k(df, 3, 20, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "FlatMapGroups" not in plan  # the query tiles alone


def test_few_pairs_are_multiplied_in_double_precision(monkeypatch):
    r = np.random.default_rng(3)
    v = r.normal(size=(8000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, again = np.arange(8000), []
    once = tk.Lists.again
    monkeypatch.setattr(tk.Lists, "again", lambda self, at, query, *rest: again.append(len(query)) or once(self, at, query, *rest))
    lists = tk.Lists(ids[:500], v[:500], 10)
    for a in range(0, 8000, 1000):
        lists.meet(ids[a : a + 1000], v[a : a + 1000], v[a : a + 1000].astype(np.float32))
    assert sum(again) < 0.02 * 500 * 8000


def test_scores_closer_than_single_precision(spark):
    r = np.random.default_rng(4)
    for spread in (3e-4, 3e-3, 0.0):
        vectors = r.normal(size=16) + spread * r.normal(size=(400, 16))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        assert {tuple(x) for x in tk.top_k(df, 5, 90, 2).collect()} == by_hand(range(400), vectors, 5)
