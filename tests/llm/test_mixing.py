import itertools
import random

import numpy as np
import pytest
from fixtures_llm import awkward, empty

from gritstone.llm import mixing


@pytest.mark.parametrize("seed", range(25))
def test_closest_subset_is_the_best(seed):
    r = random.Random(seed)
    lengths = np.array(r.sample(range(1, 30), 5))
    counts = np.array([r.randint(0, 3) for _ in lengths])
    budget = r.randint(0, 80)
    take = mixing.closest_subset(lengths, counts, budget)
    best = max(s for c in itertools.product(*[range(x + 1) for x in counts]) if (s := int((np.array(c) * lengths).sum())) <= budget)
    assert (take <= counts).all() and int((take * lengths).sum()) == best


def test_budget_is_hit_and_spread():
    r = np.random.default_rng(5)
    lengths = np.unique(r.integers(20, 4000, 1500))
    counts = r.integers(1, 4, len(lengths))
    budget = int((lengths * counts).sum() * 0.4)
    take = mixing.fit_budget(lengths, counts, budget)
    assert int((take * lengths).sum()) == budget and (take <= counts).all() and (take >= 0).all()
    low = lengths < np.median(lengths)
    assert 0.3 < take[low].sum() / counts[low].sum() < 0.5


def test_shortfall_goes_to_the_others():
    assert mixing.budgets({"a": 10, "b": 1000, None: 1000}, None, 900) == {"a": 10, "b": 445, None: 445}
    assert mixing.budgets({"a": 100, "b": 100}, {"a": 3, "c": 1}, 50) == {"a": 50, "b": 0}
    assert mixing.budgets({}, None, 10) == {}


def test_selection(spark):
    docs = awkward(spark)
    got = mixing.chosen(docs).toPandas()
    assert got.doc_id.is_unique and set(got.doc_id) <= {1, 2, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, -5}
    kept = mixing.mix(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(got.doc_id)
    again = mixing.chosen(docs.repartition(7)).toPandas()
    assert sorted(again.doc_id) == sorted(got.doc_id)
    whole = mixing.chosen(docs, share=1.0).toPandas()
    assert len(whole) == 13


def test_selection_equals_brute_force_however_lengths_are_cut(spark):
    r = np.random.default_rng(2)
    rows = [(int(i), None if i % 5 == 4 else f"s{i % 3}", int(n)) for i, n in enumerate(r.choice([3, 3, 3, 8, 21, 500], 900))]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    got = [{x.doc_id for x in mixing.choose(df, ranked=k).collect()} for k in (mixing.RANKED, 7, 50)]
    hashes = {x.doc_id: x.h for x in df.select("doc_id", mixing.hash_order(mixing.F.lit(mixing.SEED), "doc_id").alias("h")).collect()}
    have = {}
    for _, s, n in rows:
        have[s] = have.get(s, 0) + n
    goal, want = mixing.budgets(have, None, sum(have.values()) // 2), set()
    for s in have:
        lengths, counts = np.unique([n for _, t, n in rows if t == s], return_counts=True)
        for n, k in zip(lengths, mixing.fit_budget(lengths, counts, goal[s])):
            want |= set(sorted((i for i, t, m in rows if t == s and m == n), key=lambda i: (hashes[i], i))[:k])
    assert got[0] == got[1] == got[2] == want


def test_weights(spark):
    docs = spark.createDataFrame([(i, "word " * (10 + i % 37), f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    got = mixing.chosen(docs, weights={"s0": 2, "s1": 1}, total=3000).toPandas()
    assert got.groupby("source").n_tokens.sum().to_dict() == {"s0": 2000, "s1": 1000}


def test_empty_table(spark):
    assert mixing.chosen(empty(spark)).count() == 0
    assert mixing.mix(empty(spark)).count() == 0
