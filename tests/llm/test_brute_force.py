"""The queries that SQL can't express, and the whole pipeline, against versions that go through all documents, pairs and bins one by one."""

import math
import re

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_packing import bins_by_hand

from gritstone.llm import kernels, mixing, near_dedup, packing, secret_ledger
from gritstone.llm import ordinal_quality as oq
from gritstone.llm.common import hash_order
from gritstone.llm.tokens import VOCABULARY, encoding


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def model(spark, sf_dir, docs):
    return oq.train(docs, oq.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def judged(model, text):
    """(expected grade, tail) of one text, weight by weight."""
    raw, off = kernels.buffers(pa.array([text]))
    _, place, value = oq.features(raw, off)
    if not len(place):
        return 0.0, 0.0
    score = sum(float(model.weights[p]) * float(v) for p, v in zip(place, value))
    words = set(kernels.runs(raw, off, kernels.FOLD)[0].tolist())
    marks = [s for w, s in zip(model.markers.word.tolist(), model.markers.strength.tolist()) if w in words]
    score += float(model.weights[oq.MARKER]) * max(marks, default=0.0) * oq.MARKER_SCALE
    p = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
    return sum(p), p[-1]


def groups(signed):
    """kept id of each signed document: all pairs that share a band and whose sketches are near, joined one after another."""
    parent = {r.doc_id: r.doc_id for r in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    most = near_dedup.most_different(near_dedup.LEAST)
    for k, a in enumerate(signed):
        for b in signed[:k]:
            same = (a.sig_a, a.sig_b) == (b.sig_a, b.sig_b)
            if same or any(x == y for x, y in zip(a.bands, b.bands)) and sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a.sketch, b.sketch)) <= most:
                x, y = sorted((root(a.doc_id), root(b.doc_id)))
                parent[y] = x
    return {x: root(x) for x in parent}


def secret(text):
    return any(re.search(r.pattern, text) for r in secret_ledger.RULES)


def mixed(spark, rows):
    """ids that budget mixing takes, of (doc_id, source, text)."""
    encode = encoding(VOCABULARY).encode_ordinary
    sized = [(i, s, len(encode(t))) for i, s, t in rows if t and encode(t)]
    have = {}
    for _, s, n in sized:
        have[s] = have.get(s, 0) + n
    goal, out = mixing.budgets(have, None, int(sum(have.values()) * mixing.SHARE)), set()
    hashed = {r.id: r.h for r in spark.createDataFrame([(i,) for i, *_ in sized], "id long").select("id", hash_order(F.lit(mixing.SEED), "id").alias("h")).collect()}
    for s in have:
        lengths, counts = np.unique([n for _, t, n in sized if t == s], return_counts=True)
        for n, k in zip(lengths, mixing.fit_budget(lengths, counts, goal[s])):
            out |= set(sorted((i for i, t, m in sized if t == s and m == n), key=lambda i: (hashed[i], i))[:k])
    return out


def packed(spark, rows):
    """(doc_id, piece) to (length, bin, offset) of (doc_id, text)."""
    encode = encoding(VOCABULARY).encode_ordinary
    pieces = [(i, p, min(packing.CAPACITY, n - p * packing.CAPACITY)) for i, t in rows for n in [len(encode(t))] for p in range(-(-n // packing.CAPACITY))]
    hashed = {(r.i, r.p): r.h for r in spark.createDataFrame([x[:2] for x in pieces], "i long, p int").select("i", "p", hash_order("i", "p").alias("h")).collect()}
    pieces.sort(key=lambda x: (-x[2], hashed[x[:2]], x))
    bins = bins_by_hand(pieces, packing.CAPACITY)
    return {(i, p): (n, *bins[i, p]) for i, p, n in pieces}


def bins_of(placed):
    """The bins, each as its lengths and offsets: bins that hold alike are interchangeable."""
    out = {}
    for n, b, at in placed.values():
        out.setdefault(b, []).append((at, n))
    return sorted(map(sorted, out.values()))


def test_quality_of_every_document(docs, model, spark, sf_dir):
    want = {r.doc_id: judged(model, r.text) for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: (r.expected_grade, r.tail_probability) for r in oq.graded(docs, model).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-5 for i in want for a, b in zip(got[i], want[i]))
    assert {r.doc_id for r in oq.query(spark, sf_dir).collect()} == {i for i, (_, t) in want.items() if t >= oq.LEAST_TAIL}


def test_near_duplicates_of_every_document(docs, spark, sf_dir):
    signed = near_dedup.signatures(docs).collect()
    want = {i: k for i, k in groups(signed).items() if i != k}
    got = near_dedup.query(spark, sf_dir).collect()
    assert {r.doc_id: r.kept_doc_id for r in got} == want and len(want) > 5
    sketch = {r.doc_id: r.sketch for r in signed}
    for r in got:
        bits = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(sketch[r.doc_id], sketch[r.kept_doc_id]))
        assert abs(r.est_jaccard - float(near_dedup.similarity(bits))) < 1e-9


def test_packing_of_every_document(docs, spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.text]
    got = {(r.doc_id, r.piece): (r.n_tokens, r.bin_id, r.bin_offset) for r in packing.query(spark, sf_dir).collect()}
    want = packed(spark, rows)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and bins_of(got) == bins_of(want)


def test_mixing_of_every_document(docs, spark, sf_dir):
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    assert {r.doc_id for r in mixing.query(spark, sf_dir).collect()} == mixed(spark, rows)


def test_pipeline_stage_by_stage_by_hand(docs, model, spark, sf_dir):
    rows = {r.doc_id: r for r in docs.collect()}
    left = {i for i, r in rows.items() if judged(model, r.text)[1] >= oq.LEAST_TAIL}
    signed = near_dedup.signatures(docs.filter(F.col("doc_id").isin(sorted(left)))).collect()
    kept = groups(signed)
    left = {i for i in left if kept.get(i, i) == i}
    left = {i for i in left if not secret(rows[i].text)}
    left = mixed(spark, [(i, rows[i].source, rows[i].text) for i in left])
    want = packed(spark, [(i, rows[i].text) for i in sorted(left)])
    got = {(r.doc_id, r.piece): (r.n_tokens, r.bin_id, r.bin_offset) for r in cp.run(spark, sf_dir).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and bins_of(got) == bins_of(want) and len(want) > 20
