import random
import re

import numpy as np
from fixtures_llm import awkward, empty, prose

from gritstone.llm import fingerprints as fp
from gritstone.llm import piecewise


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def score(a, b):
    """By the definition, on (block size, sig, sig_double)."""
    best = 0
    for la, sa in ((a[0], a[1]), (2 * a[0], a[2])):
        for lb, sb in ((b[0], b[1]), (2 * b[0], b[2])):
            if la == lb and min(len(sa), len(sb)) >= 7 and {sa[i : i + 7] for i in range(len(sa) - 6)} & {sb[i : i + 7] for i in range(len(sb) - 6)}:
                best = max(best, 100 * (len(sa) + len(sb) - distance(sa, sb)) // (len(sa) + len(sb)))
    return best


def squeezed(p):
    f = lambda s: re.sub(r"(.)\1{3,}", r"\1\1\1", s)
    return p[0], f(p[1]), f(p[2])


def prints(texts):
    return [squeezed(piecewise.fingerprint(np.frombuffer((t or "").encode(), np.uint8))) for t in texts]


def test_bit_parallel_distance():
    r = random.Random(2)
    sigs = ["".join(r.choice("ABCD") for _ in range(r.randint(0, 64))) for _ in range(40)]
    codes, masks, size = fp.encoded(sigs)
    a, b = np.array([(i, j) for i in range(40) for j in range(40)]).T
    got = size[a] + size[b] - 2 * fp.common(masks, codes, a, b)
    assert all(d == distance(sigs[i], sigs[j]) for i, j, d in zip(a, b, got))


def test_boundaries_are_local():
    text = np.frombuffer(prose(3000, 1).encode(), np.uint8)
    ends = piecewise.boundaries(text, 96)
    moved = piecewise.boundaries(np.concatenate([np.frombuffer(b"0123456789", np.uint8), text]), 96) - 10
    assert set(ends[ends > 6]) <= set(moved)
    big = np.tile(text, 80)
    assert len(big) > piecewise._STEP
    h = piecewise.rolling(big)
    assert (piecewise.boundaries(big, 96) == np.flatnonzero(h % np.uint32(96) == 95)).all()


def pairs_by_hand(ids, texts):
    """Pairs of classes, and for each document its class."""
    p = prints(texts)
    first, of = {}, {}
    key = lambda x, t: (x, None if max(len(x[1]), len(x[2])) >= 7 else t or "")
    for i, x, t in sorted(zip(ids, p, texts), key=lambda r: r[0]):
        of[i] = first.setdefault(key(x, t), i)
    classes = sorted((i, k[0]) for k, i in first.items())
    out = {}
    for k, (i, x) in enumerate(classes):
        for j, y in classes[:k]:
            if i != j and (s := score(x, y)) >= fp.LEAST:
                out[min(i, j), max(i, j)] = s
    return out, of


def rows_by_hand(ids, texts):
    pairs, of = pairs_by_hand(ids, texts)
    near = {}
    for (a, b), s in pairs.items():
        near.setdefault(a, []).append((-s, b))
        near.setdefault(b, []).append((-s, a))
    best = {c: min(x) for c, x in near.items()}
    return {i: (c, len(near.get(c, [])), *((best[c][1], -best[c][0]) if c in best else (None, None))) for i, c in of.items()}


def rows_of(frame):
    return {r.doc_id: (r.class_id, r.links, r.best_class, r.best_score) for r in frame.collect()}


def family():
    r = random.Random(4)
    texts = []
    for i in range(25):
        words = prose(r.randint(30, 500), i).split()
        for _ in range(r.randint(1, 6)):
            w = list(words)
            for _ in range(r.choice([0, 0, 1, 3, 8, 20])):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    shared = prose(120, 999)
    texts += [f"{prose(60, 500 + i)} {shared} {prose(60, 700 + i)}" for i in range(10)]
    texts += ["ab", "ab", "abc", "", None]
    return list(range(100, 100 + len(texts))), texts


def test_search_equals_all_pairs_however_buckets_are_cut(spark):
    ids, texts = family()
    made = fp.fingerprints(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"))
    want, of = pairs_by_hand(ids, texts)
    assert len(want) > 20
    for block in (fp.BLOCK, 3):
        got = {(r.doc_a, r.doc_b): r.score for r in fp.similar(fp.classes(made), block=block).collect()}
        assert got == want
    assert rows_of(fp.classes_of(made)) == rows_by_hand(ids, texts)


def test_sf_documents_against_all_pairs(spark, sf_dir):
    listed = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = fp.query(spark, sf_dir)
    assert got.columns == ["doc_id", "block_size", "class_id", "links", "best_class", "best_score"]
    assert rows_of(got) == rows_by_hand([r.doc_id for r in listed], [r.text for r in listed])


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    assert fp.fingerprints(docs).count() == 16
    got = rows_of(fp.classes_of(fp.fingerprints(docs)))
    assert len(got) == 15
    assert got[2][0] == got[1][0] == 1 and got[7][0] == got[6][0] == 6 and got[4][0] == got[3][0] == 3
    assert got[9][1] == 1 and got[9][2] == 8 and all(got[i][1] == 0 for i in (3, 4, 5, 6, 7))
    assert fp.classes_of(fp.fingerprints(empty(spark))).count() == 0


def test_repeated_ids(spark):
    docs = spark.createDataFrame([(1, prose(200, 1)), (1, prose(200, 1)), (1, prose(200, 2)), (2, prose(200, 2))], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.links) for r in fp.classes_of(fp.fingerprints(docs)).collect())
    assert got == [(1, 1, 0), (1, 1, 0), (2, 1, 0)]
