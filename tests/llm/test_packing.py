import random
from collections import Counter

import numpy as np
import pytest
from fixtures_llm import awkward, empty

from gritstone.llm import packing
from gritstone.llm.tokens import VOCABULARY, encoding


def place_one_by_one(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return room


def play(counts, capacity):
    """The bins that a plan fills, from its steps; checks that every piece gets one place and none overlap."""
    steps = packing.plan(counts, capacity)
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    steps = steps[order]
    key = (steps[:, 0] << 44) | steps[:, 1]
    used = {}
    for n, c in counts.items():
        for rank in range(c):
            s = steps[np.searchsorted(key, (n << 44) | rank, "right") - 1]
            turn = rank - s[1]
            b, at = int(s[2] + turn // s[3]), int(s[4] + turn % s[3] * n)
            used.setdefault(b, []).append((at, n))
    for spans in used.values():
        spans.sort()
        at = 0
        for start, n in spans:
            assert start == at
            at += n
        assert at <= capacity
    return used


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 20, 64, 100])
    lengths = [r.randint(1, capacity) if seed % 3 else min(capacity, 1 + int(r.expovariate(4 / capacity))) for _ in range(r.randint(1, 400))]
    used = play(Counter(lengths), capacity)
    assert Counter(capacity - sum(n for _, n in s) for s in used.values()) == Counter(place_one_by_one(lengths, capacity))


def test_tree_finds_the_tightest():
    r = random.Random(1)
    tree, have = packing.RoomTree(50), set()
    for _ in range(2000):
        x = r.randint(0, 50)
        have.symmetric_difference_update({x})
        tree.put(x, x in have)
        q = r.randint(0, 50)
        assert tree.tightest(q) == min((h for h in have if h >= q), default=None)


def test_whole_texts_are_packed(spark):
    docs = awkward(spark)
    got = packing.pack_documents(docs, capacity=64).toPandas()
    encode = encoding(VOCABULARY).encode_ordinary
    want = Counter()
    for row in docs.collect():
        if row.doc_id is not None and row.text:
            want[row.doc_id] += len(encode(row.text))
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == dict(want)
    for _, b in got.groupby("bin_id"):
        b = b.sort_values("bin_offset")
        assert (b.bin_offset.to_numpy() == np.concatenate([[0], np.cumsum(b.n_tokens.to_numpy())[:-1]])).all()
        assert b.n_tokens.sum() <= 64
    room = Counter((64 - got.groupby("bin_id").n_tokens.sum()).tolist())
    assert room == Counter(place_one_by_one(got.n_tokens.tolist(), 64))


def bins_by_hand(pieces, capacity):
    """(doc_id, piece, n_tokens) in the stated order, one by one: by falling length, then hash order, doc_id and piece; the bin that came first to the tightest remainder."""
    room, since, clock, out = [], [], 0, {}
    for d, p, n in pieces:
        fits = [(r, since[i], i) for i, r in enumerate(room) if r >= n]
        if fits:
            i = min(fits)[2]
        else:
            i = len(room)
            room.append(capacity)
            since.append(0)
        out[d, p] = (i, capacity - room[i])
        room[i] -= n
        clock += 1
        since[i] = clock
    return out


def test_bins_and_order_do_not_depend_on_how_lengths_are_cut(spark):
    r = random.Random(9)
    lengths = [(i, r.choice([5, 5, 5, 7, 20, 64, 130, 200])) for i in range(400)]
    df = spark.createDataFrame(lengths, "doc_id long, n_tokens long")
    got = [{(x.doc_id, x.piece): (x.n_tokens, x.bin_id, x.bin_offset) for x in packing.pack(df, 64, ranked=k).collect()} for k in (packing.RANKED, 10, 33)]
    assert got[0] == got[1] == got[2]
    cut = packing.pieces(df, 64).select("doc_id", "piece", "n_tokens", packing.hash_order("doc_id", "piece").alias("h")).collect()
    order = sorted(cut, key=lambda x: (-x.n_tokens, x.h, x.doc_id, x.piece))
    want = bins_by_hand([(x.doc_id, x.piece, x.n_tokens) for x in order], 64)
    rank = {}
    for k, (n, b, o) in got[0].items():
        rank.setdefault(b, set()).add((o, n))
    by_hand = {}
    for (d, p), (b, o) in want.items():
        by_hand.setdefault(b, set()).add((o, got[0][d, p][0]))
    assert sorted(map(sorted, rank.values())) == sorted(map(sorted, by_hand.values()))
    for n in {x.n_tokens for x in cut}:  # pieces of one length come to bins in the stated order
        assert len({got[0][x.doc_id, x.piece][1:] for x in order if x.n_tokens == n}) == sum(x.n_tokens == n for x in order)


def test_empty_table(spark):
    assert packing.pack_documents(empty(spark)).count() == 0
