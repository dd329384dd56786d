import numpy as np
import pyarrow as pa
from fixtures_llm import awkward, empty, prose

from gritstone.llm import kernels, near_dedup


def shingle_sets(texts):
    out = []
    for t in texts:
        words = "".join(c if c.isalnum() and ord(c) < 128 or ord(c) >= 128 else " " for c in (t or "").translate({i: i + 32 for i in range(65, 91)})).split()
        out.append({" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set())
    return out


def test_words_and_shingles():
    texts = ["Hello, World! hello", "", None, "éa b", "x y z", "one"]
    raw, off = kernels.buffers(pa.array(texts))
    g, bounds = kernels.shingles(raw, off, 2)
    assert np.diff(bounds).tolist() == [2, 0, 0, 1, 2, 1]
    h, start, size = kernels.runs(raw, off, kernels.FOLD)
    assert [bytes(raw[s : s + n]).decode() for s, n in zip(start, size)] == ["Hello", "World", "hello", "éa", "b", "x", "y", "z", "one"]
    assert h[0] == h[2] != h[1]


def test_hashes_do_not_depend_on_windows(monkeypatch):
    texts = [prose(500, i) for i in range(8)] + ["z" * 5000, ""]
    raw, off = kernels.buffers(pa.array(texts))
    want = kernels.runs(raw, off, kernels.FOLD)[0]
    sizes = [kernels.runs(*kernels.buffers(pa.array([t])), kernels.FOLD)[0] for t in texts]
    assert (np.concatenate(sizes) == want).all()
    whole = kernels.minhash(raw, off, 2, 64)[0]
    alone = np.concatenate([kernels.minhash(*kernels.buffers(pa.array([t])), 2, 64)[0] for t in texts])
    assert (whole == alone).all()


def test_estimate_follows_jaccard():
    base = prose(400, 1).split()
    texts = [" ".join(base)]
    for k in (4, 12, 30, 60):
        w = list(base)
        for i in range(0, 400, 400 // k):
            w[i] = f"new{k}x{i}"
        texts.append(" ".join(w))
    m, _ = kernels.minhash(*kernels.buffers(pa.array(texts)), 2, near_dedup.SAMPLES)
    sk = near_dedup.odd_sketch(m)
    sets = shingle_sets(texts)
    for i in range(1, len(texts)):
        true = len(sets[0] & sets[i]) / len(sets[0] | sets[i])
        got = near_dedup.similarity(np.bitwise_count(sk[0] ^ sk[i]).sum())
        assert abs(got - true) < 0.12


def test_bucket_search_equals_all_pairs():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, (6, 8), dtype=np.uint64)
    sk = base[r.integers(0, 6, 80)].copy()
    for row in sk:
        for b in r.integers(0, 512, r.integers(0, 40)):
            row[b // 64] ^= np.uint64(1 << (int(b) % 64))
    ids = r.permutation(1000)[:80].astype(np.int64)
    most = 60
    parent = {int(i): int(i) for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(80):
        for j in range(i):
            if np.bitwise_count(sk[i] ^ sk[j]).sum() <= most:
                a, b = sorted((root(int(ids[i])), root(int(ids[j]))))
                parent[b] = a
    got = dict((h, low) for low, h in near_dedup.bucket_links(ids, sk, most))
    assert {i: got.get(i, i) for i in parent} == {i: root(i) for i in parent}


def test_blocks_of_a_crowded_band_give_the_same_groups(spark):
    """Near copies that drift, so that far ones meet only through others, all in bands that are cut into blocks."""
    docs = []
    for family in range(3):
        words = prose(120, family).split()
        for i in range(60):
            words[(i * 7) % 120] = f"w{family}x{i}"
            docs.append((family * 1000 + i, " ".join(words)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    reps = near_dedup.signatures(docs).select(near_dedup.F.col("doc_id").alias("rep"), "sketch", "bands")
    groups = []
    for block in (near_dedup.BLOCK, 2, 5):
        links = near_dedup.candidate_links(reps, near_dedup.LEAST, block)
        groups.append({(r.id, r.root) for r in near_dedup.components(links).collect()})
    assert groups[0] == groups[1] == groups[2] and len(groups[0]) > 100


def test_cross_links_equal_all_pairs():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, (5, 8), dtype=np.uint64)
    sk = base[r.integers(0, 5, 120)].copy()
    for row in sk:
        for b in r.integers(0, 512, r.integers(0, 60)):
            row[b // 64] ^= np.uint64(1 << (int(b) % 64))
    ids = r.permutation(5000)[:120].astype(np.int64)

    def groups(links):
        parent = {int(i): int(i) for i in ids}
        root = lambda x: x if parent[x] == x else root(parent[x])
        for a, b in links:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        return {i: root(i) for i in parent}

    for most in (40, 60, 90):
        a, b = (ids[:50], sk[:50]), (ids[50:], sk[50:])
        cut = near_dedup.bucket_links(*a, most) + near_dedup.bucket_links(*b, most) + near_dedup.cross_links(a, b, most)
        assert groups(cut) == groups(near_dedup.bucket_links(ids, sk, most))
    assert near_dedup.cross_links((ids[:1], sk[:1]), (ids[:1], sk[:1]), 60) == []


def test_estimate_of_repeated_ids_does_not_depend_on_order(spark):
    rows = [(2, prose(100, 1) + " tail"), (2, prose(100, 2)), (1, prose(100, 1)), (1, prose(100, 3))]
    got = [near_dedup.near_duplicates(spark.createDataFrame(r, "doc_id long, text string").repartition(3)).collect() for r in (rows, rows[::-1])]
    assert got[0] == got[1] and [(r.doc_id, r.kept_doc_id) for r in got[0]] == [(2, 1)]


def test_components(spark):
    r = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in zip(r.integers(0, 300, 200), r.integers(0, 300, 200)) if a != b] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    df = spark.createDataFrame([(min(x), max(x)) for x in links], "low long, high long")
    got = {r.id: r.root for r in near_dedup.components(df).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_recall_and_precision_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = shingle_sets([r.text for r in rows])
    gone = {r.doc_id: r.kept_doc_id for r in near_dedup.near_duplicates(docs).collect()}
    group = lambda i: gone.get(i, i)
    near = far = found = wrong = 0
    for i in range(len(rows)):
        for j in range(i):
            if not sets[i] or not sets[j]:
                continue
            jac = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            same = group(rows[i].doc_id) == group(rows[j].doc_id)
            if jac >= 0.65:
                near += 1
                found += same
            elif jac < 0.35:
                far += 1
                wrong += same
    assert near > 5 and found / near >= 0.9 and wrong == 0


def test_awkward(spark):
    docs = awkward(spark)
    got = {(r.doc_id, r.kept_doc_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(2, 1), (7, 6), (9, 8)}
    kept = near_dedup.remove(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [-5, 1, 3, 4, 5, 6, 8, 10, 11, 12, 13, 14]


def test_many_copies_and_empty(spark):
    docs = spark.createDataFrame([(i, prose(50, 1) + (" tail" if i % 5 == 0 else "")) for i in range(2000)], "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == 1999 and {r.kept_doc_id for r in got} == {0}
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    assert near_dedup.remove(empty(spark)).count() == 0
