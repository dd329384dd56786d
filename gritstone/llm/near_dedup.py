"""MinHash near-duplicate removal with odd sketches.

Every document's MinHash samples over two-word shingles are folded into a parity bitmap (an odd sketch: each
sample flips one bit). Bands of the samples propose candidates; the population count of two sketches' XOR
estimates their Jaccard similarity, most precisely where it is high, and decides. Documents joined by such
links, directly or through others, form a group, of which the lowest doc_id stays.

Defined cases. A row without a doc_id is no document and is left out. Rows that repeat a doc_id are one
document, for which in estimates the text of its lowest signature stands. Null texts and texts without a letter or
digit have nothing to compare: each is a group of its own. A text of a single word has that word as its only
shingle, so equal ones meet. Words are runs of letters and digits; all bytes of a script other than ASCII count as
letters, so a text without spaces in such a script is one word, of which only equal copies meet. Columns other than
doc_id (an integer) and text are never read by the search; ``remove`` keeps them as they are. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm import kernels
from gritstone.llm.common import arrow_batches, hash_part, keyed, shared_dir, small_side, stored, table, with_ids

WORDS, SAMPLES, BITS, BANDS, ROWS, LEAST = 2, 256, 512, 24, 4, 0.55
#: Representatives of one band that are searched at once.
BLOCK = 8192


def odd_sketch(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(texts, k) samples to (texts, bits / 64) words of a parity bitmap: sample j flips the bit that a hash of (j, value) names."""
    n, k = samples.shape
    at = kernels.mix((samples.astype(np.uint64) << np.uint64(16)) + np.arange(k, dtype=np.uint64)) % np.uint64(bits)
    flat = np.bincount((np.arange(n, dtype=np.int64)[:, None] * bits + at.astype(np.int64)).ravel(), minlength=n * bits)
    return np.packbits((flat & 1).astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view(np.uint64)


def similarity(different: np.ndarray | int, samples: int = SAMPLES, bits: int = BITS) -> np.ndarray:
    """Jaccard estimate from the number of bits in which two odd sketches differ."""
    left = np.maximum(1.0 - 2.0 * np.asarray(different, float) / bits, 1e-12)
    return np.clip(1.0 + bits / (4.0 * samples) * np.log(left), 0.0, 1.0)


def most_different(least: float, samples: int = SAMPLES, bits: int = BITS) -> int:
    """The largest number of differing bits of which the estimate reaches ``least``."""
    ok = np.flatnonzero(similarity(np.arange(bits + 1), samples, bits) >= least)
    return int(ok[-1])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, 128 bits that name all samples, the odd sketch, and a key for each band; of documents with any shingle."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.ravel().view(np.int64))
        r = np.random.Generator(np.random.PCG64(7))
        weights = r.integers(0, 1 << 63, (2, SAMPLES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            raw, off = kernels.buffers(batch.column("text"))
            m, some = kernels.minhash(raw, off, WORDS, SAMPLES)
            m = m[some]
            if not len(m):
                continue
            wide = m.astype(np.uint64)
            whole = [kernels.mix((wide * w).sum(1)).view(np.int64) for w in weights]
            band = wide[:, : BANDS * ROWS].reshape(len(m), BANDS, ROWS)
            key = kernels.mix((band * weights[0, :ROWS]).sum(2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            ids = batch.column("doc_id").filter(pa.array(some))
            yield pa.RecordBatch.from_arrays([ids, pa.array(whole[0]), pa.array(whole[1]), lists(np.ascontiguousarray(odd_sketch(m))), lists(np.ascontiguousarray(key))], ["doc_id", "sig_a", "sig_b", "sketch", "bands"])

    docs = keyed(docs, F.col("text").cast("string").alias("text")).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return arrow_batches(docs, sign, "doc_id bigint, sig_a bigint, sig_b bigint, sketch array<bigint>, bands array<bigint>")


def clusters(ids: np.ndarray, sketches: np.ndarray, most: int) -> list[np.ndarray]:
    """The members (places) of each connected group of a bucket, its lowest id first: a search that goes on from each member it finds, so all pairs count, though members once found are compared no more."""
    out, rest = [], np.argsort(ids, kind="stable")
    while len(rest):
        edge, rest, at = [rest[0]], rest[1:], 0
        while at < len(edge) and len(rest):
            near = np.bitwise_count(sketches[rest] ^ sketches[edge[at]]).sum(1) <= most
            edge.extend(rest[near])
            rest = rest[~near]
            at += 1
        out.append(np.array(edge))
    return out


def bucket_links(ids: np.ndarray, sketches: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (lowest id, other) of every connected group within one bucket."""
    return [(int(ids[c[0]]), int(ids[x])) for c in clusters(ids, sketches, most) if len(c) > 1 for x in c[1:] if ids[x] != ids[c[0]]]


def cross_links(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], most: int) -> list[tuple[int, int]]:
    """A link for each pair of groups of two blocks that has any: by their heads where these are near, by their members only where the
    heads' distance and the groups' radii leave it open (Hamming distance is a metric)."""
    sides = []
    for ids, sketches in (a, b):
        groups = clusters(ids, sketches, most)
        heads = np.array([c[0] for c in groups])
        radii = np.array([int(np.bitwise_count(sketches[c] ^ sketches[c[0]]).sum(1).max()) for c in groups])
        sides.append((ids, sketches, groups, heads, radii))
    (ids_a, sk_a, groups_a, heads_a, radii_a), (ids_b, sk_b, groups_b, heads_b, radii_b) = sides
    links = []
    for i, head in enumerate(heads_a):
        apart = np.bitwise_count(sk_b[heads_b] ^ sk_a[head]).sum(1).astype(np.int64)
        for j in np.flatnonzero(apart <= most + radii_a[i] + radii_b):
            x, y = head, heads_b[j]
            if apart[j] > most:
                for x in groups_a[i]:
                    near = np.flatnonzero(np.bitwise_count(sk_b[groups_b[j]] ^ sk_a[x]).sum(1) <= most)
                    if len(near):
                        y = groups_b[j][near[0]]
                        break
                else:
                    continue
            if ids_a[x] != ids_b[y]:
                links.append((int(min(ids_a[x], ids_b[y])), int(max(ids_a[x], ids_b[y]))))
    return links


def _members(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of each list, and the reps and sketches of all."""
    off = column.offsets.to_numpy() - column.offsets[0].as_py()
    flat = column.flatten()
    ids = flat.field("rep").to_numpy()
    return off, ids, flat.field("sketch").flatten().to_numpy().view(np.uint64).reshape(len(ids), BITS // 64)


def candidate_links(reps: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """low, high: verified links between representatives that share a band, enough to connect all that such links connect.

    A band of more than ``block`` representatives is cut into blocks by the hash of these; each block is searched alone and each
    pair of its blocks for links between them, so no task holds more than two blocks of a band however many share it."""
    most = most_different(least)

    def links_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["low", "high"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, ids, sk = _members(batch.column("members"))
            yield links_of([x for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True) for x in bucket_links(ids[a:b], sk[a:b], most)])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (off_a, ids_a, sk_a), (off_b, ids_b, sk_b) = (_members(batch.column(c)) for c in ("members", "others"))
            yield links_of([x for a, b, c, d in zip(off_a[:-1].tolist(), off_a[1:].tolist(), off_b[:-1].tolist(), off_b[1:].tolist(), strict=True) for x in cross_links((ids_a[a:b], sk_a[a:b]), (ids_b[c:d], sk_b[c:d]), most)])

    listed = reps.select("rep", "sketch", F.explode("bands").alias("band"))
    gather = F.collect_list(F.struct("rep", "sketch")).alias("members")
    # A band that none else has needs no list: counts are summed before the shuffle and tell the crowded bands too.
    crowded = stored(reps.select(F.explode("bands").alias("band")).groupBy("band").count().filter(F.col("count") > block).select("band", F.ceil(F.col("count") / block).cast("int").alias("parts")), "crowded")
    if crowded.isEmpty():
        lists = listed.groupBy("band").agg(gather).filter(F.size("members") > 1)
        return arrow_batches(lists.select("members"), within, "low bigint, high bigint", 2000).distinct()
    sized = listed.join(small_side(crowded), "band", "left").withColumn("part", F.coalesce(hash_part(F.col("parts"), "rep"), F.lit(0)))
    lists = stored(sized.groupBy("band", "part", "parts").agg(gather), "blocks")
    alone = arrow_batches(lists.filter(F.size("members") > 1).select("members"), within, "low bigint, high bigint", 200)
    # Each block goes to its pairs, so that these, not the band, are what tasks share out.
    blocks = lists.filter("parts is not null")
    first = blocks.filter("part < parts - 1").select("band", F.col("part").alias("i"), F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("j"), "members")
    second = blocks.filter("part > 0").select("band", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("i"), F.col("part").alias("j"), F.col("members").alias("others"))
    pairs = first.join(second, ["band", "i", "j"]).select("members", "others")
    return alone.union(arrow_batches(pairs, between, "low bigint, high bigint", 8)).distinct()


def components(links: DataFrame) -> DataFrame:
    """id, root: every linked id with the lowest id of its connected component, by alternating large-star and small-star steps."""
    shared_dir(links.sparkSession)
    edges = links.select(F.col("high").alias("u"), F.col("low").alias("v")).distinct().checkpoint()
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        edges = both.filter("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        hop = edges.join(low, F.col("u") == F.col("k"))
        edges = hop.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("k", "m")).filter("u <> v").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, kept_doc_id, est_jaccard: one row for each document that goes, with the one that stays of its group and the estimate for the two.

    The estimate may lie under ``least`` where the two are linked through others."""
    signed = stored(signatures(docs), "signed")
    same = stored(signed.groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch"), F.min("bands").alias("bands")), "representatives")
    roots = components(candidate_links(same, least))
    exact = signed.select("doc_id", "sig_a", "sig_b").join(same.select("sig_a", "sig_b", "rep"), ["sig_a", "sig_b"]).select("doc_id", "rep")
    # Rows of one doc_id with different texts are one document: their groups are one group.
    pairs = exact.join(roots, F.col("rep") == F.col("id"), "left").select("doc_id", F.coalesce("root", "rep").alias("kept")).distinct()
    several = pairs.groupBy("doc_id").agg(F.min("kept").alias("low"), F.max("kept").alias("high")).filter("low <> high")
    if not several.isEmpty():
        split = components(several.select("low", "high").union(pairs.join(several.select("doc_id"), "doc_id").filter("doc_id <> kept").select(F.least("doc_id", "kept"), F.greatest("doc_id", "kept"))))
        pairs = pairs.join(split, F.col("kept") == F.col("id"), "left").select("doc_id", F.coalesce("root", "kept").alias("kept")).distinct()
    gone = pairs.filter("doc_id <> kept")
    sketch = signed.groupBy("doc_id").agg(F.min_by("sketch", F.struct("sig_a", "sig_b")).alias("s"))
    bits = F.aggregate(F.zip_with("s", "t", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    estimate = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 + BITS / (4.0 * SAMPLES) * F.log(F.greatest(1 - 2.0 * bits / BITS, F.lit(1e-12)))))
    other = sketch.select(F.col("doc_id").alias("kept"), F.col("s").alias("t"))
    return gone.join(sketch, "doc_id").join(other, "kept").select("doc_id", F.col("kept").alias("kept_doc_id"), estimate.alias("est_jaccard"))


def remove(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents with one of each group of near-duplicates: the lowest doc_id, and one row of each doc_id. All columns stay."""
    return with_ids(docs, near_duplicates(docs, least).select("doc_id"), keep=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
