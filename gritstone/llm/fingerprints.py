"""Document fingerprints by context-triggered piecewise hashing, and the search for all similar documents.

A rolling hash over seven bytes ends chunks where the text itself says so; each chunk gives one of 64 characters.
Two fingerprints compare at equal block sizes, or one's double with the other's single: the score is
100 * (1 - d / (l1 + l2)) for the insertions and deletions d between the signatures. As is usual for this kind of
hash, runs of more than three equal characters count as three, and signatures without a common run of
``GRAM`` = 7 characters score 0.

That rule makes the search exact: whoever scores shares a 7-gram at one block size, so signatures meet on their
grams. Documents with equal fingerprints are one class, named by its lowest doc_id, and only classes are compared.
A pair is compared where a common run starts (the characters before differ, or there are none), so long common runs
cost one comparison, not one a gram. Edit distances are bit-parallel over whole batches of pairs. ``similar`` lists
all pairs of classes that score; ``classes_of`` gives every document its class, how many other classes score with
that, and the best of them, so its rows grow as the documents do while no link is left out of the count.

Defined cases. Rows without a doc_id are left out; rows that repeat a doc_id are one row for each class they are in,
and never paired with themselves. Null texts count as empty. An empty text, or one of too few chunks for a gram, has
a fingerprint that says too little: it scores with nothing, and its class is that of its equal texts. Only doc_id
(an integer) and text are read. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm import kernels
from gritstone.llm.common import arrow_batches, hash_part, keyed, small_side, stored, table
from gritstone.llm.piecewise import ALPHABET, GRAM, LENGTH, fingerprint

LEAST, PAIRS = 60, 1 << 17
#: Signatures with one gram that are compared at once.
BLOCK = 4096
_CODE = np.full(256, LENGTH, np.uint8)
_CODE[np.frombuffer(ALPHABET, np.uint8)] = np.arange(64, dtype=np.uint8)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, block_size, sig, sig_double, and a hash of the text, of every document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = kernels.buffers(batch.column("text"))
            out = [fingerprint(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            block, one, two = zip(*out, strict=True) if out else ((), (), ())
            whole = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(block, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(np.array(whole, np.uint64).view(np.int64))], ["doc_id", "block_size", "sig", "sig_double", "text_hash"])

    texts = keyed(docs, F.col("text").cast("string").alias("text")).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return arrow_batches(texts, sign, "doc_id bigint, block_size bigint, sig string, sig_double string, text_hash bigint")


def common(masks: np.ndarray, codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence for each pair of signatures: a's masks of places (one bit each, by character) against b's characters."""
    v = np.full(len(a), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for t in range(LENGTH):
        u = v & masks[a, codes[b, t]]
        v = (v + u) | (v - u)
    return LENGTH - np.bitwise_count(v).astype(np.int64)


def encoded(sigs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters as codes (64 beyond the end), place masks by code, and lengths."""
    size = np.fromiter(map(len, sigs), np.int64, len(sigs))
    codes = _CODE[np.frombuffer("".join(s.ljust(LENGTH, "\0") for s in sigs).encode(), np.uint8)].reshape(-1, LENGTH)
    masks = np.zeros((len(sigs), LENGTH + 1), np.uint64)
    at = np.arange(len(sigs))
    for t in range(LENGTH):
        masks[at, codes[:, t]] |= np.uint64(1 << t)
    masks[:, LENGTH] = 0
    return codes, masks, size


def run_starts(rep: np.ndarray, before: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within each bucket at which a common run starts, in pieces of about ``PAIRS``."""
    a, b, held = [], [], 0
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if hi - lo == 2:
            if rep[lo] != rep[lo + 1] and (before[lo] != before[lo + 1] or not before[lo]):
                a.append(np.array([lo]))
                b.append(np.array([lo + 1]))
                held += 1
        else:
            first = before[lo:hi]
            if (first == first[0]).all() and first[0]:
                continue
            for i in range(lo, hi - 1):
                j = np.arange(i + 1, hi)
                j = j[(rep[j] != rep[i]) & ((before[j] != before[i]) | (before[i] == 0))]
                if len(j):
                    a.append(np.full(len(j), i))
                    b.append(j)
                    held += len(j)
                if held >= PAIRS:
                    yield np.concatenate(a), np.concatenate(b)
                    a, b, held = [], [], 0
    if held:
        yield np.concatenate(a), np.concatenate(b)


def run_starts_between(rep_a: np.ndarray, before_a: np.ndarray, rep_b: np.ndarray, before_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of two blocks of one bucket at which a common run starts, in pieces of about ``PAIRS``."""
    step = max(1, PAIRS // max(1, len(rep_b)))
    for lo in range(0, len(rep_a), step):
        r, c = rep_a[lo : lo + step, None], before_a[lo : lo + step, None]
        i, j = np.nonzero((r != rep_b[None, :]) & ((c != before_b[None, :]) | (c == 0)))
        yield i + lo, j


def classes(prints: DataFrame) -> DataFrame:
    """doc_id, block_size, sig, sig_double, rep: fingerprints without long runs, and the lowest doc_id of the class, stored."""
    squeeze = lambda c: F.regexp_replace(c, r"(.)\1{3,}", "$1$1$1")
    prints = prints.select("doc_id", "block_size", squeeze("sig").alias("sig"), squeeze("sig_double").alias("sig_double"), "text_hash")
    told = F.greatest(F.length("sig"), F.length("sig_double")) >= GRAM
    prints = stored(prints.select("doc_id", "block_size", "sig", "sig_double", F.when(told, F.lit(0).cast("bigint")).otherwise(F.col("text_hash")).alias("text_hash")).distinct(), "prints")
    keys = ["block_size", "sig", "sig_double", "text_hash"]
    # The lowest doc_id is found before the shuffle as far as it goes, so a class of any size is one row of the smaller side.
    return stored(prints.join(prints.groupBy(*keys).agg(F.min("doc_id").alias("rep")), keys).select("doc_id", "block_size", "sig", "sig_double", "rep"), "classes")


def similar(classed: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """doc_a < doc_b, block_size, score of every pair of ``classes`` that scores at least ``least``, each class by its lowest doc_id.

    A gram of more than ``block`` signatures is cut into blocks by the hash of their classes, and each block and each pair of blocks
    is compared as rows of their own: no bucket, however large, is one row or one task."""
    levels = F.array(F.struct(F.col("block_size").alias("level"), F.col("sig").alias("s")), F.struct((F.col("block_size") * 2).alias("level"), F.col("sig_double").alias("s")))
    entries = stored(classed.filter("doc_id = rep").select("rep", F.explode(levels).alias("x")).select("rep", "x.level", "x.s").filter(F.length("s") >= GRAM).distinct(), "entries")
    hashed = lambda i: F.xxhash64("level", F.substring("s", i, F.lit(GRAM)))
    places = F.sequence(F.lit(1), F.length("s") - (GRAM - 1))
    grams = F.transform(places, lambda i: F.struct(hashed(i).alias("gram"), F.when(i == 1, 0).otherwise(F.ascii(F.substring("s", i - 1, F.lit(1)))).alias("before")))
    rows = entries.select("rep", "level", F.explode(grams).alias("g")).select("rep", "level", "g.gram", "g.before")
    counted = entries.select(F.explode(F.transform(places, hashed)).alias("gram")).groupBy("gram").count()
    crowded = stored(counted.filter(F.col("count") > block).select("gram", F.ceil(F.col("count") / block).cast("int").alias("parts")), "crowded")

    def scored(pair: list[np.ndarray], left: tuple, right: tuple) -> pa.RecordBatch:
        (rep_a, level_a, masks, size_a), (rep_b, level_b, codes, size_b), (a, b) = left, right, pair
        ok = (level_a[a] == level_b[b]) & (200 * np.minimum(size_a[a], size_b[b]) >= least * (size_a[a] + size_b[b]))
        a, b = a[ok], b[ok]
        score = 200 * common(masks, codes, a, b) // (size_a[a] + size_b[b])
        ok = score >= least
        a, b, score = a[ok], b[ok], score[ok]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(rep_a[a], rep_b[b])), pa.array(np.maximum(rep_a[a], rep_b[b])), pa.array(level_a[a]), pa.array(score.astype(np.int32))], ["doc_a", "doc_b", "block_size", "score"])

    def parts_of(m: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        off = (m.offsets.to_numpy() - m.offsets[0].as_py()).astype(np.int64)
        flat = m.flatten()
        return off, (*(flat.field(c).to_numpy() for c in ("rep", "level", "before")), *encoded(flat.field("s").to_pylist()))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, (rep, level, before, codes, masks, size) = parts_of(batch.column("m"))
            for pair in run_starts(rep, before, off):
                yield scored(pair, (rep, level, masks, size), (rep, level, codes, size))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (off_a, left), (off_b, right) = parts_of(batch.column("m")), parts_of(batch.column("others"))
            for a, b, c, d in zip(off_a[:-1], off_a[1:], off_b[:-1], off_b[1:], strict=True):
                rep_a, level_a, before_a, _, masks, size_a = (x[a:b] for x in left)
                rep_b, level_b, before_b, codes, _, size_b = (x[c:d] for x in right)
                for pair in run_starts_between(rep_a, before_a, rep_b, before_b):
                    yield scored(pair, (rep_a, level_a, masks, size_a), (rep_b, level_b, codes, size_b))

    schema = "doc_a bigint, doc_b bigint, block_size bigint, score int"
    gather = lambda *c: F.collect_list(F.struct(*c)).alias("m")
    if crowded.isEmpty():
        # Most grams are alone; only those that meet another take their signatures along.
        met = rows.groupBy("gram").agg(gather("rep", "level", "before")).filter(F.size("m") > 1).select("gram", F.explode("m").alias("m")).select("gram", "m.rep", "m.level", "m.before")
        full = met.join(entries, ["rep", "level"]).groupBy("gram").agg(gather("rep", "level", "before", "s"))
        pairs = arrow_batches(full.select("m"), within, schema, 500)
    else:
        part = F.coalesce(hash_part(F.col("parts"), "rep"), F.lit(0)).alias("part")
        sized = rows.join(small_side(crowded), "gram", "left").select("gram", "rep", "level", "before", "parts", part)
        some = sized.groupBy("gram", "part", "parts").agg(gather("rep", "level", "before")).filter("size(m) > 1 or parts is not null").select("gram", "part", "parts", F.explode("m").alias("m")).select("gram", "part", "parts", "m.rep", "m.level", "m.before")
        full = stored(some.join(entries, ["rep", "level"]).groupBy("gram", "part", "parts").agg(gather("rep", "level", "before", "s")), "blocks")
        blocks = full.filter("parts is not null")
        first = blocks.filter("part < parts - 1").select("gram", F.col("part").alias("i"), F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("j"), "m")
        second = blocks.filter("part > 0").select("gram", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("i"), F.col("part").alias("j"), F.col("m").alias("others"))
        pairs = arrow_batches(full.select("m"), within, schema, 50).union(arrow_batches(first.join(second, ["gram", "i", "j"]).select("m", "others"), between, schema, 4))
    return pairs.groupBy("doc_a", "doc_b").agg(F.max(F.struct("score", "block_size")).alias("x")).select("doc_a", "doc_b", "x.block_size", "x.score")


def classes_of(prints: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """doc_id, block_size, class_id, links, best_class, best_score: every document with the lowest doc_id of its class, the number of other
    classes that score at least ``least`` with it, and the one that scores best (the lowest of equals; null where there is none)."""
    classed = classes(prints)
    pairs = similar(classed, least, block).select("doc_a", "doc_b", "score")
    both = pairs.union(pairs.select("doc_b", "doc_a", "score")).toDF("class_id", "other", "score")
    links = both.groupBy("class_id").agg(F.count("*").alias("links"), F.max(F.struct(F.col("score"), (-F.col("other")).alias("other"))).alias("best"))
    links = links.select("class_id", "links", (-F.col("best.other")).alias("best_class"), F.col("best.score").alias("best_score"))
    mine = classed.select("doc_id", "block_size", F.col("rep").alias("class_id"))
    return mine.join(links, "class_id", "left").select("doc_id", "block_size", "class_id", F.coalesce("links", F.lit(0)).alias("links"), "best_class", "best_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_of(fingerprints(table(spark, sf_dir, "documents")))
