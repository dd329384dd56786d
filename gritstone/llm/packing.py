"""Best-fit-decreasing packing of documents into training sequences of a fixed number of tokens.

Lengths are whole numbers of at most the capacity, so how best-fit decreasing runs depends only on how many
pieces there are of each length. The driver plays it over that histogram: a segment tree over remaining
capacities finds the tightest open bin, in logarithmic time, and all bins of one remainder that would be filled
alike are filled in one step. What it returns is exactly what placing document after document gives, yet its
work and memory depend on the capacity, not on the corpus. Executors then look their pieces' bins up by rank.

Defined cases. A document longer than the capacity is cut into full pieces and a rest, all of them packed;
nothing is dropped or truncated. Texts of no tokens (null or empty) take no room and are in no bin. Rows without
a doc_id are left out; rows that repeat a doc_id are packed as often as they occur. Among equal lengths the
hash of doc_id and piece, then doc_id and piece decide, however the rows lie; among equally tight bins the one that
came to that remainder first. Only doc_id and text are read. No rows in, no rows out.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.llm.common import arrow_batches, hash_order, hash_part, stored, table
from gritstone.llm.tokens import VOCABULARY, count_tokens

#: Pieces of one length that one task ranks, about.
CAPACITY, RANKED = 2048, 1 << 21


class RoomTree:
    """Segment tree over remainders 0..capacity: whether any open bin has each, and the least remainder of at least x that one has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def put(self, remainder: int, some: bool) -> None:
        at = remainder + self.size
        self.any[at] = some
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, x: int) -> int | None:
        at = x + self.size
        if self.any[at]:
            return x
        while at > 1:  # up until a sibling on the right has one, then down to its leftmost
            if at & 1 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over a histogram of lengths. Rows (length, first rank, first bin, pieces a bin, offset in the bin): the
    pieces of that length from that rank on fill bins one after another, so many in each."""
    tree, held, bins, steps = RoomTree(capacity), [deque() for _ in range(capacity + 1)], 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                first, many = bins, -(-left // (room // length))
                bins += many
            else:
                first, many = held[room].popleft()
            each = room // length
            steps.append((length, rank, first, each, capacity - room))
            full = min(many, left // each)
            rest = min(left - full * each, each - 1) if full < many else 0
            moved = [(first, full, room - each * length)] if full else []
            if rest:
                moved.append((first + full, 1, room - rest * length))
            untouched = many - full - bool(rest)
            if untouched:
                held[room].appendleft((first + full + bool(rest), untouched))
            if room < capacity or untouched:
                tree.put(room, bool(held[room]))
            for start, n, remainder in moved:
                held[remainder].append((start, n))
                tree.put(remainder, True)
            rank += full * each + rest
            left -= full * each + rest
    return np.array(steps, np.int64).reshape(-1, 5)


def pieces(lengths: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, n_tokens: whole capacities and the rest of each document."""
    n = F.expr(f"cast((n_tokens + {capacity - 1}) div {capacity} as int)")
    cut = lengths.filter("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("n_tokens"))


def pack(lengths: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """doc_id, piece, n_tokens, bin_id, bin_offset for lengths (doc_id, n_tokens)."""
    held = stored(pieces(lengths, capacity), "pieces")
    # Ranks within a length are counted within ranges of the hash they are ordered by, as many as its pieces need, and shifted by
    # the ranges before: no length, however common, is one task, and the order doesn't depend on their number.
    common = held.groupBy("n_tokens").count().select("n_tokens", F.ceil(F.col("count") / ranked).cast("int").alias("parts"))
    many = {r["n_tokens"]: r["parts"] for r in common.filter("parts > 1").collect()}  # at most capacity rows
    parts_of = F.lit(1) if not many else F.coalesce(F.create_map(*[F.lit(x) for kv in many.items() for x in kv])[F.col("n_tokens")], F.lit(1))
    held = held.withColumn("salt", hash_part(parts_of, "doc_id", "piece"))
    parts = held.groupBy("n_tokens", "salt").count().toPandas()  # at most capacity + pieces / ranked rows
    table_of = np.zeros((capacity + 1, max(many.values(), default=1)), np.int64)
    table_of[parts["n_tokens"], parts["salt"]] = parts["count"]
    before = np.cumsum(table_of, axis=1) - table_of
    totals = table_of.sum(1)
    steps = plan({int(n): int(totals[n]) for n in np.flatnonzero(totals)}, capacity)
    starts = np.lexsort((steps[:, 1], steps[:, 0]))
    steps = steps[starts]
    key = (steps[:, 0] << 44) | steps[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, salt, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_tokens", "salt", "rank"))
            rank = rank - 1 + before[n, salt]
            step = steps[np.searchsorted(key, (n << 44) | rank, "right") - 1]
            turn = rank - step[:, 1]
            bin_id, slot = step[:, 2] + turn // step[:, 3], turn % step[:, 3]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("piece"), batch.column("n_tokens"), pa.array(bin_id), pa.array((step[:, 4] + slot * n).astype(np.int32))], ["doc_id", "piece", "n_tokens", "bin_id", "bin_offset"])

    in_order = held.withColumn("rank", F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy(hash_order("doc_id", "piece"), "doc_id", "piece")))
    return arrow_batches(in_order, place, "doc_id bigint, piece int, n_tokens int, bin_id bigint, bin_offset int", 10_000)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    return pack(count_tokens(docs, vocabulary), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
