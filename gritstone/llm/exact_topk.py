"""Exact top-k search: every vector against every other, by tiles of matrix products.

Vectors are laid into tiles of ``TILE`` rows. A task holds up to ``FAN`` query tiles with the lists of their k best and
streams all tiles past them, so lists are neither shuffled nor stored, and a tile is read once for each such group.

A pair of tiles is multiplied in single precision first. What it gives differs from the true product by less than a
bound that follows from the length of the vectors; only pairs that come within it of a query's k-th best are multiplied
again in double precision and may enter the list. No other pair can belong there, so the result is that of multiplying
all pairs in double precision. Work is still one product for every pair of vectors, quadratic by definition.

Scores are cosines rounded to ``DIGITS`` decimals, which makes the order the same whatever the tiling; ties fall
to the lower vec_id.

Defined cases. Every row with a vec_id and a usable embedding is a query and a candidate; a null or empty embedding, one
with a null, NaN or infinite part, and a null vec_id are neither. Only vectors of one length are compared. A zero
vector scores 0 with everything. A row isn't its own neighbour; other rows of its vec_id aren't either. Rows that
repeat a vec_id are one vector: the first in order. With fewer than k others all of them are listed. Only vec_id
and embedding are read. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.llm.common import arrow_batches, stored, table

K, TILE, DIGITS, FAN = 10, 2048, 6, 16
#: Queries of a tile that meet another tile at a time, so that their products stay in the processor's cache.
STRIP = 256
#: Bytes of query tiles that a task holds, whatever their number, and of vectors multiplied again at a time.
HELD_BYTES, AGAIN_BYTES = 64 << 20, 8 << 20
_NO_ID = np.iinfo(np.int64).max


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of (n, m) scores, by score and then id; -1 marks no entry. Everything that ties with the k-th takes part."""
    if scores.shape[1] > 4 * k:
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        wide = int((scores >= edge).sum(1).max())
        at = np.argpartition(-scores, min(wide, scores.shape[1] - 1), axis=1)[:, : wide + 1] if wide < scores.shape[1] else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
        scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(np.broadcast_to(ids, (len(scores), ids.shape[-1])), at, 1)
    else:
        ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


class Lists:
    """The k best so far of each query of one tile, by score and then id; minus infinity marks no entry."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int) -> None:
        self.ids, self.rows, self.single, self.k = ids, rows, rows.astype(np.float32), k
        self.found, self.scores = np.full((len(ids), k), _NO_ID), np.full((len(ids), k), -np.inf)
        # Twice the error bound of a single-precision product of unit vectors, and what rounding two scores can shift.
        self.slack = 2 * (rows.shape[1] + 8) * 2.0**-24 + 10.0**-DIGITS

    def meet(self, ids: np.ndarray, rows: np.ndarray, single: np.ndarray) -> None:
        """Let another tile's vectors, or the tile's own, into the lists."""
        n, k = len(ids), self.k
        own = np.array_equal(ids, self.ids)
        products, near = np.empty((STRIP, n), np.float32), np.zeros((STRIP, -(-n // 8) * 8), bool)
        for at in range(0, len(self.ids), STRIP):
            queries = np.arange(at, min(at + STRIP, len(self.ids)))
            m = len(queries)
            product = np.matmul(self.single[queries[0] : at + m], single.T, out=products[:m])
            if own:
                product[queries - at, queries] = -np.inf
            bar = self.scores[queries, -1] - self.slack
            if n > k and np.isneginf(bar).any():
                bar = np.maximum(bar, np.partition(product, n - k, axis=1)[:, n - k] - 2 * self.slack)
            np.greater_equal(product, bar.astype(np.float32)[:, None], out=near[:m, :n])
            words = near[:m].reshape(-1, 8)  # few are set: eight are looked at as one
            full = np.flatnonzero(words.view(np.uint64).ravel() != 0)
            word, bit = np.nonzero(words[full])
            query, other = np.divmod(full[word] * 8 + bit, near.shape[1])
            self.enter(at + query, ids, other, self.again(at, query, rows, other, m))

    def again(self, at: int, query: np.ndarray, rows: np.ndarray, other: np.ndarray, m: int) -> np.ndarray:
        """Rounded scores, in double precision, of pairs of a query of the strip of m from ``at`` on and another vector."""
        scores = np.empty(len(query))
        if 8 * len(query) > m * len(rows):  # crowded: cheaper at once
            scores[:] = (self.rows[at : at + m] @ rows.T)[query, other]
        else:
            step = max(1, AGAIN_BYTES // (8 * rows.shape[1]))
            for i in range(0, len(query), step):
                np.einsum("ij,ij->i", self.rows[at + query[i : i + step]], rows[other[i : i + step]], out=scores[i : i + step])
        return np.round(scores, DIGITS) + 0.0

    def enter(self, query: np.ndarray, ids: np.ndarray, other: np.ndarray, scores: np.ndarray) -> None:
        """Keep of pairs of a query, in order, and another vector those that are among the k best."""
        found = ids[other]
        last, last_id = self.scores[query, -1], self.found[query, -1]
        keep = (found != self.ids[query]) & ((scores > last) | (scores == last) & (found < last_id))  # a vector isn't its own neighbour
        query, scores, found = query[keep], scores[keep], found[keep]
        if not len(query):
            return
        changed, row, count = np.unique(query, return_inverse=True, return_counts=True)
        place = self.k + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        all_ids, all_scores = (np.full((len(changed), self.k + count.max()), x) for x in (_NO_ID, -np.inf))
        all_ids[:, : self.k], all_scores[:, : self.k] = self.found[changed], self.scores[changed]
        all_ids[row, place], all_scores[row, place] = found, scores
        self.found[changed], self.scores[changed] = best(all_ids, all_scores, self.k)


def tiles(vectors: DataFrame, tile: int = TILE) -> DataFrame:
    """dims, tile, ids, rows: vectors in blocks of about ``tile`` rows, as binary; in single precision if they come so."""
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    clean = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if single else 'double'}>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable)
    clean = clean.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dims", F.size("embedding"))
    sizes = {r["dims"]: r["count"] for r in clean.groupBy("dims").count().collect()}  # one row a length of vector
    parts = F.lit(1)
    for dims, n in sizes.items():
        parts = F.when(F.col("dims") == dims, -(-n // tile)).otherwise(parts)

    def block(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        m = np.stack(part["embedding"].to_numpy()).astype(np.float32 if single else np.float64)
        return pd.DataFrame({"dims": part["dims"].iloc[:1], "tile": part["tile"].iloc[0], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "rows": [m.tobytes()]})

    return clean.withColumn("tile", F.pmod(F.xxhash64("vec_id"), parts).cast("int")).groupBy("dims", "tile").applyInPandas(block, "dims int, tile int, ids binary, rows binary")


def unit(dims: int, ids: pa.Scalar, rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """The ids and normalised vectors of a tile."""
    of = np.frombuffer(ids.as_buffer(), np.int64)
    m = np.frombuffer(b := rows.as_buffer(), f"f{b.size // (len(of) * dims)}").reshape(-1, dims).astype(np.float64)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return of.copy(), np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def top_k(vectors: DataFrame, k: int = K, tile: int = TILE, fan: int = FAN) -> DataFrame:
    """vec_id, rank (from 1), neighbour_id, score: the k most similar vectors of every vector."""
    laid = stored(tiles(vectors, tile), "tiles")
    there = laid.agg(F.count("*").alias("n"), F.coalesce(F.max("dims"), F.lit(1)).alias("dims")).first()
    held = max(1, min(fan, HELD_BYTES // (12 * tile * there["dims"])))
    tasks = max(1, -(-there["n"] // held), min(there["n"], 4 * vectors.sparkSession.sparkContext.defaultParallelism))
    queries = laid.repartitionById(tasks, F.pmod(F.col("tile") + F.col("dims"), F.lit(tasks)).cast("int"))
    # One partition that streams: each task reads all of it, a tile at a time, past the query tiles of its own.
    shards = laid.select(F.col("dims").alias("s_dims"), F.col("tile").alias("node"), F.col("ids").alias("s_ids"), F.col("rows").alias("s_rows")).coalesce(1)
    # Not an equality: with one length of vectors that would bring all pairs into one task.
    pairs = shards.hint("shuffle_replicate_nl").crossJoin(queries).filter(F.abs(F.col("dims") - F.col("s_dims")) < 1).select("dims", "tile", "ids", "rows", "node", "s_ids", "s_rows")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[tuple[int, int], Lists] = {}
        shard, last = (), None
        for batch in batches:
            for dims, tile, ids, rows, node, s_ids, s_rows in zip(*batch.columns, strict=True):
                query, now = (dims.as_py(), tile.as_py()), (dims.as_py(), node.as_py())
                if query not in lists:
                    lists[query] = Lists(*unit(query[0], ids, rows), k)
                if now != last:
                    of, m = unit(query[0], s_ids, s_rows)
                    shard, last = (of, m, m.astype(np.float32)), now
                lists[query].meet(*shard)
        for x in lists.values():
            real = np.isfinite(x.scores)
            out = [np.repeat(x.ids, k)[real.ravel()], np.tile(np.arange(1, k + 1, dtype=np.int32), len(x.ids))[real.ravel()], x.found[real], x.scores[real]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["vec_id", "rank", "neighbour_id", "score"])

    return arrow_batches(pairs, search, "vec_id bigint, rank int, neighbour_id bigint, score double", 8)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_inner_product(a.e, b.e) / (a.n * b.n), {DIGITS}) + 0.0 AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour_id) AS n FROM p)
SELECT vec_id, n::INTEGER AS rank, neighbour_id, score FROM r WHERE n <= {K}"""
