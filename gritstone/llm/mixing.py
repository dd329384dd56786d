"""Mixing sources to target weights by fitting each source's token budget exactly.

Documents are counted by source and exact token length. Each source's budget is its share of the whole one by
weight; what a source is too small to give goes to the others by their weights. Within a source lengths give
documents in proportion until ``WINDOW`` tokens are left, and a bounded-knapsack dynamic program over the
documents still free finds the subset whose lengths come closest to those, exactly hit wherever a subset does.
The documents of each length are then those of the lowest seeded hashes.

All but the weights runs on executors: one task per source sees its histogram only. The driver holds one number
a source.

Defined cases. Rows without a doc_id are left out; rows that repeat a doc_id are one document, the one of the
lowest source and token count. A null source is a source of its own. Texts of no tokens are never chosen. A
source without a weight gets none of the budget. Ties in the seeded hash fall to the lower doc_id. Only doc_id,
source and text are read; ``mix`` keeps all columns. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.llm.common import hash_order, hash_part, small_side, stored, table, with_ids
from gritstone.llm.tokens import VOCABULARY, count_tokens

WINDOW, SHARE, SEED = 1 << 15, 0.5, 17
#: Documents of one source and length that one task ranks, about.
RANKED = 1 << 21


def budgets(available: Mapping[str | None, int], weights: Mapping[str | None, float] | None, total: int) -> dict[str | None, int]:
    """Tokens for each source: by weight, never more than it has, the shortfall shared out among the rest."""
    weight = {s: 1.0 if weights is None else float(weights.get(s, 0.0)) for s in available}
    given, open_ = {}, {s for s in available if weight[s] > 0}
    while open_:
        left, scale = total - sum(given.values()), sum(weight[s] for s in open_)
        short = {s for s in open_ if left * weight[s] / scale >= available[s]}
        if not short:
            given |= {s: int(left * weight[s] / scale) for s in open_}
            break
        given |= {s: available[s] for s in short}
        open_ -= short
    return {s: given.get(s, 0) for s in available}


def closest_subset(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take, of at most ``counts``, so that the sum is the largest that doesn't exceed ``budget``: bounded knapsack over sums."""
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by, used = np.full(budget + 1, -1, np.int32), np.zeros(budget + 1, np.int32)
    for i in range(len(lengths)):
        n = int(lengths[i])
        if n > budget or not counts[i]:
            continue
        fresh = np.flatnonzero(reached[: budget + 1 - n]) + n  # sums with one copy
        copies = 1
        while True:
            fresh = fresh[~reached[fresh]]
            if not len(fresh):
                break
            reached[fresh], by[fresh], used[fresh] = True, i, copies
            copies += 1
            if copies > counts[i]:
                break
            fresh = fresh[fresh + n <= budget] + n
        if reached[budget]:
            break
    take, at = np.zeros(len(lengths), np.int64), int(np.flatnonzero(reached)[-1])
    while at:
        i = by[at]
        take[i] += used[at]
        at -= int(used[at]) * int(lengths[i])
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED, window: int = WINDOW) -> np.ndarray:
    """How many documents of each of the ascending lengths come closest to ``budget`` tokens without exceeding it.

    The share of every length is carried on to the next where it isn't whole, from a seeded start, so at any length
    the documents taken so far are within one of their share: no length is favoured, even where each has one
    document. The last ``window`` tokens, an eighth of the budget at most, and what rounding left, are for the
    knapsack, which tries lengths in a seeded order."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    r = np.random.Generator(np.random.PCG64(seed))
    share = (budget - min(window, budget // 8)) / total
    ends = np.floor(np.cumsum(counts) * share + r.random()).astype(np.int64)
    take = np.minimum(np.diff(ends, prepend=0), counts)
    left = budget - int((lengths * take).sum())
    for i in range(len(lengths) - 1, -1, -1):  # only where a document is longer than the window
        if left >= 0:
            break
        less = min(int(take[i]), -(left // int(lengths[i])))
        take[i] -= less
        left += less * int(lengths[i])
    order = r.permutation(len(lengths))
    take[order] += closest_subset(lengths[order], (counts - take)[order], left)
    return take


def choose(lengths: DataFrame, weights: Mapping[str | None, float] | None = None, total: int | None = None, share: float = SHARE, seed: int = SEED, ranked: int = RANKED) -> DataFrame:
    """doc_id, source, n_tokens of the chosen documents, of lengths (doc_id, source, n_tokens)."""
    held = stored(lengths.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("x")).select("doc_id", "x.source", "x.n_tokens").filter("n_tokens > 0"), "lengths")
    counts = stored(held.groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "histogram")
    available = {r["source"]: int(r["tokens"]) for r in counts.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens")).collect()}  # one row a source
    goal = budgets(available, weights, int(sum(available.values()) * share) if total is None else total)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n_tokens", ignore_index=True)
        source = part["source"].iloc[0]
        budget = goal[None if pd.isna(source) else source]
        part["take"] = fit_budget(part["n_tokens"].to_numpy(np.int64), part["n"].to_numpy(np.int64), budget, seed)
        return part[["source", "n_tokens", "n", "take"]]

    # A length of a source is ranked in ranges of the seeded hash that orders it, as many as its documents need.
    fitted = counts.groupBy("source").applyInPandas(fit, "source string, n_tokens bigint, n bigint, take bigint")
    take = stored(fitted.filter("take > 0").select(F.col("source").alias("s"), F.col("n_tokens").alias("length"), "take", F.ceil(F.col("n") / ranked).cast("int").alias("parts")), "take")
    order = hash_order(F.lit(seed), "doc_id")
    drawn = held.join(small_side(take), F.col("source").eqNullSafe(F.col("s")) & (F.col("n_tokens") == F.col("length"))).withColumn("part", hash_part(F.col("parts"), F.lit(seed), "doc_id"))
    keys = ["source", "n_tokens", "part"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "doc_id"))
    if take.filter("parts > 1").isEmpty():
        return drawn.withColumn("rank", rank).filter("rank <= take").select("doc_id", "source", "n_tokens")
    sizes = drawn.groupBy(*keys).agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("source", "n_tokens").orderBy("part")) - F.col("size")
    before = stored(sizes.select(F.col("source").alias("s2"), F.col("n_tokens").alias("length2"), F.col("part").alias("part2"), before.alias("before")), "before")
    at = F.col("source").eqNullSafe(F.col("s2")) & (F.col("n_tokens") == F.col("length2")) & (F.col("part") == F.col("part2"))
    # Ranges that lie wholly beyond what is taken go before anything is sorted.
    return drawn.join(small_side(before), at).filter("before < take").withColumn("rank", rank + F.col("before")).filter("rank <= take").select("doc_id", "source", "n_tokens")


def chosen(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: int | None = None, share: float = SHARE, seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    named = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    return choose(count_tokens(named, vocabulary, "source"), weights, total, share, seed)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The chosen documents with all their columns."""
    return with_ids(docs, chosen(docs, **how).select("doc_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(table(spark, sf_dir, "documents"))
