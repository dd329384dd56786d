"""Ordered pattern search: step i + 1 strictly after step i, in each scope, with the first witnesses.

The earliest match of a step is the best start for the next, so k steps are k aggregations, each partial before its
shuffle, joined with one row a scope. No window sorts a scope, and a large scope is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sequence(rows: DataFrame, scope: str, order: Sequence[str], steps: Sequence[Column]) -> DataFrame:
    """scope, and for each step the ``order`` columns of its first witness (s1_.., s2_..). Scopes without a match are left out."""
    place = F.struct(*[F.col(c) for c in order])
    found = rows.filter(steps[0]).groupBy(F.col(scope).alias("__k")).agg(F.min(place).alias("s1"))
    for i, step in enumerate(steps[1:], 2):
        later = rows.filter(step).join(found, (F.col(scope) == F.col("__k")) & (place > F.col(f"s{i - 1}")))
        found = later.groupBy("__k", *[f"s{j}" for j in range(1, i)]).agg(F.min(place).alias(f"s{i}"))
    return found.select(F.col("__k").alias(scope), *[F.col(f"s{i}.{c}").alias(f"s{i}_{c}") for i in range(1, len(steps) + 1) for c in order])


def sequence_on_one_path(rows: DataFrame, scope: str, order: Sequence[str], first: Column, second: Column, arm: Column) -> DataFrame:
    """The two-step search where both witnesses must be able to run together: their ``arm`` is the same, or one of them has none (null).

    Best starts are kept by arm: an earliest first step for each arm and one for all."""
    place = F.struct(*[F.col(c) for c in order])
    starts = rows.filter(first).groupBy(F.col(scope).alias("__k"), arm.alias("__a")).agg(F.min(place).alias("s1"))
    later = rows.filter(second).select(F.col(scope).alias("__k2"), arm.alias("__b"), place.alias("s2"))
    pairs = later.join(starts, (F.col("__k") == F.col("__k2")) & (F.col("s2") > F.col("s1")) & (F.col("__a").isNull() | F.col("__b").isNull() | (F.col("__a") == F.col("__b"))))
    best = pairs.groupBy("__k").agg(F.min(F.struct("s1", "s2")).alias("x"))
    return best.select(F.col("__k").alias(scope), *[F.col(f"x.{s}.{c}").alias(f"{s}_{c}") for s in ("s1", "s2") for c in order])
