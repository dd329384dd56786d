"""Structural operators on interval-labelled trees: sweeps along a tree for ancestors and descendants, joins with an equality for children.

A node has its tree (``root``), ``pre`` (depth-first number) and ``post`` (largest ``pre`` below it); d is below a when a.pre < d.pre <= a.post.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _along(root: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*root).orderBy("pre")


def has(inner: Column, root: Sequence[str] = ("root",)) -> Column:
    """Whether a node has a strict descendant that ``inner`` holds for: the next such node on the way through the tree lies within its span.

    One sweep of all nodes of a tree in order decides it for each: no join, and nodes that are sorted already aren't again."""
    later = _along(root).rowsBetween(1, Window.unboundedFollowing)
    return F.coalesce(F.min(F.when(inner, F.col("pre"))).over(later) <= F.col("post"), F.lit(False))


def inside(outer: Column, root: Sequence[str] = ("root",)) -> Column:
    """Whether a node has a strict ancestor that ``outer`` holds for: of such nodes before it, the span that reaches farthest reaches it."""
    earlier = _along(root).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(outer, F.col("post"))).over(earlier) >= F.col("pre"), F.lit(False))


def first_descendant(nodes: DataFrame, inner: DataFrame, keys: Sequence[str], carry: Sequence[str], root: Sequence[str] = ("root",)) -> DataFrame:
    """keys of each node with the first descendant (lowest pre) in ``inner``, its ``carry`` columns prefixed hit_."""
    found = inner.select(*[F.col(c).alias(f"__{c}") for c in root], F.col("pre").alias("__pre"), *[F.col(c).alias(f"__hit_{c}") for c in carry])
    below = (F.col("__pre") > F.col("pre")) & (F.col("__pre") <= F.col("post"))
    for c in root:
        below &= F.col(c) == F.col(f"__{c}")
    got = nodes.join(found, below).groupBy(*keys).agg(F.min(F.struct("__pre", *[f"__hit_{c}" for c in carry])).alias("h"))
    return got.select(*keys, *[F.col(f"h.__hit_{c}").alias(f"hit_{c}") for c in carry])


def child_at(parents: DataFrame, children: DataFrame, key: str, position: Column) -> DataFrame:
    """Parents of which the child at a position matches: ``children`` is filtered, ``position`` picks the place."""
    return parents.join(children.filter(position).select(F.col(key).alias("__child_of")), F.col(key) == F.col("__child_of"), "left_semi")


def any_child(parents: DataFrame, *witnesses: DataFrame, key: str) -> DataFrame:
    """Parents for which each set of children has a witness; the witnesses are independent of each other."""
    for w in witnesses:
        parents = parents.join(w.select(F.col(key).alias("__child_of")), F.col(key) == F.col("__child_of"), "left_semi")
    return parents


def interval_tree(levels: DataFrame, root: str, order: Sequence[str | Column]) -> DataFrame:
    """Add pre to rows that are sorted within their tree by ``order``; a root's own row must sort first."""
    return levels.withColumn("pre", F.row_number().over(Window.partitionBy(root).orderBy(*order)) - 1)
