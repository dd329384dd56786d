"""Composition of match sets and shaping of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")


def any_of(*sets: DataFrame) -> DataFrame:
    """Union without repeats."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()


def all_in_scope(scope: str, *sets: DataFrame, item: str) -> DataFrame:
    """Scopes in which every set has a match; b1.., b2.. list each set's items in order, as text."""
    out = None
    for i, s in enumerate(sets, 1):
        one = s.groupBy(scope).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.cast("string")), ",").alias(f"b{i}"))
        out = one if out is None else out.join(one, scope)
    return out


def first_branch(rows: DataFrame, site: Sequence[str], branch: str) -> DataFrame:
    """Of matches at one site only those of its first branch stay; repeats within that branch do too.

    Sites that several branches share are counted out first, so rows aren't brought together by site: one that most rows share is no single task. The rows are read twice."""
    shared = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in site]).agg(F.min(branch).alias("__low"), F.max(branch).alias("__high")).filter("__low < __high").drop("__high")
    on = F.col(branch) > F.col("__low")
    for c in site:
        on &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(shared, on, "left_anti")


def difference(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, change ('added' or 'removed') between two tables."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return b.join(a, list(keys), "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, list(keys), "left_anti").withColumn("change", F.lit("removed")))


def first_wins(rows: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """One row a key: the first in order, as the most derived definition overrides the others."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def severity_rank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        out = F.when(F.upper(c) == s, i).otherwise(out)
    return out


def glob(c: str, pattern: str) -> Column:
    """Whole-string match of * and ? globs."""
    out = "".join(".*" if x == "*" else "." if x == "?" else x if x.isalnum() or x in "_-" else "\\" + x for x in pattern)
    return F.col(c).rlike(f"^(?:{out})$")
