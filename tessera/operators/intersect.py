"""Intersections: of sets of values, and of adjacency lists to extend partial solutions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intersect_sets(sets: list[DataFrame], column: str = "value") -> DataFrame:
    """Values that are in every one of ``sets`` (one column each): the first is reduced by semi
    joins, which the optimiser may broadcast; no set is gathered."""
    if not sets:
        raise ValueError("nothing to intersect")
    named = [s.toDF(column) for s in sets]
    return reduce(lambda a, b: a.join(b, column, "left_semi"), named).distinct()


def adjacency(edges: DataFrame, key: str, value: str) -> DataFrame:
    """(key, list): the values beside each key."""
    return edges.groupBy(key).agg(F.collect_list(value).alias(f"list_{value}"))


def extend(partial: DataFrame, value: str, edges: list[tuple[DataFrame, str]], max_degree: int) -> DataFrame | None:
    """One worst-case-optimal step: for each partial solution, the values that every edge set
    (its DataFrame, and its bound column) has beside the bound column. None if some list would be
    longer than ``max_degree``: then joins are the better way, as they split long lists."""
    for df, key in edges:
        if df.groupBy(key).count().filter(F.col("count") > max_degree).limit(1).count():
            return None
    out = partial
    names = []
    for i, (df, key) in enumerate(edges):
        lists = df.groupBy(key).agg(F.collect_list(value).alias(f"list{i}"))
        out = out.join(lists, key)
        names.append(f"list{i}")
    shared = reduce(F.array_intersect, map(F.col, names))
    return out.withColumn(value, F.explode(shared)).drop(*names)


def first_values(columns: list[DataFrame]) -> DataFrame:
    """Candidates of the first variable: what all its patterns allow."""
    return intersect_sets(columns)
