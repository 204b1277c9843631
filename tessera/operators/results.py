"""Results for people and programs: capped rows, counts, statistics, JSON."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are shown of a result; counting goes on.
DISPLAY_CAP = 1000


def result_stats(df: DataFrame) -> DataFrame:
    """One row: rows, cells, non-empty cells, their bytes in UTF-8, share filled, and bytes per
    cell, empty ones included."""
    cells = [F.col(f"`{c}`") for c in df.columns]
    full = sum((F.when(c.isNotNull() & (F.length(c) > 0), 1).otherwise(0) for c in cells), F.lit(0))
    chars = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in cells), F.lit(0))
    sums = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(full), F.lit(0)).cast("long").alias("filled"), F.coalesce(F.sum(chars), F.lit(0)).cast("long").alias("chars"))
    total = F.col("rows") * len(df.columns)
    share = F.when(total > 0, F.round(100.0 * F.col("filled") / total, 2)).otherwise(0.0)
    mean = F.when(total > 0, F.round(F.col("chars") / total, 2)).otherwise(0.0)
    return sums.select("rows", total.alias("cells"), "filled", "chars", share.alias("filled_percent"), mean.alias("mean_chars"))


@dataclass
class Shown:
    columns: list[str]
    rows: list[list[str | None]]
    count: int
    truncated: bool
    elapsed_ms: float

    def as_dict(self, cap: int = DISPLAY_CAP) -> dict:
        filled = [len(v.encode()) for r in self.rows for v in r if v]
        width = len(self.columns)
        cells = len(self.rows) * width
        return {
            "ok": True,
            "head": {"vars": [f"?{c}" for c in self.columns]},
            "results": {"bindings": self.rows, "count": self.count, "returned_count": len(self.rows), "truncated": self.truncated, "truncated_limit": cap},
            "metrics": {"elapsed_ms": round(self.elapsed_ms, 3)},
            "query_stats": {
                "row_count": self.count, "returned_row_count": len(self.rows), "column_count": width, "cell_count": cells, "total_cell_count": self.count * width,
                "non_empty_cells": len(filled), "non_empty_ratio_percent": 100 * len(filled) / cells if cells else 0.0, "avg_value_chars": sum(filled) / cells if cells else 0.0,
                "truncated": self.truncated, "truncated_limit": cap,
            },
        }

    def as_json(self, cap: int = DISPLAY_CAP) -> str:
        return json.dumps(self.as_dict(cap), ensure_ascii=False)


def show(df: DataFrame, cap: int = DISPLAY_CAP) -> Shown:
    """At most ``cap`` rows, and how many there are. Short results take one job; only a longer
    one is counted by another."""
    began = time.perf_counter()
    rows = [list(r) for r in df.limit(cap + 1).collect()]
    more = len(rows) > cap
    count = df.count() if more else len(rows)
    return Shown(df.columns, rows[:cap], count, more, 1000 * (time.perf_counter() - began))


def capped(df: DataFrame, cap: int = DISPLAY_CAP) -> DataFrame:
    """One row: count, returned_count, truncated."""
    return df.agg(F.count("*").alias("count")).select("count", F.least("count", F.lit(cap).cast("long")).alias("returned_count"), (F.col("count") > cap).alias("truncated"))


def stream_rows(df: DataFrame, on_row: Callable[[list], None], max_rows: int | None = None) -> int:
    """Call ``on_row`` with each row, one partition in memory at a time; the number of rows."""
    n = 0
    for r in iterate(df if max_rows is None else df.limit(max_rows)):
        on_row(r)
        n += 1
    return n


def iterate(df: DataFrame) -> Iterator[list]:
    return (list(r) for r in df.toLocalIterator(prefetchPartitions=True))


def print_result(df: DataFrame, cap: int = DISPLAY_CAP, rows: bool = True) -> int:
    """Header and rows as text (or only the count); returns the count."""
    shown = show(df, cap)
    if rows:
        print("\t".join(f"?{c}" for c in shown.columns))
        for r in shown.rows:
            print("\t".join("" if v is None else str(v) for v in r))
    print(f"{shown.count} rows in {shown.elapsed_ms:.1f} ms")
    return shown.count
