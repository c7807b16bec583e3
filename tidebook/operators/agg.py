"""Per-window aggregation that stays on hash aggregation.

String values in an aggregation buffer force a sort; strings as grouping keys do not. Descriptive strings
are therefore grouped on first, next to fixed-width aggregates, and the few resulting rows per window are
merged in a second, tiny step that also resolves windows whose description varies between rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level1(kind: str, v: Column, at: Column):
    if kind == "first":
        return [F.min_by(v, at)]
    if kind == "last":
        return [F.max_by(v, at)]
    if kind == "first_valid":
        o = F.when(v.isNotNull(), at)
        return [F.min_by(v, o), F.min(o)]
    if kind == "last_valid":
        o = F.when(v.isNotNull(), at)
        return [F.max_by(v, o), F.max(o)]
    return [{"min": F.min, "max": F.max, "sum": F.sum, "count": F.count_if}[kind](v)]


def by_window(df: DataFrame, keys: Sequence[str], meta: Sequence[str], at: Column, specs: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """``specs``: name → (first | last | first_valid | last_valid | min | max | sum | count, value)."""
    one = [F.min(at).alias("__lo"), F.max(at).alias("__hi")]
    for name, (kind, v) in specs.items():
        parts = _level1(kind, v, at)
        one += [p.alias(name if i == 0 else f"__o_{name}") for i, p in enumerate(parts)]
    a = df.groupBy(*keys, *meta).agg(*one)
    c = F.col
    two = [F.min_by(c(m), F.when(c(m).isNotNull() & (c(m) != ""), c("__lo"))).alias(m) for m in meta]
    for name, (kind, _) in specs.items():
        merged = {
            "first": lambda n=name: F.min_by(c(n), c("__lo")),
            "last": lambda n=name: F.max_by(c(n), c("__hi")),
            "first_valid": lambda n=name: F.min_by(c(n), c(f"__o_{n}")),
            "last_valid": lambda n=name: F.max_by(c(n), c(f"__o_{n}")),
            "min": lambda n=name: F.min(c(n)),
            "max": lambda n=name: F.max(c(n)),
            "sum": lambda n=name: F.sum(c(n)),
            "count": lambda n=name: F.sum(c(n)),
        }[kind]()
        two.append(merged.alias(name))
    return a.groupBy(*keys).agg(*two)
