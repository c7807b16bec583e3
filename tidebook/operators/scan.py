"""Ordered running computations that survive a hot key.

A plain ``OVER (PARTITION BY key ORDER BY ts)`` sends a whole key to one task. Here every key
is first cut into *slices* along the order axis (time slices or arrival-ordinal slices, derived
from the data and so identical on every retry). Running values are computed inside each
(key, slice); one partially aggregated summary row per slice is scanned per key and carried into
the next slice. The rows are shuffled once, on (key, slice); only summaries are shuffled by key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Running:
    """One running output: ``kind`` over ``value``, optionally excluding the current row."""

    name: str
    kind: str  # sum | count | max | min | any | last | first | prev
    value: Column
    exclusive: bool = False


def _total(kind: str, value: Column, order: Column, reverse: bool) -> Column:
    latest, earliest = (F.min_by, F.max_by) if reverse else (F.max_by, F.min_by)
    if kind == "sum":
        return F.sum(value)
    if kind == "count":
        return F.count(value)
    if kind in ("max", "any"):
        return F.max(value)
    if kind == "min":
        return F.min(value)
    if kind == "prev":
        return latest(value, order)
    if kind == "last":
        return latest(value, F.when(value.isNotNull(), order))
    if kind == "first":
        return earliest(value, F.when(value.isNotNull(), order))
    raise ValueError(f"unknown running kind {kind!r}")


def _over(kind: str, value: Column, window) -> Column:
    if kind == "sum":
        return F.sum(value).over(window)
    if kind == "count":
        return F.count(value).over(window)
    if kind in ("max", "any"):
        return F.max(value).over(window)
    if kind == "min":
        return F.min(value).over(window)
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return F.first(value, ignorenulls=True).over(window)


def _merge(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    if kind == "any":
        return F.coalesce(carry, F.lit(False)) | F.coalesce(local, F.lit(False))
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    if kind == "first":
        return F.coalesce(carry, local)
    return F.coalesce(local, carry)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    outputs: Sequence[Running],
    reverse: bool = False,
    peers: bool = False,
) -> DataFrame:
    """Append running columns to ``df``. ``slice_by`` must be non-decreasing along ``order``.

    NULL keys carry no group and are dropped. With ``peers`` rows equal in ``order`` see each other.
    """
    keys = list(keys)
    values = {}
    for i, o in enumerate(outputs):
        values[f"__v{i}"] = o.value
    src = df.filter(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    src = src.withColumns({"__slice": slice_by, **values})

    def direction(c):
        return F.col(c).desc() if reverse else F.col(c).asc()

    part = [*keys, "__slice"]
    inside = Window.partitionBy(*part).orderBy(*[direction(c) for c in order])
    upto = (inside.rangeBetween if peers else inside.rowsBetween)(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    order_key = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])

    columns = {
        f"__l{i}": F.lag(f"__v{i}").over(inside) if o.kind == "prev" else _over(o.kind, F.col(f"__v{i}"), before if o.exclusive else upto)
        for i, o in enumerate(outputs)
    }
    if any(o.kind == "prev" for o in outputs):
        columns["__n"] = F.row_number().over(inside)
    local = src.withColumns(columns)
    summary = src.groupBy(*part).agg(
        *[_total(o.kind, F.col(f"__v{i}"), order_key, reverse).alias(f"__t{i}") for i, o in enumerate(outputs)]
    )
    neighbour = Window.partitionBy(*keys).orderBy(direction("__slice"))
    across = neighbour.rowsBetween(Window.unboundedPreceding, -1)
    carry_kind = {"count": "sum"}
    carry = summary.select(
        *part,
        *[
            # every slice has a row, so the previous slice's last row is the predecessor, NULL or not
            (F.lag(f"__t{i}").over(neighbour) if o.kind == "prev" else _over(carry_kind.get(o.kind, o.kind), F.col(f"__t{i}"), across)).alias(f"__c{i}")
            for i, o in enumerate(outputs)
        ],
    )
    joined = local.join(carry, part)
    merged = {}
    for i, o in enumerate(outputs):
        carried, own = F.col(f"__c{i}"), F.col(f"__l{i}")
        merged[o.name] = F.when(F.col("__n") == 1, carried).otherwise(own) if o.kind == "prev" else _merge(o.kind, carried, own)
    keep = [c for c in df.columns if c not in merged]
    return joined.select(*[F.col(c) for c in keep], *[m.alias(n) for n, m in merged.items()])


#: place of rows without a position
NOWHERE = -(2**62)


def trailing(df: DataFrame, keys: Sequence[str], pos: str, width: int, sums: Mapping[str, tuple[Column, int, int]]) -> DataFrame:
    """Append whole-number sums over trailing ranges: ``sums`` names (value, far, near), the sum of ``value`` over the rows whose
    integer position lies from ``far`` to ``near`` behind a row's own, both included.

    A row enters a sum ``near`` past its position and leaves it beyond ``far``, so every sum is a running total of what came and went,
    and a row costs the same however many rows its range holds. Slices are ``width`` long. As in a RANGE frame, equal positions see
    each other, and rows without a key or without a position are among themselves.
    """
    steps: dict[int, dict[str, Column]] = {0: {}}
    for name, (value, far, near) in sums.items():
        steps.setdefault(near, {})[name] = value
        steps.setdefault(far + 1, {})[name] = -value
    step = lambda by, own: F.struct(F.lit(by).cast("bigint").alias("__by"), *[own.get(n, F.lit(0)).cast("bigint").alias(n) for n in sums])
    lines = df.select("*", F.inline(F.array(*[step(by, own) for by, own in steps.items()])))
    group = {f"__k{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(keys)} | {f"__u{i}": F.col(k).isNull() for i, k in enumerate(keys)}
    lines = lines.withColumns({**group, "__at": F.coalesce(F.col(pos), F.lit(NOWHERE)) + F.col("__by")})
    out = running(lines, list(group), ["__at"], F.floor(F.col("__at") / width), [Running(n, "sum", F.col(n)) for n in sums], peers=True)
    return out.filter(F.col("__by") == 0).select(*df.columns, *sums)


def with_halo(df: DataFrame, pos: Column, width, reach) -> DataFrame:
    """Copy rows lying within ``reach`` of the next slice into it, so trailing range frames are local.

    ``pos`` is the integer position on the order axis, ``width`` the slice width; ``reach`` must not
    exceed ``width``. Adds ``__slice`` and ``__halo`` (true on the copies, to be filtered after use).
    """
    home = F.floor(pos / width).cast("bigint")
    near = (pos - home * width) >= (width - reach)
    targets = F.when(
        near, F.array(F.struct(home.alias("s"), F.lit(False).alias("h")), F.struct((home + 1).alias("s"), F.lit(True).alias("h")))
    ).otherwise(F.array(F.struct(home.alias("s"), F.lit(False).alias("h"))))
    return (
        df.withColumn("__t", F.explode(targets))
        .withColumn("__slice", F.col("__t.s"))
        .withColumn("__halo", F.col("__t.h"))
        .drop("__t")
    )


def global_rank(df: DataFrame, order: Sequence[str], slice_by: Column, name: str) -> DataFrame:
    """Dense 1-based position in a total order without a single-partition window."""
    tagged = df.withColumn("__all", F.lit(1))
    out = running(tagged, ["__all"], order, slice_by, [Running(name, "count", F.lit(1))])
    return out.drop("__all")
