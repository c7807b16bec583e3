"""Parameter grids and sweep jobs. Grids are small driver-side lists; every evaluation is one Spark job."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import results as R
from .outcomes import Quote, outcomes
from .windows import index_quantile

# Sweep axes. Structural axes are opt-in.
AXES: dict[str, tuple] = {
    "offset": (0.010, 0.015, 0.020, 0.025, 0.030, 0.035, 0.040),
    "queue_gate": (0.0, 10.0, 25.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0),
    "thr": (0.06, 0.08, 0.10, 0.12, 0.14),
    "exit_5m": (0.06, 0.08, 0.10, 0.12, 0.14, 0.16),
    "reversal": (0.010, 0.015, 0.020, 0.025, 0.030),
    "entry_delay": ("15s", "30s", "60s", "10%", "20%"),
    "leg_chase": ("on", "off"),
    "late_entry": (0.0, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30),
}
STRUCTURAL: dict[str, tuple] = {
    "pair_cost": (0.96, 0.97, 0.98, 0.99, 1.00),
    "quote_range": ((0.00, 1.00), (0.05, 0.95), (0.10, 0.90), (0.15, 0.85), (0.20, 0.80), (0.25, 0.75), (0.30, 0.70)),
    "dead_zone_pct": (0.0, 0.05, 0.15, 0.20, 0.30),
    "dead_zone_sec": (0.0, 15.0, 30.0, 60.0, 90.0, 120.0),
    "naked_leg": ("close", "hold"),
}
#: axes that are asked for together
COMPOUND = {"dead_zone": ("dead_zone_pct", "dead_zone_sec")}
CHASE_CAP = 0.99
# Axes of the joint grid, and of random samples.
JOINT_AXES: dict[str, tuple] = {"offset": (0.015, 0.020, 0.025, 0.030), "queue_gate": (0.0, 25.0, 50.0, 100.0, 200.0, 500.0, 1000.0), "thresholds": (0.08, 0.10, 0.12, 0.14), "reversal": (0.015, 0.020)}
RANDOM_AXES: dict[str, tuple] = {
    "offset": AXES["offset"], "queue_gate": (0.0, 10.0, 25.0, 50.0, 100.0, 200.0), "thresholds": (0.06, 0.08, 0.09, 0.10, 0.11, 0.12, 0.14, 0.16),
    "reversal": (0.010, 0.015, 0.020, 0.030), "entry_delay": ("0s", *AXES["entry_delay"]), "leg_chase": ("off", "on"),
}


def thresholds(level: float, base: Quote, every: bool) -> tuple[tuple[str, float], ...]:
    """The stop thresholds that follow from the short windows' level; long windows keep the base's unless ``every`` is derived."""
    # Two series stop earlier, by 3 and 1 cents, but not below 5 and 6.
    table = {"btc-up-or-down-5m": max(0.05, round(level - 0.03, 2)), "sol-up-or-down-5m": max(0.06, round(level - 0.01, 2))}
    if every:
        table |= {k: round(level + 0.01, 2) for k in ("btc-up-or-down-15m", "sol-up-or-down-15m", "default_15m")}
    kept = {k: v for k, v in base.thr_by_slug if k not in table} or ({} if every else {"default_15m": base.thr})
    return tuple({**table, **kept, "default_5m": level}.items())


def change(base: Quote, axis: str, value) -> dict:
    """The fields that one value of an axis sets."""
    if axis == "quote_range":
        return {"lo": value[0], "hi": value[1]}
    if axis in ("exit_5m", "thresholds"):
        return {"thr_by_slug": thresholds(value, base, axis == "thresholds")}
    if axis in ("entry_delay", "late_entry"):
        text = f"{value * 100:g}%" if axis == "late_entry" else value
        number = float(text[:-1])
        return {"delay": 0.0, "delay_pct": number / 100} if text.endswith("%") and number else {"delay": number, "delay_pct": -1.0}
    if axis == "leg_chase":
        return {"max_pair": (base.max_pair or CHASE_CAP) if value == "on" else 0.0}
    if axis == "pair_cost":
        return {"max_pair": value}
    if axis.startswith("dead_zone_"):
        return {"dead_zone": value, "dead_zone_unit": axis.removeprefix("dead_zone_")}
    return {"policy" if axis == "naked_leg" else axis: value}


def _with(base: Quote, axis: str, value) -> Quote:
    return replace(base, config_id=f"{axis}={value}", **change(base, axis, value))


def ofat(base: Quote = Quote(), axes: Mapping[str, Sequence] = AXES, structural: bool = False) -> list[Quote]:
    """Baseline first, then every one-factor change away from it."""
    pool = {**axes, **(STRUCTURAL if structural else {})}
    grid = [replace(base, config_id="Baseline")]
    return grid + [q for axis, values in pool.items() for q in (_with(base, axis, v) for v in values) if q.key() != base.key()]


def only(grid: Sequence[Quote], axes: Iterable[str]) -> list[Quote]:
    """The baseline and the rows of some axes; ``dead_zone`` stands for both of its units."""
    wanted = tuple(f"{x}=" for a in axes for x in COMPOUND.get(a, (a,)))
    return [q for q in grid if q.config_id == "Baseline" or q.config_id.startswith(wanted)]


def point(base: Quote, axes: Mapping[str, Sequence], values: Sequence) -> Quote:
    """The configuration at one value of every axis."""
    q = base
    for axis, v in zip(axes, values, strict=True):
        q = _with(q, axis, v)
    return replace(q, config_id="_".join(f"{a}={v}" for a, v in zip(axes, values, strict=True)))


def joint(base: Quote, axes: Mapping[str, Sequence] = JOINT_AXES) -> list[Quote]:
    """Full product of the given axes."""
    return [point(base, axes, values) for values in itertools.product(*axes.values())]


def drawn(i: int, size: int, seed: int) -> int:
    """The ``i``-th element of a keyed permutation of range(size): a Feistel network, walked until it lands inside."""
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        left, right = i >> half, i & mask
        for turn in range(6):
            mixed = hashlib.blake2b(f"{seed}:{turn}:{right}".encode(), digest_size=8).digest()
            left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
        i = left << half | right
        if i < size:
            return i


def sampled(base: Quote, axes: Mapping[str, Sequence] = RANDOM_AXES, count: int = 50, seed: int = 42) -> list[Quote]:
    """Seeded draws from the product without replacement, baseline first; longer samples extend shorter ones.

    A draw is a place of a keyed permutation, taken apart into a digit for each axis: the product is never listed.
    """
    size, out = math.prod(map(len, axes.values())), [replace(base, config_id="Baseline")]
    for i in range(size):
        if len(out) > count:
            break
        place, values = drawn(i, size, seed), []
        for held in axes.values():
            place, digit = divmod(place, len(held))
            values.append(held[digit])
        q = point(base, axes, values)
        if q.key() != base.key():
            out.append(q)
    return out


def deduplicate(grid: Sequence[Quote]) -> list[Quote]:
    """Equal configurations keep their first label."""
    seen: set[str] = set()
    return [q for q in grid if not (q.key() in seen or seen.add(q.key()))]


def config_hash(q: Quote) -> str:
    return hashlib.sha1(q.key().encode()).hexdigest()[:12]


def run_sweep(ticks: DataFrame | None, grid: Sequence[Quote], size: int = R.MIN_SIZE, levels=None, quotes: DataFrame | None = None) -> DataFrame:
    """Every configuration over every window, reduced to one metrics row per config and level group."""
    # two consumers (totals and drawdown): write the per-window outcomes once instead of replaying ticks twice
    return R.sweep_metrics(cut(outcomes(ticks, deduplicate(grid), quotes=quotes), "sweep"), size, levels)


def split_boundary(windows: DataFrame, holdout: float) -> DataFrame:
    """One row: the start time at index floor(n*(1-holdout)) of the clocked windows."""
    return windows.filter(F.col("end_ts") > F.col("start_ts")).agg(index_quantile("start_ts", 1.0 - holdout).alias("boundary"))


def chrono_split(windows: DataFrame, holdout: float) -> DataFrame:
    """Label every window in_sample / holdout / purged / unclocked."""
    b = split_boundary(windows, holdout).withColumn("__k", F.lit(1))
    clocked = F.col("end_ts") > F.col("start_ts")
    label = (
        F.when(~F.coalesce(clocked, F.lit(False)), "unclocked")
        .when(F.col("end_ts") <= F.col("boundary"), "in_sample")
        .when(F.col("start_ts") >= F.col("boundary"), "holdout")
        .otherwise("purged")
    )
    return windows.withColumn("__k", F.lit(1)).join(F.broadcast(b), "__k").withColumn("part", label).drop("__k", "boundary")


def windows_of(quotes: DataFrame) -> DataFrame:
    return quotes.groupBy("cid").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))


def split_quotes(quotes: DataFrame, holdout: float) -> tuple[DataFrame, DataFrame]:
    """Quote ticks of the in-sample and of the hold-out windows; windows across the boundary are in neither."""
    parts = cut(chrono_split(windows_of(quotes), holdout).select("cid", "part"), "parts")
    mine = lambda part: quotes.join(parts.filter(F.col("part") == part).select("cid"), "cid", "left_semi")
    return mine("in_sample"), mine("holdout")


def named(q: Quote, base: Quote, axes: Iterable[str]) -> str:
    """A configuration by where it departs from the base."""
    parts = [f"{a}={getattr(q, a)}" for a in axes if getattr(q, a) != getattr(base, a)]
    return ",".join(parts) or "base"


def descend(quotes: DataFrame, base: Quote, axes: Mapping[str, Sequence], rounds: int = 5, min_filled: int = R.MIN_FILLED, size: int = R.MIN_SIZE) -> tuple[DataFrame, Quote]:
    """Search from ``base`` by single-axis moves over the windows of ``quotes``: the trials, and the configuration that leads.

    The trials are one growing table (round, config, metrics, admitted). Each round sweeps the untried neighbours of the leader
    in one job and appends their metrics; the leader is the table's best admitted row (the base until one is admitted), picked by
    a top-1 query. The search ends when a round brings no new leader or no new neighbour.
    """
    trials, known = None, {}
    leader, fresh = "base", {"base": base}
    for turn in range(rounds + 1):
        known |= fresh
        grid = [replace(q, config_id=name) for name, q in fresh.items()]
        admitted = F.col("filled_windows") >= min_filled
        swept = run_sweep(None, grid, size, quotes=quotes).select(F.lit(turn).alias("round"), F.col("config_id").alias("config"), "total_pnl", "filled_windows", admitted.alias("admitted"))
        trials = cut(swept if trials is None else trials.unionByName(swept), "trials")
        best = trials.filter("admitted").orderBy(F.desc("total_pnl"), "config").select("config").first()
        ahead = best.config if best else "base"
        if turn and ahead == leader:
            break
        leader = ahead
        moves = [replace(known[leader], **change(known[leader], axis, v)) for axis, values in axes.items() for v in values]
        fresh = {name: q for q in moves if (name := named(q, base, axes)) not in known}
        if not fresh:
            break
    return trials, replace(known[leader], config_id=leader)


def confirm(quotes: DataFrame, base: Quote, winner: Quote, min_filled: int = R.MIN_FILLED, size: int = R.MIN_SIZE) -> DataFrame:
    """One row: whether the winner beats the base on the windows of ``quotes``, and if not why: it is the base, too few filled
    windows, or no gain."""
    same = winner.key() == base.key()
    grid = [replace(base, config_id="base")] + ([] if same else [replace(winner, config_id="winner")])
    m = run_sweep(None, grid, size, quotes=quotes)
    of = lambda k, x: F.max(F.when(F.col("config_id") == k, F.col(x)))
    v = m.agg(of("base", "total_pnl").alias("base_pnl"), of("base" if same else "winner", "total_pnl").alias("winner_pnl"), of("base" if same else "winner", "filled_windows").alias("filled"))
    thin, worse = F.coalesce(F.col("filled") < min_filled, F.lit(True)), ~F.coalesce(F.col("winner_pnl") > F.col("base_pnl"), F.lit(False))
    reason = F.when(F.lit(same), "base_kept").when(thin, "too_few_fills").when(worse, "no_gain").otherwise("gain")
    return v.select(F.lit(winner.config_id).alias("winner"), "base_pnl", "winner_pnl", reason.alias("reason"), (reason == "gain").alias("confirmed"))
