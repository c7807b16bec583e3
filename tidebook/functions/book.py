"""Book and quote rules as ``Column`` expressions: no Python workers, NULL stays NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import as_price, clamp, decimilli, finite, lit, milli, round_dp

# Fixed values the results depend on.
ONE_SIDED_NUDGE = 0.005
EPS = 1e-6
MARK_FLOOR, MARK_CEIL = 0.0001, 0.9999
DEFAULT_EXIT_THRESHOLD = 0.05
TAKER_RATE = 0.07
WINNER_DEAD_BAND = 0.02
OSCILLATION_EDGE = 0.02


def clamp_prob(p: Column) -> Column:
    return clamp(p, 0.0, 1.0)


def mid(bid: Column, ask: Column) -> Column:
    raw = (
        F.when(bid.isNotNull() & ask.isNotNull(), (bid + ask) / 2.0)
        .when(bid.isNotNull(), bid + ONE_SIDED_NUDGE)
        .when(ask.isNotNull(), ask - ONE_SIDED_NUDGE)
    )
    return clamp_prob(raw)


def two_sided_mid(up_bid, up_ask, dn_bid, dn_ask) -> Column:
    up = (up_bid + up_ask) / 2.0
    down = (dn_bid + dn_ask) / 2.0
    return round_dp(clamp_prob((up + (1.0 - down)) / 2.0), 4)


def two_sided_mid_default(up_bid, up_ask, dn_bid, dn_ask, default: float = 0.50) -> Column:
    def leg(bid, ask):
        return F.coalesce((bid + ask) / 2.0, bid, ask, F.lit(default))

    return round_dp((leg(up_bid, up_ask) + (1.0 - leg(dn_bid, dn_ask))) / 2.0, 4)


def touch_pair(recorded: Column, up_ask: Column, dn_ask: Column) -> Column:
    return F.coalesce(recorded, round_dp(up_ask + dn_ask, 4))


def resting_leg(prob: Column, offset) -> Column:
    return round_dp(clamp(prob - lit(offset), 0.01, 0.99), 3)


def resting_up(m: Column, offset) -> Column:
    return resting_leg(m, offset)


def resting_down(m: Column, offset) -> Column:
    return resting_leg(1.0 - m, offset)


def queue_ahead(bids: Column, price: Column) -> Column:
    """Size at or above ``price``; unknown (NULL) for a missing, empty or unparseable ladder.

    ``bids`` is ARRAY<STRUCT<price,size>>; map-shaped ladders go through ``ladder`` first.
    """
    return size_ahead(usable_ladder(bids), price)


def usable_ladder(bids: Column) -> Column:
    """The ladder, or NULL where it is missing, empty or unparseable: one test of a book that is asked for many prices."""
    bad = F.exists(bids, lambda x: x["price"].isNull() | x["size"].isNull() | (x["size"] < 0))
    return F.when(bids.isNotNull() & (F.size(bids) > 0) & ~bad, bids)


def size_ahead(bids: Column, price: Column) -> Column:
    """Size at or above ``price`` in a usable ladder."""
    total = F.aggregate(
        bids,
        F.lit(0.0),
        lambda acc, x: acc + F.when(x["price"] >= price, x["size"]).otherwise(F.lit(0.0)),
    )
    return F.when(bids.isNotNull() & price.isNotNull(), total)


def ladder(levels: Column) -> Column:
    """String-keyed level map to ARRAY<STRUCT<price,size>>, unparseable entries kept as NULLs."""
    return F.transform(
        F.map_entries(levels),
        lambda e: F.struct(as_price(e["key"]).alias("price"), finite(e["value"]).alias("size")),
    )


def compact_depth(bids: Column, floor: float = 0.05) -> Column:
    kept = F.filter(bids, lambda x: milli(x["price"]) >= int(round(floor * 1000)))
    return F.reverse(F.array_sort(kept))


def pair_cost(up: Column, down: Column) -> Column:
    return round_dp(up + down, 4)


def pair_edge_cents(up: Column, down: Column, gas_usd=0.0, shares=50) -> Column:
    gas = lit(gas_usd) * 100.0 / F.greatest(F.lit(1), lit(shares))
    return round_dp((1.0 - (up + down)) * 100.0 - gas, 4)


def taker_fee(p: Column, rate: float = TAKER_RATE) -> Column:
    return F.when((p > 0) & (p < 1), lit(rate) * p * (1.0 - p)).otherwise(F.lit(0.0))


def exec_quote(p: Column) -> Column:
    return F.when((p > 0) & (p <= 1), p)


def clamp_mark(p: Column) -> Column:
    return round_dp(clamp(p, MARK_FLOOR, MARK_CEIL), 4)


def window_clock(start_ts: Column, end_ts: Column) -> Column:
    start, end = finite(start_ts), finite(end_ts)
    return F.when(end > start, F.struct(start.alias("start"), (end - start).alias("length")))


def elapsed(ts: Column, start_ts: Column) -> Column:
    return F.when(ts.isNotNull() & start_ts.isNotNull(), F.greatest(F.lit(0.0), ts - start_ts))


def remaining(ts: Column, end_ts: Column) -> Column:
    return F.when(ts.isNotNull() & end_ts.isNotNull(), F.greatest(F.lit(0.0), end_ts - ts))


def window_fraction_seconds(length: Column, pct) -> Column:
    p = clamp(finite(lit(pct)), 0.0, 1.0)
    return F.when((finite(length) > 0) & p.isNotNull(), round_dp(p * length, 6)).otherwise(F.lit(0.0))


def dead_zone_cutoff(length: Column, value, unit="pct") -> Column:
    v, u = lit(value), F.lower(F.trim(lit(unit)))
    return (
        F.when((length <= 0) | (v <= 0), F.lit(0.0))
        .when(u == "sec", F.least(v.cast("double"), length))
        .otherwise(round_dp(clamp(v, 0.0, 1.0) * length, 6))
    )


def in_dead_zone(rem: Column, length: Column, value, unit="pct") -> Column:
    cutoff = dead_zone_cutoff(length, value, unit)
    return (
        F.when(length <= 0, F.lit(False))
        .when(rem <= 0, F.lit(True))
        .otherwise((cutoff > 0) & (rem <= cutoff + EPS))
    )


def dead_zone_start(start_ts: Column, end_ts: Column, value, unit="pct") -> Column:
    return end_ts - dead_zone_cutoff(end_ts - start_ts, value, unit)


def chase_cap(max_pair_cost, entry: Column) -> Column:
    return (F.floor((lit(max_pair_cost) - entry + 1e-9) * 100.0) / 100.0).cast("double")


def chase_progress(now: Column, naked: Column, dz_start: Column) -> Column:
    return (
        F.when(dz_start <= naked, F.lit(1.0))
        .when(now <= naked, F.lit(0.0))
        .otherwise(clamp((now - naked) / (dz_start - naked), 0.0, 1.0))
    )


def chase_ceiling(orig: Column, max_aff: Column, progress: Column) -> Column:
    p = clamp(F.coalesce(progress, F.lit(0.0)), 0.0, 1.0)
    raw = orig + p * (max_aff - orig)
    return (
        F.when(orig.isNull() | max_aff.isNull(), F.lit(0.0))
        .when((max_aff <= orig) | (p <= 0.0), round_dp(orig, 2))
        .when(p >= 1.0, round_dp(max_aff, 2))
        .otherwise(F.floor((raw + 1e-9) * 100.0) / 100.0)
    )


def tape_hit(tape: Column, token: Column, resting: Column, tick: float, skip_buys: Column | None = None) -> Column:
    """A print of ``token`` within one tick of our price. ``skip_buys`` drops aggressor buys at or above it."""

    def at_price(x):
        hit = (x["asset"] == token) & (F.abs(x["price"] - resting) <= tick + EPS)
        if skip_buys is not None:
            hit = hit & ~F.coalesce(x["price"] >= skip_buys - 1e-9, F.lit(False))
        return hit

    return F.coalesce(F.exists(tape, at_price), F.lit(False)) & resting.isNotNull()


def token_prints(tape: Column, token: Column, skip_buys: Column | None = None) -> Column:
    """Prices printed for one token; ``skip_buys`` (the ask) drops aggressor buys at or above it."""
    def mine(x):
        hit = x["asset"] == token
        return hit if skip_buys is None else hit & ~F.coalesce(x["price"] >= skip_buys - 1e-9, F.lit(False))

    return F.transform(F.filter(tape, mine), lambda x: x["price"])


def printed_near(prices: Column, resting: Column, tick: float) -> Column:
    """Any of the prices within one tick of ours."""
    near = F.exists(prices, lambda p: F.abs(p - resting) <= tick + EPS)
    return (F.size(prices) > 0) & resting.isNotNull() & F.coalesce(near, F.lit(False))


def ask_through(ask: Column, resting: Column, tick: float, newly_placed: Column) -> Column:
    reach = F.when(newly_placed, ask <= resting + EPS).otherwise(ask <= resting - tick + EPS)
    return F.coalesce(reach, F.lit(False))


def fill_predicate(resting, ask, tape, token, tick: float, newly_placed: Column, skip_buys: Column | None = None) -> Column:
    return tape_hit(tape, token, resting, tick, skip_buys) | ask_through(ask, resting, tick, newly_placed)


def print_side(price: Column, bid: Column, ask: Column) -> Column:
    return (
        F.when(price >= ask - 1e-9, F.lit("buy")).when(price <= bid + 1e-9, F.lit("sell")).otherwise(F.lit("sell"))
    )


def settlement_proxy(m: Column) -> Column:
    d = decimilli(m)
    band = int(round(WINNER_DEAD_BAND * 10000))
    return F.when(d > 5000 + band, F.lit("up")).when(d < 5000 - band, F.lit("down"))


def redemption_winner(held_side: Column, held_mid: Column, other_mid: Column) -> Column:
    """Winning side from the held leg's own mid, else one minus the other leg's; exactly even abstains."""
    p = F.coalesce(held_mid, 1.0 - other_mid)
    other = F.when(held_side == "up", F.lit("down")).otherwise(F.lit("up"))
    return F.when(p > 0.5, held_side).when(p < 0.5, other)


def close_value(bid: Column, entry: Column) -> Column:
    return round_dp((bid - entry) * 100.0 - taker_fee(bid) * 100.0, 4)


def hold_value(won: Column, entry: Column) -> Column:
    return round_dp((won.cast("int") - entry) * 100.0, 4)


def leg_mid_bucket(m: Column) -> Column:
    """Lower edge of the 0.05-wide bucket, computed on integer units."""
    d = decimilli(clamp_prob(m))
    return (F.least(F.floor(d / 500).cast("int"), F.lit(19)) * 500).cast("double") / 10000.0


def spot_drift(price: Column, base: Column) -> Column:
    return F.when(base != 0, (price - base) / base)


def spot_diff(a: Column, r: Column) -> Column:
    return round_dp(a - r, 4)


def spot_diff_pct(a: Column, r: Column) -> Column:
    return F.when(r != 0, round_dp((a - r) / r * 100.0, 4))


def fill_ratio(printed: Column, queue: Column) -> Column:
    return F.when(queue.isNotNull(), printed / F.greatest(queue, F.lit(1.0)))


def classify_path(max_mid: Column, min_mid: Column) -> Column:
    """Path class from extreme mids; both inputs NULL means the window priced nothing."""
    edge = int(round(OSCILLATION_EDGE * 10000))
    up = decimilli(max_mid) - 5000 >= edge
    down = 5000 - decimilli(min_mid) >= edge
    return (
        F.when(max_mid.isNull(), F.lit("no_data"))
        .when(up & down, F.lit("oscillating"))
        .when(up | down, F.lit("monotonic"))
        .otherwise(F.lit("flat"))
    )


def exit_threshold(series: Column, slug: Column, duration: Column, table: list[tuple[str, float]]) -> Column:
    """Ordered lookup: exact series, exact slug, first substring key, per-duration default, constant."""
    exact_keys = dict(reversed(table))
    arr = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(v)).alias("v")) for k, v in table])

    def first_where(pred):
        return F.try_element_at(F.filter(arr, pred), F.lit(1))["v"]

    named = F.when(duration <= 300, F.lit("default_5m")).otherwise(F.lit("default_15m"))
    default = first_where(lambda x: x["k"] == named)
    if not exact_keys:
        return F.lit(DEFAULT_EXIT_THRESHOLD)
    return F.coalesce(
        first_where(lambda x: x["k"] == series),
        first_where(lambda x: x["k"] == slug),
        first_where(
            lambda x: ~x["k"].startswith("default") & (series.contains(x["k"]) | slug.contains(x["k"]))
        ),
        default,
        F.lit(DEFAULT_EXIT_THRESHOLD),
    )


def outcome_kind(pair: Column, exited: Column, single_leg: Column) -> Column:
    return (
        F.when(pair, F.lit("pair")).when(exited, F.lit("exit")).when(single_leg, F.lit("settle")).otherwise(F.lit("no_event"))
    )


def outcome_label(pair: Column, exited: Column, side: Column) -> Column:
    return (
        F.when(exited, F.concat(F.lit("exit_"), side)).when(pair, F.lit("pair_merged")).otherwise(F.lit("-"))
    )
