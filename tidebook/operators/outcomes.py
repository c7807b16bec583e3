"""What one resting two-sided quote per window would have earned, as chained first-event aggregates.

Each step asks for the first tick at which something holds, given the step before. Every step is one
conditional ``min``/``min_by`` per (config, window): partially aggregated before its shuffle, so a hot
window costs one summary row per map task. The per-window state is joined back on the window key, where
adaptive execution broadcasts it when it measures small and splits skewed partitions when it does not.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import book as B
from ..functions.num import clamp, round_dp
from ..functions.text import sane_epoch
from ..session import cut
from .agg import by_window
from .scan import Running, running

KEYS = ["config_id", "cid"]
NEAR, FAR = 1 << 46, 1 << 62


def start_us() -> Column:
    return F.floor(sane_epoch(F.col("start_ts")) * 1e6).cast("bigint")


def with_position(ticks: DataFrame) -> DataFrame:
    """``at``, the place of a tick in its window as one BIGINT: microseconds since the start, then its rank by line among equals.

    Ranks are taken among the ticks of one microsecond, so no window is ever one task. The rank has 16 bits up to two years from
    the start and 2 bits beyond; ticks of one microsecond that exceed them share the last place.
    """
    c = F.col
    same = Window.partitionBy("cid", F.coalesce("ts_us", -c("line_no"))).orderBy("line_no")
    n, o = F.row_number().over(same).cast("bigint") - 1, c("ts_us") - start_us()
    near = o * 65536 + F.least(n, F.lit(65535))
    far = F.signum(o).cast("bigint") * (F.lit(FAR) + (F.abs(o) - NEAR) * 4) + F.least(n, F.lit(3))
    return ticks.withColumn("at", F.when(F.abs(o) < NEAR, near).otherwise(far))


def seconds(at: str) -> Column:
    """Epoch seconds of a position."""
    x = F.col(at)
    after, before = F.lit(NEAR) + F.shiftright(x - FAR, 2), -F.lit(NEAR) - F.shiftright(F.lit(3 - FAR) - x, 2)
    offset = F.when(x >= FAR, after).when(x <= 3 - FAR, before).otherwise(F.shiftright(x, 16))
    return (F.col("start_us") + offset) / 1e6


def held_name(up: Column | None = None) -> Column:
    up = F.col("held_up") if up is None else up
    return F.when(up, "up").when(~up, "down")


@dataclass(frozen=True)
class Quote:
    """One configuration of the single-round quote."""

    config_id: str = "base"
    offset: float = 0.02
    lo: float = 0.10
    hi: float = 0.90
    delay: float = 0.0
    queue_gate: float = 0.0
    touch_gate: float = 0.0
    dead_zone: float = 0.10
    policy: str = "close"
    thr: float = 0.05
    reversal: float = 0.02
    fee_rate: float = B.TAKER_RATE
    gas_usd: float = 0.0
    shares: int = 50
    tick: float = 0.001
    delay_pct: float = -1.0  # fraction of the window; wins over ``delay`` when not negative
    dead_zone_unit: str = "pct"
    max_pair: float = 0.0  # ceiling of a chased pair's cost; 0 leaves the second leg at its first price
    thr_by_slug: tuple[tuple[str, float], ...] = ()  # ordered; wins over ``thr`` when not empty

    def __post_init__(self):
        if not 0 <= self.lo < self.hi <= 1:
            raise ValueError("quote range must satisfy 0 <= lo < hi <= 1")
        if self.policy not in ("close", "hold"):
            raise ValueError("policy is close or hold")
        if not 0 < self.offset < 0.5:
            raise ValueError("offset must lie in (0, 0.5)")
        if self.dead_zone_unit not in ("pct", "sec"):
            raise ValueError("dead zone unit is pct or sec")
        if self.dead_zone < 0 or (self.dead_zone_unit == "pct" and self.dead_zone > 1):
            raise ValueError("dead zone out of range")
        if self.max_pair and not 0.5 <= self.max_pair <= 1.0:
            raise ValueError("max pair cost is 0 (no chase) or within [0.5, 1]")
        if not 0 <= self.delay <= 86400 or self.delay_pct > 1:
            raise ValueError("entry delay out of range")

    def key(self) -> str:
        body = {k: v for k, v in asdict(self).items() if k != "config_id"}
        return json.dumps(body, sort_keys=True)


PARAMS = [f.name for f in fields(Quote) if f.name not in ("config_id", "thr_by_slug")]


def config_struct(q: Quote, params: Sequence[str] = PARAMS) -> Column:
    return F.struct(F.lit(q.config_id).alias("config_id"), *[F.lit(getattr(q, p)).alias(f"p_{p}") for p in params])


def with_configs(df: DataFrame, configs: Sequence[Quote], params: Sequence[str] = PARAMS) -> DataFrame:
    """Attach every configuration to every row inside the scan stage (no join, no extra shuffle)."""
    if len({q.config_id for q in configs}) != len(configs):
        raise ValueError("config ids must be unique")
    return df.select("*", F.inline(F.array(*[config_struct(q, params) for q in configs])))


def attach(qt: DataFrame, state: DataFrame, configs: Sequence[Quote]) -> DataFrame:
    """Ticks next to the per-(config, window) state of the step before.

    The state is packed to one row per window (an array over the configurations) so that ticks are joined, and
    if need be shuffled, once per window and not once per configuration; rows multiply after the join, in the
    same stage as the partial aggregation that follows.
    """
    qt = qt.drop("start_us")
    if len(configs) == 1:
        return qt.join(state, "cid").select("*", *[F.lit(getattr(configs[0], p)).alias(f"p_{p}") for p in PARAMS])
    lookup = F.create_map(*[x for q in configs for x in (F.lit(q.config_id), config_struct(q))])
    keep = [c for c in state.columns if c not in ("cid", "config_id")]
    packed = state.withColumn("__p", F.element_at(lookup, F.col("config_id"))).groupBy("cid").agg(
        F.collect_list(F.struct(*keep, "__p.*")).alias("__s")
    )
    return qt.join(packed, "cid").select(*qt.columns, F.inline("__s"))


def meet(qt: DataFrame, state: DataFrame, by: Sequence[str], derive: Mapping[str, Column], some: Column, on: Sequence[str] = ("cid",)) -> DataFrame:
    """Ticks next to the state of the step before, in two levels: once for each of a window's distinct values ``by``, and then for
    the configurations that share them.

    ``derive`` is computed on the first level, and ticks for which ``some`` fails there go no further, so what depends on the
    price alone is not computed for every configuration. Beside ``cid``, columns of ``on`` may be NULL and equal NULL.
    """
    on = list(on)
    rest = [x for x in state.columns if x not in (*on, *by)]
    inner = state.groupBy(*on, *by).agg(F.collect_list(F.struct(*rest)).alias("__c"))
    outer = inner.groupBy(*on).agg(F.collect_list(F.struct(*by, "__c")).alias("__s"))
    outer = outer.select(*[F.col(k).alias(f"__{k}") for k in on], "__s")
    same = F.col("cid") == F.col("__cid")
    for k in on[1:]:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    j = qt.join(outer, same).select(*qt.columns, F.inline("__s")).withColumns(dict(derive)).filter(some)
    return j.select(*[x for x in j.columns if x != "__c"], F.inline("__c"))


def with_params(state: DataFrame, configs: Sequence[Quote], params: Sequence[str]) -> DataFrame:
    """State rows with some parameters of their configurations."""
    lookup = F.create_map(*[x for q in configs for x in (F.lit(q.config_id), config_struct(q, params))])
    return state.withColumn("__p", F.element_at(lookup, F.col("config_id"))).select(*state.columns, *[F.col(f"__p.p_{p}").alias(f"p_{p}") for p in params])


def quote_ticks(ticks: DataFrame, skip_buys: bool = False) -> DataFrame:
    """Narrow ticks with the config-independent columns every step needs, computed before configs multiply rows."""
    t = with_position(ticks.filter(F.col("end_ts") > F.col("start_ts")))
    length = F.col("end_ts") - F.col("start_ts")
    return t.select(
        "cid", "series", "slug", "duration", "day", "ts", "ts_us", "line_no", "start_ts", "end_ts",
        "up_token", "dn_token", "up_bid", "up_ask", "dn_bid", "dn_ask", "up_bids", "dn_bids", "tape",
        B.two_sided_mid(*[F.col(x) for x in ("up_bid", "up_ask", "dn_bid", "dn_ask")]).alias("tsm"),
        B.mid(F.col("up_bid"), F.col("up_ask")).alias("mid_up"),
        B.elapsed(F.col("ts"), F.col("start_ts")).alias("elapsed"),
        B.remaining(F.col("ts"), F.col("end_ts")).alias("rem"),
        length.alias("length"),
        B.token_prints(F.col("tape"), F.col("up_token"), F.col("up_ask") if skip_buys else None).alias("up_prints"),
        B.token_prints(F.col("tape"), F.col("dn_token"), F.col("dn_ask") if skip_buys else None).alias("dn_prints"),
        "at",
        start_us().alias("start_us"),
    )


def _in_range(x: Column) -> Column:
    return (x >= F.col("p_lo")) & (x <= F.col("p_hi"))


def _dz() -> Column:
    return B.in_dead_zone(F.col("rem"), F.col("length"), F.col("p_dead_zone"), F.col("p_dead_zone_unit"))


def _carry(df: DataFrame, names: Sequence[str]):
    return [F.first(n).alias(n) for n in names]


# what a step depends on; later steps add to it
ANCHOR = ("offset", "lo", "hi", "dead_zone", "dead_zone_unit")
PLACE = (*ANCHOR, "delay", "delay_pct", "queue_gate", "touch_gate")


def distinct(configs: Sequence[Quote], names: Sequence[str]) -> tuple[list[Quote], dict[str, list[str]]]:
    """One configuration for each combination of ``names``, and the ids of those it stands for."""
    first: dict[tuple, Quote] = {}
    of: dict[str, list[str]] = {}
    for q in configs:
        mine = first.setdefault(tuple(getattr(q, n) for n in names), q)
        of.setdefault(mine.config_id, []).append(q.config_id)
    return list(first.values()), of


def fan_out(state: DataFrame, of: dict[str, list[str]]) -> DataFrame:
    """Per-window state of some configurations, given to all configurations they stand for."""
    if all(ids == [k] for k, ids in of.items()):
        return state
    table = F.create_map(*[x for k, ids in of.items() for x in (F.lit(k), F.array(*map(F.lit, ids)))])
    rest = [c for c in state.columns if c != "config_id"]
    return state.select(F.explode(F.element_at(table, F.col("config_id"))).alias("config_id"), *rest)


def anchors(qt: DataFrame, configs: Sequence[Quote], leg_range: bool = True) -> DataFrame:
    """First in-range two-sided mid outside the dead zone; its value is held afterwards."""
    x = with_configs(qt.select("cid", "at", "start_us", "tsm", "rem", "length"), configs, ANCHOR)
    ru, rd = B.resting_up(F.col("tsm"), F.col("p_offset")), B.resting_down(F.col("tsm"), F.col("p_offset"))
    ok = F.col("tsm").isNotNull() & _in_range(F.col("tsm")) & ~_dz()
    if leg_range:
        ok = ok & _in_range(ru) & _in_range(rd)
    at = F.when(ok, F.col("at"))
    return x.groupBy(*KEYS).agg(
        F.min("start_us").alias("start_us"),
        F.min(at).alias("anchor_at"),
        F.min_by(F.col("tsm"), at).alias("anchor_mid"),
    )


def placements(qt: DataFrame, anchor: DataFrame, configs: Sequence[Quote]) -> DataFrame:
    """First tick at or after the anchor on which both orders may be posted."""
    priced = with_params(anchor, configs, ["offset"]).withColumns(
        {
            "ru": B.resting_up(F.col("anchor_mid"), F.col("p_offset")),
            "rd": B.resting_down(F.col("anchor_mid"), F.col("p_offset")),
        }
    )
    known = cut(priced.drop("p_offset"), "anchors")
    state = with_params(known.filter(F.col("anchor_at").isNotNull()).select(*KEYS, "ru", "rd", "anchor_at"), configs, [p for p in PLACE if p != "offset"])
    gate = F.col("p_queue_gate")
    up, dn = B.size_ahead(F.col("up_bids"), F.col("ru")), B.size_ahead(F.col("dn_bids"), F.col("rd"))
    queue = F.when(up.isNotNull() & dn.isNotNull(), F.greatest(up, dn)) if any(q.queue_gate > 0 for q in configs) else F.lit(None).cast("double")
    t = qt.select("cid", "at", "elapsed", "rem", "length", "tsm", "up_ask", "dn_ask", *[B.usable_ladder(F.col(x)).alias(x) for x in ("up_bids", "dn_bids")]).filter(F.col("tsm").isNotNull())
    j = meet(t, state, ["ru", "rd"], {"queue": queue}, F.lit(True))
    touch = F.col("up_ask") + F.col("dn_ask")
    touch_ok = (F.col("p_touch_gate") <= 0) | F.coalesce(touch <= F.col("p_touch_gate"), F.lit(True))
    ok = (
        (F.col("at") >= F.col("anchor_at"))
        & (F.col("elapsed") >= F.when(F.col("p_delay_pct") >= 0, F.col("p_delay_pct") * F.col("length")).otherwise(F.col("p_delay")))
        & _in_range(F.col("tsm"))
        & ~_dz()
        & ((gate <= 0) | F.coalesce(F.col("queue") <= gate, F.lit(False)))
        & touch_ok
    )
    first = j.filter(ok).groupBy(*KEYS).agg(F.min("at").alias("placed_at"), F.min("elapsed").alias("placed_elapsed"))
    return known.join(first, KEYS, "left").select(*KEYS, *STATE)


STATE = ["start_us", "anchor_at", "anchor_mid", "ru", "rd", "placed_at", "placed_elapsed"]


def leg_fills(qt: DataFrame, placed: DataFrame, configs: Sequence[Quote], detector: str = "both") -> DataFrame:
    """First fill of each leg under one detector (tape, ask or both); a first leg never fills inside the dead zone, a second leg may."""
    known = cut(placed.select(*KEYS, *STATE), "placed")
    state = with_params(known.filter(F.col("placed_at").isNotNull()).select(*KEYS, "ru", "rd", "placed_at"), configs, ["dead_zone", "dead_zone_unit"])

    def leg(name, resting, ask, prints):
        hit = B.printed_near(F.col(prints), F.col(resting), 0.001) if detector != "ask" else F.lit(False)
        reach = [B.ask_through(F.col(ask), F.col(resting), 0.001, F.lit(new)) if detector != "tape" else F.lit(False) for new in (True, False)]
        return {f"{name}_new": reach[0] | hit, f"{name}_old": reach[1] | hit}

    derive = {**leg("__up", "ru", "up_ask", "up_prints"), **leg("__dn", "rd", "dn_ask", "dn_prints")}
    t = qt.filter(F.col("mid_up").isNotNull()).select("cid", "at", "rem", "length", "up_ask", "dn_ask", "up_prints", "dn_prints")
    # an order that is newly placed fills at its price already, a resting one only beyond it
    j = meet(t, state, ["ru", "rd"], derive, F.col("__up_new") | F.col("__dn_new")).filter(F.col("at") >= F.col("placed_at"))
    newly = F.col("at") == F.col("placed_at")
    fills = {leg: F.when(newly, F.col(f"{leg}_new")).otherwise(F.col(f"{leg}_old")) for leg in ("__up", "__dn")}
    j = j.withColumns({**fills, "__dz": _dz()}).filter(F.col("__up") | F.col("__dn"))
    up, dn, dz = F.col("__up"), F.col("__dn"), F.col("__dz")

    def first(cond):
        return F.min(F.when(cond, F.col("at")))

    f = j.groupBy(*KEYS).agg(first(up & ~dz).alias("__u"), first(up).alias("__ua"), first(dn & ~dz).alias("__d"), first(dn).alias("__da"))
    f = known.join(f, KEYS, "left")
    f = f.withColumns(
        {
            "fill_up_at": F.coalesce("__u", F.when(F.col("__d").isNotNull(), F.col("__ua"))),
            "fill_dn_at": F.coalesce("__d", F.when(F.col("__u").isNotNull(), F.col("__da"))),
        }
    )
    u, d = F.col("fill_up_at"), F.col("fill_dn_at")
    return f.drop("__u", "__ua", "__d", "__da").withColumns(
        {
            "pair_at": F.when(u.isNotNull() & d.isNotNull(), F.greatest(u, d)),
            "first_at": F.least(u, d),
            # the leg that is naked until (and unless) the pair completes; NULL when both fill together
            "held_up": F.when(u.isNotNull() & (d.isNull() | (u < d)), True).when(d.isNotNull() & (u.isNull() | (d < u)), False),
        }
    ).withColumns({"entry": F.when(F.col("held_up"), F.col("ru")).when(~F.col("held_up"), F.col("rd")), "held": held_name()})


def chase_path(qt: DataFrame, fills: DataFrame, configs: Sequence[Quote]) -> DataFrame:
    """Every tick of a naked spell with the open leg's chased price and whether it fills there.

    The quote is the running maximum of min(ask, ceiling) and never falls below its first price.
    """
    cols = ["cid", "at", "ts_us", "line_no", "elapsed", "length", "up_ask", "dn_ask", "up_prints", "dn_prints"]
    up_open = ~F.col("held_up")
    pick = lambda up, dn: F.when(up_open, F.col(up)).otherwise(F.col(dn))
    state = with_params(fills.filter(F.col("held_up").isNotNull()), configs, ["max_pair", "dead_zone", "dead_zone_unit"]).select(
        *KEYS, "held_up", pick("ru", "rd").alias("orig"), "first_at", B.chase_cap(F.col("p_max_pair"), F.col("entry")).alias("cap"),
        (seconds("first_at") - F.col("start_us") / 1e6).alias("since"), "p_dead_zone", "p_dead_zone_unit",
    )
    open_leg = {"ask": pick("up_ask", "dn_ask"), "prints": pick("up_prints", "dn_prints"), "el_ms": F.floor(F.col("elapsed") * 1000)}
    t = qt.filter(F.col("mid_up").isNotNull()).select(*cols)
    j = meet(t, state, ["held_up", "orig"], open_leg, F.lit(True)).filter(F.col("at") > F.col("first_at"))
    # one column for each step: written as one expression, every use repeats all of it
    j = j.withColumn("dz_start", F.col("length") - B.dead_zone_cutoff(F.col("length"), F.col("p_dead_zone"), F.col("p_dead_zone_unit")))
    j = j.withColumn("progress", B.chase_progress(F.col("elapsed"), F.col("since"), F.col("dz_start")))
    j = j.withColumn("ceiling", B.chase_ceiling(F.col("orig"), F.col("cap"), F.col("progress")))
    j = j.withColumn("target", F.when(F.col("ask").isNotNull(), round_dp(clamp(F.least(F.col("ask"), F.col("ceiling")), 0.01, 0.99), 3)))
    j = j.select(*KEYS, "at", "ts_us", "line_no", "el_ms", "ask", "prints", "orig", "target")
    j = running(j, KEYS, ["at"], F.floor(F.col("el_ms") / 600_000).cast("bigint"), [Running("hi", "max", F.col("target")), Running("hi_before", "max", F.col("target"), exclusive=True)])
    level, before = F.greatest("orig", "hi"), F.greatest("orig", "hi_before")
    j = j.withColumns({"level": level, "raised": level > before})
    hit = B.ask_through(F.col("ask"), F.col("level"), 0.001, F.col("raised")) | B.printed_near(F.col("prints"), F.col("level"), 0.001)
    return j.withColumn("hit", hit)


def apply_chase(qt: DataFrame, fills: DataFrame, configs: Sequence[Quote]) -> DataFrame:
    """Let configurations with a pair ceiling complete their pair at the chased price instead."""
    chasing = [q for q in configs if q.max_pair > 0]
    if not chasing:
        return fills
    fills = cut(fills, "fills")
    mine = F.col("config_id").isin([q.config_id for q in chasing])
    path = chase_path(qt, fills.filter(mine), chasing)
    at = F.when(F.col("hit"), F.col("at"))
    hits = path.groupBy(*KEYS).agg(F.min(at).alias("ch_at"), F.min_by("level", at).alias("ch_px"))
    j = fills.join(hits, KEYS, "left")
    naked = mine & F.col("held_up").isNotNull()
    up_open, done = naked & ~F.col("held_up"), F.col("ch_at").isNotNull()
    dn_open = naked & F.col("held_up")
    return j.withColumns(
        {
            "fill_up_at": F.when(up_open, F.col("ch_at")).otherwise(F.col("fill_up_at")),
            "fill_dn_at": F.when(dn_open, F.col("ch_at")).otherwise(F.col("fill_dn_at")),
            "pair_at": F.when(naked, F.col("ch_at")).otherwise(F.col("pair_at")),
            "ru": F.when(up_open & done, F.col("ch_px")).otherwise(F.col("ru")),
            "rd": F.when(dn_open & done, F.col("ch_px")).otherwise(F.col("rd")),
        }
    ).drop("ch_at", "ch_px")


FILL_STATE = [*STATE, "fill_up_at", "fill_dn_at", "pair_at", "first_at", "held_up", "entry"]


def pair_or_naked(fills: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("pair_at").isNotNull(), "pair").when(F.col("first_at").isNotNull(), "naked").otherwise("no_fill")
    )
    return fills.withColumn("fill_kind", kind)


def excursion() -> Column:
    """Adverse move of the up-leg mid from the held leg's entry, 6 dp."""
    up = round_dp(F.col("entry") - F.col("mid_up"), 6)
    down = round_dp(F.col("mid_up") - (1.0 - F.col("entry")), 6)
    return F.when(F.col("held_up"), up).when(~F.col("held_up"), down)


def held_bid() -> Column:
    return F.when(F.col("held_up"), F.col("up_bid")).when(~F.col("held_up"), F.col("dn_bid"))


def stop_threshold(configs: Sequence[Quote]) -> Column:
    """The configuration's threshold, looked up per series where it carries a table."""
    out = F.col("p_thr")
    for q in configs:
        if q.thr_by_slug:
            named = B.exit_threshold(F.col("series"), F.col("slug"), F.col("duration"), list(q.thr_by_slug))
            out = F.when(F.col("config_id") == q.config_id, named).otherwise(out)
    return out


def exits(qt: DataFrame, fills: DataFrame, configs: Sequence[Quote]) -> DataFrame:
    """Dead-zone close and stop exit of the naked leg, as the first ticks at which each could happen."""
    known = cut(fills.select(*KEYS, *FILL_STATE), "fills")
    naked = known.filter(F.col("held_up").isNotNull()).select(*KEYS, "held_up", "entry", "first_at", "pair_at")
    on = ["cid"]
    if any(q.thr_by_slug for q in configs):
        # thresholds are looked up once for each description of a window, not on every tick
        on += ["series", "slug", "duration"]
        naked = naked.join(qt.select(*on).distinct(), "cid")
    naked = with_params(naked, configs, ["dead_zone", "dead_zone_unit", "policy", "reversal", "thr"])
    naked = cut(naked.withColumn("p_thr", stop_threshold(configs)), "naked")
    t = qt.filter(F.col("mid_up").isNotNull()).select(*on, "at", "rem", "length", "mid_up", "up_bid", "dn_bid")
    at, seen = F.col("at"), {"exc": excursion(), "hb": held_bid()}
    before_pair = F.coalesce(at < F.col("pair_at"), F.lit(True))
    j = meet(t, naked.drop("p_reversal"), ["held_up", "entry"], seen, F.lit(True), on).filter((at > F.col("first_at")) & before_pair)
    close = _dz() & (F.col("p_policy") == "close") & B.exec_quote(F.col("hb")).isNotNull()
    j = j.withColumns({"__cross": F.col("exc") >= F.col("p_thr"), "__close": close}).filter(F.col("__cross") | F.col("__close"))
    step = j.groupBy(*KEYS).agg(
        F.min(F.when(F.col("__cross"), at)).alias("cross_at"),
        F.min(F.when(F.col("__close"), at)).alias("dz_at"),
        F.min_by("hb", F.when(F.col("__close"), at)).alias("dz_bid"),
    )
    step = cut(step, "crossings")
    crossed = naked.select(*on, "config_id", "held_up", "entry", "pair_at", "p_reversal").join(step.filter(F.col("cross_at").isNotNull()).select(*KEYS, "cross_at"), KEYS)
    k = meet(t.drop("rem", "length"), crossed, ["held_up", "entry"], seen, F.lit(True), on).filter((at >= F.col("cross_at")) & before_pair)
    k = k.withColumns({"__can": F.col("hb").isNotNull(), "__calm": F.col("exc") < F.col("p_reversal")}).filter(F.col("__can") | F.col("__calm"))
    last = k.groupBy(*KEYS).agg(
        F.min(F.when(F.col("__can"), at)).alias("stop_at"),
        F.min_by("hb", F.when(F.col("__can"), at)).alias("stop_bid"),
        F.min(F.when(F.col("__calm"), at)).alias("latch_at"),
    )
    out = known.join(step, KEYS, "left").join(last, KEYS, "left")
    fires = F.col("stop_at").isNotNull() & F.coalesce(F.col("stop_at") < F.col("latch_at"), F.lit(True))
    return out.withColumns({"stop_at": F.when(fires, F.col("stop_at")), "stop_bid": F.when(fires, F.col("stop_bid")), "held": held_name()})


def closings(qt: DataFrame) -> DataFrame:
    """Per window: identity, path extremes, last quotes and last usable quotes of both legs."""
    quotes = ("up_bid", "up_ask", "dn_bid", "dn_ask")
    specs = {n: ("first", F.col(n)) for n in ("duration", "start_ts", "end_ts")}
    specs |= {
        "n_snaps": ("count", F.lit(True)), "first_ts": ("min", F.col("ts")), "first_seq": ("min", F.col("line_no")), "last_ts": ("max", F.col("ts")),
        "max_mid": ("max", F.col("mid_up")), "min_mid": ("min", F.col("mid_up")), "last_tsm": ("last_valid", F.col("tsm")),
    }
    specs |= {f"last_{n}": ("last", F.col(n)) for n in quotes}
    specs |= {f"lat_{n}": ("last_valid", B.exec_quote(F.col(n))) for n in quotes}
    return by_window(qt, ["cid"], ["series", "slug", "day"], F.col("at"), specs)


def settlement_ladder(held: Column, entry: Column) -> Column:
    """(mark, payoff mark, source) of a leg carried to the close."""
    def side(up, dn):
        return F.when(held == "up", F.col(up)).otherwise(F.col(dn))

    bid = B.exec_quote(side("last_up_bid", "last_dn_bid"))
    opp_ask = B.exec_quote(side("last_dn_ask", "last_up_ask"))
    lat_bid = side("lat_up_bid", "lat_dn_bid")
    lat_ask = side("lat_dn_ask", "lat_up_ask")
    held_mid = B.mid(side("last_up_bid", "last_dn_bid"), side("last_up_ask", "last_dn_ask"))
    opp_mid = B.mid(side("last_dn_bid", "last_up_bid"), side("last_dn_ask", "last_up_ask"))
    winner = B.redemption_winner(held, held_mid, opp_mid)
    payoff = F.when(winner == held, F.lit(1.0)).when(winner.isNotNull(), F.lit(0.0))

    def rung(mark, source):
        return F.when(mark.isNotNull(), F.struct(mark.alias("mark"), mark.alias("value"), F.lit(source).alias("source")))

    return F.coalesce(
        rung(bid, "direct_bid"),
        rung(B.clamp_mark(1.0 - opp_ask), "complement_ask"),
        rung(lat_bid, "latched_bid"),
        rung(B.clamp_mark(1.0 - lat_ask), "latched_complement_ask"),
        F.when(payoff.isNotNull(), F.struct(F.lit(None).cast("double").alias("mark"), payoff.alias("value"), F.lit("redeemed").alias("source"))),
        F.struct(F.lit(None).cast("double").alias("mark"), F.lit(None).cast("double").alias("value"), F.lit("unresolved").alias("source")),
    )


def settle(exited: DataFrame, closing: DataFrame, configs: Sequence[Quote]) -> DataFrame:
    """Earliest terminal event of every window, then its profit and fees in cents per share."""
    o = with_configs(closing, configs).join(exited, KEYS)
    first = F.array_min(
        F.filter(
            F.array(
                *[
                    F.when(F.col(a).isNotNull(), F.struct(F.col(a).alias("at"), F.lit(i).alias("prio"), F.lit(name).alias("kind")))
                    for i, (a, name) in enumerate((("pair_at", "pair"), ("dz_at", "dead_zone"), ("stop_at", "stop")))
                ]
            ),
            lambda e: e.isNotNull(),
        )
    )
    o = o.withColumn("__first", first)
    kind = (
        F.when(F.col("first_at").isNull(), F.lit("no_fill")).when(F.col("__first").isNotNull(), F.col("__first.kind")).otherwise(F.lit("settle"))
    )
    o = o.withColumns({"kind": kind, "__ladder": settlement_ladder(F.col("held"), F.col("entry"))})
    exit_bid = F.when(F.col("kind") == "dead_zone", F.col("dz_bid")).when(F.col("kind") == "stop", F.col("stop_bid"))
    fee = lambda p: B.taker_fee(p, F.col("p_fee_rate")) * 100.0
    edge = B.pair_edge_cents(F.col("ru"), F.col("rd"), F.col("p_gas_usd"), F.col("p_shares"))
    k = F.col("kind")
    pnl = (
        F.when(k == "pair", edge)
        .when(k.isin("dead_zone", "stop"), (exit_bid - F.col("entry")) * 100.0)
        .when(k == "settle", F.coalesce((F.col("__ladder.value") - F.col("entry")) * 100.0, F.lit(0.0)))
        .otherwise(F.lit(0.0))
    )
    fees = (
        F.when(k.isin("dead_zone", "stop"), fee(exit_bid))
        .when(k == "settle", fee(F.lit(0.50)) + F.coalesce(fee(F.col("__ladder.mark")), F.lit(0.0)))
        .otherwise(F.lit(0.0))
    )
    ts = seconds
    up_filled = F.col("fill_up_at").isNotNull() & F.coalesce(F.col("fill_up_at") <= F.col("__first.at"), F.lit(True))
    dn_filled = F.col("fill_dn_at").isNotNull() & F.coalesce(F.col("fill_dn_at") <= F.col("__first.at"), F.lit(True))
    delay = F.greatest(F.lit(0.0), F.col("first_ts") - F.col("start_ts"))
    return o.select(
        "config_id", "cid", "series", "slug", "duration", "day", "start_ts", "end_ts", "first_ts", "first_seq", "n_snaps",
        B.classify_path(F.col("max_mid"), F.col("min_mid")).alias("class"),
        F.coalesce(F.greatest(F.lit(0.0), round_dp(F.col("max_mid") - 0.5, 4)), F.lit(0.0)).alias("max_up"),
        F.coalesce(F.greatest(F.lit(0.0), round_dp(0.5 - F.col("min_mid"), 4)), F.lit(0.0)).alias("max_down"),
        "anchor_mid", ts("anchor_at").alias("anchor_ts"), ts("placed_at").alias("placed_ts"), "placed_elapsed",
        "ru", "rd", ts("fill_up_at").alias("fill_up_ts"), ts("fill_dn_at").alias("fill_dn_ts"),
        F.col("placed_at").isNotNull().alias("entered"),
        up_filled.alias("filled_up"), dn_filled.alias("filled_dn"),
        "kind", F.when(k != "no_fill", F.when(k != "pair", F.col("held"))).alias("held"), "entry",
        F.coalesce(exit_bid, F.when(k == "settle", F.col("__ladder.mark"))).alias("exit_price"),
        F.when(k == "pair", seconds("pair_at")).when(k == "no_fill", F.lit(None)).otherwise(F.coalesce(seconds("__first.at"), F.col("last_ts"))).alias("exit_ts"),
        F.when(k == "settle", F.col("__ladder.source")).alias("settle_source"),
        F.when(k == "pair", B.pair_cost(F.col("ru"), F.col("rd"))).alias("pair_cost"),
        F.when(k == "pair", edge).alias("pair_edge"),
        round_dp(pnl, 4).alias("pnl"), round_dp(fees, 4).alias("fees"),
        round_dp(F.when(up_filled, F.col("ru")).otherwise(F.lit(0.0)) + F.when(dn_filled, F.col("rd")).otherwise(F.lit(0.0)), 4).alias("capital"),
        round_dp(delay, 2).alias("start_delay"), (delay > 5.0).alias("partial"),
        "last_tsm", "last_up_bid", "last_dn_bid",
        B.settlement_proxy(F.col("last_tsm")).alias("winner"),
    )


def fills_of(qt: DataFrame, configs: Sequence[Quote], detector: str = "both", leg_range: bool = True) -> DataFrame:
    """Anchor, placement and fills in one go, each over the configurations that differ in what the step reads."""
    anchoring, anchored = distinct(configs, ANCHOR)
    placing, placed = distinct(configs, PLACE)
    known = {k: [q.config_id for q in placing if q.config_id in ids] for k, ids in anchored.items()}
    a = fan_out(anchors(qt, anchoring, leg_range), known)
    return fan_out(leg_fills(qt, placements(qt, a, placing), placing, detector), placed)


def written_quotes(ticks: DataFrame, skip_buys: bool = False) -> DataFrame:
    """Quote ticks with their positions, derived once and written; every step then reads the columns it needs."""
    return cut(quote_ticks(ticks, skip_buys), "quotes")


def outcomes(ticks: DataFrame, configs: Sequence[Quote] = (Quote(),), detector: str = "both", quotes: DataFrame | None = None) -> DataFrame:
    """One row per (config, window): entry, fills, terminal event, profit and fees. ``quotes`` are written quote ticks, if there are."""
    qt = written_quotes(ticks) if quotes is None else quotes
    fills = apply_chase(qt, fills_of(qt, configs, detector), configs)
    return settle(exits(qt, fills, configs), closings(qt), configs)
