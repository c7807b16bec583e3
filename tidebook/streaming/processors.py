"""Keyed state machines. Python state processors only where order-dependent state needs them.

Every processor sorts the rows of one key inside one micro-batch by their ordinal; the micro-batch is
bounded by the source's trigger limits, so a group is bounded too, however large the backlog is.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000


def ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = list(rows)
    return (pd.concat(parts) if len(parts) > 1 else parts[0]).sort_values(by, kind="stable")


def expire_at(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """One timer per key, moved on with every batch that touches the key."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    handle.registerTimer(at_ms)


def _num(x):
    return None if x is None or pd.isna(x) else float(x)


class Side:
    """One side of a ladder: sizes by price, and the prices in order, kept so level by level."""

    def __init__(self, levels: dict[float, float]):
        self.size = levels
        self.prices = sorted(levels)

    def set(self, price: float, size: float) -> None:
        if size > 0:
            if price not in self.size:
                insort(self.prices, price)
            self.size[price] = size
        elif self.size.pop(price, None) is not None:
            del self.prices[bisect_left(self.prices, price)]

    def keep(self, low: float | None = None, high: float | None = None) -> None:
        """Drop levels below ``low`` and above ``high``."""
        a = 0 if low is None else bisect_left(self.prices, low)
        b = len(self.prices) if high is None else bisect_right(self.prices, high)
        for p in self.prices[:a] + self.prices[b:]:
            del self.size[p]
        self.prices = self.prices[a:b]


class BookProcessor(StatefulProcessor):
    """Ladder per token: snapshots replace, changes set or delete one level, declared tops prune ghosts.

    Emits the top of book after every frame with the last frame kind that says something about the book and its declared
    quotes. A token whose next frame is more than ``ttl_ms`` of event time away starts afresh, and its state goes once
    event time has passed that; one timer is set at a time and moved on only when it fires.
    """

    OUT = "token string, event_id bigint, ts_us bigint, kind string, best_bid double, best_ask double, n_bids int, n_asks int, last_kind string, decl_bb double, decl_ba double, changed boolean"
    NAMES = [c.split()[0] for c in OUT.split(", ")]

    def __init__(self, ttl_ms: int = 2 * DAY_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", "side string, price double", "size double")
        self.meta = handle.getValueState("meta", "kind string, bb double, ba double, top_bb double, top_ba double, seen boolean, last_us bigint, armed boolean")

    def handleInputRows(self, key, rows, timerValues):
        before = {(k[0], k[1]): v[0] for k, v in self.levels.iterator()}
        book = {s: Side({p: z for (t, p), z in before.items() if t == s}) for s in "ba"}
        fresh = (None, None, None, None, None, False, None, False)
        kind, bb, ba, top_bb, top_ba, seen, last, armed = self.meta.get() if self.meta.exists() else fresh
        out = []
        for f in ordered(rows, ["line_no", "seq"]).itertuples(index=False):
            if last is not None and f.ts_us - last > self.ttl_ms * 1000:
                book = {"b": Side({}), "a": Side({})}
                kind, bb, ba, top_bb, top_ba, seen = fresh[:6]
            last = int(f.ts_us) if last is None else max(last, int(f.ts_us))
            if f.kind == "book":
                book = {"b": Side(dict(zip(f.bid_px, f.bid_sz, strict=True))), "a": Side(dict(zip(f.ask_px, f.ask_sz, strict=True)))}
                kind, bb, ba = "book", None, None
            elif f.kind == "price_change":
                book[f.side].set(float(f.price), float(f.size))
                kind, bb, ba = f.kind, _num(f.decl_bb), _num(f.decl_ba)
                book["b"].keep(high=bb)
                book["a"].keep(low=ba)
            elif f.kind == "best_bid_ask":
                kind, bb, ba = f.kind, _num(f.decl_bb), _num(f.decl_ba)
            bids, asks = book["b"].prices, book["a"].prices
            now = (bids[-1] if bids else None, asks[0] if asks else None)
            changed = not seen or now != (top_bb, top_ba)
            (top_bb, top_ba), seen = now, True
            out.append((key[0], f.event_id, f.ts_us, f.kind, now[0], now[1], len(bids), len(asks), kind, bb, ba, changed))
        after = {(s, p): z for s in "ba" for p, z in book[s].size.items()}
        for at in before.keys() - after.keys():
            self.levels.removeKey(at)
        for at, size in after.items():
            if before.get(at) != size:
                self.levels.updateValue(at, (size,))
        if not armed:
            self.handle.registerTimer(last // 1000 + self.ttl_ms)
        self.meta.update((kind, bb, ba, top_bb, top_ba, seen, last, True))
        yield pd.DataFrame(out, columns=self.NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.meta.exists():
            due = self.meta.get()[6] // 1000 + self.ttl_ms
            if due > expiredTimerInfo.getExpiryTimeInMs():
                self.handle.registerTimer(due)
            else:
                self.levels.clear()
                self.meta.clear()
        yield pd.DataFrame([], columns=self.NAMES)

    def close(self) -> None:
        pass


class WindowProcessor(StatefulProcessor):
    """One record per window once event time passes the window's own end, whatever its length.

    Ticks that come after that open the window anew and are filed as ``reopened``.
    """

    OUT = "cid string, series string, end_ts double, snaps bigint, f double, l double, mn double, mx double, reopened boolean"
    NAMES = [c.split()[0] for c in OUT.split(", ")]

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("window", "end_ts double, snaps bigint, first_no bigint, f double, last_no bigint, l double, mn double, mx double, reopened boolean")

    def handleInputRows(self, key, rows, timerValues):
        end, snaps, first_no, f, last_no, l, mn, mx, again = self.state.get() if self.state.exists() else (None, 0, None, None, None, None, None, None, None)  # noqa: E741
        for part in rows:
            snaps += len(part)
            top = float(part["end_ts"].max())
            end = top if end is None else max(end, top)
            seen = part[part["m"].notna()]
            if len(seen):
                a, b = seen.loc[seen["line_no"].idxmin()], seen.loc[seen["line_no"].idxmax()]
                if first_no is None or a["line_no"] < first_no:
                    first_no, f = int(a["line_no"]), float(a["m"])
                if last_no is None or b["line_no"] > last_no:
                    last_no, l = int(b["line_no"]), float(b["m"])  # noqa: E741
                low, high = float(seen["m"].min()), float(seen["m"].max())
                mn, mx = (low, high) if mn is None else (min(mn, low), max(mx, high))
        if again is None:
            again = timerValues.getCurrentWatermarkInMs() > end * 1000
        self.state.update((end, snaps, first_no, f, last_no, l, mn, mx, bool(again)))
        expire_at(self.handle, int(-(-end * 1000 // 1)))
        yield pd.DataFrame([], columns=self.NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        end, snaps, _, f, _, l, mn, mx, again = self.state.get()  # noqa: E741
        self.state.clear()
        yield pd.DataFrame([(key[0], key[1], end, snaps, f, l, mn, mx, again)], columns=self.NAMES)

    def close(self) -> None:
        pass


class AuthorityProcessor(StatefulProcessor):
    """A feed leg is trusted once warmed up and while it keeps printing; a reconnect starts over."""

    OUT = "token string, event_id bigint, authoritative boolean"

    def __init__(self, warmup_us: int, horizon_us: int, ttl_ms: int = 2 * DAY_MS):
        self.warmup_us, self.horizon_us, self.ttl_ms = warmup_us, horizon_us, ttl_ms

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("authority", "ready_at bigint, last_print bigint")

    def handleInputRows(self, key, rows, timerValues):
        ready, printed = self.state.get() if self.state.exists() else (None, None)
        out = []
        for r in ordered(rows, ["ts_us", "line_no"]).itertuples(index=False):
            if ready is None or r.reconnect:
                ready, printed = int(r.ts_us), None
            if r.printed:
                printed = int(r.ts_us)
            ok = r.ts_us - ready >= self.warmup_us and printed is not None and r.ts_us - printed <= self.horizon_us
            out.append((key[0], r.event_id, bool(ok)))
        self.state.update((ready, printed))
        expire_at(self.handle, int(r.ts_us) // 1000 + self.ttl_ms)
        yield pd.DataFrame(out, columns=["token", "event_id", "authoritative"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        yield pd.DataFrame([], columns=["token", "event_id", "authoritative"])

    def close(self):
        pass


class ShockProcessor(StatefulProcessor):
    """Shock detector with one pending shock: resolved by a reaction, a late row, or an event-time timer."""

    OUT = "series string, shock_id bigint, shock_us bigint, drift double, reacted boolean, reaction_ms double"

    def __init__(self, threshold: float, range_us: int, react_us: int):
        self.threshold, self.range_us, self.react_us = threshold, range_us, react_us

    def init(self, handle):
        self.handle = handle
        self.recent = handle.getListState("recent", "us bigint, price double")
        self.pending = handle.getValueState("pending", "shock_id bigint, us bigint, drift double, up_bid double, up_ask double, dn_bid double, dn_ask double, mid double")
        self.flag = handle.getValueState("flag", "in_shock boolean")

    QUOTES = ("up_bid", "up_ask", "dn_bid", "dn_ask", "mid")

    def handleInputRows(self, key, rows, timerValues):
        recent = deque((int(u), float(p)) for u, p in self.recent.get())
        pend = self.pending.get() if self.pending.exists() else None
        in_shock = bool(self.flag.get()[0]) if self.flag.exists() else False
        out = []
        for r in ordered(rows, ["ts_us", "event_id"]).itertuples(index=False):
            while recent and r.ts_us - recent[0][0] > self.range_us:
                recent.popleft()
            recent.append((int(r.ts_us), float(r.price)))
            if pend is not None:
                dt = r.ts_us - pend[1]
                moved = dt <= self.react_us and any(
                    b is not None and _num(getattr(r, q)) is not None and abs(getattr(r, q) - b) >= 0.01 - 1e-9 for q, b in zip(self.QUOTES, pend[3:])
                )
                if moved or dt > self.react_us:
                    out.append((key[0], pend[0], pend[1], pend[2], moved, dt / 1000.0 if moved else None))
                    pend = None
                    continue
            base = recent[0][1]
            drift = (r.price - base) / base if len(recent) > 1 and base > 0 else 0.0
            hot = abs(drift) >= self.threshold
            if not hot:
                in_shock = False
            elif not in_shock and pend is None and _num(r.mid) is not None:
                in_shock = True
                pend = (int(r.event_id), int(r.ts_us), drift, *[_num(getattr(r, q)) for q in self.QUOTES])
        self.recent.put(list(recent))
        self.flag.update((in_shock,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if pend is None:
            self.pending.clear()
        else:
            self.pending.update(pend)
            self.handle.registerTimer((pend[1] + self.react_us) // 1000 + 1)
        yield pd.DataFrame(out, columns=["series", "shock_id", "shock_us", "drift", "reacted", "reaction_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        rows = []
        if self.pending.exists():
            p = self.pending.get()
            rows.append((key[0], p[0], p[1], p[2], False, None))
            self.pending.clear()
        yield pd.DataFrame(rows, columns=["series", "shock_id", "shock_us", "drift", "reacted", "reaction_ms"])

    def close(self):
        pass


TERMINAL = ("MATCHED", "CANCELED", "CANCELLED", "FILLED")
OPEN = ("LIVE", "DELAYED", "UNMATCHED")


class OrderProcessor(StatefulProcessor):
    """Order status by id: the snapshot seeds, buffered events replay in time order, unknown statuses change nothing.

    An order is forgotten once event time passes its last event by ``ttl_ms``.
    """

    OUT = "order_id string, event_id bigint, status string, is_open boolean"

    def __init__(self, ttl_ms: int = 2 * DAY_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("order", "status string, is_open boolean")

    def handleInputRows(self, key, rows, timerValues):
        status, is_open = self.state.get() if self.state.exists() else (None, None)
        out, latest = [], 0
        for r in ordered(rows, ["seed", "ts_us", "event_id"]).itertuples(index=False):
            latest = max(latest, int(r.ts_us))
            s = (r.status or "").upper()
            if s in TERMINAL:
                status, is_open = s, False
            elif s in OPEN:
                status, is_open = s, True
            out.append((key[0], r.event_id, status, is_open))
        self.state.update((status, is_open))
        expire_at(self.handle, latest // 1000 + self.ttl_ms)
        yield pd.DataFrame(out, columns=["order_id", "event_id", "status", "is_open"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        yield pd.DataFrame([], columns=["order_id", "event_id", "status", "is_open"])

    def close(self):
        pass
