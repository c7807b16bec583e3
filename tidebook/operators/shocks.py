"""Shocks of a price and the first book move after each; a row costs the same however dense the rows are."""

from __future__ import annotations

from collections import deque
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions import book as B
from ..session import cut
from .scan import with_halo

QUOTES = ("up_bid", "up_ask", "dn_bid", "dn_ask", "mid")
#: a cent, whatever the binary tails of two prices
MOVE = 0.01 - 1e-9

c = F.col


def rising_edges(prices: DataFrame, reach: int, hot_at: float) -> DataFrame:
    """(event_id, series, ts_us, drift) of rows hot after a row that was not: the drift against the oldest price up to ``reach`` back.

    Each row asks at its range's start for the first price from there on (of equal times the least event_id), which is carried back
    along the times of a slice. The row before a slice's first one is the newest of the slice before it.
    """
    ask = lambda own, at: F.struct(F.lit(own).alias("asks"), at.alias("at"))
    lines = prices.filter(c("ts_us").isNotNull()).select("event_id", "series", "price", F.inline(F.array(ask(False, c("ts_us")), ask(True, c("ts_us") - reach))))
    lines = with_halo(lines, -c("at"), 4 * reach, reach).filter(~(c("asks") & c("__halo")))
    back = Window.partitionBy("series", "__slice").orderBy(c("at").desc(), c("asks"), c("event_id").desc())
    seen = F.last(F.when(~c("asks"), F.struct("price")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    h = lines.withColumn("base", seen["price"]).filter("asks").withColumn("drift", B.spot_drift(c("price"), c("base")))
    h = h.withColumn("hot", F.abs("drift") >= hot_at)
    one = F.lit(1)
    h = h.withColumns({"was": F.lead("hot").over(back), "oldest": F.lead(one).over(back).isNull(), "newest": F.lag(one).over(back).isNull()})
    kept = h.filter((c("hot") & (c("oldest") | ~c("was"))) | c("newest"))
    kept = cut(kept.select("event_id", "series", "__slice", (c("at") + reach).alias("ts_us"), "drift", "hot", "was", "oldest", "newest"), "shocks")
    # slices count backwards; a drift that is not known counts as hot for the row after it, as NOT NULL holds nowhere
    before = Window.partitionBy("series").orderBy(c("__slice").desc())
    ends = kept.filter("newest").select(c("series").alias("s"), c("__slice").alias("k"), F.lag(F.coalesce("hot", F.lit(True)), 1, False).over(before).alias("carried"))
    j = kept.filter("hot").join(ends, c("series").eqNullSafe(c("s")) & (c("__slice") == c("k")))
    return j.filter(~F.when(c("oldest"), c("carried")).otherwise(c("was"))).select("event_id", "series", "ts_us", "drift")


class Waiting:
    """Shocks that have not seen a move, by the value of each quote: a move ends those at the low or the high end of them."""

    def __init__(self):
        self.open, self.queue = {}, deque()
        self.low, self.high = [[] for _ in QUOTES], [[] for _ in QUOTES]

    def add(self, n: int, shock: tuple, quotes: tuple) -> None:
        self.open[n] = shock
        self.queue.append(n)
        for heaps, sign in ((self.low, 1), (self.high, -1)):
            for q, x in enumerate(quotes):
                if x is not None:
                    heappush(heaps[q], (sign * x, n))
                    if len(heaps[q]) > 2 * len(self.open) + 100:
                        heaps[q] = [e for e in heaps[q] if e[1] in self.open]
                        heapify(heaps[q])

    def late(self, since: int):
        """Shocks before ``since`` leave without a move."""
        while self.queue and (self.queue[0] not in self.open or self.open[self.queue[0]][2] < since):
            if (shock := self.open.pop(self.queue.popleft(), None)) is not None:
                yield (*shock, None)

    def moved(self, at: int, quotes: tuple):
        for low, high, x in zip(self.low, self.high, quotes, strict=True):
            if x is None:
                continue
            while low and x - low[0][0] >= MOVE:
                if (shock := self.open.pop(heappop(low)[1], None)) is not None:
                    yield (*shock, at)
            while high and -high[0][0] - x >= MOVE:
                if (shock := self.open.pop(heappop(high)[1], None)) is not None:
                    yield (*shock, at)


def first_moves(shocks: DataFrame, books: DataFrame, within: int) -> DataFrame:
    """Each shock with ``r_us``, when a quote of its series first differs by a cent from the shock's own book, after it and ``within`` it.

    Books lie in time slices of a series and those of a slice's beginning in the one before it too, so a shock finds all it may meet in
    its slice. Spark deals the slices and sorts them; a task passes through them once and holds the shocks still waiting.
    """
    names = ["event_id", "series", "ts_us", "drift", "r_us"]
    out = StructType([StructField(n, t()) for n, t in zip(names, (LongType, StringType, LongType, DoubleType, LongType), strict=True)])
    types = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64()]

    def run(batches):
        def rows(found):
            columns = zip(*found, strict=True) if found else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

        group, at, n, waiting, fresh, own = None, None, 0, Waiting(), [], (None, ())
        for batch in batches:
            found = []
            lines = zip(*(batch.column(x).to_pylist() for x in ("__slice", *names[:4], "is_shock", *QUOTES)), strict=True)
            for k, event, series, ts, drift, is_shock, *quotes in lines:
                if group != (series, k):
                    found += [(*s, None) for s in waiting.open.values()] + [(*s, None) for s, _ in fresh]
                    group, at, waiting, fresh, own = (series, k), None, Waiting(), [], (None, ())
                if ts != at:
                    for s, book in fresh:
                        n += 1
                        waiting.add(n, s, book)
                    fresh, at = [], ts
                    found += waiting.late(ts - within)
                if is_shock:
                    fresh.append(((event, series, ts, drift), own[1] if own[0] == event else ()))
                else:
                    own = event, quotes
                    if waiting.open:
                        found += waiting.moved(ts, quotes)
            yield rows(found)
        yield rows([(*s, None) for s in waiting.open.values()] + [(*s, None) for s, _ in fresh])

    met = books.filter(c("series").isNotNull() & c("ts_us").isNotNull()).select("event_id", "series", "ts_us", *QUOTES, F.lit(False).alias("is_shock"))
    met = met.unionByName(shocks.withColumn("is_shock", F.lit(True)), allowMissingColumns=True)
    met = with_halo(met, -c("ts_us"), 4 * within, within).filter(~(c("is_shock") & c("__halo"))).drop("__halo")
    return met.repartition("series", "__slice").sortWithinPartitions("series", "__slice", "ts_us", "event_id", "is_shock").mapInArrow(run, out)
