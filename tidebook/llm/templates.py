"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become sequences of canonical tokens: numbers, names and units turn into typed
placeholders, other words are lower-cased, punctuation is dropped.

* *number*: digits, also with points or commas between them; digits and letters that touch are two tokens;
* *unit*: a word of ``UNITS`` right after a number;
* *name*: a capitalised word of two letters or more, not all in capitals; names in a row with nothing but blanks, hyphens or
  apostrophes between them are one (for text in which nouns are capitalised this is broad; slots decide then).

A capitalised word that opens a sentence may be a name or not, so there are two *readings* of every text and item: openers as
plain words and openers as names. Windows of ``width`` canonical tokens with at least ``literals`` plain words are hashed in
both. A text's windows pass a bitmap of the benchmark's window hashes (fixed size, in the scan) and are joined to them by
reading and hash. Positions count words, whatever the reading. For each text, item and *alignment* (position in the text less
position in the item; alignments at most ``DRIFT`` words from the next one are one, as other values may have more or fewer words) the
placeholders of the matched windows must map the item's values to the text's one to one: a re-parameterised question has
each value replaced by one other value. A placement counts if at least ``share`` of the item's windows match consistently,
in either reading; windows that hold clashing values are taken away first.

A text is contaminated if any item reaches ``share``. An item shorter than ``width`` tokens is one window of its
own length, if it has ``literals`` plain words. An item without any window in this sense (values mostly, or names) is matched by
its words and values as they are, a third reading without placeholders, in windows of ``width`` words or all its words if fewer; if
it has fewer than ``WHOLE`` words, only a text of just these words is a copy.

Defined results: null or empty texts are clean; rows with null or repeated ids are each judged on their own text in
``report`` and share a verdict by text in ``keep_clean``; null items are ignored, equal items all count; an
empty benchmark leaves everything clean; other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import bitmap, mix64, without
from tidebook.llm.shingles import BASE, WINDOW, prefix_sums, span_hash, text_buffers
from tidebook.session import cut

#: unit words, lower-cased
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "g", "mg", "kg", "gram", "grams", "kilogram", "kilograms", "lb", "lbs",
    "pound", "pounds", "oz", "ounce", "ounces", "ton", "tons", "ml", "cl", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "cup", "cups", "s", "sec", "second",
    "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "cent", "cents", "dollar",
    "dollars", "euro", "euros", "percent", "degree", "degrees", "mph", "kmh", "hz", "w", "kw", "v", "j", "kj", "n", "pa",
)
PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: readings: openers of sentences as plain words, as names, and no placeholders at all
WORDS, NAMES, VALUES = 0, 1, 2
#: alignments this many words apart are one placement
DRIFT = 3
#: items of fewer words that have values only must be the whole text
WHOLE = 3
DIGIT, UPPER = np.zeros(256, bool), np.zeros(256, bool)
DIGIT[48:58] = UPPER[65:91] = True
MEMBER = np.zeros(256, bool)
MEMBER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
STOPS = np.zeros(256, bool)
STOPS[list(b".!?:\n")] = True
JOINS = np.zeros(256, bool)
JOINS[list(b" \t-'")] = True


def unit_hashes() -> np.ndarray:
    names = [u.encode() for u in UNITS]
    data = np.frombuffer(b"".join(names), np.uint8)
    at = np.cumsum([0, *map(len, names)])
    return span_hash(prefix_sums(data), at[:-1], at[1:])


class Canonical:
    """Canonical tokens of texts in one buffer: kind, hash of the placeholder or word, hash of the value, and number of the first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, reading: int = WORDS):
        n = len(data)
        digit = DIGIT[data]
        member = MEMBER[data]
        if n > 2:
            between = digit[:-2] & digit[2:] & ((data[1:-1] == 46) | (data[1:-1] == 44))
            member[1:-1] |= between
            digit[1:-1] |= between
        border = np.zeros(n + 1, bool)
        border[offsets] = True
        change = np.zeros(n + 1, bool)
        if n:
            change[1:n] = digit[1:] != digit[:-1]
        edge = border | change
        before = np.concatenate([[False], member[:-1]]) if n else member
        after = np.concatenate([member[1:], [False]]) if n else member
        self.starts = np.flatnonzero(member & (~before | edge[:-1]))
        self.ends = np.flatnonzero(member & (~after | edge[1:])) + 1
        self.ranges = np.searchsorted(self.starts, offsets)
        sums = prefix_sums(data)
        self.value = span_hash(sums, self.starts, self.ends)
        self.word = np.arange(len(self.starts))
        if reading == VALUES:
            self.kind, self.token = np.full(len(self.starts), PLAIN, np.int8), self.value
            return
        self.kind = np.where(digit[self.starts], NUMBER, PLAIN).astype(np.int8)
        stops = np.concatenate([[0], np.cumsum(STOPS[data])])
        opens = np.ones(len(self.starts), bool)
        opens[1:] = stops[self.starts[1:]] > stops[self.ends[:-1]]
        opens[self.ranges[:-1][self.ranges[:-1] < len(opens)]] = True
        upper = UPPER[data][self.starts]
        if n:
            # capitals of Latin letters in two bytes: C3 80 to C3 9E
            second = data[np.minimum(self.starts + 1, n - 1)]
            upper = (upper & ~UPPER[second]) | ((data[self.starts] == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        upper &= self.ends - self.starts > 1
        self.kind[(self.kind == PLAIN) & upper & (~opens if reading == WORDS else True)] = NAME
        follows = np.zeros(len(self.starts), bool)
        follows[1:] = self.kind[:-1] == NUMBER
        follows[self.ranges[:-1][self.ranges[:-1] < len(follows)]] = False
        self.kind[follows & np.isin(self.value, unit_hashes())] = UNIT
        self.join_names(data, offsets, sums)
        self.token = np.where(self.kind == PLAIN, self.value, mix64(self.kind.astype(np.uint64) + np.uint64(77)))

    def join_names(self, data: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> None:
        """Names in a row become one token."""
        name, parted = self.kind == NAME, np.concatenate([[0], np.cumsum(~JOINS[data])])
        joined = np.zeros(len(name), bool)
        joined[1:] = name[1:] & name[:-1] & (parted[self.starts[1:]] == parted[self.ends[:-1]])
        joined[self.ranges[:-1][self.ranges[:-1] < len(joined)]] = False
        if joined.any():
            head = np.flatnonzero(~joined)
            self.ends = self.ends[np.append(head[1:], len(joined)) - 1]
            self.starts, self.kind, self.word = self.starts[head], self.kind[head], self.word[head]
            self.value = span_hash(sums, self.starts, self.ends)
            self.ranges = np.searchsorted(self.starts, offsets)

    def windows(self, first: int, last: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and number of plain words of every window of the tokens first to last."""
        n = last - first - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.full(n, width, np.uint64)
        for j in range(width):
            total += self.token[first + j : first + j + n] * np.uint64(BASE * (2 * j + 3) % (1 << 64))
        plain = np.concatenate([[0], np.cumsum(self.kind[first:last] == PLAIN)])
        return mix64(total), plain[width:] - plain[:-width]

    def slots(self, at: int, width: int) -> list[dict]:
        return [{"place": int(self.word[at + i] - self.word[at]), "value": int(self.value[at + i].view(np.int64))} for i in range(width) if self.kind[at + i] != PLAIN]


HITS = "array<struct<reading: int, hash: long, at: long, n: long, slots: array<struct<place: int, value: long>>>>"
HIT = pa.list_(pa.struct([("reading", pa.int32()), ("hash", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("slots", pa.list_(pa.struct([("place", pa.int32()), ("value", pa.int64())])))]))


def windows_of(texts: DataFrame, widths: dict[int, list[int]], own_width: int | None, literals: int, held=None) -> DataFrame:
    """(key, wins): a text's windows of every width of every reading, those the bitmap may hold; ``at`` counts words, ``n`` is
    its number of tokens.

    With ``own_width`` (benchmark items) a text gives windows of that width only, or one of its own length if shorter, and
    windows without placeholders if it has no others.
    """
    kind = texts.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            found: list = []
            first = 0
            while first < len(offsets) - 1:
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + WINDOW, "right")) - 1)
                part = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                owns: list = [[] for _ in range(last - first)]
                for reading in (WORDS, NAMES, VALUES) if own_width else sorted(widths):
                    c = Canonical(*part, reading)
                    for own, a, b in zip(owns, c.ranges[:-1].tolist(), c.ranges[1:].tolist(), strict=True):
                        if own_width and reading == VALUES and own:
                            continue
                        for width in [min(own_width, b - a)] if own_width else widths[reading]:
                            if reading == VALUES and width < min(WHOLE, b - a):
                                continue
                            names, plain = c.windows(a, b, width) if width else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                            keep = plain >= (min(literals, width) if own_width is None or reading == VALUES else literals)
                            if held is not None and len(names):
                                keep &= held.might_hold(names)
                            own += [{"reading": reading, "hash": int(names[i].view(np.int64)), "at": int(c.word[a + i] - c.word[a]), "n": b - a, "slots": c.slots(a + i, width)} for i in np.flatnonzero(keep).tolist()]
                found += owns
                first = last
            some = [i for i, own in enumerate(found) if own]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(some, pa.int64())), pa.array([found[i] for i in some], HIT)], ["key", "wins"])

    return texts.mapInArrow(run, f"key {kind}, wins {HITS}")


def placements(docs: DataFrame, benchmark: DataFrame, width: int, literals: int, share: float) -> DataFrame:
    """(key, item, at, matched, windows, changed): consistent placements of items in texts given as (key, text)."""
    items = benchmark.filter("text is not null")
    marks = windows_of(items.select(F.col("item").alias("key"), "text"), {}, width, literals)
    marks = marks.select(F.col("key").alias("item"), F.inline("wins"))
    marks = cut(marks.select("item", "reading", "hash", F.col("at").alias("item_at"), "n", F.col("slots").alias("item_slots")), "template-items")
    totals = marks.groupBy("item").agg(F.countDistinct("item_at").alias("windows"))
    widths: dict[int, list[int]] = {}
    for r in marks.select("reading", F.least("n", F.lit(width)).alias("n")).distinct().orderBy("reading", "n").collect():
        widths.setdefault(r.reading, []).append(r.n)
    hits = windows_of(docs, widths, None, literals, bitmap(marks, "hash"))
    hits = hits.select("key", F.inline("wins")).drop("n")
    met = hits.join(marks, ["reading", "hash"]).withColumn("off", F.col("at") - F.col("item_at"))
    pairs = F.arrays_zip(F.col("item_slots.value").alias("a"), F.col("slots.value").alias("b"), F.col("item_slots.place").alias("place"))
    met = cut(met.select("key", "item", "off", "reading", "item_at", pairs.alias("pairs")).distinct(), "template-hits")

    # a chain of near alignments is one placement, named by the first
    after = Window.partitionBy("key", "item").orderBy("off")
    chains = met.select("key", "item", "off").distinct().withColumn("starts", F.coalesce(F.col("off") - F.lag("off").over(after) > DRIFT, F.lit(True)))
    chains = chains.withColumn("run", F.max(F.when(F.col("starts"), F.col("off"))).over(after)).drop("starts")
    met = cut(met.join(chains, ["key", "item", "off"]), "template-placed")
    place = ["key", "item", "run"]
    window = [*place, "off", "reading", "item_at"]

    # a slot is consistent if its item value has one text value in the placement and the reverse; a value that occurs
    # in several windows of one slot counts once, by its place in the item
    slots = met.select(*window, F.inline("pairs"))
    votes = slots.groupBy(*place, "a", "b").agg(F.countDistinct(F.col("item_at") + F.col("place")).alias("count"))
    best_b = votes.groupBy(*place, "a").agg(F.max_by("b", F.struct("count", "b")).alias("best"))
    best_a = votes.groupBy(*place, "b").agg(F.max_by("a", F.struct("count", "a")).alias("back"))
    bad = votes.join(best_b, [*place, "a"]).join(best_a, [*place, "b"]).filter("b <> best or a <> back")
    torn = slots.join(bad.select(*place, "a", "b"), [*place, "a", "b"], "left_semi").select(*window).distinct()
    sound = met.join(torn, window, "left_anti")
    changed = F.size(F.filter("pairs", lambda p: p.a != p.b)) > 0
    tally = sound.groupBy(*place).agg(F.countDistinct("item_at").alias("matched"), F.max(changed).alias("changed"))
    return tally.join(totals, "item").filter(F.col("matched") >= F.lit(share) * F.col("windows")).select("key", "item", F.col("run").alias("at"), "matched", "windows", "changed")


def report(docs: DataFrame, benchmark: DataFrame, width: int = 8, literals: int = 5, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per row of ``docs``: id, ``contaminated``, ``n_items``, the smallest ``item_id`` of the best placement, its
    share of matched windows, and whether its values were changed."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col("text").cast("string").alias("text"))
    found = placements(texts.select("key", "text"), items, width, literals, share)
    rate = F.col("matched") / F.col("windows")
    best = found.withColumn("rate", rate).groupBy("key").agg(
        F.countDistinct("item").alias("n_items"), F.min_by("item", F.struct(-F.col("rate"), "item")).alias("item"), F.max("rate").alias("rate"), F.min_by("changed", F.struct(-F.col("rate"), "item", "changed")).alias("changed"),
    )
    out = texts.select("id", "key").join(best, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("item").alias(item_col), F.coalesce("rate", F.lit(0.0)).alias("matched_share"), F.coalesce("changed", F.lit(False)).alias("reparameterised"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 8, literals: int = 5, share: float = 0.5, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns as they are."""
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col("text").cast("string").alias("text"))
    found = placements(texts, items, width, literals, share).select(F.col("key").alias("_leaked")).distinct()
    return without(docs, found, key == F.col("_leaked"), "template-leaks")
