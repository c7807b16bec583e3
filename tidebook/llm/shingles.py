"""Word shingles of whole texts as 64-bit hashes, computed on Arrow buffers without a Python object per word.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D), with A-Z lower-cased; a set
holds the distinct runs of ``width`` words, or the whole sequence where a text has fewer words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidebook.llm.common import WHITESPACE, mix64

WINDOW = 1_000_000
BASE = 0x9E3779B97F4A7C15
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, bool)
IS_WORD[list(WHITESPACE)] = False
BYTE_HASH = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASE))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as long as the longest window needs.

    They are kept for the process; a pickled task function carries an empty one.
    """

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return Powers, ()

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
            steps = [np.full(max(n, 1 << 16), x, np.uint64) for x in (base, inverse)]
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.cumprod(s, dtype=np.uint64) for s in steps)
        return self.up, self.down


POWERS = Powers()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null counts as an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, members: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of member bytes, and the range of runs of every text."""
    inside = members[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over lower-cased bytes; with them any span has its hash in a few steps."""
    up, _ = POWERS.to(len(data))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_HASH[LOWER[data]] * up[: len(data)], dtype=np.uint64)])


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = POWERS.to(len(sums) - 1)
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, over windows of bounded length."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + WINDOW, "right")))
        out[at:to] = span_hash(prefix_sums(data[low : ends[to - 1]]), starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a column."""
    data, offsets = text_buffers(column)
    sets: list[np.ndarray] = []
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + WINDOW, "right")) - 1)
        part, own = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        starts, ends, ranges = word_spans(part, own)
        words = word_hashes(part, starts, ends)
        runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for j in range(width):
            runs += words[j : j + len(runs)] * np.uint64((BASE * (2 * j + 3)) % (1 << 64))
        runs = mix64(runs)
        for a, b in zip(ranges[:-1], ranges[1:], strict=True):
            if b - a >= width:
                sets.append(np.unique(runs[a : b - width + 1]))
            elif b > a:
                short = np.uint64(b - a)
                for w in words[a:b]:
                    short = mix64(np.array([short], np.uint64) * np.uint64(BASE) + w)[0]
                sets.append(np.array([short], np.uint64))
            else:
                sets.append(np.zeros(0, np.uint64))
        first = last
    return sets
