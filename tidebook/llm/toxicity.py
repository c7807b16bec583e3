"""Toxic spans by a linear-chain conditional random field in numpy; span marginals make a document score.

Tokens are runs of ASCII letters, digits and non-ASCII bytes, with A-Z lower-cased. A chain is a sentence
(it ends at ``.``, ``!``, ``?`` or a line end) or at most ``CHAIN`` tokens of it. States are clean and toxic;
a token's emission sums learned weights of hashed features (word, prefixes, suffix, neighbours), and
transitions are learned too. Forward-backward gives each token's marginal of being toxic.

*Labelled tokens.* The table labels documents, so token labels are derived: in toxic texts, a token whose
word or prefix is markedly more frequent (in documents) among toxic texts than among others is toxic; all others
and all tokens of other texts are clean. Only rows of the learning folds take part.

*Document score.* A logistic function of two aggregates of the marginals, their maximum and expected number,
fitted on the same rows.

Training uses a bounded sample on the driver: the ``sample`` labelled rows of each class with the smallest hash
of their id, each with at most ``crop`` characters. Scoring runs in tasks over whole texts.

Defined results: a null or empty text, or one without tokens, has no spans and the score of no evidence;
without labelled rows of both classes every score is the share of toxic labels (0 without any); equal texts get
equal scores; ids may be null or repeated; other columns are ignored.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import mix64
from tidebook.llm.quality import labelled_sample
from tidebook.llm.shingles import prefix_sums, span_hash, text_buffers, word_spans

CHAIN, TABLE_BITS, SLAB = 64, 20, 2_000_000
IN_TOKEN = np.zeros(256, bool)
IN_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
ENDS = np.zeros(256, bool)
ENDS[list(b".!?\n")] = True
#: token features: kind, and for prefixes and suffixes their bytes
KINDS = (("word", 0), ("prefix", 3), ("prefix", 4), ("prefix", 5), ("suffix", 3))


class Tokens:
    """Tokens of texts in one buffer, their feature slots, and the chains they form."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.ranges = word_spans(data, offsets, IN_TOKEN)
        n = len(self.starts)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.ranges))
        stops = np.concatenate([[0], np.cumsum(ENDS[data])])
        fresh = np.ones(n, bool)
        fresh[1:] = (stops[self.starts[1:]] > stops[self.ends[:-1]]) | (self.text[1:] != self.text[:-1])
        first = np.flatnonzero(fresh)
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        self.first = np.flatnonzero(place % CHAIN == 0)
        self.length = np.diff(np.append(self.first, n))
        sums = prefix_sums(data)
        self.keys = []
        for kind, size in KINDS:
            s, e = self.starts, self.ends
            if kind == "prefix":
                e = np.minimum(e, s + size)
            elif kind == "suffix":
                s = np.maximum(s, e - size)
            self.keys.append(span_hash(sums, s, e))

    @cached_property
    def slots(self) -> list[np.ndarray]:
        """Feature slots of every token: its own features, then its neighbours in the chain."""
        slots = [((k + np.uint64(i)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int32) for i, k in enumerate(self.keys)]
        word, n = self.keys[0], len(self.starts)
        inside = np.ones(n, bool)
        inside[self.first] = False
        before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        before[1:] = np.where(inside[1:], word[:-1], 0)
        after[:-1] = np.where(inside[1:], word[1:], 0)
        return slots + [(mix64(k + np.uint64(j + 11)) >> np.uint64(64 - TABLE_BITS)).astype(np.int32) for j, k in enumerate((before, after))]

    def steps(self):
        """Chains by falling length: row t holds the chains that have a t-th token."""
        order = np.argsort(-self.length, kind="stable")
        first, length = self.first[order], self.length[order]
        longest = int(length[0]) if len(length) else 0
        alive = np.searchsorted(-length, -np.arange(longest), "left")
        return [first[:n] + t for t, n in enumerate(alive)]


def emissions(weights: np.ndarray, tokens: Tokens) -> np.ndarray:
    """Weight of the toxic state over the clean one for every token."""
    total = np.zeros(len(tokens.starts), np.float64)
    for slot in tokens.slots:
        total += weights[slot]
    return total


def marginals(crf: dict, tokens: Tokens, pairs: bool = False):
    """Probability that each token is toxic; with ``pairs`` also the expected transitions (2, 2) and starts."""
    s, step = emissions(crf["weights"], tokens), np.exp(crf["step"])
    lift = np.exp(np.clip(s, -30, 30))
    start = np.exp(crf["start"])
    rows = tokens.steps()
    a = np.empty((len(s), 2))
    for t, at in enumerate(rows):
        before = a[at - 1] @ step if t else np.broadcast_to(start, (len(at), 2))
        a[at, 0], a[at, 1] = before[:, 0], before[:, 1] * lift[at]
        a[at] /= a[at].sum(axis=1, keepdims=True)
    b = np.ones((len(s), 2))
    for t in range(len(rows) - 2, -1, -1):
        at = rows[t + 1]
        later = b[at] * np.stack([np.ones(len(at)), lift[at]], axis=1)
        back = later @ step.T
        b[at - 1] = back / back.sum(axis=1, keepdims=True)
    both = a * b
    p = both[:, 1] / both.sum(axis=1)
    if not pairs:
        return p
    inner = np.ones(len(s), bool)
    inner[tokens.first] = False
    at = np.flatnonzero(inner)
    joint = a[at - 1][:, :, None] * step[None] * (b[at] * np.stack([np.ones(len(at)), lift[at]], axis=1))[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return p, joint.sum(axis=0), np.array([(1 - p[tokens.first]).sum(), p[tokens.first].sum()])


def token_labels(tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic texts whose word or prefix is bound to toxic texts beyond chance.

    Measure: the likelihood ratio of its document counts, which must exceed what the best of as many
    unrelated words would reach.
    """
    mark = np.zeros(len(tokens.starts), bool)
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    for (kind, size), key in zip(KINDS, tokens.keys, strict=True):
        if kind == "suffix" or (kind == "prefix" and size < 4):
            continue
        order = np.lexsort([tokens.text, key])
        k, t = key[order], tokens.text[order]
        once = np.ones(len(k), bool)
        once[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
        names, at = np.unique(k[once], return_inverse=True)
        in_toxic = toxic[t[once]]
        c1, c0 = np.bincount(at, in_toxic), np.bincount(at, ~in_toxic)
        expected = (c1 + c0) * n1 / (n1 + n0)
        bound = 2 * (c1 * np.log(np.maximum(c1, 1e-9) / expected) + c0 * np.log(np.maximum(c0, 1e-9) / np.maximum(c1 + c0 - expected, 1e-9)))
        wide = (c1 / n1 > 8 * c0 / n0) & (bound > 2 * np.log(len(names)) + 6)
        mark |= np.isin(key, names[wide])
    return (mark & toxic[tokens.text]).astype(np.float64)


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 8, rate: float = 0.4, decay: float = 1e-5, seed: int = 5) -> dict | None:
    """Weights that maximise the likelihood of the derived token labels (AdaGrad); a quarter of the texts teach only the document layer."""
    toxic = labels > 0
    if not toxic.any() or toxic.all():
        return None if not len(labels) else {"share": float(toxic.mean())}
    rng = np.random.default_rng(seed)
    order = np.concatenate([rng.permutation(np.flatnonzero(toxic)), rng.permutation(np.flatnonzero(~toxic))])[np.argsort(np.concatenate([(np.arange(n) + 0.5) / n for n in (toxic.sum(), (~toxic).sum())]), kind="stable")]
    join = lambda own: (np.frombuffer(b"".join(texts[i] for i in own), np.uint8), np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])]))
    y = token_labels(Tokens(*join(order)), toxic[order])
    batches, at, size = [], 0, max(4, min(40, len(order) // 8))
    for low in range(0, len(order), size):
        tokens = Tokens(*join(order[low : low + size]))
        _, tokens.keys = tokens.slots, []
        batches.append((tokens, y[at : at + len(tokens.starts)]))
        at += len(tokens.starts)
    learn = batches[: max(1, len(batches) * 3 // 4)]

    used = np.unique(np.concatenate([s for t, _ in learn for s in t.slots] or [np.zeros(0, np.int32)]))
    own = [np.searchsorted(used, np.concatenate(t.slots)).astype(np.int32) for t, _ in learn]
    crf = {"weights": np.zeros(1 << TABLE_BITS, np.float32), "step": np.zeros((2, 2)), "start": np.zeros(2)}
    crf["step"][0, 1] = crf["start"][1] = -3.0
    held = {"weights": np.zeros(len(used)), "step": crf["step"], "start": crf["start"]}
    grown = {k: np.full(v.shape, 1e-2) for k, v in held.items()}
    for _ in range(max(epochs, min(60, 400 // len(learn)))):
        for i in rng.permutation(len(learn)):
            tokens, want = learn[i]
            if not len(tokens.starts):
                continue
            p, joint, begin = marginals(crf, tokens, pairs=True)
            inner = np.ones(len(want), bool)
            inner[tokens.first] = False
            to = np.flatnonzero(inner)
            seen = np.bincount((want[to - 1] * 2 + want[to]).astype(int), minlength=4).reshape(2, 2)
            starts = np.bincount(want[tokens.first].astype(int), minlength=2)
            slope = {"step": (seen - joint) / len(tokens.first), "start": (starts - begin) / len(tokens.first)}
            slope["weights"] = np.bincount(own[i], np.tile(want - p, len(tokens.slots)), len(used)) - decay * len(want) * held["weights"]
            for k in held:
                grown[k] += slope[k] ** 2
                held[k] += rate * slope[k] / np.sqrt(grown[k])
            crf["weights"][used] = held["weights"]
    last = batches[len(learn) :] or batches
    traits = np.concatenate([aggregate(marginals(crf, t), t, len(t.ranges) - 1) for t, _ in last])
    crf["top"] = fit_top(traits, labels[order][-len(traits) :])
    return crf


def aggregate(p: np.ndarray, tokens: Tokens, n: int) -> np.ndarray:
    """Per text: the largest marginal as a log-odds, and the expected number of toxic tokens, on a log scale."""
    most, total = np.zeros(n), np.zeros(n)
    np.maximum.at(most, tokens.text, p)
    np.add.at(total, tokens.text, np.where(p > 0.02, p, 0))
    return np.stack([most, total], axis=1)


def traits_of(raw: np.ndarray) -> np.ndarray:
    most = np.clip(raw[:, 0], 1e-5, 1 - 1e-5)
    return np.stack([np.log(most / (1 - most)) / 4, np.log1p(raw[:, 1])], axis=1)


def fit_top(raw: np.ndarray, labels: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Logistic weights by Newton's method with a small penalty."""
    x = np.concatenate([traits_of(raw), np.ones((len(raw), 1))], axis=1)
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (labels - p) - 0.05 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        w = w + np.linalg.solve(h, g)
    return w


def assess(crf: dict | None, data: np.ndarray, offsets: np.ndarray, least: float = 0.5) -> tuple[np.ndarray, list]:
    """Scores and toxic spans (character start, end, marginal) of texts in one buffer, slab by slab of whole sentences."""
    n = len(offsets) - 1
    spans: list = [[] for _ in range(n)]
    if crf is None or "weights" not in crf:
        return np.full(n, crf["share"] if crf else 0.0), spans
    raw = np.zeros((n, 2))
    for low, high in slabs(data, offsets):
        at = np.searchsorted(offsets, low, "right") - 1
        to = np.searchsorted(offsets, high, "left")
        cuts = np.clip(offsets[at : to + 1], low, high)
        part = data[low:high]
        tokens = Tokens(part, cuts - low)
        if not len(tokens.starts):
            continue
        p = marginals(crf, tokens)
        found = aggregate(p, tokens, to - at)
        raw[at:to] = np.stack([np.maximum(raw[at:to, 0], found[:, 0]), raw[at:to, 1] + found[:, 1]], axis=1)
        hot = np.flatnonzero(p >= least)
        for i, text in zip(hot, tokens.text[hot] + at, strict=True):
            spans[text].append((int(tokens.starts[i] + low - offsets[text]), int(tokens.ends[i] + low - offsets[text]), float(p[i])))
    for text, found in enumerate(spans):
        if found:
            own = data[offsets[text] : offsets[text + 1]]
            chars = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            spans[text] = [(int(chars[s]), int(chars[e]), m) for s, e, m in found]
    x = np.concatenate([traits_of(raw), np.ones((n, 1))], axis=1)
    return 1 / (1 + np.exp(-np.clip(x @ crf["top"], -30, 30))), spans


def slabs(data: np.ndarray, offsets: np.ndarray):
    """Ranges of about SLAB bytes that end with a text or, inside a longer one, behind a sentence or at least a token."""
    low, end = int(offsets[0]), int(offsets[-1])
    while low < end:
        high = min(end, low + SLAB)
        if high < end:
            whole = int(offsets[np.searchsorted(offsets, high, "right") - 1])
            if whole > low:
                high = whole
            else:
                stop = int(offsets[np.searchsorted(offsets, high, "right")])
                ahead = np.flatnonzero(ENDS[data[high:stop]])
                high = high + int(ahead[0]) + 1 if len(ahead) else stop
        yield low, high
        low = high


def fit(docs: DataFrame, labels: DataFrame, folds: Column, label: str = "toxic", sample: int = 1200, crop: int = 3000, **names) -> dict | None:
    """At most ``sample`` toxic and ``3 * sample`` other texts teach the model."""
    parts = [labelled_sample(docs, labels.filter(F.col(label) == k), label, folds, n, crop, **names) for k, n in ((1, sample), (0, 3 * sample))]
    return train(parts[0][0] + parts[1][0], np.concatenate([parts[0][1], parts[1][1]]))


def with_spans(docs: DataFrame, crf: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans) per row: spans are array<struct<start, end, marginal>> of toxic tokens by character offsets."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches):
        for batch in batches:
            score, spans = assess(crf, *text_buffers(batch.column("text")))
            found = [[{"start": s, "end": e, "marginal": m} for s, e, m in own] for own in spans]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score, pa.float64()), pa.array(found, span)], ["id", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double, spans array<struct<start: long, end: long, marginal: double>>").withColumnRenamed("id", id_col)
