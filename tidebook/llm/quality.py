"""Quality scores of whole texts from a byte-level convolutional network in numpy.

Network, on the UTF-8 bytes of the whole text: a learned vector per byte; ``FILTERS`` learned filters of 6 bytes
every 2 bytes, rectified; their means over overlapping chunks of 128 bytes every 64; a second learned layer
over each chunk's means and their squares (a chunk of few patterns has uneven means); the largest value of every unit over all chunks of the text; a logistic combination. Every
byte lies under a filter and inside a chunk, and memory is bounded by a slab of bytes, not by a text.

Training happens on the driver on a bounded sample: the ``sample`` labelled rows with the smallest hash of
their id, each with at most ``crop`` characters from a hashed start. Scoring runs in tasks over all texts.

Defined results: a null or empty text is one empty chunk and gets the score that follows from it; labels that
are null, or of rows not in the texts, teach nothing; without any labelled row every score is 0.5; equal
texts get equal scores; ids may be null or repeated; other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidebook.llm.shingles import text_buffers

WIDTH, STEP, HALF = 6, 2, 64
EMBED, FILTERS, UNITS = 8, 24, 24
SLAB = 1 << 18


class Padded:
    """Texts laid out one after another in whole half-chunks of zero-padded bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        self.halves = np.maximum(1, -(-(sizes + WIDTH - STEP) // HALF))
        self.first = np.concatenate([[0], np.cumsum(self.halves)])
        self.bytes = np.zeros(int(self.first[-1]) * HALF, np.uint8)
        for i in range(len(sizes)):
            at = int(self.first[i]) * HALF
            self.bytes[at : at + sizes[i]] = data[offsets[i] : offsets[i + 1]]
        real = -(-sizes // STEP)
        steps = HALF // STEP
        place = np.arange(int(self.first[-1])) - np.repeat(self.first[:-1], self.halves)
        self.count = np.clip(np.repeat(real, self.halves) - place * steps, 0, steps).astype(np.float32)
        self.last = np.zeros(int(self.first[-1]), bool)
        self.last[self.first[1:] - 1] = True


def fresh(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "embed": normal(256, EMBED, scale=0.5),
        "filters": normal(WIDTH // STEP, STEP * EMBED, FILTERS, scale=(2 / (WIDTH * EMBED)) ** 0.5),
        "bias": np.zeros(FILTERS, np.float32),
        "mix": normal(2 * FILTERS, UNITS, scale=(2 / FILTERS) ** 0.5),
        "mix_bias": np.zeros(UNITS, np.float32),
        "out": normal(UNITS, scale=UNITS**-0.5),
        "out_bias": np.zeros(1, np.float32),
    }


def convolve(net: dict, padded: Padded) -> tuple[np.ndarray, np.ndarray]:
    """Embedded steps and rectified filter values; steps that start behind a text's end are zero."""
    steps = net["embed"][padded.bytes].reshape(-1, STEP * EMBED)
    value = steps @ net["filters"][0] + net["bias"]
    for j in range(1, WIDTH // STEP):
        value[:-j] += steps[j:] @ net["filters"][j]
    np.maximum(value, 0, out=value)
    short = np.flatnonzero(padded.count < HALF // STEP)
    grid = value.reshape(len(padded.count), HALF // STEP, FILTERS)
    for i in short:
        grid[i, int(padded.count[i]) :] = 0
    return steps, grid


def chunk_means(grid: np.ndarray, padded: Padded) -> tuple[np.ndarray, np.ndarray]:
    """Means over two neighbouring half-chunks (one at a text's end), and the steps in each."""
    total, count = grid.sum(axis=1), padded.count.copy()
    inner = np.flatnonzero(~padded.last)
    both, steps = total.copy(), count.copy()
    both[inner] += total[inner + 1]
    steps[inner] += count[inner + 1]
    steps = np.maximum(steps, 1)
    return both / steps[:, None], steps


def forward(net: dict, padded: Padded):
    steps, grid = convolve(net, padded)
    means, count = chunk_means(grid, padded)
    means = np.concatenate([means, means * means], axis=1)
    units = np.maximum(means @ net["mix"] + net["mix_bias"], 0)
    top = np.maximum.reduceat(units, padded.first[:-1], axis=0)
    return steps, grid, means, count, units, top, top @ net["out"] + net["out_bias"][0]


def gradients(net: dict, padded: Padded, labels: np.ndarray) -> tuple[dict, float]:
    steps, grid, means, count, units, top, logit = forward(net, padded)
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    loss = float(-np.mean(np.log(np.where(labels > 0, p, 1 - p) + 1e-9)))
    d_logit = ((p - labels) / len(labels)).astype(np.float32)
    d_top = d_logit[:, None] * net["out"]
    text = np.repeat(np.arange(len(labels)), padded.halves)
    best = (units == top[text]) & (units > 0)
    seen = np.cumsum(best, axis=0)
    before = np.concatenate([np.zeros((1, UNITS), seen.dtype), seen])[padded.first[:-1]]
    best &= (seen - before[text]) == 1  # the first of equal chunks
    d_units = np.where(best, d_top[text], 0).astype(np.float32)
    d_both = d_units @ net["mix"].T
    d_means = (d_both[:, :FILTERS] + 2 * means[:, :FILTERS] * d_both[:, FILTERS:]) / count[:, None]
    d_half = d_means.copy()
    inner = np.flatnonzero(~padded.last)
    d_half[inner + 1] += d_means[inner]
    d_value = (np.broadcast_to(d_half[:, None, :], grid.shape) * (grid > 0)).reshape(-1, FILTERS)
    d_steps = d_value @ net["filters"][0].T
    d_filters = [steps.T @ d_value]
    for j in range(1, WIDTH // STEP):
        d_filters.append(steps[j:].T @ d_value[:-j])
        d_steps[j:] += d_value[:-j] @ net["filters"][j].T
    d_bytes = d_steps.reshape(-1, EMBED)
    d_embed = np.stack([np.bincount(padded.bytes, d_bytes[:, e], 256) for e in range(EMBED)], axis=1)
    return {
        "embed": d_embed, "filters": np.stack(d_filters), "bias": d_value.sum(axis=0),
        "mix": means.T @ d_units, "mix_bias": d_units.sum(axis=0), "out": top.T @ d_logit, "out_bias": d_logit.sum(keepdims=True),
    }, loss


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 14, batch: int = 32, rate: float = 4e-3, decay: float = 1e-4, seed: int = 7) -> dict | None:
    """Fitted weights by Adam on the logistic loss; the same samples give the same weights."""
    if not texts:
        return None
    rng, net = np.random.default_rng(seed), fresh(seed)
    net["out_bias"][0] = np.log((labels.mean() + 0.01) / (1.01 - labels.mean()))
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    epochs = max(epochs, min(60, 30_000 // len(texts)))
    total, step = epochs * -(-len(texts) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            parts = [np.frombuffer(texts[i], np.uint8) for i in own]
            padded = Padded(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]))
            slope, _ = gradients(net, padded, labels[own])
            step += 1
            pace = rate * min(1, step / 50) * (1 - 0.95 * step / total)
            for k in net:
                g = slope[k].astype(np.float32) + decay * net[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return net


def probabilities(net: dict | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores of texts held in one buffer. Slabs of whole half-chunks bound memory; a text may span many slabs."""
    if net is None:
        return np.full(len(offsets) - 1, 0.5)
    top = np.zeros((len(offsets) - 1, UNITS), np.float32)
    first = 0
    while first < len(top):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLAB, "right")) - 1)
        if offsets[last] - offsets[first] <= 2 * SLAB:
            padded = Padded(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            top[first:last] = forward(net, padded)[5]
        else:
            top[first] = long_top(net, data[offsets[first] : offsets[last]])
        first = last
    logit = top.astype(np.float64) @ net["out"].astype(np.float64) + float(net["out_bias"][0])
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def long_top(net: dict, text: np.ndarray) -> np.ndarray:
    """Largest unit values of one long text, slab by slab; slabs share one chunk, so none is cut."""
    top = np.zeros(UNITS, np.float32)
    for at in range(0, len(text), SLAB):
        # two more half-chunks let the slab's last chunk and its last filters see what follows
        part = text[at : at + SLAB + 2 * HALF]
        units = forward(net, Padded(part, np.array([0, len(part)])))[4]
        ended = at + SLAB + 2 * HALF >= len(text)
        top = np.maximum(top, (units if ended else units[: SLAB // HALF]).max(axis=0))
    return top


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: Column, sample: int, crop: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[bytes], np.ndarray]:
    """At most ``sample`` labelled texts of the learning folds, as bytes, with their labels, in id order."""
    known = labels.filter(folds & F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.pmod(F.xxhash64(F.lit("start"), F.col(id_col)), F.greatest(F.length(text) - crop, F.lit(0)) + 1) + 1
    crops = docs.select(F.col(id_col).alias("id"), F.substring(text, start.cast("int"), F.lit(crop)).alias("text"))
    rows = crops.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.id)
    return [r.text.encode() for r in rows], np.array([r.label for r in rows], np.float32)


def fit(docs: DataFrame, labels: DataFrame, folds: Column, label: str = "quality", sample: int = 4000, crop: int = 6000, **names) -> dict | None:
    return train(*labelled_sample(docs, labels, label, folds, sample, crop, **names))


def with_score(docs: DataFrame, net: dict | None, score_col: str = "score", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its score appended."""
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probabilities(net, data, offsets), pa.float64())], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, net: dict | None, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with their columns as they are."""
    score = "_quality_score"
    return with_score(docs, net, score, text_col).filter(F.col(score) >= threshold).drop(score)
