"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, by products of sparse incidence matrices.

Both tokenizers encode space + text. All matrices are CSR triples (starts, columns, values) built here by hand, and
``product`` multiplies two of them row by row (Gustavson), a bounded slab of rows at a time:

* token-byte incidence A (tokens x bytes) times B transposed (bytes x tokens) gives the overlap links with their shared bytes;
* offsets where tokens of both end cut the bytes into groups; group incidence of A (a row for each id in a group, with its
  occurrences) times that of B transposed gives the shared-group links of a text;
* documents x words times words x id pairs gives the links of a document.

A *word* starts at each space between two other characters. There a pre-token of A starts, and no piece of B holds a space
behind another character (checked at load), so both tokenizers end a token: words align apart from each other, and
equal words are aligned once a task. A text with a word whose bytes do not come back is encoded in one piece instead.

``align`` returns counts, the link table of each document and, if asked, its groups; ``link_counts`` counts the documents of
each id pair over the corpus; ``scored`` sums these over a document's links.

Defined results: texts that are null or empty, or whose joined token bytes differ from space + text, have no tokens: zeros, and
'' for groups. Repeated rows are documents of their own, ids may be null or repeated, other columns are ignored.
A text is held whole by its task (its groups are one string), words are remembered up to a bound.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import SENT_IDS
from tidebook.session import cut

WORD = re.compile(r"(?<=\S)(?= \S)")
#: bits of an id in a pair's name
ID_BITS = 20
#: words and their characters that a task remembers, characters aligned at once, entries of a product's slab
WORDS, WORD_CHARS, SLAB_CHARS, SLAB = 300_000, 6_000_000, 1_000_000, 1_000_000

Csr = tuple[np.ndarray, np.ndarray, np.ndarray]


def csr(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> Csr:
    """The matrix of entries (row, column, value); equal places are summed."""
    bits = int(columns.max(initial=1)).bit_length()
    if bits + height.bit_length() > 63:
        raise OverflowError("places above 63 bits")
    key = rows << bits | columns
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key)
        key, values = key[order], values[order]
    first = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=first[1:])
    at = np.nonzero(first)[0]
    if len(at) < len(key):
        key, values = key[at], np.add.reduceat(values, at)
    return np.searchsorted(key, np.arange(height + 1) << bits), key & ((1 << bits) - 1), values


def product(left: Csr, right: Csr) -> Csr:
    """left x right: every row of the result gathers the rows of ``right`` that its entries name, scaled and summed."""
    starts, columns, values = left
    fan = np.diff(right[0])[columns]
    before = np.concatenate(([0], np.cumsum(fan)))
    cuts, height = [0], len(starts) - 1
    while cuts[-1] < height:
        reach = int(np.searchsorted(before[starts], before[starts[cuts[-1]]] + SLAB, side="right")) - 1
        cuts.append(min(height, max(cuts[-1] + 1, reach)))
    parts = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        a, b = starts[lo], starts[hi]
        many = fan[a:b]
        row = np.repeat(np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1])), many)
        at = np.arange(many.sum()) - np.repeat(before[a:b] - before[a], many) + np.repeat(right[0][columns[a:b]], many)
        parts.append(csr(row, right[1][at], np.repeat(values[a:b], many) * right[2][at], hi - lo))
    if not parts:
        return np.zeros(1, np.int64), columns[:0], values[:0]
    held = np.concatenate([np.diff(p[0]) for p in parts])
    return np.concatenate(([0], np.cumsum(held))), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Both tokenizers, and what their ids are in bytes."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        alphabet, size = byte_alphabet(), max(self.a.get_vocab().values()) + 1
        self.bytes_a = [b""] * size
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.by_word = not any(re.search("[^▁]▁", p) for p in pieces)
        if max(size, len(pieces)) > 1 << ID_BITS:
            raise ValueError(f"ids above {ID_BITS} bits")

    def encode(self, texts: list[str]) -> tuple[list, list]:
        """Ids of texts that begin with the added space; B adds its own."""
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)

    def flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words one after another, if the bytes come back and both have a token's end at each word's end."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = "".join(words)
        a, b = (x[0] for x in self.encode([text]))
        if b"".join(map(self.bytes_a.__getitem__, a)) != text.encode() or b"".join(map(self.bytes_b.__getitem__, b)) != text.encode():
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def joinable(word: str) -> bool:
    """Whether the word ends and begins so that it may stand between others: a space and a character, and a character."""
    return len(word) > 1 and not word[1].isspace() and not word[-1].isspace()


class Words:
    """What a task knows of words: counts (tokens of A and B, overlaps, groups, links), groups as text, and linked id pairs."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.long_a, self.long_b = (np.array([len(x) for x in held], np.int64) for held in (pair.bytes_a, pair.bytes_b))
        size = max(len(self.long_a), len(self.long_b))
        self.told = np.array([f"{i}{end}" for end in ",|;" for i in range(size)], object)
        self.told_long = np.array([len(x) for x in self.told], np.int64)
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.at, self.groups, self.chars = {}, [], 0
        self.counts, self.links = np.zeros((0, 5), np.int64), (np.zeros(1, np.int64), none, none)

    def learn(self, words: list[str]) -> None:
        """Align new words: those that can stand side by side are encoded as one text and told apart by their bytes."""
        plain, single, start, held = [w for w in words if joinable(w)], [w for w in words if not joinable(w)], 0, 0
        for i, word in enumerate(plain):
            held += len(word)
            if held >= SLAB_CHARS or i == len(plain) - 1:
                part = plain[start : i + 1]
                found = self.pair.flat(part)
                if found is None:
                    single += part
                else:
                    self.add(part, *found)
                start, held = i + 1, 0
        good, parts = [], []
        for word in single:
            found = self.pair.flat([word])
            if found is None:
                self.at[word] = -1
            else:
                good.append(word)
                parts.append(found)
        if good:
            self.add(good, *(np.concatenate(x) for x in zip(*parts, strict=True)))

    def add(self, words: list[str], a: np.ndarray, b: np.ndarray) -> None:
        """Align words as the blocks of block-diagonal matrices, and keep what comes out."""
        self.at.update(zip(words, range(len(self.groups), len(self.groups) + len(words)), strict=True))
        self.chars += sum(map(len, words))
        word_ends = np.cumsum([len(w.encode()) for w in words])
        long_a, long_b = self.long_a[a], self.long_b[b]
        end_a, end_b, size = np.cumsum(long_a), np.cumsum(long_b), int(word_ends[-1])
        one = np.ones(size, np.int64)
        token_bytes = (np.concatenate(([0], end_a)), np.arange(size), one)
        byte_tokens = (np.arange(size + 1), np.repeat(np.arange(len(b)), long_b), one)
        overlaps = np.diff(product(token_bytes, byte_tokens)[0])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        word_of, word_a, word_b = (np.searchsorted(word_ends, x) for x in (ends, end_a, end_b))
        ids_in_a, ids_in_b = csr(group_a, a, np.ones_like(a), len(ends)), csr(group_b, b, np.ones_like(b), len(ends))
        row_group = np.repeat(np.arange(len(ends)), np.diff(ids_in_a[0]))
        links = product((np.arange(len(row_group) + 1), row_group, ids_in_a[2]), ids_in_b)
        row = np.repeat(np.arange(len(row_group)), np.diff(links[0]))
        by_word = csr(word_of[row_group[row]], ids_in_a[1][row] << ID_BITS | links[1], links[2], len(words))
        total = lambda rows, values=None: np.bincount(rows, values, len(words)).astype(np.int64)
        n_links = np.diff(np.concatenate(([0], np.cumsum(by_word[2])))[by_word[0]])
        counts = np.stack([total(word_a), total(word_b), total(word_a, overlaps), total(word_of), n_links], axis=1)
        self.counts = np.concatenate([self.counts, counts])
        starts, pairs, values = self.links
        self.links = np.concatenate([starts, starts[-1] + by_word[0][1:]]), np.concatenate([pairs, by_word[1]]), np.concatenate([values, by_word[2]])
        # a group reads a1,a2|b1,b2; - its tokens in order, each with what follows it
        group, side = np.concatenate([group_a, group_b]), np.concatenate([np.zeros(len(a), bool), np.ones(len(b), bool)])
        order = np.argsort(group * 2 + side, kind="stable")
        group, side = group[order], side[order]
        last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)
        token = np.concatenate([a, b])[order] + np.where(last, 1 + side, 0) * (len(self.told) // 3)
        text, stops = "".join(self.told[token].tolist()), np.cumsum(self.told_long[token])
        stops = stops[np.append(word_of[group[1:]] != word_of[group[:-1]], True)].tolist()
        self.groups.extend(text[x : y - 1] for x, y in zip([0, *stops], stops, strict=False))

    def place(self, texts: list[str | None]) -> list[list[int]]:
        """The words of each text, by their places in this table; of texts without tokens, none."""
        if len(self.at) > WORDS or self.chars > WORD_CHARS:
            self.clear()
        split = [(WORD.split(f" {t}") if self.pair.by_word else [f" {t}"]) if t else [] for t in texts]
        self.learn(list(set().union(*split) - self.at.keys()))
        at = self.at.__getitem__
        placed = [list(map(at, words)) for words in split]
        odd = [i for i, words in enumerate(placed) if -1 in words]
        self.learn(list({f" {texts[i]}" for i in odd} - self.at.keys()))
        for i in odd:
            k = self.at[f" {texts[i]}"]
            placed[i] = [] if k < 0 else [k]
        return placed


def aligned_batch(words: Words, texts: list[str | None], with_groups: bool) -> list[pa.Array]:
    """The columns of ``align`` for some texts: documents x words times words x pairs."""
    placed = words.place(texts)
    document = np.repeat(np.arange(len(texts)), [len(p) for p in placed])
    word = np.fromiter((k for p in placed for k in p), np.int64, len(document))
    texts_words = csr(document, word, np.ones_like(word), len(texts))
    links = product(texts_words, words.links)
    counts = words.counts[texts_words[1]] * texts_words[2][:, None]
    sums = np.diff(np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(counts, axis=0)])[texts_words[0]], axis=0)
    groups = [";".join(map(words.groups.__getitem__, p)) for p in placed]
    ragged = lambda values: pa.ListArray.from_arrays(pa.array(links[0], pa.int32()), pa.array(values, pa.int64()))
    out = [pa.array(sums[:, j], pa.int64()) for j in range(5)]
    out += [pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string())]
    return [*out, ragged(links[1]), ragged(links[2]), *([pa.array(groups, pa.string())] if with_groups else [])]


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_a``, ``n_b``, ``n_overlaps``, ``n_groups``, ``n_links``, ``groups_sha256``,
    ``pairs`` (a << 20 | b) with ``links`` (occurrences) and, if asked, ``groups`` (``a1,a2|b1;a3|b2``)."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    named = f"`{id_col}` long, n_a long, n_b long, n_overlaps long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"
    names = [id_col, "n_a", "n_b", "n_overlaps", "n_groups", "n_links", "groups_sha256", "pairs", "links", *(["groups"] if with_groups else [])]

    def run(batches):
        words = Words(Pair(path_a, path_b))
        for batch in batches:
            texts, start, held = batch.column(1).to_pylist(), 0, 0
            for i, text in enumerate(texts):
                held += len(text or "")
                if held >= SLAB_CHARS or i == len(texts) - 1:
                    out = aligned_batch(words, texts[start : i + 1], with_groups)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), *out], names)
                    start, held = i + 1, 0

    return rows.mapInArrow(run, named + (", groups string" if with_groups else ""))


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, documents, best): in how many documents an id pair is linked, and whether no other pair of its A id is in more."""
    counts = cut(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents")), "token-pairs")
    a = F.shiftright("pair", ID_BITS)
    top = counts.groupBy(a.alias("a")).agg(F.max("documents").alias("top"))
    return counts.join(top, a == F.col("a")).select("pair", "documents", (F.col("documents") == F.col("top")).alias("best"))


def scored(aligned: DataFrame, counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``aligned`` rows with ``n_best`` and ``count_sum`` over their links.

    The table of pairs goes to every task while it is short (counted, at most SENT_IDS); beyond that both sides are shuffled by
    pair, where frequent pairs can be split. ``aligned`` must be a written table, as its rows are told apart by their places.
    """
    counts = cut(counts, "token-pair-counts")
    kept = ["n_a", "n_b", "n_overlaps", "n_groups", "n_links", "groups_sha256"]
    placed = aligned.withColumn("_row", F.monotonically_increasing_id())
    entries = placed.select("_row", F.explode(F.arrays_zip("pairs", "links")).alias("e")).select("_row", F.col("e.pairs").alias("pair"), F.col("e.links").alias("n"))
    met = entries.join(F.broadcast(counts) if counts.count() <= SENT_IDS else counts, "pair")
    n, best = F.col("n"), F.when(F.col("best"), F.col("n")).otherwise(0)
    sums = met.groupBy("_row").agg(F.sum(best).alias("n_best"), F.sum(n * F.col("documents")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return placed.select(id_col, *kept, "_row").join(sums, "_row", "left").select(id_col, *kept, zero("n_best"), zero("count_sum"))
