"""Token counts of whole texts by overlap resynchronisation.

A text of up to ``stride + overlap`` characters is counted in one piece. A longer one is cut into chunks that
overlap; chunks are encoded with offsets in separate tasks and spliced where two neighbours agree:

* A *boundary* is the start of a pre-token (a word of the tokenizer's own splitting step, not merely a token).
* The splitter reads left to right and never looks back, so two scans that both have a boundary at p split the
  text after p alike. A boundary is proven in the left chunk when the chunk holds ``guard`` more characters
  after it (the splitter's look-ahead and the longest added token). If the right chunk has a boundary at the
  same p, its tokens from p on are those of the whole text.
* Neighbours without a common boundary (one word longer than the overlap) are encoded again with a wider
  overlap until all agree; in the end a chunk holds the whole text.

Defined results: a null or empty text has no tokens; equal rows are counted each; ids may be null or repeated;
other columns of the input are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.session import cut

STRIDE, OVERLAP = 32_768, 1_024
CACHE, JOINED = 400_000, 20_000
TOUCHING = re.compile(r"[\s\x00-\x1f](?=[ \n])|[ \n](?=[\s\x00-\x1f])|\n\Z")
PLAIN_END = re.compile(r"[0-9A-Za-zÀ-ÖØ-öø-ʯ]")
BETWEEN = re.compile(r"(?<=\S)(?= \S)")


def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordCounts:
    """Token counts of whole texts, remembering those of single words.

    A single space or line end between two other characters always starts a new pre-token and occurs in no
    added token, so a text may be encoded in pieces cut before them; a full stop or comma that ends such
    a piece behind a letter or digit is a pre-token of its own. Equal pieces are encoded once.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known = load(path), {}
        self.marks = dict(zip(".,", self.encode([".", ","]), strict=True))

    def encode(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Counts of new words: many are encoded as one text and told apart by the tokens' offsets."""
        known, marked, plain = self.known, [], []
        for w in words:
            if w[-1:] in self.marks and PLAIN_END.match(w, max(0, len(w) - 2)):
                marked.append(w)
                plain.append(w[:-1])
            else:
                plain.append(w)
        plain = list(set(plain) - known.keys())
        if "" in plain:
            known[""] = self.encode([" "])[0]
            plain.remove("")
        for at in range(0, len(plain), JOINED):
            part = plain[at : at + JOINED]
            text = [w if w[0] == "\n" else f" {w}" for w in part]
            starts = np.cumsum([0, *map(len, text)])
            e = self.tokenizer.encode("".join(text), add_special_tokens=False)
            tokens = np.fromiter((x for x, _ in e.offsets), np.int64, len(e))
            known.update(zip(part, np.diff(np.searchsorted(tokens, starts)).tolist(), strict=True))
        known.update((w, known[w[:-1]] + self.marks[w[-1]]) for w in marked)

    def counts(self, texts: list[str]) -> list[int]:
        first, rest, odd = [], [], {}
        for i, text in enumerate(texts):
            if TOUCHING.search(text):
                odd[i] = BETWEEN.split(text)
                first.append("")
                rest.append([])
            else:
                head, *words = text.replace("\n", " \n").split(" ")
                first.append(head)
                rest.append(words)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        self.learn(list(set().union(*rest) - known.keys()))
        total = [n + sum(map(known.__getitem__, words)) for n, words in zip(self.encode(first), rest, strict=True)]
        for i, pieces in odd.items():
            total[i] = sum(self.encode(pieces))
        return total


def _slabs(texts: list[str], limit: int = 4_000_000):
    """Index ranges of a batch with a bounded number of characters each."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def count_whole(rows: DataFrame, text: str, path: str) -> DataFrame:
    """``n_tokens`` appended to rows whose texts are encoded in one piece each; ``text`` itself is dropped."""
    kept = [f for f in rows.schema.fields if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens long"

    def run(batches):
        words = WordCounts(path)
        for batch in batches:
            texts = batch.pop(text).tolist()
            counts: list[int] = []
            for a, b in _slabs(texts):
                counts += words.counts(texts[a:b])
            batch["n_tokens"] = counts
            yield batch

    return rows.mapInPandas(run, schema)


def cut_chunks(texts: DataFrame, stride: int, overlap: int) -> DataFrame:
    """(text_key, chunk, start, stop, last, piece) of (text_key, text): chunks of stride + overlap characters."""

    def run(batches):
        for batch in batches:
            for key, text in zip(batch["text_key"], batch["text"], strict=True):
                n = max(1, -(-(len(text) - overlap) // stride))
                for i in range(n):
                    start, stop = i * stride, len(text) if i == n - 1 else min(len(text), (i + 1) * stride + overlap)
                    yield pd.DataFrame([(key, i, start, stop, i == n - 1, text[start:stop])], columns=["text_key", "chunk", "start", "stop", "last", "piece"])

    return texts.mapInPandas(run, "text_key string, chunk long, start long, stop long, last boolean, piece string")


def bounded(words: WordCounts, piece: str, left: int, right: int) -> tuple[int, list[tuple[int, int]]]:
    """Tokens of a chunk, and its boundaries (position, tokens before) in the first ``left`` and last ``right`` characters.

    Only these edges are encoded with offsets; between them, cut before spaces, words are counted.
    """
    a = BETWEEN.search(piece, left)
    near = max(0, len(piece) - right - 1024)
    b = [m.start() for m in BETWEEN.finditer(piece, near, len(piece) - right)] if right else [len(piece)]
    spans = [(0, a.start()), (b[-1], len(piece))] if a and b and a.start() < b[-1] else [(0, len(piece))]
    bounds, before = [], 0
    for i, (start, stop) in enumerate(spans):
        if i:
            before += words.counts([piece[spans[0][1] : start]])[0]
        e = words.tokenizer.encode(piece[start:stop], add_special_tokens=False)
        word, at = e.word_ids, e.offsets
        bounds += [(start + at[j][0], before + j) for j in range(len(word)) if j == 0 or word[j] != word[j - 1]]
        before += len(word)
    return before, bounds


def encode_chunks(chunks: DataFrame, overlap: int, path: str) -> DataFrame:
    """Token totals of chunks and the boundaries in both overlaps, as positions in the text with the tokens before each."""
    schema = "text_key string, chunk long, last boolean, n long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"

    def run(batches):
        words = WordCounts(path)
        guard = max([2, *(len(t.content) for t in words.tokenizer.get_added_tokens_decoder().values())])
        for batch in batches:
            for row in batch.itertuples():
                n, bounds = bounded(words, row.piece, overlap if row.chunk else 0, 0 if row.last else overlap)
                left = [(row.start + p, k) for p, k in bounds if p < overlap] if row.chunk else []
                right = [] if row.last else [(row.start + p, k) for p, k in bounds if row.stop - overlap <= row.start + p <= row.stop - guard]
                yield pd.DataFrame([(row.text_key, row.chunk, row.last, n, *(list(x) for x in (zip(*left, strict=True) if left else ([], []))), *(list(x) for x in (zip(*right, strict=True) if right else ([], []))))], columns=["text_key", "chunk", "last", "n", "left_at", "left_n", "right_at", "right_n"])

    return chunks.mapInPandas(run, schema)


def splice(encoded: DataFrame) -> DataFrame:
    """(text_key, n_tokens) of encoded chunks; null where some neighbours share no proven boundary.

    Every chunk gives the tokens before its right splice less those before its left one.
    """
    left = encoded.filter("chunk > 0").select("text_key", (F.col("chunk") - 1).alias("chunk"), "left_at", "left_n")
    seams = encoded.filter("not last").select("text_key", "chunk", "right_at", "right_n").join(left, ["text_key", "chunk"])
    seams = seams.withColumn("p", F.array_min(F.array_intersect("right_at", "left_at")))
    gain = F.expr("right_n[cast(array_position(right_at, p) as int) - 1] - left_n[cast(array_position(left_at, p) as int) - 1]")
    parts = seams.select("text_key", gain.alias("part"), F.col("p").isNull().alias("open"))
    tails = encoded.filter("last").select("text_key", F.col("n").alias("part"), F.lit(False).alias("open"))
    return parts.unionByName(tails).groupBy("text_key").agg(F.when(~F.max("open"), F.sum("part")).alias("n_tokens"))


def count_long(texts: DataFrame, path: str, stride: int = STRIDE, overlap: int = OVERLAP) -> DataFrame:
    """(text_key, n_tokens) of distinct long texts given as (text_key, text)."""
    done = None
    while True:
        parts = texts.sparkSession.conf.get("spark.sql.shuffle.partitions")
        chunks = cut_chunks(texts, max(stride, overlap), overlap).repartition(int(parts), "text_key", "chunk")
        spliced = cut(splice(cut(encode_chunks(chunks, overlap, path), "token-chunks")), "token-splices")
        done = spliced if done is None else done.filter("n_tokens is not null").unionByName(spliced)
        open_keys = spliced.filter("n_tokens is null").select("text_key")
        if open_keys.isEmpty():
            return done
        texts, overlap = texts.join(open_keys, "text_key", "left_semi"), overlap * 4


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", stride: int = STRIDE, overlap: int = OVERLAP, limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``n_tokens``, ``over_limit`` and ``chunked``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    whole = F.length("text") <= stride + overlap
    short = count_whole(rows.filter(whole), "text", path).withColumn("chunked", F.lit(False))
    large = rows.filter(~whole).withColumn("text_key", F.sha2("text", 256))
    counted = count_long(large.select("text_key", "text").dropDuplicates(["text_key"]), path, stride, overlap)
    long = large.drop("text").join(counted, "text_key").select("id", "n_bytes", "n_tokens", F.lit(True).alias("chunked"))
    return short.unionByName(long).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "chunked")
