"""Alignment of two tokenizers against encoding whole texts and comparing all token pairs."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidebook.llm import crosstok as ct
from tidebook.llm.queries import op11_cross_tokenizer_alignment

PATHS = tuple(str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def spans(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def brute(rows):
    """Rows of the contract from whole texts, by comparing all pairs of tokens."""
    pair, docs = ct.Pair(*PATHS), []
    for key, text in rows:
        a, b = (x[0] for x in pair.encode([f" {text}"])) if text else ([], [])
        if text and not b"".join(pair.bytes_a[i] for i in a) == f" {text}".encode() == b"".join(pair.bytes_b[i] for i in b):
            a, b = [], []
        sa, sb = spans([pair.bytes_a[i] for i in a]), spans([pair.bytes_b[i] for i in b])
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        group = lambda s: sum(e <= s[0] for e in ends)
        ga, gb = [group(s) for s in sa], [group(s) for s in sb]
        links = [(x, y) for x, g in zip(a, ga, strict=True) for y, h in zip(b, gb, strict=True) if g == h]
        overlaps = sum(s[0] < t[1] and t[0] < s[1] for s in sa for t in sb)
        told = ";".join(",".join(str(x) for x, h in zip(a, ga, strict=True) if h == g) + "|" + ",".join(str(x) for x, h in zip(b, gb, strict=True) if h == g) for g in range(len(ends)))
        docs.append((key, len(a), len(b), overlaps, len(ends), links, told))
    count = Counter(p for d in docs for p in set(d[5]))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    return [(k, n_a, n_b, n_o, n_g, len(ls), sum(count[p] == top[p[0]] for p in ls), sum(count[p] for p in ls), sha(t)) for k, n_a, n_b, n_o, n_g, ls, t in docs]


def run(spark, docs):
    aligned = ct.cut(ct.align(docs, *PATHS), "aligned")
    return ct.scored(aligned, ct.link_counts(aligned))


def told(out):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_overlaps, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()), key=key), key


def texts():
    rng = random.Random(5)
    bits = ["the", "Straße", "naïve", "東京都に", "🙂", "▁", "<|endoftext|>", "</s>", "x" * 40, "12,345.67", "don't", "\n", "\t", "  ", "   ", " ", "\x1c", "\x00", "Übergrößenträger", "á", "مرحبا", "<0x41>"]
    out = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    out += ["".join(rng.choice(bits + [" "]) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    return out + [" ", "  ", " a", "a ", "▁", "a▁b", "\n\n a \n", "".join(chr(rng.randint(33, 0x2FFF)) for _ in range(300))]


def test_random_texts(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(None, "the cat"), (3, "the cat"), (3, "the cat"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, pair string").repartition(5)
    got, key = told(run(spark, docs))
    assert got == sorted(brute(rows), key=key)
    assert sum(r[1] > 0 for r in got) > 100


def test_words_are_forgotten_and_slabs_are_small(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts()[:60])]
    pair = ct.Pair(*PATHS)
    want = ct.aligned_batch(ct.Words(pair), [t for _, t in rows], True)
    for name, value in (("WORDS", 3), ("SLAB_CHARS", 10), ("SLAB", 5)):
        monkeypatch.setattr(ct, name, value)
    words = ct.Words(pair)
    for i, (_, text) in enumerate(rows):
        assert [c.to_pylist() for c in ct.aligned_batch(words, [text], True)] == [c.slice(i, 1).to_pylist() for c in want]


def test_product_is_matrix_product(monkeypatch):
    rng = np.random.default_rng(1)
    for slab in (1, 7, 10_000):
        monkeypatch.setattr(ct, "SLAB", slab)
        a, b = rng.integers(0, 3, (9, 14)), rng.integers(0, 3, (14, 6))
        make = lambda m: ct.csr(*np.nonzero(m), m[np.nonzero(m)], len(m))
        starts, columns, values = ct.product(make(a), make(b))
        out = np.zeros((9, 6), np.int64)
        out[np.repeat(np.arange(9), np.diff(starts)), columns] = values
        assert (out == a @ b).all()


def test_empty_long_and_shuffled(spark, monkeypatch):
    assert run(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "never stop " * 4000), (2, "z" * 30_000), (3, "stop")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    aligned = ct.cut(ct.align(docs, *PATHS, with_groups=True), "aligned")
    by_id = {r.doc_id: r for r in aligned.collect()}
    assert by_id[1].n_groups >= 8000 and by_id[1].groups.count(";") == by_id[1].n_groups - 1
    assert hashlib.sha256(by_id[2].groups.encode()).hexdigest() == by_id[2].groups_sha256
    sent = told(ct.scored(aligned, ct.link_counts(aligned)))[0]
    monkeypatch.setattr(ct, "SENT_IDS", -1)
    assert told(ct.scored(aligned, ct.link_counts(aligned)))[0] == sent


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    out = op11_cross_tokenizer_alignment(spark, sf)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text is None or len(r.text) < 2500]
    whole = {r.doc_id: r for r in out.collect()}
    assert len(whole) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for key, n_a, n_b, n_o, n_g, n_l, _, _, sha in brute(rows):
        r = whole[key]
        assert (r.n_a, r.n_b, r.n_overlaps, r.n_groups, r.n_links, r.groups_sha256) == (n_a, n_b, n_o, n_g, n_l, sha)


@pytest.mark.parametrize("text", ["a b", "über alles", "日本 語"])
def test_words_cut_like_whole_texts(text):
    pair = ct.Pair(*PATHS)
    assert pair.by_word
    whole = pair.encode([f" {text}"])
    parts = pair.encode(ct.WORD.split(f" {text}"))
    assert [x[0] for x in whole] == [[i for p in x for i in p] for x in parts]
