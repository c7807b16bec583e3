"""Spliced and remembered counts against the library on the whole text."""

import random

import pytest

from tidebook.llm import token_counts as tc
from tidebook.llm.queries import op1_token_counts, tokenizer_path

WORDS = ["the", "été", "ñandú", "x" * 40, "don't", "<|endoftext|>", "<|endo", "12345", "!!", "中文字", "🙂", "a b", "\n", "tab\tbed"]


@pytest.fixture(scope="module")
def library():
    return tc.load(tokenizer_path())


def text_of(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "", "  ", "\n", " \n ", "　"]) for _ in range(n))


def test_remembered_words_equal_whole_text(library):
    texts = [text_of(s, 60) for s in range(60)] + ["", " ", "  ", " a", "a ", "\n", "x" * 5000]
    counts = tc.WordCounts(tokenizer_path())
    expected = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counts.counts(texts) == expected
    assert counts.counts(texts) == expected


def test_spliced_equal_whole_text(spark, library):
    texts = [text_of(s, 900) for s in range(6)] + ["y" * 4000, "a b " * 700 + "z" * 1500 + " c" * 600, " " * 3000, "<|endoftext|>" * 300]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "y"), (3, texts[3], "z"), (50, None, "n"), (51, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = tc.token_counts(docs, tokenizer_path(), stride=300, overlap=40).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got) and any(r.chunked for r in got)


def test_empty_table(spark):
    assert tc.token_counts(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_query(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in op1_token_counts(spark, sf).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in docs.items()}
