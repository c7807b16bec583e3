"""Exact and re-parameterised items are found, clashing values and clean texts are not; against plain matching."""

import random
import re

import numpy as np

from tidebook.llm import templates as tp
from tidebook.llm.queries import op7_benchmark_decontamination

ITEMS = [
    (1, "Anna buys 12 apples for 3.50 dollars each and gives 4 apples to Ben because Anna likes her friend Ben a lot."),
    (2, "A train travels 300 km in 4 hours. How far does the same train travel in 9 hours at that speed?"),
    (3, "The quick brown fox jumps over the lazy dog while the sleepy cat watches from the warm window sill."),
    (4, "short item with six plain words"),
    (5, None),
]
FILL = "here are other words that say nothing of interest to anyone at all and go on for a while longer."


def verdicts(spark, texts, **params):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_items string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {r.doc_id: r for r in tp.report(docs, bench, **params).collect()}


def test_canonical_tokens():
    text = "Then Anna ran 3.5km, or 1,200 m. Éva saw Élan 7 times".encode()
    c = tp.Canonical(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    words = [text[a:b].decode() for a, b in zip(c.starts, c.ends, strict=True)]
    assert words == ["Then", "Anna", "ran", "3.5", "km", "or", "1,200", "m", "Éva", "saw", "Élan", "7", "times"]
    assert c.kind.tolist() == [tp.PLAIN, tp.NAME, tp.PLAIN, tp.NUMBER, tp.UNIT, tp.PLAIN, tp.NUMBER, tp.UNIT, tp.PLAIN, tp.PLAIN, tp.NAME, tp.NUMBER, tp.PLAIN]


def test_exact_changed_and_clashing(spark):
    changed = "Maya buys 15 apples for 2.25 euros each and gives 6 apples to Tom because Maya likes her friend Tom a lot."
    clash = "A bus goes. A train travels 500 miles in 4 hours. How far does the same train travel in 4 hours at that speed?"
    got = verdicts(spark, [FILL, f"{FILL} {ITEMS[0][1]} {FILL}", f"{FILL} {changed}", f"{FILL} {ITEMS[2][1].upper()}", None, "", f"so {ITEMS[3][1]} indeed", ITEMS[2][1][:50], f"{FILL} {ITEMS[1][1]} {FILL} {ITEMS[0][1]}", clash])
    assert {i: r.item_id for i, r in got.items()} == {0: None, 1: 1, 2: 1, 3: 3, 4: None, 5: None, 6: 4, 7: None, 8: 1, 9: got[9].item_id}
    assert not got[1].reparameterised and got[2].reparameterised and got[8].n_items == 2
    assert got[1].matched_share == 1.0 and 0.9 < got[2].matched_share < 1  # the name that opens the sentence is a word


def test_slot_consistency_removes_windows(spark):
    fair = "Anna buys 7 apples for 2.25 dollars each and gives 9 apples to Ben because Anna likes her friend Ben a lot."
    torn = "Anna buys 7 apples for 2.25 dollars each and gives 7 apples to Eve because Max likes her friend Zoe a lot."
    got = verdicts(spark, [fair, torn], share=0.9)
    assert got[0].contaminated and not got[1].contaminated


def test_keep_clean_and_edges(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(1, FILL, "k"), (1, FILL, "k"), (None, f"a {ITEMS[2][1]}", None), (2, None, "m"), (3, "", "_leaked")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = tp.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == ["", "", FILL, FILL]
    assert tp.keep_clean(docs, bench.limit(0)).count() == 5 and tp.keep_clean(docs.limit(0), bench).count() == 0


def test_query_equals_plain_matching(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    squeeze = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [f" {squeeze(t)} " for t in items]
    whole = {i for i, t in docs.items() if any(x in f" {squeeze(t)} " for x in items)}
    found = {r.doc_id for r in op7_benchmark_decontamination(spark, sf).collect() if r.contaminated}
    assert whole and whole <= found and len(found - whole) <= 0.01 * len(docs)


def judged(spark, items, texts, **params):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = tp.report(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), **params).collect()
    return [r.item_id for r in sorted(out, key=lambda r: r.doc_id)]


def test_names_that_open_sentences_or_have_more_words(spark):
    sold = "Natalia sold 48 clips in April. Natalia then sold half as many in May. How many clips did Natalia sell?"
    trip = "Last summer the family of Ben drove from Boston to the coast with Ben and stayed in Boston for a week before Ben left the town of Boston again."
    texts = [
        sold.replace("Natalia", "Maria"), f"{FILL} Now {sold.replace('Natalia', 'Mary Ann')}", f"How To Win. {sold}",
        trip.replace("Ben", "Mary Ann").replace("Boston", "New York"), f"{FILL} {trip.replace('Boston', 'Salt Lake City')}", FILL,
    ]
    assert judged(spark, [sold, trip], texts) == [0, 0, 0, 1, 1, None]


def test_names_in_a_row_are_one_token():
    text = b"He met Mary Ann Smith, Ben and Jean-Luc. New York is big"
    c = tp.Canonical(np.frombuffer(text, np.uint8), np.array([0, len(text)]), tp.NAMES)
    words = [text[a:b].decode() for a, b in zip(c.starts, c.ends, strict=True)]
    assert words == ["He", "met", "Mary Ann Smith", "Ben", "and", "Jean-Luc", "New York", "is", "big"]
    assert c.word.tolist() == [0, 1, 2, 5, 6, 7, 9, 11, 12]


def test_items_of_values_or_names_are_found_as_they_are(spark):
    items = ["What is 12 + 35 * 4?", "7 13 19 25 31 37 43 49 55 61", "Der Hund Bello und die Katze Minka", "42"]
    texts = [f"{FILL} What is 12 + 35 * 4? {FILL}", f"a 7, 13, 19, 25, 31, 37, 43, 49, 55, 61 {FILL}", f"So: der Hund Bello und die Katze Minka. {FILL}", "42!", f"page 42 {FILL}", "What is 12 + 35 * 5?", FILL]
    assert judged(spark, items, texts) == [0, 1, 2, 3, None, None, None]


def test_many_copies_of_one_item(spark):
    rng = random.Random(1)
    texts = [f"{rng.random()} {ITEMS[2][1]}" for _ in range(50)] + [ITEMS[2][1]] * 50
    assert all(r.contaminated for r in verdicts(spark, texts).values())
