"""Every stage of the pipeline on its own input against a plain version, and the whole on planted cases."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp

SF = "/root/testdata/sf0.01"


def shingles(text, width=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        docs = cp.cut(stage(spark, docs, SF), name)
        out.append((name, docs))
    return out


def test_columns_and_shrinking(spark, steps):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    before = first
    for _, docs in steps[:-1]:
        assert docs.columns == first.columns
        assert docs.exceptAll(before).isEmpty()
        before = docs
    last = steps[-1][1]
    assert last.count() == before.count() and {"doc_id", "shard", "slot", "text"} <= set(last.columns)


def test_quality_keeps_good_documents(spark, steps):
    kept = {r.doc_id for r in steps[0][1].select("doc_id").collect()}
    rows = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    good, bad = [[r.doc_id for r in rows if r.quality == k] for k in (1, 0)]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.3 * len(bad)


def test_one_of_each_group_stays(steps):
    before = {r.doc_id: shingles(r.text) for r in steps[0][1].collect()}
    kept = {r.doc_id for r in steps[1][1].select("doc_id").collect()}
    held = {}
    for i, s in before.items():
        for x in s:
            held.setdefault(x, []).append(i)
    root = {i: i for i in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in before.items():
        for j in {j for x in s for j in held[x] if j > i}:
            both = len(s & before[j])
            if 100 * both >= 80 * (len(s) + len(before[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert kept == {i for i in before if find(i) == i}


def test_no_item_is_left_and_clean_documents_stay(spark, steps):
    squeeze = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [squeeze(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = [{r.doc_id: squeeze(r.text or "") for r in steps[k][1].collect()} for k in (1, 2)]
    leaks = {i for i, t in before.items() if any(x in t for x in items)}
    assert leaks and not leaks & set(after) and len(set(before) - set(after) - leaks) <= 0.01 * len(before)


def test_mix_and_shards(steps):
    mixed = steps[3][1].groupBy("source").count().collect()
    before = {r.source: r["count"] for r in steps[2][1].groupBy("source").count().collect()}
    short = [r for r in mixed if r["count"] < before[r.source]]
    assert len(short) <= 1
    rows = steps[4][1].groupBy("shard").count().collect()
    assert max(r["count"] for r in rows) - min(r["count"] for r in rows) <= 1


def test_mixing_keeps_all_and_shards_keep_the_mix(steps):
    assert steps[3][1].count() == steps[2][1].count()
    seqs = sorted(r.mix_seq for r in steps[4][1].select("mix_seq").collect())
    assert seqs == list(range(len(seqs)))


def test_places_are_those_of_the_mixing_stage(spark, steps):
    order = [r.doc_id for r in steps[3][1].select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    assert [r.doc_id for r in steps[4][1].orderBy("mix_seq").select("doc_id").collect()] == order
    other = steps[3][1].orderBy(F.col("doc_id").desc())
    for docs in (cp.cut(other, "other-mix"), spark.createDataFrame(other.take(5), other.schema)):
        ids = [r.doc_id for r in cp.sharding_stage(spark, docs, SF).orderBy("mix_seq").select("doc_id").collect()]
        assert ids == sorted(ids, reverse=True) and len(ids) == docs.count()


def test_odd_rows_and_registration(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, score string"
    docs = spark.createDataFrame([(None, None, None, None, None, "x"), (1, "", "", "", 0, None), (1, "", "", "", 0, None), (2, "a b c", "en", "s", 5, "y")], shape)
    for odd in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            odd = cp.cut(stage(spark, odd, SF), "odd")
        odd.count()
    assert entry.queries()["pipeline"] is cp.run
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_|", q)[0] for q in entry.queries()}
