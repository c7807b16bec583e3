"""PartEnum components and link counts against comparing every pair."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidebook.llm import partenum as pe
from tidebook.llm.queries import op5_ngram_jaccard_join
from tidebook.llm.shingles import shingle_sets

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_sets(text, width=3):
    words = [w.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for w in WORD.findall((text or "").encode())]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows):
    """(id, size, component, links) of (id, text) rows, comparing all pairs that share a shingle."""
    sets = [brute_sets(t) for _, t in rows]
    held = {}
    for i, s in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(i)
    root, links, seen = list(range(len(rows))), [0] * len(rows), set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for x in s for j in held[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 90 * (len(s) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[find(i)] = min(key, low.get(find(i), key))
    return sorted(((-1 if k is None else k), len(sets[i]), low.get(find(i), -1) if sets[i] else (-1 if k is None else k), links[i]) for i, (k, _) in enumerate(rows))


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.n_links) for r in df.collect())


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(3))
    rows = []
    for n in (1, 2, 3, 5, 8, 12, 14, 21, 25, 32, 40, 60, 120, 333):
        for _ in range(3):
            base = [word() for _ in range(n)]
            for _ in range(6):
                other = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, 3, max(1, n // 60)])):
                    i = rng.randrange(len(other))
                    other[i : i + 1] = rng.choice([[word()], [], [other[i], word()]])
                    other = other or ["x"]
                rows.append((len(rows) + 10, rng.choice([" ", "\n", "\t "]).join(other)))
    return rows


def test_shingles_equal_plain_sets():
    texts = [t for _, t in corpus(4)] + ["", " \n", "A b", "a B", "É é x", None, "w" * 50, "one two\x0bthree\x0cfour\x1cfive"]
    sets = shingle_sets(pa.array(texts), 3)
    plain = [brute_sets(t) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i in range(0, len(texts), 3):
        for j in range(len(texts)):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])


def test_small_windows(monkeypatch):
    import tidebook.llm.shingles as sh

    texts = pa.array([t for _, t in corpus(5)])
    whole = shingle_sets(texts, 3)
    monkeypatch.setattr(sh, "WINDOW", 50)
    assert all((a == b).all() for a, b in zip(whole, shingle_sets(texts, 3), strict=True))


def test_every_linked_pair_shares_a_signature():
    scheme, rng = pe.Scheme(90, 100), np.random.default_rng(3)
    for n in [*range(1, 60), 100, 237, 500, 1777]:
        for _ in range(3):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            grow = rng.integers(0, len(a) // 9 + 1)
            lose = int((len(a) * 10 - 9 * grow) // 100) if grow * 9 <= len(a) * 10 else 0
            b = np.unique(np.concatenate([rng.permutation(a)[lose:], rng.integers(0, 2**63, grow).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 90 * (len(a) + len(b) - common):
                assert np.intersect1d(scheme.signatures(a), scheme.signatures(b)).size


@pytest.mark.parametrize("block", [256, 3])
def test_equals_all_pairs(spark, block):
    rows = corpus(2) + [(1, None), (2, ""), (3, " \n "), (None, "a b c d"), (None, "lonely"), (7, "a b c d"), (7, "A  b c d"), (7, "A  b c d")]
    docs = spark.createDataFrame([(i, t, "n", 0) for i, t in rows], "doc_id long, text string, node string, component_id int").repartition(3)
    assert got(pe.jaccard_join(docs, block=block)) == brute(rows)


def test_near_copies_in_blocks(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else f"x{rng.randrange(99)}" for w in base)) for i in range(150)]
    assert got(pe.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), block=16)) == brute(rows)


def test_keep_first(spark):
    rows = [(5, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "other words"), (9, "other words"), (None, "a b c d"), (None, ""), (6, None)]
    kept = pe.keep_first(spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string"))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in kept.select("doc_id", "text").collect() if r.text) == [(-1, "a b c d"), (4, "a b c d"), (9, "other words")]
    assert kept.count() == 5 and kept.columns == ["doc_id", "text", "source"]


def test_keep_first_finds_one_sided_passages(spark):
    """Texts and the same with as many words more as the threshold allows: at the end, at the start or inside, over all bands."""
    rows, want = [], set()
    for n in [*range(9, 90), 120, 150, 237, 300, 450, 568, 570, 700, 1100, 2000]:
        more = (n - 4) // 4
        for cutting in (0, n // 2, n):
            key, words, own = len(rows), [f"t{len(rows)}w{i}" for i in range(n)], [f"t{len(rows)}p{i}" for i in range(more)]
            longer = words[:cutting] + own + words[cutting:]
            rows += [(key, " ".join(words)), (key + 1, " ".join(longer))]
            a, b = (brute_sets(x, 5) for _, x in rows[-2:])
            want |= {key} if 10 * len(a & b) >= 8 * len(a | b) else {key, key + 1}
    kept = pe.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want and len(want) < 1.4 * len(rows) / 2


def test_empty(spark):
    assert pe.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op5_ngram_jaccard_join(spark, sf)) == brute(rows)


def test_forest_is_that_of_plain_search():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 400):
        a, b = rng.integers(0, n, (2, n // 2 + 1))
        root = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                root[x] = root[y] = min(root[x], root[y])
        assert pe.forest(n, a, b).tolist() == root


def test_sketches_let_every_link_pass():
    rng = np.random.default_rng(8)
    for n in (1, 2, 9, 40, 300, 3000):
        for num in (80, 90):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            off = len(a) * (100 - num) // 100
            for b in (a[off:], np.unique(np.concatenate([a, rng.integers(0, 1 << 63, len(a) * (100 - num) // num, dtype=np.uint64)]))):
                if len(b):
                    sketches = np.stack([pe.sketch(a), pe.sketch(b)]).view(np.uint64)
                    assert pe.may_link(np.array([len(a), len(b)]), sketches, np.array([0]), np.array([1]), num, 100).all()


def test_split_signatures_give_the_same_components(spark, monkeypatch):
    rows = corpus(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(pe, "SPLIT", 2)
    assert got(pe.jaccard_join(docs)) == brute(rows)


def test_sets_that_only_share_signatures_are_not_dealt_together(spark, monkeypatch):
    """Long texts along a chain, each with five sevenths of the words of the next: all tied by signatures, none linked."""
    rows = [(i, " ".join(f"w{j}" for j in range(i * 200, i * 200 + 700))) for i in range(24)]
    dealt, blocks_of = [], pe.blocks_of

    def counted(*args):
        out = blocks_of(*args)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(pe, "blocks_of", counted)
    monkeypatch.setattr(pe, "SPLIT", 4)
    found = pe.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=5, num=80, block=1).collect()
    assert len(found) == 24 and all(r.component_id == r.doc_id and r.n_links == 0 for r in found)
    assert 20 < dealt[0] <= 3 * len(rows) and dealt[1:] == [0]


def test_many_near_copies_under_one_anchor(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(700)]
    rows = [(i, " ".join(w if rng.random() > 0.002 * (i % 12) else f"x{rng.randrange(9)}" for w in base)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for split in (7, 4096):
        monkeypatch.setattr(pe, "SPLIT", split)
        assert got(pe.jaccard_join(docs, block=16)) == brute(rows)


def test_bitmaps_grow_with_their_keys():
    assert [pe.bits_for(n, 22) for n in (0, 1, 1 << 17, 1 << 18, 1 << 20, 1 << 40)] == [22, 22, 22, 23, 25, pe.MAX_BITS]
