"""The curve against its defining property, and shards against the law."""

import zlib

from tidebook.llm import hilbert as hb
from tidebook.llm.queries import op8_hilbert_sharding


def test_curve_visits_all_cells_by_single_steps(spark):
    for bits, axes in ((3, 3), (4, 2), (2, 4)):
        n = 1 << bits
        cells = spark.range(n**axes).selectExpr(*[f"cast(id div {n**i} % {n} as int) as a{i}" for i in range(axes)])
        names = [f"a{i}" for i in range(axes)]
        path = [tuple(r[a] for a in names) for r in hb.curve_index(cells, names, "at", bits).orderBy("at").collect()]
        at = sorted(r.at for r in hb.curve_index(cells, names, "at", bits).collect())
        assert at == list(range(n**axes))
        assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in zip(path, path[1:], strict=False))


def lawful(rows, texts, shards=8):
    assert len(rows) == len(texts)
    held = [sorted(r.slot for r in rows if r.shard == s) for s in range(shards)]
    assert all(h == list(range(len(h))) for h in held)
    sizes = [len(h) for h in held]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_edges(spark):
    rows = [(1, "a", "en", "s", "x"), (1, "a", "en", "s", "x"), (None, None, None, None, "y"), (2, "", "fr", "t", None), (3, "é" * 9000, "", "", "z")] + [(10 + i, "same", "en", "hot", "w") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string")
    out = hb.shard(docs, carry=docs.columns)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve", "text", "lang", "source"]
    lawful(out.collect(), [(r[0], r[1]) for r in rows])
    lawful(hb.shard(docs.limit(3)).collect(), [(r[0], r[1]) for r in rows[:3]])
    assert hb.shard(docs.limit(0)).count() == 0


def test_files_prune_in_every_dimension(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hb.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 8
    for column in ("lang", "source"):
        values = docs.select(column).distinct().count()
        spread = [r[0] for r in back.groupBy("shard").agg({column: "approx_count_distinct"}).select(f"approx_count_distinct({column})").collect()]
        assert sum(spread) / 8 < 0.75 * values


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    lawful(op8_hilbert_sharding(spark, sf).collect(), [(r.doc_id, r.text) for r in docs])


def test_texts_are_moved_by_the_sort_alone(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 3}") for i in range(20)], "doc_id long, text string, lang string, source string")
    plans, ranked = [], hb.ranked

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return ranked(df, *args)

    monkeypatch.setattr(hb, "ranked", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = hb.shard(docs, carry=docs.columns).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lawful(rows, [(i, f"text {i}") for i in range(20)])
    assert plans[0].count("BroadcastHashJoin") == 2 and "hashpartitioning" not in plans[0]
