"""Registered queries of the operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import blockmax, chat, crosstok, hilbert, mixing, partenum, pivots, quality, secrets, templates, toxicity, vptree
from tidebook.llm import token_counts as tokens
from tidebook.llm.common import crc_bucket
from tidebook.session import cut

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crf = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_bucket("doc_id", 4) != 2)
    scored = toxicity.with_spans(docs, crf)
    return scored.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


@query("op3_chat_role_repair")
def op3_chat_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


@query("op4_pfair_mixing")
def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op5_ngram_jaccard_join")
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_join(table(spark, sf_dir, "documents"))


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op7_benchmark_decontamination")
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_hilbert_sharding")
def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(table(spark, sf_dir, "documents"))


@query("op9_embedding_near_dedup")
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.fit(docs, table(spark, sf_dir, "labels"), crc_bucket("doc_id", 5) != 0)
    scored = quality.with_score(docs, net)
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op11_cross_tokenizer_alignment")
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    aligned = cut(crosstok.align(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model")), "aligned")
    out = crosstok.scored(aligned, crosstok.link_counts(aligned))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


@query(
    "op12_exact_top_k",
    f"""
    WITH v AS (
        SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
        FROM embeddings WHERE {FINITE}
    ), scored AS (
        SELECT q.nr, q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
        FROM v q JOIN v d ON q.nr <> d.nr WHERE q.vec_id % 100 = 0
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY nr ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM placed WHERE rank <= 10
    """,
)
def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockmax.top_k(table(spark, sf_dir, "embeddings"))


def clustering_sql(clusters: int = 16, rounds: int = 3) -> str:
    """Every round as all distances, the least by (distance, number), and floors of the means."""
    near = """
    d{r} AS MATERIALIZED (
        SELECT v.nr, c.cluster, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS distance FROM v JOIN c{r} c USING (pos) GROUP BY v.nr, c.cluster
    ), a{r} AS MATERIALIZED (
        SELECT nr, cluster, distance FROM (SELECT *, row_number() OVER (PARTITION BY nr ORDER BY distance, cluster) AS n FROM d{r}) WHERE n = 1
    )"""
    move = """
    m{r} AS MATERIALIZED (
        SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM a{r} JOIN v USING (nr) GROUP BY cluster, pos
    ), c{t} AS MATERIALIZED (
        SELECT c.cluster, c.pos, coalesce(CAST((m.s - ((m.s % m.n) + m.n) % m.n) / m.n AS BIGINT), c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster, pos)
    )"""
    steps = [near.format(r=r) + ("," + move.format(r=r, t=r + 1) if r < rounds else "") for r in range(rounds + 1)]
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings WHERE len(embedding) = 64 AND {FINITE}
    ), v AS MATERIALIZED (
        SELECT nr, unnest(range(1, 65)) AS pos, unnest(e) AS x FROM kept
    ), first AS MATERIALIZED (
        SELECT e, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), e) - 1 AS cluster FROM kept
    ), c0 AS MATERIALIZED (
        SELECT cluster, unnest(range(1, 65)) AS pos, unnest(e) AS x FROM first WHERE cluster < {clusters}
    ), {",".join(steps)},
    names AS (
        SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster
    )
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
           CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
           CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM a{rounds} JOIN kept USING (nr) JOIN names USING (cluster)
    """


@query("op13_centroid_clustering", clustering_sql())
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.report(table(spark, sf_dir, "embeddings"))
