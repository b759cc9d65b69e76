"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm import audit, clusters, htmltext, jaccard, language, lattice, licenses, mixing, packing, quality, sharding, tokenfiles, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("n_blocks")


def op3_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(_table(spark, sf_dir, "documents"))


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(language.learned_from(docs)))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return topk.top_k(table, table.where(F.col("vec_id") % 100 == 0))


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs, docs.select("doc_id", F.col("lang").alias("label")))


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(_table(spark, sf_dir, "embeddings"))


def op12_walsh_hadamard_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_host_consensus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


ORACLES = {
    "op9_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 10
""",
}


def queries() -> dict:
    import corpus_pipeline  # beside the package; the operators can be used without it

    return {
        "op1_lattice_near_dedup": op1_lattice_near_dedup,
        "op2_license_scan": op2_license_scan,
        "op3_simple8b": op3_simple8b,
        "op4_virtual_slots": op4_virtual_slots,
        "op5_importance_resampling": op5_importance_resampling,
        "op6_minhash_forest": op6_minhash_forest,
        "op7_best_fit": op7_best_fit,
        "op8_language_spans": op8_language_spans,
        "op9_exact_topk": op9_exact_topk,
        "op10_soft_mixing": op10_soft_mixing,
        "op11_dual_tree_lloyd": op11_dual_tree_lloyd,
        "op12_walsh_hadamard_audit": op12_walsh_hadamard_audit,
        "op13_host_consensus_html": op13_host_consensus_html,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    new = {"op11_dual_tree_lloyd": clusters.oracle(), "op12_walsh_hadamard_audit": audit.oracle()}
    return ORACLES | new | {"op1_lattice_near_dedup": lattice.oracle(), "op2_license_scan": licenses.oracle(), "op6_minhash_forest": jaccard.oracle()}
