"""Queries of the llm problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import lookalikes, matching, mixing, packing, personal, tokens, vectors
from fieldloom.runtime import table

K, FLOOR = 5, 0.88


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.top_k(table(spark, sf_dir, "field_vectors"), K, FLOOR)
    return near.select(F.least("id", "neighbour").alias("vec_id_a"), F.greatest("id", "neighbour").alias("vec_id_b")).distinct()


def p1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar of all vectors for every vector whose id is divisible by 100."""
    found = vectors.search(table(spark, sf_dir, "field_vectors"), F.col("id") % 100 == 0, K)
    return found.select(F.col("id").alias("vec_id"), "rank", F.col("neighbour").alias("neighbour_id"), F.round("cos", 4).alias("similarity"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.same_look_pairs(table(spark, sf_dir, "dictionary_fields"), "row_id", ["description", "question_text"])


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both texts of every row in their one form."""
    return lookalikes.spelled(table(spark, sf_dir, "dictionary_fields").select("row_id", "description", "question_text"), ["description", "question_text"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.clusters(table(spark, sf_dir, "field_vectors"), FLOOR, 5)


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pivot cluster with its size and the names of its three most typical members."""
    v = table(spark, sf_dir, "field_vectors")
    out = vectors.describe(v, vectors.pivot_clusters(v, FLOOR, 2), "variable_name")
    return out.withColumn("typical", F.array_join("typical", ", "))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match(table(spark, sf_dir, "field_references")).select(F.col("a").alias("ref_id_a"), F.col("b").alias("ref_id_b"))


def p6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches with their confidence."""
    return matching.match(table(spark, sf_dir, "field_references")).withColumnsRenamed({"a": "ref_id_a", "b": "ref_id_b"})


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r["container_kind"]: r["capacity_tokens"] for r in table(spark, sf_dir, "container_sizes").collect()}


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), _capacities(spark, sf_dir))
    return packed.withColumnsRenamed({"kind": "container_kind", "id": "doc_id", "n": "n_tokens"})


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _capacities(spark, sf_dir)
    return packing.report(packing.pack(table(spark, sf_dir, "documents"), sizes), sizes)


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokens.sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", "n", keep_text=False)
    return mixing.mix(docs, table(spark, sf_dir, "mix_targets"))


def p8_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).withColumnsRenamed({"id": "doc_id", "n": "n_tokens"})


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all tokens that each source reached in each mix."""
    return mixing.shares(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "pii_type", "start_at")


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders for personal data."""
    return personal.redact(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_topk, p3_found, p3_forms, p4_found, p4_clusters, p6_found, p6_matches, p7_packed, p7_report, p8_mixed, p8_shares, p9_found, p9_redacted)}


def oracle_sql() -> dict[str, str]:
    return {}
